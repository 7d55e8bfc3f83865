"""Log-bilinear language model scores (operator 4).

Tokens are runs of characters other than white space, A-Z lower-cased, and one
end per text. Each token belongs to one of ``STATES`` states: the end, the
most frequent tokens, or, for the others, a class by the last two bytes. The
model gives P(token | previous state) = P(state | previous state) *
P(token | state); the second factor is 1 for states of one token, and the
smoothed share of the token in its class otherwise, so the probabilities of
all tokens, unseen ones included, add up to 1.

P(state | previous) = softmax(c[previous] . t[state] + b[state]): a log-bilinear
model, trained in numpy with noise-contrastive estimation. Its data are the
counts of all pairs of states in all training texts, added up by Spark: as
many numbers as there are pairs of states, whatever the corpus. Batched matrix
products then give the table of normalised log-probabilities.

Token counts are grouped in Spark over the whole vocabulary. The most frequent
tokens' counts (``HEAD`` at most) go with the scoring tasks; a document's other
tokens are shuffled as 64-bit hashes to meet theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm import tokens as T
from basketlens.llm.common import cut, numpy_columns

CLASSES = 64             # classes of the less frequent tokens
STATES = 1024            # all states: end, classes, single tokens
SINGLE = STATES - CLASSES - 1
HEAD = 1 << 18           # token counts that go with the tasks: 16 bytes each
SMOOTH = 0.1
END = np.uint64(0)       # hash of the end token
SLICE_BYTES = 4 << 20


def token_stream(texts: pa.Array):
    """(hash, class, bounds): tokens of each row, an end behind each row's last."""
    h, bounds, last = T.token_hashes(texts, T.SPACED, last_bytes=True)
    h[h == END] = T.U64(1)
    cls = ((last * 2654435761) >> 8) % CLASSES
    n = len(bounds) - 1
    at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(bounds))
    out, kind = np.full(len(h) + n, END, np.uint64), np.full(len(h) + n, -1, np.int64)
    out[at], kind[at] = h, cls
    return out, kind, bounds + np.arange(n + 1)


def slices(batch: pa.RecordBatch):
    """Slices of a batch of about SLICE_BYTES of text, a row at least."""
    _, offsets = T.text_bytes(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _count(batches):
    """Token counts, combined over some batches at a time so that a task's memory is bounded."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        h, c, n = (np.concatenate(x) for x in zip(*held))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        return u, c[first], np.bincount(back, weights=n).astype(np.int64)

    def rows(u, c, n):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], names=["h", "cls", "n"])

    for batch in batches:
        for part in slices(batch):
            h, c, _ = token_stream(part.column("text"))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, c[first], n))
            if sum(len(x[0]) for x in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield rows(*held[0])
                    held = []
    if held:
        yield rows(*merged())


class States:
    """State of each token: 0 the end, 1 to CLASSES the classes, then the single tokens."""

    def __init__(self, single: np.ndarray):
        self.single = np.sort(single.astype(np.uint64))

    def of(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        state = cls + 1
        if len(self.single):
            at = np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)
            state = np.where(self.single[at] == h, at + CLASSES + 1, state)
        state[h == END] = 0
        return state


def _pairs(states: States):
    def count(batches):
        total = np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            for part in slices(batch):
                h, cls, bounds = token_stream(part.column("text"))
                s = states.of(h, cls)
                before = np.zeros(len(s), np.int64)        # a text begins behind an end
                before[1:] = s[:-1]
                before[bounds[:-1]] = 0
                total += np.bincount(before * STATES + s, minlength=STATES * STATES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])
    return count


def train_nce(pairs: np.ndarray, dims: int = 24, noise: int = 10, epochs: int = 60, rate: float = 0.08, seed: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, t, b) of the log-bilinear model from the matrix of pair counts (previous x next), by noise-contrastive estimation.

    The noise draws from the next states' smoothed shares q. For a pair seen n
    times after a state seen m times, data against ``noise`` draws a sample has
    the objective n log sigmoid(s - log(noise q)) + m noise q log sigmoid(log(noise q) - s),
    the expectation over the noise taken in full. Adagrad over batches of previous states.
    """
    size = len(pairs)
    rng = np.random.default_rng(seed)
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * size)
    c, t = rng.normal(0, 0.1, (size, dims)).astype(np.float32), rng.normal(0, 0.1, (size, dims)).astype(np.float32)
    b = np.log(share).astype(np.float32)
    log_noise = np.log(noise * share).astype(np.float32)
    used = np.flatnonzero(pairs.sum(1))
    weight = pairs.sum(1)
    squares = [np.full_like(x, 1e-3) for x in (c, t, b)]
    for epoch in range(epochs):
        rng.shuffle(used)
        step = rate * (1 - epoch / epochs) + 1e-3
        for batch in np.array_split(used, max(1, len(used) // 128)):
            # each previous state counts by the square root of its frequency, so that rare ones are learnt too
            seen = (pairs[batch] / np.sqrt(weight[batch])[:, None]).astype(np.float32)
            draws = np.sqrt(weight[batch]).astype(np.float32)[:, None] * (noise * share).astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(c[batch] @ t.T + b - log_noise, -30, 30)))
            g = seen * (1 - p) - draws * p
            g /= np.sqrt(weight[batch]).astype(np.float32)[:, None]
            for x, grad, sq, rows in ((c, g @ t, squares[0], batch), (t, g.T @ c[batch], squares[1], slice(None)), (b, g.sum(0), squares[2], slice(None))):
                sq[rows] += grad * grad
                x[rows] += step * grad / np.sqrt(sq[rows])
    return c, t, b


def log_table(c: np.ndarray, t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each state (column) after each state (row)."""
    score = c.astype(np.float64) @ t.T.astype(np.float64) + b
    score -= score.max(1, keepdims=True)
    return (score - np.log(np.exp(score).sum(1, keepdims=True))) / np.log(10)


def _scorer(states: States, table: np.ndarray, known: np.ndarray, counts: np.ndarray, base: np.ndarray, inner: np.ndarray):
    """known, counts, base, inner: hash (sorted), count, base and in-state log10 probability of the most frequent tokens."""
    flat = table.astype(np.float64).ravel()

    def score(batches):
        for batch in batches:
            for part in slices(batch):
                h, cls, bounds = token_stream(part.column("text"))
                n = part.num_rows
                s = states.of(h, cls)
                before = np.zeros(len(s), np.int64)
                before[1:] = s[:-1]
                before[bounds[:-1]] = 0
                row = np.repeat(np.arange(n), np.diff(bounds))
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                model = np.bincount(row, weights=flat[before * STATES + s], minlength=n)
                model += np.bincount(row[hit], weights=inner[at[hit]], minlength=n)
                plain = np.bincount(row[hit], weights=base[at[hit]], minlength=n)
                n_known = np.bincount(row[hit], minlength=n)
                # the others, to be looked up by a join
                key = np.flatnonzero(~hit)
                ends = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(row[key], minlength=n), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(bounds)), pa.array(n_known.astype(np.int64)), pa.array(plain.astype(np.float64)), pa.array(model.astype(np.float64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(h[key].view(np.int64))), pa.ListArray.from_arrays(pa.array(ends), pa.array((s[key] - 1).astype(np.int32)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare", "cls"])
    return score


def score_texts(docs: DataFrame, dims: int = 24, seed: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs(doc_id, text)``.

    held_out: crc32 of doc_id as text is divisible by 10; the other rows train
    (a null id's text is empty). n_known: tokens seen in training. base_score:
    sum over the tokens of log10((c + 0.1) / (N + 0.1 (V + 1))) with c the
    token's training count, N their sum (train_tokens) and V their number.
    score: log10 probability of the text under the model.

    A null text is empty: one token, the end. Rows that repeat are rows of
    their own. Without training rows c, N and V are 0 and the model is
    uniform over states. An empty table gives an empty result. Other columns
    are not read.
    """
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10) == 0
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = cut(train.mapInArrow(_count, "h long, cls int, n long").groupBy("h").agg(F.sum("n").alias("n"), F.min("cls").alias("cls")))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the tokens above a frequency that at most HEAD tokens reach, from a histogram of frequencies
    level = F.floor(F.log2("n") * 16).cast("int")
    histogram = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)         # 64 * 16 rows at most
    least, held = 1 << 20, 0
    for x, n in histogram:
        held += n
        if held > HEAD:
            break
        least = x
    head = numpy_columns(counts.where(level >= least).select("h", "n", "cls"))
    frequent = np.lexsort((head["h"], -head["n"]))
    frequent = frequent[head["h"][frequent] != int(END)]
    single = head["h"][frequent[:SINGLE]].view(np.uint64)
    states = States(single)

    in_class = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in single.view(np.int64)] or [(0,)], "h long")), "h", "left_anti").where(f"h != {int(END)}")
    per_class = in_class.groupBy("cls").agg(F.sum("n"), F.count(F.lit(1))).collect()                 # CLASSES rows
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for cls, n, v in per_class:
        class_n[cls], class_v[cls] = n, v
    cells = train.mapInArrow(_pairs(states), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = numpy_columns(cells)                                              # STATES * STATES rows at most
    pairs = np.zeros(STATES * STATES)
    pairs[cells["cell"]] = cells["n"]
    table = log_table(*train_nce(pairs.reshape(STATES, STATES), dims=dims, seed=seed))

    total = n_all + SMOOTH * (v_all + 1)
    class_total = class_n + SMOOTH * (class_v + 1)
    order = np.argsort(head["h"].view(np.uint64), kind="stable")
    known, n = head["h"].view(np.uint64)[order], head["n"].astype(np.float64)[order]
    cls = head["cls"].astype(np.int64)[order]
    one = np.isin(known, states.single) | (known == END)
    inner = np.where(one, 0.0, np.log10((n + SMOOTH) / class_total[np.maximum(cls, 0)]))
    scored = cut(rows.mapInArrow(_scorer(states, table, known, n, np.log10((n + SMOOTH) / total), inner),
                                 "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>, cls array<int>"))

    rare = scored.select("row", F.explode(F.arrays_zip(F.col("rare").alias("h"), F.col("cls").alias("cls"))).alias("x")).select("row", "x.h", "x.cls").groupBy("row", "h", "cls").agg(F.count(F.lit(1)).alias("k"))
    found = rare.join(counts.where(level < least).select("h", "n"), "h", "left")
    by_class = F.array(*[F.lit(float(x)) for x in class_total])
    c = F.coalesce(F.col("n"), F.lit(0))
    tail = found.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"),
        F.sum(F.col("k") * F.log10((c + SMOOTH) / F.lit(float(total)))).alias("base2"),
        F.sum(F.col("k") * F.when(F.col("cls") < 0, F.lit(0.0)).otherwise(F.log10((c + SMOOTH) / by_class[F.greatest("cls", F.lit(0))]))).alias("model2"))
    zero = F.lit(0.0)
    return scored.drop("rare", "cls").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), (F.col("model") + F.coalesce("model2", zero)).alias("score"))
