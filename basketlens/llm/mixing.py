"""Soft-membership mixing to target weights (operator 9).

A classifier learnt from the labelled table gives every document a posterior
over the domains "good", "low" and "toxic". Projected gradient least squares
then fits a rate for each document, between 0 and ``max_rate``, such that the
expected tokens of each domain (sum of tokens * posterior * rate) meet the
target totals. Least squares are weighted by the inverse of the posteriors'
token-weighted second moments, so that domains of any size converge alike.

The fit is distributed: a step needs only the domains' totals, and a
document's rate is replayed from the few vectors of the steps so far, so no
state is kept per document and a lost executor costs a recomputation only.

The classifier counts, over all labelled documents, how many of each domain
hold a feature (hashed tokens, shape of the text). The features whose split
differs most from chance (chi-square) get weights by softmax regression on a
bounded sample of the labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm import tokens as T
from basketlens.llm.common import broadcast_if_small, cut, numpy_columns, text_key

DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.9, "low": 0.1, "toxic": 0.0}
FEATURES = 1 << 18
SHAPES = 64               # the last features: shape of a text
CHI_SQUARE = 30.0
MOST_FEATURES = 512       # features that get weights
SAMPLE_ROWS = 8192        # labelled rows that the weights are fitted on
MAX_BROADCAST_LABELS = 500_000


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) for each distinct feature of each row, sorted by row; and each row's number of words."""
    h, bounds = T.token_hashes(texts, T.SPACED)
    _, word_bounds = T.token_hashes(texts)
    n = np.diff(bounds)
    rows = np.repeat(np.arange(len(n)), n)
    cells = np.unique(rows * FEATURES + (h >> T.U64(40)).astype(np.int64) % (FEATURES - SHAPES))
    distinct = np.bincount(cells // FEATURES, minlength=len(n))
    raw, offsets = T.text_bytes(texts)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    shapes = [share(raw - np.uint8(65) < 26), share((raw > 32) & (raw < 48)), share(raw - np.uint8(48) < 10), distinct / np.maximum(n, 1)]
    bins = [np.minimum((x * 15.999).astype(np.int64), 15) + 16 * k for k, x in enumerate(shapes)]
    extra = np.concatenate([np.arange(len(n)) * FEATURES + FEATURES - SHAPES + b for b in bins])
    cells = np.sort(np.concatenate([cells, extra]))
    return cells // FEATURES, cells % FEATURES, np.diff(word_bounds)


def _pieces(batch: pa.RecordBatch, most: int = 4 << 20):
    """Slices of a batch with about ``most`` bytes of text, a row at least."""
    _, offsets = T.text_bytes(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _count(batches):
    total, classes = np.zeros(len(DOMAINS) * FEATURES, np.int64), np.zeros(len(DOMAINS), np.int64)
    for batch in batches:
        for part in _pieces(batch):
            domain = part.column("domain").to_numpy(zero_copy_only=False).astype(np.int64)
            rows, features, _ = _features(part.column("text"))
            np.add.at(total, domain[rows] * FEATURES + features, 1)
            classes += np.bincount(domain, minlength=len(DOMAINS))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - np.arange(len(DOMAINS))])), pa.array(np.concatenate([total[at], classes]))], names=["cell", "n"])


def _chosen(table: np.ndarray):
    """The chosen features of each row, as their places in ``table`` (sorted feature numbers)."""
    def pick(batches):
        for batch in batches:
            for part in _pieces(batch):
                rows, features, _ = _features(part.column("text"))
                at = np.minimum(np.searchsorted(table, features), len(table) - 1)
                hit = table[at] == features
                ends = np.zeros(part.num_rows + 1, np.int32)
                np.cumsum(np.bincount(rows[hit], minlength=part.num_rows), out=ends[1:])
                yield pa.RecordBatch.from_arrays([part.column("domain"), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))], names=["domain", "x"])
    return pick


def choose(counts: np.ndarray, classes: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` features whose split over the domains is furthest from chance (chi-square), if far enough; sorted."""
    total = max(classes.sum(), 1.0)
    held = counts.sum(0)
    expected = np.outer(classes / total, held)
    chi = ((counts - expected) ** 2 / np.maximum(expected, 1e-9)).sum(0) * np.minimum(total / np.maximum(total - held, 1e-9), 100.0)
    chi[held < 5] = 0.0
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] >= CHI_SQUARE])


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def regress(domain: np.ndarray, rows: np.ndarray, at: np.ndarray, width: int, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Softmax regression on 0/1 features, (row, feature) pairs; weights (domains x features + 1, the last the intercept), by Adam."""
    k, n = len(DOMAINS), max(len(domain), 1)
    w, first, second = (np.zeros((k, width + 1)) for _ in range(3))
    if not len(domain):
        return w
    target = np.eye(k)[domain]
    for t in range(1, steps + 1):
        score = np.stack([np.bincount(rows, weights=w[j][at], minlength=n) for j in range(k)], 1) + w[:, -1]
        g = (softmax(score) - target) / n
        grad = np.stack([np.append(np.bincount(at, weights=g[rows, j], minlength=width), g[:, j].sum()) for j in range(k)]) + ridge * np.hstack([w[:, :-1], np.zeros((k, 1))])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= 0.1 * (1 - t / (steps + 1)) * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-9)
    return w


def train(docs: DataFrame, labels: DataFrame, most_features: int = MOST_FEATURES, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) learnt from ``labels``. Features are chosen by counts over every labelled row of ``docs``; the
    weights are fitted on at most ``sample_rows`` labelled rows, the first in the order of a hash of doc_id, with one row (the smallest
    text_key) for an id that repeats.

    A label without quality or toxic counts for nothing; of several for one
    document the worst holds. Without labels all domains are alike.
    """
    domain = F.when(F.col("toxic") != 0, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = (labels.where("doc_id is not null and quality is not null and toxic is not null")
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(domain).cast("long").alias("domain")))
    known = cut(known)
    base = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    cells = (base.join(broadcast_if_small(known, MAX_BROADCAST_LABELS), "__id").select("text", "domain")
             .mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("cell < 0 or n >= 2"))
    cells = numpy_columns(cells)               # a fixed number of cells
    cell, n = cells["cell"], cells["n"].astype(np.float64)
    classes = np.zeros(len(DOMAINS))
    classes[-1 - cell[cell < 0]] = n[cell < 0]
    counts = np.zeros(len(DOMAINS) * FEATURES)
    counts[cell[cell >= 0]] = n[cell >= 0]
    table = choose(counts.reshape(len(DOMAINS), FEATURES), classes, most_features)
    if not len(table):
        return table, np.hstack([np.zeros((len(DOMAINS), 0)), np.log((classes + 0.5) / (classes.sum() + 0.5 * len(DOMAINS)))[:, None]])
    some = known.join(base.select("__id").distinct(), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    drawn = base.join(F.broadcast(cut(some)), "__id").groupBy("__id").agg(F.min_by("text", text_key(F.col("text"))).alias("text"), F.any_value("domain").alias("domain"))
    drawn = drawn.select("text", "domain").mapInArrow(_chosen(table), "domain long, x array<int>")
    drawn = numpy_columns(drawn.select("domain", F.size("x").alias("n"), "x"))      # sample_rows rows at most
    rows = np.repeat(np.arange(len(drawn["n"])), drawn["n"])
    return table, regress(drawn["domain"].astype(np.int64), rows, drawn["x"].astype(np.int64), len(table))


def _classifier(table: np.ndarray, weights: np.ndarray):
    def classify(batches):
        for batch in batches:
            for part in _pieces(batch):
                rows, features, n_words = _features(part.column("text"))
                if len(table):
                    at = np.minimum(np.searchsorted(table, features), len(table) - 1)
                    hit = table[at] == features
                    rows, at = rows[hit], at[hit]
                else:
                    rows, at = rows[:0], rows[:0]
                post = softmax(np.stack([np.bincount(rows, weights=w[at], minlength=part.num_rows) for w in weights[:, :-1]], 1) + weights[:, -1])
                ends = pa.array(np.arange(0, post.size + 1, len(weights), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(post.ravel()))],
                    names=["doc_id", "text_key", "n_tokens", "post"])
    return classify


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("n_tokens").to_numpy().astype(np.float64), batch.column("post").flatten().to_numpy().reshape(batch.num_rows, -1)


def replay(post: np.ndarray, steps: list[np.ndarray], max_rate: float) -> np.ndarray:
    """Rates after the given steps: each moves along the gradient and back into [0, max_rate]."""
    rate = np.full(len(post), min(1.0, max_rate))
    for step in steps:
        rate = np.clip(rate - post @ step, 0.0, max_rate)
    return rate


def _totals(memberships: DataFrame, steps: list[np.ndarray], max_rate: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain under the rates so far, and the second moments sum(tokens * post post')."""
    def partial(batches):
        total, moments = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            t, post = _matrix(batch)
            total += (t * replay(post, steps, max_rate)) @ post
            moments += (post * t[:, None]).T @ post
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([total, moments.ravel()]))], names=["cell", "x"])

    rows = memberships.select("n_tokens", "post").mapInArrow(partial, "cell long, x double").groupBy("cell").agg(F.sum("x")).collect()   # k + k * k rows
    out = np.zeros(k + k * k)
    for cell, x in rows:
        out[cell] = x
    return out[:k], out[k:].reshape(k, k)


def fit(memberships: DataFrame, targets: dict[str, float], total: float | None = None, max_rate: float = 1.0,
        steps: int = 25, tolerance: float = 1e-6) -> tuple[list[np.ndarray], dict]:
    """(steps, report): the gradient steps from which every document's rate is replayed; wanted, reached and natural
    tokens by domain. ``total`` defaults to the tokens at which the domain of the largest weight is kept whole. No domain
    is asked for more than its tokens at ``max_rate``: a scarce one falls short, and the others are not cut for it."""
    names = list(targets)
    k = len(names)
    weight = np.array([targets[x] for x in names], np.float64)
    if not len(weight) or (weight < 0).any() or weight.sum() <= 0:
        raise ValueError("target weights must be nonnegative and not all zero")
    weight = weight / weight.sum()
    done: list[np.ndarray] = []
    now, moments = _totals(memberships, done, max_rate, k)
    natural = now.copy()
    if total is None:
        total = float(natural[weight.argmax()] / weight.max())
    wanted = np.minimum(weight * total, natural * max(max_rate, 1.0))
    scale = np.linalg.pinv(moments + np.eye(k) * 1e-9 * max(np.trace(moments), 1e-12))
    best = (np.inf, done)
    for _ in range(steps):
        miss = now - wanted
        loss = float(miss @ scale @ miss)
        if loss < best[0] * (1 - 1e-9):
            best = (loss, list(done))
        if np.abs(miss).sum() <= tolerance * max(total, 1e-12):
            break
        done = [*done, scale @ miss]
        before, (now, _) = now, _totals(memberships, done, max_rate, k)
        if np.abs(now - before).sum() <= tolerance * max(total, 1e-12):
            break
    miss = now - wanted
    if float(miss @ scale @ miss) > best[0]:
        done = best[1]
        now, _ = _totals(memberships, done, max_rate, k)
    return done, {"wanted": dict(zip(names, wanted)), "reached": dict(zip(names, now)), "natural": dict(zip(names, natural))}


def memberships(docs: DataFrame, table: np.ndarray, weights: np.ndarray) -> DataFrame:
    """doc_id, text_key, n_tokens and post (the posteriors, in the order of DOMAINS) of each row of ``docs``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    return cut(base.mapInArrow(_classifier(table, weights), "doc_id long, text_key long, n_tokens long, post array<double>"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None,
        max_rate: float = 1.0, seed: int = 9) -> DataFrame:
    """doc_id, text_key, n_tokens, post, rate and copies for each row of ``docs(doc_id, text)``.

    copies is the rate rounded up or down by a seeded hash of the row, so that
    its expectation is the rate; a rate of 0 gives none. Null and empty texts
    have no tokens and the prior's posteriors. Rows that repeat are decided
    alike. An empty table stays empty. Where the labels tell no domains apart
    (or there are none) and no ``total`` is given, every row is kept.
    """
    targets = TARGETS if targets is None else targets
    if set(targets) != set(DOMAINS):
        raise ValueError(f"targets must name {DOMAINS}")
    targets = {x: targets[x] for x in DOMAINS}
    features, weights = train(docs, labels)
    rows = memberships(docs, features, weights)
    steps = fit(rows, targets, total, max_rate)[0] if len(features) or total is not None else []

    def rated(batches):
        for batch in batches:
            _, post = _matrix(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replay(post, steps, max_rate))], names=[*batch.schema.names, "rate"])

    out = rows.mapInArrow(rated, "doc_id long, text_key long, n_tokens long, post array<double>, rate double")
    chance = F.pmod(F.xxhash64(F.lit(seed).cast("long"), "doc_id", "text_key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    low = F.floor("rate")
    return out.withColumn("copies", (low + (chance < F.col("rate") - low).cast("int")).cast("int"))


def sample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as its copies say; all columns."""
    marks = mix(docs, labels, **options).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("copies").alias("__n")).where("__n > 0").distinct()
    keyed = docs.withColumn("__text_key", text_key(F.col("text")))
    kept = keyed.join(marks, keyed["doc_id"].cast("long").eqNullSafe(marks["__id"]) & (keyed["__text_key"] == marks["__key"]))
    return kept.withColumn("__i", F.explode(F.sequence(F.lit(1), "__n"))).drop("__i", "__id", "__key", "__n", "__text_key")
