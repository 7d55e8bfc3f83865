"""Cross-tokenizer alignment (operator 11): pointer jumping over overlapping tokens.

A text is cut into tokens by two tokenizers, A (byte-level BPE) and B (pieces
with byte fallback), whose tokens cover the same bytes. Every token points to
its farthest-right overlapping token: the token of the other side that holds
its last byte, or itself if it is an A token and that one ends with it.
Pointers never lead left, so they end in the A token at the next offset where
both sides end. Doubling all pointers at once (p = p[p]) reaches these
terminals in as many rounds as the logarithm of the longest chain, for all
texts of a batch together; the terminal labels the group.

Links are all pairs (A token, B token) of a group. Documents are aligned once
and stored with their distinct pairs; Spark counts in how many documents a
pair occurs. The counts of the most frequent pairs (``HEAD`` at most) travel
with the tasks, as numpy arrays; all other pairs meet theirs in a join.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import cut, numpy_columns, stored

#: Folder of the public tokenizers' files; functions take any other.
TOKENIZERS = "/opt/tokenizers"
SLICE = 1 << 19          # characters beyond which a text is cut at blanks, where neither tokenizer looks across
BATCH = 1 << 20          # bytes of texts that are aligned together
LARGE = 1 << 10          # links of a group beyond which its links are counted by id, not listed
ROWS = 512               # texts whose results are handed on together
HEAD = 1 << 20           # pairs whose counts go with the tasks


#: Fixed value: how byte-level BPE files of this kind cut a text into words before any merge.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 and on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + k): b for k, b in enumerate(others)}}


class Tokenizers:
    """Both tokenizers from their files' contents, with the bytes of every token."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"        # one core a task
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        described = json.loads(a_json)
        vocabulary = described["model"]["vocab"]
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        a_bytes, b_bytes = [b""] * self.n_a, []
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_bytes, self.b_bytes = Flat(a_bytes), Flat(b_bytes)
        self.ranked = self._ranked(described, alphabet)
        self.a_text, self.b_text = (Flat([b"%d" % i for i in range(n)]) for n in (self.n_a, self.n_b))

    @staticmethod
    def _ranked(described: dict, alphabet: dict[str, int]):
        """The same vocabulary as merge ranks for ``tiktoken``, which gives the same ids in a third of the time; None for a
        file of another kind: plain byte-level words, no normalisation, and ids in the order of the merges are needed."""
        form, model = described.get("pre_tokenizer") or {}, described["model"]
        if described.get("normalizer") or form.get("type") != "ByteLevel" or form.get("add_prefix_space") or not form.get("use_regex", True) or model["type"] != "BPE":
            return None
        special = {x["content"] for x in described.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(ranks) != 256 + len(merged):
            return None
        import tiktoken
        return tiktoken.Encoding("a", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranked is not None:
            return [self.ranked.encode_to_numpy(x).astype(np.int64) for x in texts]
        return [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]


class Flat:
    """Byte strings by number, so that many of them join without a Python object each."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        if not len(size):
            return np.zeros(0, np.uint8)
        return self.raw[np.arange(ends[-1]) + np.repeat(self.begin[numbers] - ends + size, size)]


def pieces(text: str, size: int) -> list[str]:
    """``text`` with a blank before it, cut before single blanks between other characters, each piece without its blank.

    No token of A crosses such a place (a word takes one blank before it), nor does one of B (its pieces hold blanks at
    their beginning only), so the pieces' tokens are the text's.
    """
    out, a = [], 0
    while len(text) - a > size:
        b = a + size
        while True:
            b = text.find(" ", b)
            if b < 0 or b + 1 >= len(text):
                b = -1
                break
            if not text[b - 1].isspace() and not text[b + 1].isspace():
                break
            b += 1
        if b < 0:
            break
        out.append(text[a:b])
        a = b + 1
    return [*out, text[a:]]


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Number of the terminal A token of every token (A's first, then B's) by pointer jumping; both sides' tokens have
    ascending ends and cover the same bytes."""
    to_b, to_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    n = len(end_a)
    here = end_b[to_b] == end_a
    pointer = np.concatenate([np.where(here, np.arange(n), to_b + n), to_a])
    while True:
        far = pointer[pointer]
        if np.array_equal(far, pointer):
            return pointer
        pointer = far


def crossed(group: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every token of ``group`` (the group of each) with every one of the ``count`` others of its group, which begin at ``first``."""
    times = count[group]
    ends = np.cumsum(times)
    left = np.repeat(np.arange(len(group)), times)
    return left, np.arange(len(left)) - np.repeat(ends - times, times) + np.repeat(first[group], times)


class Aligned:
    """Groups and links of texts that are aligned together. ``a`` and ``b`` hold the ids of all texts' tokens, in order;
    doc_a and doc_b the text of each token."""

    def __init__(self, t: Tokenizers, a, b, doc_a, doc_b, texts: int):
        self.a, self.b = a, b
        end_a, end_b = np.cumsum(t.a_bytes.size[a]), np.cumsum(t.b_bytes.size[b])
        label = terminals(end_a, end_b)
        closes = np.zeros(len(a), np.int64)
        closes[label[: len(a)]] = 1
        number = np.cumsum(closes) - 1
        self.group_a, self.group_b = number[label[: len(a)]], number[label[len(a):]]
        groups = int(closes.sum())
        self.n_a, self.n_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) for n in (self.n_a, self.n_b))
        self.doc = doc_a[self.first_a]
        self.texts, self.wide = texts, t

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of the distinct linked id pairs of each text; pair = A id * number of B ids + B id."""
        t, small = self.wide, self.n_a * self.n_b <= LARGE
        space = t.n_a * t.n_b
        keys = self.doc[self.group_a] * space + self.a * t.n_b           # an A token's part of the key
        use = small[self.group_a]
        rows = np.flatnonzero(use)
        left, right = crossed(self.group_a[rows], self.first_b, self.n_b)
        key, times = np.unique(keys[rows][left] + self.b[right], return_counts=True)
        found, counts = [key], [times.astype(np.int64)]
        for g in np.flatnonzero(~small):
            a, many_a = np.unique(self.a[self.first_a[g]: self.first_a[g] + self.n_a[g]], return_counts=True)
            b, many_b = np.unique(self.b[self.first_b[g]: self.first_b[g] + self.n_b[g]], return_counts=True)
            found.append((self.doc[g] * space + a[:, None] * t.n_b + b).ravel())
            counts.append((many_a[:, None] * many_b).ravel())
        if len(found) > 1:
            key, back = np.unique(np.concatenate(found), return_inverse=True)
            times = np.zeros(len(key), np.int64)
            np.add.at(times, back, np.concatenate(counts))
        return key // space, key % space, times.astype(np.int64)

    def texts_of_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds): text i's groups are written in bytes[bounds[i]:bounds[i + 1]] as a1,a2|b1;a3|b2,b3."""
        t, n, m = self.wide, len(self.a), len(self.b)
        into_a = np.arange(n) + self.first_b[self.group_a]                # place of each token among all of them
        into_b = np.arange(m) + (self.first_a + self.n_a)[self.group_b]
        size, start = np.zeros(n + m, np.int64), np.zeros(n + m, np.int64)
        mark, doc = np.zeros(n + m, np.uint8), np.zeros(n + m, np.int64)
        size[into_a], size[into_b] = t.a_text.size[self.a], t.b_text.size[self.b]
        start[into_a], start[into_b] = t.a_text.begin[self.a], t.b_text.begin[self.b] + len(t.a_text.raw)
        mark[into_a] = mark[into_b] = ord(",")
        last_b = into_b[self.first_b + self.n_b - 1]
        mark[into_a[self.first_a + self.n_a - 1]] = ord("|")
        mark[last_b] = ord(";")
        doc[into_a], doc[into_b] = self.doc[self.group_a], self.doc[self.group_b]
        size += 1
        ends = np.cumsum(size)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
        digits = np.concatenate([t.a_text.raw, t.b_text.raw, np.zeros(1, np.uint8)])
        out = digits[np.minimum(source, len(digits) - 1)]
        out[ends - 1] = mark
        upto = np.searchsorted(doc, np.arange(self.texts + 1))            # tokens before each text
        return out, np.concatenate([[0], ends])[upto]


class Document:
    """Totals of one text whose pieces come one after another."""

    def __init__(self):
        self.n_a = self.n_b = self.groups = 0
        self.hash, self.begun, self.fits = hashlib.sha256(), False, True
        self.pair, self.times = [], []

    def add(self, n_a, n_b, groups, written: bytes, pair, times) -> None:
        self.n_a, self.n_b, self.groups = self.n_a + n_a, self.n_b + n_b, self.groups + groups
        if self.begun:
            self.hash.update(b";")
        self.hash.update(written[:-1])                                    # without the last semicolon
        self.begun = True
        self.pair.append(pair)
        self.times.append(times)

    def row(self):
        if not self.fits or not self.begun:
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, times = self.pair[0], self.times[0]
        if len(self.pair) > 1:
            pair, back = np.unique(np.concatenate(self.pair), return_inverse=True)
            times = np.zeros(len(pair), np.int64)
            np.add.at(times, back, np.concatenate(self.times))
        return self.n_a, self.n_b, self.groups, self.hash.hexdigest(), pair, times


def _fit(t: Tokenizers, raw: bytes, ids: np.ndarray, flat: Flat) -> bool:
    return int(flat.size[ids].sum()) == len(raw) and flat.join(ids).tobytes() == raw


def align_pieces(t: Tokenizers, texts: list[str]) -> list[tuple | None]:
    """(n_a, n_b, groups, written groups, pairs, times) of each piece, None if its tokens' bytes are not blank + text."""
    a_ids = t.a_ids([" " + x for x in texts])
    b_ids = [np.array(x, np.int64) for x in t.b.encode(texts, num_threads=1)]
    good = [i for i, x in enumerate(texts) for raw in [(" " + x).encode()] if _fit(t, raw, a_ids[i], t.a_bytes) and _fit(t, raw, b_ids[i], t.b_bytes)]
    out: list[tuple | None] = [None] * len(texts)
    if not good:
        return out
    a, b = ([ids[i] for i in good] for ids in (a_ids, b_ids))
    doc_a, doc_b = (np.repeat(np.arange(len(good)), [len(x) for x in ids]) for ids in (a, b))
    both = Aligned(t, np.concatenate(a), np.concatenate(b), doc_a, doc_b, len(good))
    doc, pair, times = both.links()
    at = np.searchsorted(doc, np.arange(len(good) + 1))
    written, bounds = both.texts_of_groups()
    groups = np.bincount(both.doc, minlength=len(good))
    for k, i in enumerate(good):
        out[i] = (len(a[k]), len(b[k]), int(groups[k]), written[bounds[k]: bounds[k + 1]].tobytes(), pair[at[k]: at[k + 1]], times[at[k]: at[k + 1]])
    return out


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


def _aligner(a_json: bytes, b_model: bytes):
    def align(batches):
        t = Tokenizers(a_json, b_model)
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            held, size = [], 0                                             # (document, piece)
            texts = batch.column("text").to_pylist()
            documents = [Document() for _ in texts]

            def settle():
                for (d, _), found in zip(held, align_pieces(t, [x for _, x in held])):
                    if found is None:
                        d.fits = False
                    elif d.fits:
                        d.add(*found)
                held.clear()

            for d, text in zip(documents, texts):
                for piece in pieces(text, SLICE) if text else []:
                    held.append((d, piece))
                    size += len(piece)
                    if size > BATCH:
                        settle()
                        size = 0
            if held:
                settle()
            rows = [d.row() for d in documents]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64))) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)],
                                              pa.array([r[3] for r in rows], pa.string()), *lists], names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])
    return align


def _lookup(pair: np.ndarray, docs: np.ndarray, best: np.ndarray):
    """Sums over the links whose pair is in ``pair`` (sorted); the other pairs and their times go on."""
    def look(batches):
        for batch in batches:
            lists = batch.column("pairs")
            sizes = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            key, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
            hit = pair[at] == key if len(pair) else np.zeros(len(key), bool)

            def total(values, rows):
                out = np.zeros(batch.num_rows, np.int64)
                np.add.at(out, rows, values)
                return pa.array(out)

            h = at[hit]
            rest = np.flatnonzero(~hit)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=batch.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")], total(times, row), total(times[hit] * best[h], row[hit]), total(times[hit] * docs[h], row[hit]),
                 pa.ListArray.from_arrays(ends, pa.array(key[rest])), pa.ListArray.from_arrays(ends, pa.array(times[rest]))],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum", "rest", "times"])
    return look


def read_files(a_file: str | None = None, b_file: str | None = None) -> tuple[bytes, bytes]:
    """Contents of both tokenizers' files, which go with the tasks; executors need no copy of them."""
    out = []
    for path in (a_file or f"{TOKENIZERS}/byte_bpe_50k.json", b_file or f"{TOKENIZERS}/piece_bpe_32k.model"):
        with open(path, "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(aligned, counts, B's number of ids) of ``docs(doc_id, text)``.

    aligned: a row per row of docs with its numbers of tokens and groups, the
    digest of its groups, its distinct linked id pairs (A id * B's number of
    ids + B id) and how often each occurs. counts: pair, docs (documents that
    hold it), best (whether docs is the largest count of its A id).
    """
    a_json, b_model = read_files(a_file, b_file)
    n_b = Tokenizers(a_json, b_model).n_b
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = stored(rows.mapInArrow(_aligner(a_json, b_model), ALIGNED))
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = cut(counts.withColumn("a", F.expr(f"pair div {n_b}")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))            # a row per A id: bounded by A's vocabulary
    return aligned, cut(counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))), n_b


def align_counts(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row per row of ``docs(doc_id, text)``.

    n_links: pairs of an A and a B token of one group. n_best: links whose id
    pair occurs in as many documents as any pair of its A id. count_sum: the
    sum over links of the documents that hold their pair. Null and empty
    texts, and texts that either tokenizer does not give back byte by byte
    (after one blank), have no tokens: zeros and ''. Rows that repeat are
    documents of their own; doc_id may be null. Texts are read whole, long ones
    in pieces cut where no token can cross. An empty table gives an empty
    result. Other columns are not read. ``head``: pairs whose counts are held
    by tasks; the result does not depend on it.
    """
    aligned, counts, _ = align(docs, a_file, b_file)
    level = F.floor(F.log2("docs") * 16).cast("int")
    least, held = 1 << 20, 0
    for x, n in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):       # 64 * 16 rows at most
        held += n
        if held > head:
            break
        least = x
    frequent = numpy_columns(counts.where(level >= least).select("pair", "docs", F.col("best").cast("long").alias("best")))      # ``head`` rows at most
    order = np.argsort(frequent["pair"])
    looked = aligned.mapInArrow(_lookup(*(frequent[c][order] for c in ("pair", "docs", "best"))),
                                "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, rest array<long>, times array<long>")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rare = counts.where(level < least).select("pair", "docs", "best")
    if not rare.limit(1).count():                                          # every pair was at hand
        return looked.select(*out)
    looked = stored(looked)
    links = looked.select("row", F.explode(F.arrays_zip(F.col("rest").alias("pair"), F.col("times").alias("times"))).alias("x")).select("row", "x.pair", "x.times")
    tail = links.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.col("docs")).alias("sum"))
    whole = looked.join(tail, "row", "left")
    for name, more in (("n_best", "more"), ("count_sum", "sum")):
        whole = whole.withColumn(name, F.col(name) + F.coalesce(F.col(more), F.lit(0)))
    return whole.select(*out)
