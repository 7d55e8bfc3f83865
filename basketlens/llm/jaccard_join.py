"""N-gram Jaccard join (operator 8): MinHash banding, then verification on full n-gram sets.

1. One pass over the texts gives each document the 128-bit hash of its word
   sequence (its copy class) and its MinHash band keys. Bands and rows follow
   from the wanted recall at the threshold (``band_plan``).
2. Copy classes are collapsed by a grouped aggregate, so only one member of a
   class goes on. Band keys are shuffled as 64-bit numbers; buckets of one
   class vanish, the others link their members to the bucket's smallest one.
3. Candidate components are verified exactly: members are put into blocks by
   set size (sizes further apart than the threshold never meet) and pairs of
   blocks are counted with a matrix product per task. Tasks return a row per
   member - its links and a local representative - never a row per pair.

Words: A-Z lower-cased, runs of digits, letters and non-ASCII characters.
N-grams: runs of ``n`` words; a text of fewer words has one n-gram, all of
them. Texts without words (null and empty ones included) link to nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm import tokens as T
from basketlens.llm.common import cut, text_key
from basketlens.llm.components import components

BLOCK = 256          # members of a block: a task compares at most 2 * BLOCK sets


def band_plan(threshold: float, recall: float, max_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows) with the most rows a band such that a pair at ``threshold`` meets with probability ``recall``.

    At threshold 1 one band is certain, whatever its rows. ValueError: a
    threshold outside (0, 1], a recall outside [0, 1) below threshold 1 (no
    number of bands is certain there), or one that ``max_hashes`` can't give.
    """
    if not 0 < threshold <= 1 or not 0 <= recall <= 1:
        raise ValueError(f"no threshold in (0, 1] with a recall in [0, 1]: {threshold}, {recall}")
    if threshold == 1:
        return 1, min(max_hashes, 8)
    if recall == 1:
        raise ValueError("MinHash bands reach every recall below 1, not 1")
    best = None
    for rows in range(1, max_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"recall {recall} at threshold {threshold} takes more than {max_hashes} hashes")
    return best


def _per_document(values: np.ndarray, bounds: np.ndarray, ufunc) -> tuple[np.ndarray, np.ndarray]:
    """ufunc over each document's values; documents without any are left out. Returns (documents, results)."""
    has = np.flatnonzero(np.diff(bounds) > 0)
    return has, ufunc.reduceat(values, bounds[has]) if len(has) else np.zeros(0, values.dtype)


def copy_hash(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128-bit hash of each document's word sequence, None without words."""
    rel = np.arange(len(h), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
    out: list[bytes | None] = [None] * (len(bounds) - 1)
    has, one = _per_document(T.mix(h + T.mix(rel + T.U64(1))), bounds, np.add)
    _, two = _per_document(T.mix((h ^ T.U64(0xD6E8FEB86659FD93)) + T.mix(rel + T.U64(0x5851F42D))), bounds, np.add)
    raw = np.stack([one, two], 1).tobytes() if len(has) else b""
    for k, i in enumerate(has):
        out[i] = raw[16 * k: 16 * k + 16]
    return out


def _signer(n: int, bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    flips = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    odds = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * T.U64(2) + T.U64(1)

    def sign(batches):
        for batch in batches:
            h, bounds = T.token_hashes(batch.column("text"))
            node = copy_hash(h, bounds)
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            grams, gb = T.shingle_hashes(h, bounds, n)
            sizes = np.diff(gb)
            for a, b in _runs(sizes, 1 << 16):       # a few documents at a time, so that their n-grams stay in cache
                part, pb = grams[gb[a]: gb[b]], gb[a: b + 1] - gb[a]
                if not len(part):
                    continue
                for band in range(bands):
                    key = None
                    for j in range(band * rows, (band + 1) * rows):
                        has, low = _per_document((part ^ flips[j]) * odds[j], pb, np.minimum)
                        key = low if key is None else T.mix(key + low)
                    keys[a + has, band] = T.mix(key + T.U64(band + 1))
            values = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(node) + 1) * bands, bands, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(node, pa.binary()), lists],
                names=["doc_id", "text_key", "node", "bands"])

    return sign


def _runs(sizes: np.ndarray, most: int):
    """Ranges of rows of about ``most`` values together, one row at least."""
    a, total = 0, 0
    for b, size in enumerate(sizes):
        if b > a and total + size > most:
            yield a, b
            a, total = b, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def _shingler(n: int):
    def sets(batches):
        for batch in batches:
            h, bounds = T.token_hashes(batch.column("text"))
            node = copy_hash(h, bounds)
            grams, gb = T.shingle_hashes(h, bounds, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.binary()), pa.array([np.unique(grams[gb[i]: gb[i + 1]]).view(np.int64) for i in range(len(node))],
                                                       pa.list_(pa.int64()))], names=["node", "grams"])
    return sets


def verify(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of left and right sets (of left with itself if right is None) >= threshold."""
    sets = left if right is None else left + right
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    gram = np.cumsum(new) - 1
    shared = np.bincount(gram) > 1 if len(flat) else np.zeros(0, bool)
    column = np.cumsum(shared) - 1
    keep = shared[gram] if len(flat) else np.zeros(0, bool)
    gram, owner = column[gram[keep]] if len(flat) else gram, owner[keep]
    width, step = int(shared.sum()), 8192
    split = len(left)
    both = np.zeros((split, len(sets) if right is None else len(right)), np.float64)
    cuts = np.searchsorted(gram, np.arange(0, width + step, step))
    for k in range(len(cuts) - 1):                     # n-grams in slices: a slice's 0/1 matrix is small
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        m = np.zeros((len(sets), step), np.float32)
        m[owner[a:b], gram[a:b] - k * step] = 1
        both += m[:split] @ (m if right is None else m[split:]).T
    n_left, n_right = sizes[:split], sizes if right is None else sizes[split:]
    union = n_left[:, None] + n_right[None, :] - both
    return both >= threshold * union - 1e-9


def _links(threshold: float):
    def block_pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one = (key[1], key[2]) == (key[3], key[4])
        here = ((pdf["s"] == key[1]) & (pdf["j"] == key[2])).to_numpy()
        pdf = pd.concat([pdf[here], pdf[~here]], ignore_index=True)
        a = int(here.sum())
        sets = [np.asarray(g, np.int64) for g in pdf["grams"]]
        near = verify(sets[:a], None if one else sets[a:], threshold)
        copies = pdf["copies"].to_numpy(np.int64)
        if one:
            np.fill_diagonal(near, False)
            links = near.astype(np.int64) @ copies
        else:
            links = np.concatenate([near.astype(np.int64) @ copies[a:], near.T.astype(np.int64) @ copies[:a]])
            full = np.zeros((len(pdf), len(pdf)), bool)
            full[:a, a:], full[a:, :a] = near, near.T
            near = full
        label = np.arange(len(pdf))
        order = sorted(range(len(pdf)), key=lambda i: pdf["node"][i])
        rank = np.empty(len(pdf), np.int64)
        rank[order] = np.arange(len(pdf))
        label = rank.copy()
        while True:                                    # smallest label among the neighbours, until nothing moves
            low = np.where(near, label[None, :], len(pdf)).min(1, initial=len(pdf))
            new = np.minimum(label, low)
            if (new == label).all():
                break
            label = new
        nodes = pdf["node"].to_list()
        out = pd.DataFrame({"node": nodes, "rep": [nodes[order[x]] for x in label], "links": links})
        return out[out["links"] > 0]
    return block_pair


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, seed: int = 8) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)``: a row per input row.

    Returns doc_id, text_key (64-bit key of the text; with doc_id it names the
    row), class_id (smallest doc_id of the documents connected by links of
    Jaccard >= threshold; of copies where there are no other links), n_links
    (other documents linked to this one, copies included; rows that repeat
    count as documents), n_copies (rows with the same word sequence, this one
    included) and kept (true for the one row of the class that a deduplication
    keeps: smallest doc_id, then smallest text_key; all of several equal rows).

    Null or empty texts and texts without words: class_id = doc_id, n_links 0,
    n_copies 1, kept. A null doc_id comes after all others in its class. An
    empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    bands, rows = band_plan(threshold, recall)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_key(F.col("text")).alias("text_key"))
    signed = cut(base.mapInArrow(_signer(n, bands, rows, seed), "doc_id long, text_key long, node binary, bands array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    nodes = cut(signed.where("node is not null").groupBy("node")
                .agg(first, F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")))
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = (members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
               .where("low < high").select("key", "low"))
    star = members.join(buckets, "key").where("node != low").select(F.col("low").alias("u"), F.col("node").alias("v")).distinct()
    candidates = cut(components(star).join(nodes.select("node", "copies", "first"), "node"))

    # the n-gram sets of one member of each candidate class
    ids = candidates.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    texts = base.join(ids, base["doc_id"].eqNullSafe(ids["doc_id"]) & (base["text_key"] == ids["text_key"]), "left_semi").select("text")
    sets = texts.mapInArrow(_shingler(n), "node binary, grams array<long>")
    log = math.log(1 / threshold) if threshold < 1 else 1e-6
    sized = cut(candidates.select("node", "comp", "copies").join(sets.dropDuplicates(["node"]), "node")
                .withColumn("s", F.floor(F.log(F.size("grams").cast("double")) / log + 1e-9).cast("int")))
    counts = sized.groupBy("comp", "s").count().select("comp", "s", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
    around = counts.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("s", "nb"))).alias("nb"))
    placed = sized.join(around, "comp").withColumn("j", F.pmod(F.xxhash64("node"), F.element_at("nb", F.col("s"))).cast("int"))

    def keys(other: str, flip: bool):
        """Keys of this row's block with each block of a size class; the smaller block first."""
        mine, theirs = ("s", "j"), other
        rng = f"sequence(0, nb[{theirs}] - 1)"
        a, b = (f"struct({theirs} as s1, x as j1, {mine[0]} as s2, {mine[1]} as j2)", f"struct({mine[0]} as s1, {mine[1]} as j1, {theirs} as s2, x as j2)")
        pick = f"if(x < j, {a}, {b})" if other == "s" else (a if flip else b)
        return F.expr(f"if(nb[{theirs}] is null, array(), transform({rng}, x -> {pick}))")

    kind = "array<struct<s1:int,j1:int,s2:int,j2:int>>"
    paired = placed.withColumn("k", F.explode(F.concat(keys("s", False).cast(kind), keys("(s + 1)", False).cast(kind), keys("(s - 1)", True).cast(kind))))
    pair = ["comp", "s1", "j1", "s2", "j2"]            # the rows lie by comp so far, which would keep all pairs of a component in one task
    found = cut(paired.select("comp", "k.*", "node", "copies", "grams", "s", "j").repartition(*pair)
                .groupBy(*pair).applyInPandas(_links(threshold), "node binary, rep binary, links long"))
    final = components(found.where("node != rep").select(F.col("rep").alias("u"), F.col("node").alias("v")).distinct())
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("node", "first", "copies").join(final, "node", "left").join(linked, "node", "left").select(
        "node", "first", "copies", F.coalesce("comp", "node").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))
    heads = info.groupBy("comp").agg(F.min("first").alias("head"))
    info = info.join(heads, "comp").select("node", "copies", "links", "head")
    return signed.drop("bands").join(info, "node", "left").select(
        "doc_id", "text_key",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("head").isNull() | (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.text_key") == F.col("text_key")))).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near duplicates: one row of each class, all its columns; rows without words stay."""
    marks = jaccard_join(docs, **options).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("n_copies").alias("__n")).distinct()
    keyed = docs.withColumn("__text_key", text_key(F.col("text")))
    kept = keyed.join(marks, keyed["doc_id"].cast("long").eqNullSafe(marks["__id"]) & (keyed["__text_key"] == marks["__key"]))
    one = kept.where("__n > 1").dropDuplicates(["doc_id", "__text_key"])       # rows that repeat, id and text
    return kept.where("__n = 1").unionByName(one).drop("__id", "__key", "__n", "__text_key")
