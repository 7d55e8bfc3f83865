"""Benchmark decontamination by winnowing (operator 3), DataFrame functions only.

A text's k-grams of words are hashed; of every ``window - k + 1`` consecutive
ones the smallest hash is a fingerprint. Two texts that share ``window``
consecutive words share all k-grams of that run, hence its smallest one, so a
join on fingerprints finds every document with a shared run (an item of fewer
than ``window`` words is one window; runs of its length are fingerprints of
their own). Hits are then extended on the words themselves: windows of the
documents found are compared as text, and overlapping ones merged, so a hash
collision or a chance fingerprint never counts.

Items and fingerprints are broadcast only after a count; documents meet them
in a shuffle join otherwise. Only documents with a common fingerprint are
read a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.llm.common import broadcast_if_small, cut, once, text_key, words

K = 5
MAX_BROADCAST_FINGERPRINTS = 500_000      # 16 bytes each
MAX_BROADCAST_WINDOWS = 50_000            # a window's words, some 100 bytes each


def _run(h: str, i: str, n: int) -> str:
    return f"xxhash64({', '.join(f'{h}[{i} + {j}]' for j in range(n))})"


def _sliding(n: str, width: int, body: str) -> Column:
    """body for each start i of a run of ``width`` among ``n``; an empty array if there is none."""
    return F.expr(f"if({n} >= {width}, transform(sequence(0, {n} - {width}), i -> {body}), array())")


def fingerprints(df: DataFrame, window: int, lengths: list[int], k: int = K) -> DataFrame:
    """Adds ``prints``, the distinct fingerprints of the array ``h`` of word hashes (``n_words`` long)."""
    df = once(df, g=_sliding("n_words", k, _run("h", "i", k)).cast("array<bigint>"))
    span = window - k + 1
    least = f"least({', '.join(f'g[i + {j}]' for j in range(span))})" if span > 1 else "g[i]"
    parts = [F.array_distinct(_sliding("size(g)", span, least).cast("array<bigint>"))]
    parts += [_sliding("n_words", n, _run("h", "i", n)).cast("array<bigint>") for n in lengths]
    return df.withColumn("prints", F.concat(*parts)).drop("g")


def _hashed(df: DataFrame) -> DataFrame:
    return once(df, n_words=F.size("w"), h=F.transform("w", lambda x: F.xxhash64(x)))


def _windows(df: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """A row per window of ``w``: start, len and run (its words joined by spaces), for the full length and each of ``lengths``."""
    runs = [_sliding("size(w)", n, f"struct(i as start, {n} as len, array_join(slice(w, i + 1, {n}), ' ') as run)")
            .cast("array<struct<start:int,len:int,run:string>>") for n in [window, *lengths]]
    return df.withColumn("x", F.explode(F.concat(*runs))).select(*[c for c in df.columns if c != "w"], "x.*")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hits, spans) of ``docs(doc_id, text)`` against ``items(item_id, text)``.

    hits: doc_id, text_key, n_hit, n_items, items_sha256 for each document
    with a hit. spans: doc_id, text_key, start, end (words, end excluded): the
    merged runs that the hits cover.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_key(F.col("text")).alias("text_key"))
    items = cut(items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w"))
                .where(F.size("w") > 0))
    lengths = [r[0] for r in items.where(F.size("w") < window).select(F.size("w")).distinct().orderBy(F.size("w")).collect()]   # below ``window`` values
    full, short = items.where(F.size("w") >= window), items.where(F.size("w") < window)
    own = cut(_windows(full, window, []).select("run", "item_id").union(short.select(F.array_join("w", " "), "item_id")).distinct())
    prints = (fingerprints(_hashed(full), window, []).select(F.explode("prints").alias("p"))
              .union(fingerprints(_hashed(short), window, lengths).select(F.explode("prints"))).distinct())
    seen = fingerprints(_hashed(once(base, w=words(F.col("text"))).drop("text")), window, lengths).select("doc_id", "text_key", F.explode("prints").alias("p"))
    found = seen.join(broadcast_if_small(cut(prints), MAX_BROADCAST_FINGERPRINTS), "p", "left_semi").select("doc_id", "text_key").distinct()
    found = cut(found.withColumnsRenamed({"doc_id": "id", "text_key": "key"}))

    texts = base.join(found, base["doc_id"].eqNullSafe(found["id"]) & (base["text_key"] == found["key"]), "left_semi").dropDuplicates(["doc_id", "text_key"])
    places = _windows(once(texts, w=words(F.col("text"))).drop("text"), window, lengths)
    runs = broadcast_if_small(own.select("run").distinct(), MAX_BROADCAST_WINDOWS)
    places = cut(places.join(runs, "run", "left_semi"))

    by_doc = Window.partitionBy("doc_id", "text_key")
    before = F.max(F.col("start") + F.col("len")).over(by_doc.orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1))
    swept = places.select("doc_id", "text_key", "start", "len", before.alias("before"))
    covered = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest(F.col("start"), F.coalesce("before", F.col("start"))))
    n_hit = swept.groupBy("doc_id", "text_key").agg(F.sum(covered).cast("long").alias("n_hit"))
    group = F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(by_doc.orderBy("start", "len").rowsBetween(Window.unboundedPreceding, 0))
    spans = (swept.withColumn("g", group).groupBy("doc_id", "text_key", "g")
             .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end")).drop("g"))
    named = places.select("doc_id", "text_key", "run").distinct().join(own, "run").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    named = named.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    hits = n_hit.join(named, n_hit["doc_id"].eqNullSafe(named["id"]) & (n_hit["text_key"] == named["key"])).drop("id", "key")
    return hits, spans


def mark_contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window of an item, each
    word once; n_items the items with occurring windows; items_sha256 is the
    lower-case hex digest of their ids, sorted as strings and comma-joined.

    Null and empty texts have no words, no hits and the digest of the empty
    string, as any document without hits. Items with null id or without words
    match nothing; items that repeat count once by id. Rows that repeat get
    equal results. Other columns are not read.
    """
    hits, _ = contamination(docs, items, window)
    hits = hits.withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
                       F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return base.join(hits, base["doc_id"].eqNullSafe(hits["id"]) & (base["text_key"] == hits["key"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that share a window with an item; all columns, rows and order of columns kept."""
    hits, _ = contamination(docs, items, window)
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    keyed = docs.withColumn("__text_key", text_key(F.col("text")))
    return keyed.join(hits, keyed["doc_id"].cast("long").eqNullSafe(hits["__id"]) & (keyed["__text_key"] == hits["__key"]), "left_anti").drop("__text_key")
