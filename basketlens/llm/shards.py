"""Two-pass external shuffle into shards (operator 7).

Pass one scatters the rows into buckets by a seeded hash of their contents;
the number of buckets follows from the bytes there are, so that a bucket fits
in a task's memory (the scatter is Spark's shuffle, which writes it to disk).
Pass two puts each bucket into a fixed order, permutes it
(Fisher-Yates, seeded by the bucket) and numbers the rows on from the rows of
the buckets before it: together a random permutation of the whole table. A
shard is an equal range of that permutation ("rows" law: shard sizes differ by
one row at most), so slots are gapless and a reader gets a shuffled shard.

A bucket that turns out larger than planned because one row repeats very often
is cut into parts by a salt before pass two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basketlens.llm.common import cut, text_key

BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 200_000
MAX_BROADCAST_BUCKETS = 200_000


def _permuter(seed: int):
    def permute(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, part = int(pdf["__bucket"].iloc[0]), int(pdf["__part"].iloc[0])
        order = np.lexsort((pdf["__key"].to_numpy(), pdf["__crc"].to_numpy(), pdf["__size"].to_numpy(), pdf["__id"].to_numpy()))
        order = order[np.random.default_rng([seed, bucket, part]).permutation(len(order))]       # Fisher-Yates
        return pdf.iloc[order].assign(__pos=np.arange(len(pdf), dtype=np.int64) + int(pdf["__before"].iloc[0]))
    return permute


def _counted(sized: DataFrame) -> DataFrame:
    return sized.groupBy("__bucket", "__part").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("bytes"))


def shuffle(docs: DataFrame, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(frame, rows): all rows and columns of ``docs`` with __pos, their place (from 0) in a seeded random permutation,
    __size (UTF-8 bytes of the text, plus 8) and __crc (crc32 of the text); and their number.

    The permutation depends on the rows and the seed alone unless equal rows
    overfill a bucket. Null ids and texts are ordinary values; an empty table
    stays empty; columns of ``docs`` may have any names but those with two
    leading underscores used here.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(*docs.columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id"), text_key(F.col("text")).alias("__key"),
                        (F.octet_length(text) + F.lit(8)).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("__crc"))
    total, rows = docs.agg(F.sum(F.octet_length(text) + F.lit(8)), F.count(F.lit(1))).first()
    n = max(1, -(-(total or 0) // bucket_bytes), -(-rows // BUCKET_ROWS))
    sized = sized.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed).cast("long"), "__id", "__key"), F.lit(n)).cast("int")).withColumn("__part", F.lit(0))
    counts = cut(_counted(sized))                                                 # a row per bucket
    large = counts.where((F.col("bytes") > 4 * bucket_bytes) | (F.col("n") > 4 * BUCKET_ROWS))
    over = {r["__bucket"]: int(max(-(-r["bytes"] // bucket_bytes), -(-r["n"] // BUCKET_ROWS))) for r in large.collect()}
    if over:
        salts = F.create_map(*[F.lit(x) for pair in sorted(over.items()) for x in pair])
        hot = F.col("__bucket").isin(list(over))
        split = cut(sized.where(hot).withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts[F.col("__bucket")]).cast("int")))
        counts = cut(counts.where(~hot).unionByName(_counted(split)))
        sized = sized.where(~hot).unionByName(split)
    order = Window.orderBy("__bucket", "__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", "__part", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("__before"))
    placed = sized.join(F.broadcast(offsets) if n <= MAX_BROADCAST_BUCKETS else offsets, ["__bucket", "__part"])
    schema = T.StructType([*placed.schema.fields, T.StructField("__pos", T.LongType())])
    out = placed.groupBy("__bucket", "__part").applyInPandas(_permuter(seed), schema)
    return out.drop("__bucket", "__part", "__before", "__key", "__id"), rows


def shard(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """``shuffle`` cut into ``shards`` ranges of equal length: adds __shard (0 to shards - 1) and __slot (from 0, gapless).

    The first rows-mod-shards shards hold one row more than the others.
    """
    placed, rows = shuffle(docs, seed)
    small, more = divmod(rows, shards)
    border = more * (small + 1)
    pos = F.col("__pos")
    number = F.when(pos < border, F.expr(f"__pos div {small + 1}")).otherwise(F.expr(f"{more} + (__pos - {border}) div {max(small, 1)}")).cast("int")
    first = F.expr(f"if(__shard <= {more}, __shard * {small + 1}L, {border}L + (__shard - {more}) * {small}L)")
    return placed.withColumn("__shard", number).withColumn("__slot", pos - first)


def write(docs: DataFrame, path: str, shards: int = 24, seed: int = 7) -> None:
    """Write ``docs`` as Parquet folders shard=0 .. shard=n-1, rows in slot order (a shard of any size is written by
    several tasks, each a run of slots; file names follow slot order)."""
    cols = list(docs.columns)
    (shard(docs, shards, seed).withColumnsRenamed({"__shard": "shard", "__slot": "slot"})
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select(*cols, "slot", "shard").write.partitionBy("shard").parquet(path))


def assignment(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law ("rows"), shard, slot and grown_shard (null under this law), a row per row of ``docs``."""
    return shard(docs.select("doc_id", "text"), shards, seed).select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
