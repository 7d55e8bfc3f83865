"""Small helpers shared by the operators: reading tables, cutting lineage, word columns, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.materialise import reliable

#: Separators of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder (persisted where none is set), so later steps read it back."""
    return reliable(df)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, a local session gets a temporary
    folder; a cluster is refused, because its machines share no such folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="basketlens-")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back. Unlike ``cut`` this also drops what the planner knows of the
    frame (partitioning, constraints), which in rounds of joins grows until planning costs more than the work."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same for pure ASCII and is much faster than ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text as an array: A-Z lower-cased, runs of digits, letters and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def text_key(text: Column) -> Column:
    """64-bit key of a text that, with the id, names a row even where ids repeat; null has a key of its own."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often later expressions use them.

    The optimizer may otherwise paste a column's expression into every place
    that reads it, into the body of a lambda too, where it runs per element. A
    generated column (one row from one struct) stays as it is.
    """
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__once")
    return df.select("*", one).select(*df.columns, *[F.col(f"__once.{k}").alias(k) for k in columns])


def numpy_columns(df: DataFrame) -> dict:
    """Columns of a frame of proven bounded size, on the driver, as numpy arrays (list columns: their flattened values)."""
    out = {}
    for name, column in zip(df.columns, df.toArrow().combine_chunks().columns):
        column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        out[name] = (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)
    return out


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if a count shows at most ``max_rows`` rows; else the planner's shuffle join stays."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
