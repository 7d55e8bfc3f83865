"""Incremental staging (S1, S4): new export files are added to a table of cleaned lines partitioned by year.

``folder/lines`` holds the cleaned lines, ``folder/taken`` a row per export
file that has been taken (path, size, time of change). A run takes the files
that are not in the list, and rewrites only the years that their lines touch,
by dynamic partition overwrite; all other years' files stay as they are.

The list is written after the lines. If a run dies between the two, or while
the years are replaced, the next run takes the same files again: lines that
came from them are left out of the rewritten years first, so each counts once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.operators import clean
from basketlens.schema import LINE_ORDINAL, Params
from basketlens.sources.readers import read_order_lines

TAKEN = "file string, size long, changed timestamp"


def _file_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and identity of each file of ``paths`` (contents are not read)."""
    return spark.read.format("binaryFile").load(paths).select(
        "path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"))


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def taken_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files taken so far."""
    taken = _table(spark, f"{folder}/taken")
    return spark.createDataFrame([], TAKEN) if taken is None else taken


def staged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned lines of all files taken."""
    return spark.read.parquet(f"{folder}/lines")


def _same_columns(staged: DataFrame, new: DataFrame) -> None:
    unlike = sorted({f"{c} {t}" for c, t in staged.dtypes} ^ {f"{c} {t}" for c, t in new.dtypes})
    if unlike:
        raise ValueError(f"the files' columns differ from the staged table's: {unlike}")


def take_files(spark: SparkSession, paths: str | list[str], folder: str, params: Params = Params(), fmt: str = "parquet", **options) -> list[int | None]:
    """Stages the files under ``paths`` that have not been taken yet; returns the years rewritten (None: undated lines).

    Exports are written once: a file that was taken and has another size or
    time of change since raises ValueError, as do files whose cleaned columns
    differ from those staged. No new file: nothing is written and the result
    is empty. A file without completed lines is listed as taken. The driver
    holds the new files' names and the touched years, never lines.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found, taken = _file_list(spark, paths), taken_files(spark, folder)
    known = found.join(taken.withColumnsRenamed({"size": "old_size", "changed": "old_changed"}), "file", "left").collect()
    altered = sorted(r.file for r in known if r.old_size is not None and (r.size, r.changed) != (r.old_size, r.old_changed))
    if altered:
        raise ValueError(f"files changed after they were taken: {altered}")
    fresh = [r for r in known if r.old_size is None]
    if not fresh:
        return []

    new = clean.order_lines(read_order_lines(spark, sorted(r.path for r in fresh), fmt, **options), params)
    years = [r.year for r in new.select("year").distinct().collect()]
    staged = _table(spark, f"{folder}/lines")
    both = new
    if staged is not None:
        _same_columns(staged, new)
        dated = [y for y in years if y is not None]
        touched = F.col("year").isin(dated) if dated else F.lit(False)
        if None in years:
            touched = touched | F.col("year").isNull()
        again = spark.createDataFrame([(r.file,) for r in fresh], "again string")
        old = staged.where(touched).join(again, F.col(f"{LINE_ORDINAL}.file") == F.col("again"), "left_anti")
        both = old.select(*new.columns).unionByName(new)
    if years:
        (both.sortWithinPartitions("year", "order_number").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("year").parquet(f"{folder}/lines"))
    spark.createDataFrame([(r.file, r.size, r.changed) for r in fresh], TAKEN).coalesce(1).write.mode("append").parquet(f"{folder}/taken")
    return sorted(years, key=lambda y: (y is not None, y))
