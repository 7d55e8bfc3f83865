"""Sources and sinks.

S1 reads an order-line export (Parquet or CSV) and renames the export's
header names to canonical names. S2 reads the city -> county map, S3 a
name list (one name per line), S4 writes the anonymised table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.columns import strip_ws
from basketlens.functions.names import normalise_name
from basketlens.schema import LINE_ORDINAL, SOURCE_TO_CANONICAL


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename export headers to canonical names; unknown columns pass through."""
    mapping = {c: SOURCE_TO_CANONICAL[c] for c in df.columns if c in SOURCE_TO_CANONICAL}
    return df.withColumnsRenamed(mapping) if mapping else df


def read_order_lines(spark: SparkSession, path: str | list[str], fmt: str = "parquet",
                     schema: str | None = None, with_ordinal: bool = True, **options) -> DataFrame:
    """Order lines with canonical names and a line ordinal when the format has one.

    Parquet: ``line_no`` = (file path, row index in file), i.e. file order,
    from Spark's ``_metadata`` column (deterministic, keeps filter pushdown).
    CSV: every column is read as text (types come from the cleaning step);
    ``line_no`` = (file path, start of the read block, running number), which
    is file order too, however the files are split. Files count in the order
    of their paths.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "csv":
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        for k, v in options.items():
            reader = reader.option(k, v)
        df = canonical_names(reader.schema(schema).csv(paths) if schema else reader.csv(paths))
        if with_ordinal and LINE_ORDINAL not in df.columns:
            df = df.withColumn(LINE_ORDINAL, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                                      F.monotonically_increasing_id().alias("row")))
        return df
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    df = (reader.schema(schema) if schema else reader).format(fmt).load(paths)
    df = canonical_names(df)
    if with_ordinal and fmt == "parquet" and LINE_ORDINAL not in df.columns:
        df = df.withColumn(LINE_ORDINAL, F.struct(F.col("_metadata.file_path").alias("file"),
                                                  F.col("_metadata.row_index").alias("row")))
    return df


def read_city_county(spark: SparkSession, path: str) -> DataFrame:
    """City -> county map (CSV with a header)."""
    return spark.read.csv(path, header=True, schema="city string, county string")


def name_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """N2 on a one-column frame: strip, lower, normalise, distinct; blank entries dropped."""
    cleaned = normalise_name(F.lower(strip_ws(F.col(col))), strip=False)
    return (lines.select(cleaned.alias("name")).filter(F.col("name").isNotNull() & (F.col("name") != ""))
            .distinct())


def read_name_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S3 + N2: a text file with one name per line -> distinct normalised names."""
    return name_list(spark.read.text(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a table (Parquet by default). The only action in the privacy flow."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def stage_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store cleaned order lines partitioned by ``year`` (Parquet).

    Reports over a staged table prune partitions: the trailing-year window
    (F3), the origin filter (F6) and the last-years reports (F2), which find
    their years first and filter with them as literals. No shuffle: each task sorts its own rows by (year,
    order number) and streams one file per year it holds, so a year is
    never funnelled through one task; the order-number clustering keeps row
    groups selective and the order roll-up's partial aggregation effective.
    """
    (lines.sortWithinPartitions("year", "order_number")
     .write.mode(mode).partitionBy("year").parquet(path))


def read_staged_lines(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned order lines written by ``stage_lines``."""
    return spark.read.parquet(path)
