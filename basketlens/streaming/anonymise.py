"""The anonymiser on a stream of order lines.

``anonymise`` is stateless (row-wise expressions plus lookups against two
static name lists), so the same transform runs on ``readStream`` input:
each micro-batch joins the static name lookup (stream-static left joins)
and is appended to the sink. No watermark or state is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from basketlens.operators.privacy import anonymise
from basketlens.schema import Params
from basketlens.sources.readers import canonical_names


def anonymised_stream(spark: SparkSession, source_path: str, schema: str, male: DataFrame,
                      female: DataFrame, params: Params = Params(), fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of anonymised order lines read from ``source_path``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return anonymise(canonical_names(reader.load(source_path)), male, female, params)


def write_stream(df: DataFrame, out_path: str, checkpoint_location: str, fmt: str = "parquet",
                 available_now: bool = True) -> StreamingQuery:
    """Append the stream to files; the checkpoint (shared storage) makes restarts exactly-once."""
    writer = (df.writeStream.format(fmt).outputMode("append")
              .option("path", out_path).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
