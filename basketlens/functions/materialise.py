"""Materialising small intermediate results reliably."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def reliable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and cut its lineage when possible.

    With ``spark.checkpoint.dir`` set (a shared folder on a cluster) the frame
    is checkpointed there (eagerly), so an executor loss does not recompute
    its inputs; otherwise it is persisted to memory and disk, which Spark
    recomputes from lineage if an executor is lost.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:      # set at runtime, after the context started
            sc.setCheckpointDir(path)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
