"""The corpus pipeline: documents to shuffled training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each result as Parquet in
the folder named by spark.checkpoint.dir and reads it back for the next stage
(a cluster that names none is refused: its machines share no other folder).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import decontaminate, jaccard_join, language, mixing, shards
from basketlens.llm.common import shared_folder, table, text_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose language it rejects go (no letters, no labelled language, or too uncertain).

    The languages are those that the documents' labels hold often enough; where they hold none, no document can be
    judged and all stay.
    """
    languages = language.labelled_languages(docs)
    if not languages:
        return docs.select(*COLUMNS)
    model = language.train(docs, languages)
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    marked = language.identify(language.document_evidence(keyed, F.col("doc_id").alias("__id"), "__key", F.col("lang").alias("__lang"), F.col("source").alias("__source")), model, languages)
    rejected = marked.where("rejected").select("__id", F.col("__key").alias("__text"), "__lang", "__source").distinct()
    same = (keyed["doc_id"].eqNullSafe(rejected["__id"]) & (keyed["__key"] == rejected["__text"])
            & keyed["lang"].eqNullSafe(rejected["__lang"]) & keyed["source"].eqNullSafe(rejected["__source"]))
    return keyed.join(rejected, same, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each class of near duplicates stays."""
    return jaccard_join.deduplicate(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that share ten consecutive words with a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents stay at the rates that bring the domains to their target weights."""
    return mixing.sample(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document's place in one of 24 shuffled shards."""
    return shards.shard(docs.select(*COLUMNS)).select(*COLUMNS, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: Trained models, MinHash and seeded shuffles have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents of ``sf_dir``; documents' columns with shard and slot."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
