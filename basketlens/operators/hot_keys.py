"""Lookup joins whose hot keys are split (J1, J2): for lookups too large to broadcast.

A shuffle join puts all rows of one key into one task. Keys that hold more
than their share are found by a count per key, combined before its shuffle;
their rows are dealt over several salts, and the lookup's rows of those keys
are repeated once a salt. All other keys keep one salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def hot_keys(rows: DataFrame, key: Column, parts: int) -> dict:
    """Key value -> number of salts, for keys with more than half of an even share of ``parts`` tasks.

    At most 2 * parts keys can have that many rows, so the result is bounded
    whatever the table; a key's salts are as many as half shares it holds.
    """
    counts = rows.where(key.isNotNull()).groupBy(key.alias("key")).count()
    total = rows.count()
    least = max(1, total // (2 * parts))
    return {r["key"]: -(-r["count"] // least) for r in counts.where(F.col("count") > least).collect()}


def split_lookup(rows: DataFrame, lookup: DataFrame, key: str, lookup_key: str, hot: dict) -> DataFrame:
    """``rows`` left-joined with ``lookup`` on ``key`` = ``lookup_key``; rows of ``hot`` keys lie in as many tasks as they have salts.

    The result is that of the plain left join, whatever ``hot`` holds. A row's
    salt follows from its task and its own values, so a repeated task deals
    the same way; null keys are dealt too, as they meet nothing.
    """
    salts = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]) if hot else None

    def splits(k: Column) -> Column:
        return F.coalesce(F.element_at(salts, k), F.lit(1)) if hot else F.lit(1)

    dealt = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in rows.columns])
    most = max([*hot.values(), 1])
    salt = F.pmod(dealt, F.when(F.col(key).isNull(), F.lit(most)).otherwise(splits(F.col(key)))).cast("int")
    copies = lookup.withColumn(SALT, F.explode(F.sequence(F.lit(0), splits(F.col(lookup_key)) - 1)))
    left = rows.withColumn("__own_salt", salt)
    return left.join(copies, (F.col(key) == F.col(lookup_key)) & (F.col("__own_salt") == F.col(SALT)), "left").drop("__own_salt", SALT)
