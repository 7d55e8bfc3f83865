"""Anonymiser (N1-N4, J2, P14, Q1): infer gender from names, drop personal
columns, mask e-mail addresses.

Batch and streaming input take the same lazy path: one pass over the rows, an
Arrow step for the names, joins with the small name lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import mask_email
from basketlens.functions.names import normalise_columns
from basketlens.operators.hot_keys import hot_keys, split_lookup
from basketlens.schema import (
    FEMALE_NAME_MARK, GENDER_FEMALE, GENDER_MALE, GENDER_UNKNOWN, PII_COLUMNS, Params,
)


def name_flags(male: DataFrame, female: DataFrame) -> DataFrame:
    """J2 lookup: one row per normalised name with is_male / is_female flags.

    Inputs are N2 outputs (column ``name``). The lookup is small; the
    planner broadcasts it while its estimated size is under the broadcast
    threshold and falls back to a shuffle join (AQE splits hot names) beyond.
    """
    both = (male.select("name", F.lit(True).alias("is_male"), F.lit(False).alias("is_female"))
            .unionByName(female.select("name", F.lit(False).alias("is_male"), F.lit(True).alias("is_female"))))
    return both.groupBy("name").agg(F.max("is_male").alias("is_male"), F.max("is_female").alias("is_female"))


def normalised_names(raw: DataFrame, first: str = "first_name", last: str = "last_name") -> DataFrame:
    """N1 on the two name columns (absent column -> null)."""
    present = {o: c for o, c in (("first_name_norm", first), ("last_name_norm", last)) if c in raw.columns}
    df = normalise_columns(raw, present) if present else raw
    absent = {o: F.lit(None).cast("string") for o in ("first_name_norm", "last_name_norm") if o not in present}
    return df.withColumns(absent) if absent else df


def _gender(n1, m1, f1, n2, m2, f2) -> F.Column:
    """N3 on the (normalised name, is_male, is_female) of the first and last name."""
    marked = n1.contains(FEMALE_NAME_MARK) | n2.contains(FEMALE_NAME_MARK)
    return (F.when(m1, GENDER_MALE).when(f1, GENDER_FEMALE)
            .when(m2, GENDER_MALE).when(f2, GENDER_FEMALE)
            .when(marked, GENDER_FEMALE).otherwise(GENDER_UNKNOWN))


def infer_gender(raw: DataFrame, flags: DataFrame, first: str = "first_name", last: str = "last_name",
                 out: str = "gender", split_parts: int | None = None) -> DataFrame:
    """Gender from the first, then the last name; '-né' marks a woman; else unknown.

    One lazy pass for batch and streams: names are normalised in Arrow
    batches (distinct values of a batch only) and joined with the name lists.
    The lists are broadcast while their size is under the planner's byte
    threshold; beyond it AQE splits common names of the shuffle join. For a
    batch whose lists are that long, ``split_parts`` (the number of tasks)
    counts the names first and deals those that are common over several tasks.
    """
    df = normalised_names(raw, first, last)
    f1 = flags.select(F.col("name").alias("_n1"), F.col("is_male").alias("_m1"), F.col("is_female").alias("_f1"))
    f2 = flags.select(F.col("name").alias("_n2"), F.col("is_male").alias("_m2"), F.col("is_female").alias("_f2"))
    if split_parts:
        common = {c: hot_keys(df, F.col(c), split_parts) for c in ("first_name_norm", "last_name_norm")}
        df = split_lookup(df, f1, "first_name_norm", "_n1", common["first_name_norm"])
        df = split_lookup(df, f2, "last_name_norm", "_n2", common["last_name_norm"])
    else:
        df = (df.join(f1, F.col("first_name_norm") == F.col("_n1"), "left")
                .join(f2, F.col("last_name_norm") == F.col("_n2"), "left"))
    gender = _gender(F.col("first_name_norm"), F.col("_m1"), F.col("_f1"),
                     F.col("last_name_norm"), F.col("_m2"), F.col("_f2"))
    return df.withColumn(out, gender).drop("_n1", "_m1", "_f1", "_n2", "_m2", "_f2",
                                           "first_name_norm", "last_name_norm")


def drop_pii(df: DataFrame, columns: list[str] = PII_COLUMNS) -> DataFrame:
    """Drop personal columns; absent names are ignored."""
    return df.drop(*columns)


def mask_emails(df: DataFrame, params: Params = Params(), col: str = "email") -> DataFrame:
    """Replace e-mails by a hash prefix + '@masked.com' (skipped if the column is absent)."""
    if col not in df.columns:
        return df
    return df.withColumn(col, mask_email(col, params.mask_digits, params.mask_salt))


def anonymise(raw: DataFrame, male: DataFrame, female: DataFrame, params: Params = Params(), split_parts: int | None = None) -> DataFrame:
    """Q1: gender first (it needs the names), then drop personal columns, then mask e-mail.

    ``male``/``female`` are N2 name lists (column ``name``). No action inside,
    but for the counts of names with ``split_parts`` (see ``infer_gender``).
    """
    with_gender = infer_gender(raw, name_flags(male, female), split_parts=split_parts)
    return mask_emails(drop_pii(with_gender), params)
