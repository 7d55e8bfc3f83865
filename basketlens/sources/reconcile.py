"""Reconciling exports (S1): several exports whose headers and types differ become one frame.

Every export votes on every column: how many values it has and how many of
them read as a whole number, a number or a point in time. A column's type is
the narrowest that all values of all exports read as, so no value is lost;
what the exports disagree on is reported. Header texts that differ in case,
blanks or signs only mean the same column.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.columns import strip_ws
from basketlens.schema import LINE_ORDINAL, SOURCE_TO_CANONICAL

#: Types a column can get, narrowest first; text if none fits all values.
NUMBER = "decimal(38,10)"
KINDS = {"long": "bigint", "number": NUMBER, "double": "double", "time": "timestamp_ntz"}
VOTES = "export string, column string, header string, declared string, n long, n_long long, n_number long, n_double long, n_time long"


def plain_header(header: str) -> str:
    """A header's letters and digits only, without case and compatibility forms."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", header).casefold())


_CANONICAL = {plain_header(h): name for h, name in SOURCE_TO_CANONICAL.items()} | {plain_header(name): name for name in SOURCE_TO_CANONICAL.values()}


def column_headers(df: DataFrame) -> dict[str, list[str]]:
    """Canonical name -> the frame's headers that mean it, in their order. An unknown header's plain form is its name."""
    out: dict[str, list[str]] = {}
    for header in df.columns:
        plain = plain_header(header)
        out.setdefault(header if header == LINE_ORDINAL else _CANONICAL.get(plain, plain or header), []).append(header)
    return out


def _quoted(header: str) -> Column:
    return F.col("`" + header.replace("`", "``") + "`")


def _reads(df: DataFrame, header: str) -> dict[str, Column]:
    """For each kind, whether a value of the column reads as it without loss; blank text has no value."""
    dtype, c = df.schema[header].dataType, _quoted(header)
    if isinstance(dtype, T.StringType):
        c = F.nullif(strip_ws(c), F.lit(""))
        whole = c.rlike(r"^[+-]?\d{1,18}$") & ~c.rlike(r"^[+-]?0\d")       # a leading zero is part of a code
        number = c.rlike(r"^[+-]?\d{1,28}(\.\d{0,10})?$") & ~c.rlike(r"^[+-]?0\d")
        short = number & (F.length(F.regexp_replace(c, r"\D", "")) <= 15)      # a double gives back up to 15 digits
        return {"value": c, "long": whole, "number": number, "double": short, "time": c.try_cast("timestamp_ntz").isNotNull() & c.contains("-")}
    yes, no = c.isNotNull(), F.lit(False)
    number = isinstance(dtype, T.IntegralType) or isinstance(dtype, T.DecimalType) and dtype.scale <= 10 and dtype.precision - dtype.scale <= 28
    if isinstance(dtype, T.LongType):
        double = F.abs(c) <= 1 << 53
    else:
        double = yes if isinstance(dtype, (T.IntegralType, T.FractionalType)) and getattr(dtype, "precision", 0) <= 15 else no
    return {"value": c, "long": yes if isinstance(dtype, T.IntegralType) else no, "number": yes if number else no, "double": double,
            "time": yes if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else no}


def column_votes(spark: SparkSession, exports: dict[str, DataFrame]) -> DataFrame:
    """A row per export, column and header: declared type, values, and how many read as each kind.

    One aggregate a export, a row each; only these counts (exports x columns)
    reach the driver. The line ordinal doesn't vote.
    """
    votes = []
    for export, df in exports.items():
        pairs = [(name, h) for name, headers in column_headers(df).items() if name != LINE_ORDINAL for h in headers]
        aggs = []
        for i, (_, header) in enumerate(pairs):
            reads = _reads(df, header)
            aggs += [F.count(reads["value"]).alias(f"{i}_n")] + [F.count_if(reads[k]).alias(f"{i}_{k}") for k in KINDS]
        row = df.agg(*aggs).first() if aggs else None
        votes += [(export, name, header, df.schema[header].dataType.simpleString(), row[f"{i}_n"], *[row[f"{i}_{k}"] for k in KINDS])
                  for i, (name, header) in enumerate(pairs)]
    return spark.createDataFrame(votes, VOTES)


def _elected(votes: DataFrame) -> DataFrame:
    """(column, type): the narrowest kind that all values read as, else text; a column without values is text."""
    total = votes.groupBy("column").agg(F.sum("n").alias("n"), *[F.sum(f"n_{k}").alias(k) for k in KINDS])
    kind = F.when(F.col("n") == 0, F.lit("string"))
    for k, sql in KINDS.items():
        kind = kind.when(F.col(k) == F.col("n"), F.lit(sql))
    return total.select("column", kind.otherwise(F.lit("string")).alias("type"))


def conflicts(votes: DataFrame, exports: int) -> DataFrame:
    """A row per column on which the ``exports`` exports disagree.

    column, type (the one chosen), n_headers (different header texts),
    n_declared (different declared types), n_missing (exports without the
    column), n_text (values that keep a column of other kinds a text: those
    that read as no kind, if some do read as one).
    """
    some = votes.groupBy("column").agg(
        F.count_distinct("header").alias("n_headers"), F.count_distinct("declared").alias("n_declared"),
        (F.lit(exports) - F.count_distinct("export")).alias("n_missing"), F.sum("n").alias("n"),
        F.greatest(*[F.sum(f"n_{k}") for k in KINDS]).alias("best"))
    n_text = F.when((F.col("type") == "string") & (F.col("best") > 0), F.col("n") - F.col("best")).otherwise(F.lit(0))
    out = some.join(_elected(votes), "column").select("column", "type", "n_headers", "n_declared", "n_missing", n_text.alias("n_text"))
    return out.where("n_headers > 1 or n_declared > 1 or n_missing > 0 or n_text > 0")


def _typed(df: DataFrame, headers: list[str], kind: str) -> Column:
    """A column's value: of several headers of one export that mean it, the first that has one."""
    parts = []
    for h in headers:
        c = _quoted(h)
        if isinstance(df.schema[h].dataType, T.StringType) and kind != "string":
            c = F.nullif(strip_ws(c), F.lit(""))
        parts.append(c.cast(kind))
    return F.coalesce(*parts)


def reconcile(spark: SparkSession, exports: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(frame, conflicts) of ``exports`` (name -> frame as read).

    The frame holds all rows of all exports under canonical names, columns in
    the order in which they first occur, with the elected types; a column that
    an export lacks is null there. ``export`` names the origin of a row. The
    line ordinal is kept where all exports have one of the same type. Without
    exports it raises ValueError; exports without rows or columns count as missing votes.
    """
    if not exports:
        raise ValueError("no exports to reconcile")
    votes = column_votes(spark, exports)
    kinds = {r["column"]: r["type"] for r in _elected(votes).collect()}
    names = list(dict.fromkeys(n for df in exports.values() for n in column_headers(df) if n != LINE_ORDINAL))
    ordinals = [df.schema[LINE_ORDINAL].dataType for df in exports.values() if LINE_ORDINAL in df.columns]
    ordinal = [LINE_ORDINAL] if len(ordinals) == len(exports) and all(o == ordinals[0] for o in ordinals) else []
    frames = []
    for export, df in exports.items():
        headers = column_headers(df)
        cols = [(_typed(df, headers[n], kinds[n]) if n in headers else F.lit(None).cast(kinds[n])).alias(n) for n in names]
        frames.append(df.select(F.lit(export).alias("export"), *cols, *ordinal))
    return reduce(DataFrame.unionByName, frames), conflicts(votes, len(exports))
