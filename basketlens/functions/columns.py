"""Column-expression helpers shared by the operators.

Each helper closes one pandas/Spark semantic gap in one place:
null-safe sums, "first non-null in file order", floor day differences,
Unicode-aware stripping, coercion of money text and display formatting.
All of them are built-in Spark expressions (whole-stage codegen, no Python).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.schema import LINE_ORDINAL, MASK_DOMAIN, MONEY_TYPE

# Python's str.strip() removes every character with isspace(); the set is
# generated by that rule (about 30 code points) and handed to Spark's trim.
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

MICROS_PER_DAY = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()``: trim every Unicode white-space character (plain
    ``trim`` strips only ' ')."""
    return F.trim(col(c), F.lit(PY_WHITESPACE))


def sum0(c: str | Column) -> Column:
    """Sum where an all-null (or empty) group gives 0, not null."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def first_non_null(c: str | Column, df: DataFrame | None = None, ordinal: str = LINE_ORDINAL,
                   present: Column | None = None) -> Column:
    """First value of ``c`` in line order among rows where it is present (default: non-null).

    ``min_by`` skips rows whose ordering key is null, so masking the line
    ordinal where ``c`` is absent yields the first present value. A frame
    without an ordinal is an error: its rows have no order.
    """
    x = col(c)
    cond = x.isNotNull() if present is None else present
    if df is not None and ordinal not in df.columns:
        raise ValueError(f"'first in line order' needs the line ordinal {ordinal!r}")
    return F.min_by(x, F.when(cond, F.col(ordinal)))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from ``earlier`` to ``later``, floored (23 h -> 0, -1 h -> -1)."""
    micros = F.timestamp_diff("MICROSECOND", col(earlier), col(later))
    return floor_days(micros)


def floor_days(micros: Column) -> Column:
    """Floor division by one day; the numerator is an exact multiple, so exact."""
    whole = micros - F.pmod(micros, F.lit(MICROS_PER_DAY))
    return (whole / F.lit(MICROS_PER_DAY)).cast("long")


def exact_amount(c: str | Column) -> Column:
    """Decimal amount (six decimals); null where there is no number. A number too large for the type is an error:
    it must not become null or 0 unseen."""
    x, value = col(c), col(c).try_cast(MONEY_TYPE)
    number = x.try_cast("double")
    too_large = value.isNull() & number.isNotNull() & ~F.isnan(number)
    return F.when(too_large, F.raise_error(F.concat(F.lit(f"amount does not fit {MONEY_TYPE}: "), x.cast("string"))).cast(MONEY_TYPE)).otherwise(value)


def money(c: str | Column) -> Column:
    """Coerce to a decimal money value; unparsable or null -> 0, too large -> error."""
    return F.coalesce(exact_amount(c), F.lit(0).cast(MONEY_TYPE))


#: Patterns that ``infer_date_format`` tries, in the order that decides between equally good ones (month before day, as
#: pandas reads ambiguous text).
DATE_FORMATS = tuple(day + time for day in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "yyyyMMdd")
                     for time in (" HH:mm:ss", " HH:mm", ""))


def infer_date_format(df: DataFrame, name: str, formats: tuple[str, ...] = DATE_FORMATS) -> str | None:
    """The pattern that parses most texts of a column, from one pass that counts them all; None if the column is no text,
    or ISO-like text (parsed without a pattern) does as well as any pattern."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return None
    c = strip_ws(F.col(name))
    counts = df.agg(F.count(c.try_cast("timestamp_ntz")), *[F.count(F.try_to_timestamp(c, F.lit(f))) for f in formats]).first()
    iso, best = counts[0], max(counts[1:])
    return None if iso >= best else formats[counts[1:].index(best)]


def to_timestamp_ntz(df: DataFrame, name: str, fmt: str | None = None, strip: bool = False) -> Column:
    """Parse a date column to ``timestamp_ntz``; bad values become null.

    Text is parsed with ``fmt`` (a Spark datetime pattern) when given, else as
    ISO-like text (``2024-03-05``, ``2024-03-05 14:20[:ss]``).
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        c = strip_ws(c) if strip else c
        if fmt:
            return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
        return c.try_cast("timestamp_ntz")
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampNTZType):
        return c
    return c.cast("string").try_cast("timestamp_ntz")


def timestamp_literal(value: dt.datetime | dt.date | str | None) -> Column:
    """A ``timestamp_ntz`` literal; None means the current wall clock."""
    if value is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def last_category(path: str | Column) -> Column:
    """Text after the last '>' (whole text without one), stripped; null stays null."""
    return strip_ws(F.substring_index(col(path), ">", -1))


def weekday_name(ts: str | Column) -> Column:
    return F.date_format(col(ts), "EEEE")


def weekday_no(ts: str | Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return (F.weekday(col(ts)) + F.lit(1)).cast("int")


def format_amount(c: str | Column, suffix: str = "") -> Column:
    """``f"{x:,.2f}"`` (+ suffix); null -> ''."""
    text = F.format_number(col(c).cast("double"), 2)
    if suffix:
        text = F.concat(text, F.lit(suffix))
    return F.coalesce(text, F.lit(""))


def format_share(c: str | Column) -> Column:
    """``f"{x:.2f}%"`` of a share in per cent; null -> ''."""
    return F.coalesce(F.concat(F.format_number(col(c).cast("double"), 2), F.lit("%")), F.lit(""))


def mask_email(c: str | Column, digits: int = 10, salt: str = "") -> Column:
    """First ``digits`` hex digits of SHA-256 + '@masked.com'; null stays null."""
    x = col(c)
    if salt:
        x = F.concat(F.lit(salt), x)
    return F.concat(F.substring(F.sha2(x, 256), 1, digits), F.lit(MASK_DOMAIN))


def as_double(c: str | Column) -> Column:
    return col(c).cast("double")


def pct(part: str | Column, whole: str | Column) -> Column:
    """100 * part / whole in double arithmetic; whole = 0 -> null."""
    return F.try_divide(as_double(part), as_double(whole)) * F.lit(100.0)
