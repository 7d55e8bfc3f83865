from basketlens.functions.columns import (
    as_double, days_between, first_non_null, floor_days, format_amount, last_category,
    mask_email, money, pct, strip_ws, sum0, timestamp_literal, to_timestamp_ntz,
    weekday_name, weekday_no,
)
from basketlens.functions.names import normalise_columns, normalise_name, normalise_text

__all__ = [
    "as_double", "days_between", "first_non_null", "floor_days", "format_amount",
    "last_category", "mask_email", "money", "normalise_columns", "normalise_name", "normalise_text", "pct",
    "strip_ws", "sum0", "timestamp_literal", "to_timestamp_ntz", "weekday_name", "weekday_no",
]
