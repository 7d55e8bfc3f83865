"""Name normalisation: Python-exact ``strip``, NFKD, drop non-ASCII, lower-case.

Spark has no Unicode NFKD function, so this is the library's one Python
step: an Arrow-batched ``pandas_udf`` that maps each batch's *distinct*
values only (names repeat heavily). Measured on 1.2 M names (sf0.1): 0.59 s
against 0.48 s for a plain ``lower``; a JVM ``translate``-table variant was
slower (1.47 s, one hash lookup per character) and was dropped.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def normalise_text(name: str, strip: bool = True) -> str:
    if strip:
        name = name.strip()
    return unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode("ascii").lower()


# Ship this module's functions by value with the UDF, so executors need no
# installed copy of the package (only pandas and the standard library).
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _normalise_series(s: pd.Series, strip: bool) -> pd.Series:
    cache: dict[str, str] = {}
    out = []
    for v in s.tolist():
        if not isinstance(v, str):
            out.append(None)
            continue
        r = cache.get(v)
        if r is None:
            r = cache[v] = normalise_text(v, strip)
        out.append(r)
    return pd.Series(out, index=s.index, dtype=object)


@F.pandas_udf(T.StringType())
def _normalise_stripped(s: pd.Series) -> pd.Series:
    return _normalise_series(s, True)


@F.pandas_udf(T.StringType())
def _normalise_raw(s: pd.Series) -> pd.Series:
    return _normalise_series(s, False)


def normalise_name(c: str | Column, strip: bool = True) -> Column:
    """strip (if asked) + NFKD + ASCII + lower of a string column; null stays null."""
    x = (F.col(c) if isinstance(c, str) else c).cast("string")
    return (_normalise_stripped if strip else _normalise_raw)(x)


def normalise_columns(df: DataFrame, cols: dict[str, str], strip: bool = True) -> DataFrame:
    """Add ``out = normalise(src)`` for each ``{out: src}`` (one Python pass for all)."""
    return df.withColumns({o: normalise_name(src, strip) for o, src in cols.items()})
