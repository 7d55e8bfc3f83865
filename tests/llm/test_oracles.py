"""Registered queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from basketlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_licenses", "op8_jaccard_join", "chat_digests"])
def test_same_rows_as_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = QUERIES[name](spark, SF)
    cols = ", ".join(sorted(out.columns))
    want = sorted(map(str, con.execute(f"SELECT {cols} FROM ({ORACLES[name]})").fetchall()))
    assert sorted(str(tuple(r)) for r in out.select(*sorted(out.columns)).collect()) == want
