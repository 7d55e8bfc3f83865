import zlib
from collections import Counter, defaultdict

import pytest

from basketlens.llm.shards import assignment, shard, write
from helpers import documents


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < shards and sorted(x) == list(range(len(x))) for s, x in slots.items())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("n", [0, 5, 24, 500])
def test_every_row_once_and_shards_even(spark, n):
    rows = [(i, ("é" * (i % 7)) if i % 5 else None) for i in range(n)] + ([(3, "x"), (3, "x"), (None, "y"), (None, None)] if n > 5 else [])
    got = assignment(documents(spark, rows)).collect()
    check(rows, got, 24)
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_buckets_overfilled_by_one_row_are_split_and_order_is_random(spark, monkeypatch):
    import basketlens.llm.shards as S
    monkeypatch.setattr(S, "BUCKET_ROWS", 50)
    rows = [(1, "same")] * 700 + [(i, f"t{i}") for i in range(2, 900)]
    got = assignment(documents(spark, rows)).collect()
    check(rows, got, 24)
    first = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id > 1]
    assert sum(a < b for a, b in zip(first, first[1:])) < 0.6 * len(first)


def test_same_seed_same_order_whatever_the_partitions(spark):
    rows = [(i, f"text {i}") for i in range(300)]
    a = {r.doc_id: (r.shard, r.slot) for r in assignment(documents(spark, rows)).collect()}
    b = {r.doc_id: (r.shard, r.slot) for r in assignment(documents(spark, rows).repartition(7)).collect()}
    c = {r.doc_id: (r.shard, r.slot) for r in assignment(documents(spark, rows), seed=8).collect()}
    assert a == b and a != c


def test_written_shards_hold_all_columns(spark, tmpdir_run):
    docs = documents(spark, [(i, f"t{i}") for i in range(50)])
    write(docs, f"{tmpdir_run}/out", shards=4)
    back = spark.read.parquet(f"{tmpdir_run}/out")
    assert set(docs.columns) < set(back.columns) and back.count() == 50
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [12, 12, 13, 13]
    assert set(shard(docs).columns) == {*docs.columns, "__size", "__crc", "__pos", "__shard", "__slot"}
