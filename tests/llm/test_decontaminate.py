import hashlib

import numpy as np
import pytest

from basketlens.llm.decontaminate import clean, contamination, mark_contamination
from helpers import documents, prose, words


def brute(rows, items):
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(len(v), 10)
            runs = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v and item_id is not None else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i:i + n]) in runs:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_same_as_comparing_every_window(spark, short):
    rng = np.random.default_rng(3)
    items = [(i, prose(rng, int(rng.integers(10, 40)))) for i in range(12)] + [(3, prose(rng, 15)), (None, "n u l l"), (20, None), (21, "...")]
    if short:
        items += [(30, "one"), (31, "Four words make this"), (32, prose(rng, 9)), (33, prose(rng, 7))]
    rows = []
    for i in range(60):
        w = prose(rng, int(rng.integers(0, 200))).split()
        for item_id, text in items[: i % 4]:
            v = (text or "").split()
            a = int(rng.integers(0, max(1, len(v) - 9)))
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = v[a: a + int(rng.integers(8, 14))]
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else ", ".join(w)))
    rows += [(60, None), (61, ""), (62, "one"), (63, "so four words make this one"), (64, items[0][1]), (64, items[0][1]), (65, items[3][1] + " " + items[12][1]), (None, items[1][1]),
             (66, " ".join([items[2][1]] * 40))]
    frame = spark.createDataFrame([(a, b, 0, "r") for a, b in items], "item_id long, text string, start int, run string")
    got = mark_contamination(documents(spark, rows), frame).collect()
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, items), key=key)
    kept = clean(documents(spark, rows), frame)
    assert kept.columns == documents(spark, rows).columns
    want = [r[0] for r, b in zip(rows, brute(rows, items)) if not b[-1]]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_spans_and_empty_tables(spark):
    item = " ".join(f"k{i}" for i in range(25))
    rows = [(1, "a b " + item + " c"), (2, " ".join(item.split()[:9])), (3, " ".join(item.split()[:12]) + " x " + " ".join(item.split()[12:24]))]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    _, spans = contamination(documents(spark, rows), items)
    assert sorted((r.doc_id, r.start, r.end) for r in spans.collect()) == [(1, 2, 27), (3, 0, 12), (3, 13, 25)]
    assert mark_contamination(documents(spark, []), items).count() == 0
    none = mark_contamination(documents(spark, rows), items.limit(0)).collect()
    assert len(none) == 3 and not any(r.contaminated for r in none)


def test_same_result_without_broadcast(spark, monkeypatch):
    import basketlens.llm.decontaminate as D
    rng = np.random.default_rng(4)
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows = [(i, prose(rng, 50) + " " + items[i % 5][1]) for i in range(10)]
    monkeypatch.setattr(D, "MAX_BROADCAST_FINGERPRINTS", 0)
    monkeypatch.setattr(D, "MAX_BROADCAST_WINDOWS", 0)
    got = mark_contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, items))
