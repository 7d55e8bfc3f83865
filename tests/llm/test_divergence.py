import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketlens.llm import divergence
from basketlens.llm.divergence import Path, audit, slices
from helpers import LOWER

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, doc_id long, term string, n int, ord int, p int, item string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "y") for r in rows], SCHEMA)


def brute(rows, min_docs=30, ranks=50):
    docs = [(TERM.findall((t or "").translate(LOWER)), g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in docs}:
        mine = [(w, s) for w, g, s in docs if g == lang]
        seen = Counter(t for w, _ in mine for t in set(w))
        kept = {t for t, k in seen.items() if k >= min_docs}
        v = len(kept)
        count = defaultdict(Counter)
        for w, s in mine:
            count[s].update(t for t in w if t in kept)
        total = sum(count.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (n + 5 * v) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(total)
        for s in p:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s)
            out += [(lang, s, "pair", o, -f, k + 1) for k, (f, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, "term", t, -f, k + 1) for k, (f, _, t) in enumerate(terms)]
    return sorted(out)


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def corpus(rng, n=600):
    rows = []
    for i in range(n):
        lang = ["en", "en", "en", "Dé", None][int(rng.integers(5))]
        source = f"s{int(rng.zipf(1.6)) % 9}"
        words = [f"w{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26 % 26)}" for x in rng.zipf(1.3, int(rng.integers(0, 60))) % 300]
        words += [f"Only{source[1:]}İß", source.upper() + "x"] * int(rng.integers(0, 3))
        rows.append((" ".join(words) + "1,2_Über", lang, source))
    return rows


@pytest.mark.parametrize("held", [500_000, 20])
def test_same_as_sums_over_all_terms(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "TERMS", 200_000 if held > 20 else 50)
    rows = corpus(np.random.default_rng(held))
    got = result(audit(frame(spark, rows)))
    assert got == brute(rows) and len({r[0] for r in got}) == 3


def test_nulls_ties_repeats_and_languages_without_terms(spark):
    rows = [("a b", "x", "s")] * 30 + [("a c", "x", None)] * 31 + [("c", "x", "t"), (None, "x", "u"), ("", "x", "v"), ("123 !", None, "s"), ("zz", None, "t"), ("q", "y", "only")]
    rows += [("b " * 400_000 + "b" * 3_000_000, "x", "w")]
    got = result(audit(frame(spark, rows)))
    assert got == brute(rows)
    assert [r for r in got if r[0] == ""] == [("", "s", "pair", "t", 0, 1), ("", "t", "pair", "s", 0, 1)]
    assert not [r for r in got if r[0] == "y"]
    assert result(audit(frame(spark, []))) == []


def test_counts_beyond_64_bit_products(spark):
    share = divergence._share
    from pyspark.sql import functions as F
    row = spark.range(1).select(share(F.lit(4 * 10 ** 18), F.lit(5 * 10 ** 18), F.lit(1000)).alias("a"), share(F.lit(0), F.lit(0), F.lit(7)).alias("b")).first()
    assert row.a == 1 + 10 ** 9 * (4 * 10 ** 18 + 5) // (5 * 10 ** 18 + 5000) and row.b == 1 + 5 * 10 ** 9 // 35


def test_tree_adds_once_for_each_node_and_ancestor():
    rng = np.random.default_rng(7)
    rows = sorted({tuple((o, int(rng.integers(1, 4)) * 10) for o in sorted(rng.choice(6, int(rng.integers(2, 6)), replace=False).tolist())) for _ in range(200)})
    path, want = Path(), Counter()
    for k, row in enumerate(rows):
        o, p = np.array(row).T
        path.insert(o, p, o + 1, k + 1)
        for i in range(len(row)):
            for j in range(i):
                a, b, za, zb = p[j], p[i], o[j] + 1, o[i] + 1
                want[o[j] << 32 | o[i]] += (k + 1) * (abs(a - b) - abs(a - zb) - abs(za - b) + abs(za - zb))
    path.close(0)
    nodes = len({row[:k] for row in rows for k in range(2, len(row) + 1)})
    assert len(path.pairs) == nodes                              # shared paths once, not once a row
    assert dict(zip(*map(np.ndarray.tolist, path.sums()))) == {int(k): int(v) for k, v in want.items()}


def test_slices_keep_terms_whole():
    raw = b"aa bbb " + b"c" * 50 + b" d  " + b"e" * 5
    assert b"".join(slices(raw, 10)) == raw
    assert sum((piece.split() for piece in slices(raw, 10)), []) == raw.split()
