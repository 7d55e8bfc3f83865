import numpy as np

from basketlens.llm.nearest import chi2_quantile, nearest, search_block

SCHEMA = "vec_id long, embedding array<float>, label int, v int, p string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 1, 2, "p", 3) for i, x in rows], SCHEMA)


def brute(ids, x, queries, k):
    out = {}
    for i, q in zip(ids, x):
        if i in queries:
            score = np.einsum("d,nd->n", q, x)
            out[i] = [(int(j), float(s)) for s, j in sorted(((-s, j) for s, j in zip(score, ids) if j != i))[:k]]
            out[i] = [(j, -s) for j, s in out[i]]
    return out


def test_recall_and_scores_against_brute_force(spark, monkeypatch):
    import basketlens.llm.nearest as N
    monkeypatch.setattr(N, "ROWS", 300)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (20, 24))
    x = (centres[rng.integers(0, 20, 2000)] + 0.6 * rng.normal(0, 1, (2000, 24))).astype(np.float32).astype(float)
    x[1500:1900] = x[3]                                         # one vector very often
    ids = list(range(2000))
    got = nearest(frame(spark, list(zip(ids, x))), lambda v: v % 20 == 0, k=10).collect()
    want = brute(ids, x, {i for i in ids if i % 20 == 0}, 10)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by.keys() == want.keys() and all(len(v) == 10 for v in by.values())
    hits = sum(len({j for j, _ in by[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    for q, found in by.items():
        for j, s in found:
            assert abs(s - float(np.dot(x[q], x[j]))) < 1e-9
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert by[1500] == want[1500]                               # ties go to the smallest ids


def test_rows_that_take_no_part_few_rows_and_empty_tables(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1, 2]), (1, [2, 1]), (20, [1, 0]), (2, None), (3, [0, 0]), (4, [nan, 1]), (5, [inf, 1]), (6, [None, 1]), (7, [1, 2, 3]), (None, [5, 5]), (40, []), (1, [2, 1]), (60, [0, 0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(frame(spark, rows), lambda v: v % 20 == 0).collect())
    assert got == [(0, 1, 1, 4.0), (0, 2, 20, 1.0), (20, 1, 1, 2.0), (20, 2, 0, 1.0)]
    assert nearest(frame(spark, []), lambda v: v % 20 == 0).count() == 0
    assert nearest(frame(spark, [(1, [1, 2]), (2, [1, 2])]), lambda v: v % 20 == 0).count() == 0
    assert nearest(frame(spark, [(0, [1, 2])]), lambda v: v % 20 == 0).count() == 0


def test_chi_square_quantile_and_exhaustive_search():
    assert abs(chi2_quantile(0.95, 10) - 18.307) < 1e-3 and abs(chi2_quantile(0.5, 2) - 1.3863) < 1e-3
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(500, 6)), rng.normal(size=(9, 6))
    best = search_block(np.arange(500), x, x[:, :3], np.full(9, -1), q, q[:, :3], np.full(9, -np.inf), 100.0, 5, 1e9)
    for i in range(9):
        assert [j for _, j in best[i]] == np.argsort(-(x @ q[i]))[:5].tolist()
