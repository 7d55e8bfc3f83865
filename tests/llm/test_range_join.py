import math

import numpy as np
import pytest

from basketlens.llm import range_join
from basketlens.llm.range_join import farthest_first, linked, local_labels, near_vectors

SCHEMA = "vec_id long, label int, embedding array<double>, node string, unit int, cell int, links long, block int, first long"


def frame(spark, rows):
    return spark.createDataFrame([(i, g, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2, 3, 4, 5) for i, g, v in rows], SCHEMA)


def brute(rows, threshold=0.93):
    """A sorted list of (vec_id, n_links, component_id, kept) by comparing all pairs."""
    def fit(g, v):
        return g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.abs(v).max() if fit(g, v) else None for _, g, v in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = [[j for j in range(len(rows)) if i != j and unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1]
             and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold - 1e-15] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), comp, rows[i][0] == comp))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def corpus(rng, n=260, dim=8, labels=3):
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        rows.append((i, int(rng.integers(labels)), v))
        if i % 4 == 0:                                 # a chain of near copies, each turned a little from the last
            for k in range(int(rng.integers(1, 5))):
                v = v + rng.normal(size=dim) * 0.12 * np.linalg.norm(v)
                rows.append((1000 + 10 * i + k, rows[-1][1], v * rng.uniform(0.1, 9)))
    return rows


@pytest.mark.parametrize("split", [16, 100_000])
def test_same_links_and_components_as_all_pairs(spark, monkeypatch, split):
    monkeypatch.setattr(range_join, "BLOCK", 16)
    rows = corpus(np.random.default_rng(split))
    assert result(near_vectors(frame(spark, rows), split=split)) == brute(rows)


def test_hot_label_of_clusters_prunes_cells_and_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(range_join, "BLOCK", 32)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24)) * 3
    rows = [(i, 1, centres[i % 12] + rng.normal(size=24) * 0.6) for i in range(500)]
    rows += [(5000 + i, 1, [1.0] * 24) for i in range(150)]          # one vector that very many rows repeat
    asked = []
    plain = range_join._router

    def counted(pivots, ring, reach):
        asked.append((pivots, ring))
        return plain(pivots, ring, reach)

    monkeypatch.setattr(range_join, "_router", counted)
    assert result(near_vectors(frame(spark, rows), split=20)) == brute(rows)
    (pivots, ring), = asked
    batch = list(plain(pivots, ring, math.acos(0.93))(_batches(pivots, rows)))[0]
    assert len(pivots[24]) > 8 and batch.num_rows < 501 * 4          # far less than a copy in every one of 32 cells


def _batches(pivots, rows):
    import pyarrow as pa
    x = np.unique(np.array([v for _, _, v in rows], float), axis=0)
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = len(x)
    yield pa.RecordBatch.from_pydict({"node": pa.array([bytes([i % 256, i // 256]) for i in range(n)]), "label": pa.array(["1"] * n), "dim": pa.array([24] * n, pa.int32()),
                                      "copies": pa.array([1] * n), "unit": pa.array(list(x), pa.list_(pa.float64())), "cells": pa.array([32] * n, pa.int32())})


def test_nulls_ties_repeats_lengths_and_odd_vectors(spark):
    rows = [(1, 7, [1, 0]), (2, 7, [1, 0]), (2, 7, [1, 0]), (None, 7, [2, 0.1]), (4, None, [1, 0]), (5, 7, None), (6, 7, [0, 0]), (7, 7, [1, None]),
            (8, 7, [float("nan"), 1]), (9, 7, [float("inf"), 1]), (10, 7, []), (11, 8, [1, 0]), (12, 7, [1, 0, 0]), (13, 7, [3, 0, -0.0]), (14, 7, [1e300, 1e299]),
            (15, 7, [1e-310, 0]), (None, 9, [1, 1]), (None, 9, [1, 1]), (None, None, None), (16, 7, [-1, 0]), (17, 7, [0.93, math.sqrt(1 - 0.93 ** 2)])]
    assert result(near_vectors(frame(spark, rows))) == brute(rows)
    assert result(near_vectors(frame(spark, []))) == []


def test_pivots_and_local_labels():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    p = farthest_first(np.repeat(x, 2, 0), 200)
    assert len(p) == 50 and len(np.unique(p, axis=0)) == 50
    assert local_labels(7, np.array([5, 3, 1]), np.array([3, 1, 6])).tolist() == [0, 1, 2, 1, 4, 1, 1]
    i, j = linked(x, x, -1.0)
    assert len(i) == 2500
