import time

import numpy as np
import pandas as pd
import pytest

from basketlens.llm import components as module
from basketlens.llm.components import components
from basketlens.llm.jaccard_join import band_plan, deduplicate, jaccard_join, verify
from helpers import documents, prose, words


def brute(rows):
    """(links, class, copies) by comparing all pairs of rows."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    near = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in range(n) if near[i][j])])
            moved |= low < label[i]
            label[i] = low
    classes = [min(rows[j][0] for j in range(n) if label[j] == label[i]) for i in range(n)]
    copies = [sum(words(rows[j][1]) == words(rows[i][1]) for j in range(n)) if sets[i] else 1 for i in range(n)]
    return [sum(x) for x in near], classes, copies


def corpus():
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, int(rng.integers(1, 120)))) for i in range(60)]
    base = prose(rng, 300).split()
    for i in range(60, 90):                      # a chain and a star of near copies
        w = list(base)
        for k in range((i - 60) // 4):
            w[(37 * k) % 300] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[i - 90][1].upper().replace("Ö", "ö") + "!") for i in range(90, 100)]      # the same words
    rows += [(100, None), (101, ""), (102, "!!!"), (103, None), (104, "one two"), (105, "One, two"), (106, "one two three")]
    rows += [(107, "long " + " ".join(f"z{k}" for k in range(20000)))]
    return rows


def test_same_links_and_classes_as_all_pairs(spark):
    rows = corpus()
    got = {r.doc_id: r for r in jaccard_join(documents(spark, rows)).collect()}
    links, classes, copies = brute(rows)
    assert len(got) == len(rows)
    for (i, text), n, c, k in zip(rows, links, classes, copies):
        assert (got[i].n_links, got[i].class_id, got[i].n_copies) == (n, c, k), i
        assert got[i].kept == (got[i].class_id == i)
    kept = deduplicate(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i in got if got[i].class_id == i)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "x y z"), (2, "x y z"), (3, "k"), (3, "l")]
    got = sorted((str(r.doc_id), r.class_id, r.n_links, r.n_copies) for r in jaccard_join(documents(spark, rows)).collect())
    assert got == sorted([("1", 1, 2, 3), ("1", 1, 2, 3), ("None", 1, 2, 3), ("None", 2, 1, 2), ("2", 2, 1, 2), ("3", 3, 0, 1), ("3", 3, 0, 1)])
    assert sorted((r.doc_id, r.text) for r in deduplicate(documents(spark, rows)).collect()) == [(1, "a b c d e f g"), (2, "x y z"), (3, "k"), (3, "l")]
    assert jaccard_join(documents(spark, [])).count() == 0 and deduplicate(documents(spark, [])).count() == 0


def test_band_plan_meets_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands, rows = band_plan(0.8, recall)
        assert 1 - (1 - 0.8 ** rows) ** bands >= recall and bands * rows <= 192


def test_verify_counts_in_slices_of_grams():
    rng = np.random.default_rng(2)
    left = [np.unique(rng.integers(0, 30000, 20000)) for _ in range(3)]
    right = [left[0][:-100], left[1], np.unique(rng.integers(0, 30000, 10))]
    want = [[len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) for b in right] for a in left]
    assert (verify(left, right, 0.8) == np.array(want)).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(components(spark.createDataFrame(pd.DataFrame(edges, columns=["u", "v"]))).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}, 300: 300, 301: 300}


@pytest.mark.parametrize("edges", [1000, 5000])
@pytest.mark.parametrize("shuffled", [False, True])
def test_long_chains_settle_in_few_rounds_of_equal_cost(spark, monkeypatch, edges, shuffled):
    name = np.arange(edges + 1)
    if shuffled:
        np.random.default_rng(edges).shuffle(name)
    took, plain = [], module.stored

    def timed(df):
        begin = time.perf_counter()
        out = plain(df)
        out.schema
        took.append(time.perf_counter() - begin)
        return out

    monkeypatch.setattr(module, "stored", timed)
    got = dict(components(spark.createDataFrame(pd.DataFrame({"u": name[:-1], "v": name[1:]}))).collect())
    assert got == {int(x): 0 for x in name}
    rounds = (len(took) - 1) // 3 + 1                       # one frame at first, then two a round, and one a round on the way back
    assert rounds <= 20
    assert max(took[3:]) < 3 * max(took[1:3]) + 0.5         # later rounds cost no more than the first


def test_components_of_text_nodes_and_no_edges(spark):
    got = dict(components(spark.createDataFrame([("b", "c"), ("c", "d"), ("x", "a"), ("q", "q")], "u string, v string")).collect())
    assert got == {"b": "b", "c": "b", "d": "b", "a": "a", "x": "a"}
    assert components(spark.createDataFrame([("q", "q")], "u string, v string")).collect() == []


def test_band_plans_at_the_ends():
    assert band_plan(1.0, 1.0)[0] == band_plan(1.0, 0.9999)[0] == 1
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.99, 0.0)):
        bands, rows = band_plan(threshold, recall)
        assert bands * rows <= 192 and 1 - (1 - threshold ** rows) ** bands >= recall
    for threshold, recall in ((0.8, 1.0), (0.01, 0.9999), (0.0, 0.5), (1.1, 0.5), (0.8, -0.1)):
        with pytest.raises(ValueError):
            band_plan(threshold, recall)


def test_threshold_one_links_equal_sets_only(spark):
    text = "a b c d e f g h a b c d e"
    rows = [(1, text), (2, text.upper()), (3, text + " f"), (4, text + " x"), (5, "short"), (6, None)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(documents(spark, rows), threshold=1.0, recall=1.0).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
