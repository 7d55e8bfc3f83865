import numpy as np
import pytest

from basketlens.llm import mixing
from basketlens.llm.mixing import DOMAINS, memberships, mix, replay, sample, train
from helpers import documents, prose

LABELS = "doc_id long, quality int, toxic int, text string, domain string, n long"


def corpus():
    rng = np.random.default_rng(13)
    rows, labels = [], []
    for i in range(400):
        kind = int(rng.choice(3, p=[0.7, 0.18, 0.12]))
        text = prose(rng, int(rng.integers(30, 120)))
        text = text if kind == 0 else text.upper() + "!!" if kind == 1 else text + " idiot scum"
        rows.append((i, text))
        if i % 2 or i < 60:
            labels.append((i, int(kind != 1), int(kind == 2), "x", "y", 1))
    return rows, labels, rng


def test_classifier_separates_held_out_documents(spark):
    rows, labels, _ = corpus()
    docs, table = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: np.argmax(r.post) for r in memberships(docs, *train(docs, table)).collect()}
    want = {i: 2 if "scum" in t else 1 if t.isupper() or t.endswith("!!") else 0 for i, t in rows}
    held = [i for i, _ in rows if not (i % 2 or i < 60)]
    assert np.mean([got[i] == want[i] for i in held]) > 0.95


def test_expected_totals_meet_the_targets(spark):
    rows, labels, _ = corpus()
    docs, table = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    targets = {"good": 0.5, "low": 0.3, "toxic": 0.2}
    got = mix(docs, table, targets, total=20_000.0, max_rate=5.0).collect()
    t, p, r = np.array([x.n_tokens for x in got], float), np.array([x.post for x in got]), np.array([x.rate for x in got])
    assert np.allclose(p.sum(1), 1) and (r >= 0).all()
    assert np.allclose((t * r) @ p, 20_000 * np.array([targets[x] for x in DOMAINS]), rtol=0.01)
    assert all(x.copies in (int(x.rate), int(x.rate) + 1) for x in got)


def test_projected_gradient_finds_the_constrained_optimum(spark):
    """With targets out of reach the rates end at the bounds, as a plain projected gradient on one array finds."""
    rows, labels, _ = corpus()
    docs, table = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    got = mix(docs, table).collect()
    by = {x: [] for x in DOMAINS}
    for x in got:
        by[DOMAINS[int(np.argmax(x.post))]].append(x.rate)
        assert 0 <= x.rate <= 1 and x.copies in (0, 1)
    assert np.mean(by["good"]) > 0.97 and np.mean(by["toxic"]) < 0.1 and 0.3 < np.mean(by["low"]) < 0.9
    post = np.array([[0.9, 0.1], [0.2, 0.8]])
    assert np.allclose(replay(post, [np.array([1.0, 0.0]), np.array([-0.5, 0.5])], 1.0), [0.5, 0.5])


def test_nulls_repeats_empty_tables_and_bad_targets(spark):
    rows, labels, _ = corpus()
    odd = [(None, "null id"), (900, None), (901, ""), (0, rows[0][1])]
    labels = labels + [(None, 1, 1, "", "", 0), (1, None, 1, "", "", 0), (2, 1, None, "", "", 0), (777, 1, 0, "", "", 0), (0, 1, 1, "", "", 0)]
    docs, table = documents(spark, rows + odd), spark.createDataFrame(labels, LABELS)
    got = mix(docs, table).collect()
    assert len(got) == len(rows) + 4 and len({(r.rate, r.copies) for r in got if r.doc_id == 0}) == 1
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (900, 901))
    kept = sample(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in got)
    assert mix(documents(spark, []), table).count() == 0
    assert {r.copies for r in mix(documents(spark, rows[:5]), table.limit(0)).collect()} <= {0, 1}
    with pytest.raises(ValueError):
        mix(docs, table, {"good": 1.0})


@pytest.mark.parametrize("n_low", [20, 4, 0])
def test_scarce_low_quality_does_not_cut_clean_documents(spark, n_low):
    """Low at 5, 1 and 0 percent, toxic at 5: what is clean stays, what is toxic goes."""
    rng = np.random.default_rng(17)
    kinds = [1] * n_low + [2] * 20 + [0] * (380 - n_low)
    texts = [prose(rng, int(rng.integers(30, 120))) for _ in kinds]
    rows = [(i, t if k == 0 else t.upper() + "!!" if k == 1 else t + " idiot scum") for i, (k, t) in enumerate(zip(kinds, texts))]
    labels = [(i, int(k != 1), int(k == 2), "x", "y", 1) for i, k in enumerate(kinds)]
    docs, table = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    rates = {r.doc_id: r.rate for r in mix(docs, table).collect()}
    assert np.mean([rates[i] for i, k in enumerate(kinds) if k == 0]) > 0.97
    assert np.mean([rates[i] for i, k in enumerate(kinds) if k == 2]) < 0.1
    kept = {r.doc_id for r in sample(docs, table).select("doc_id").collect()}
    assert sum(i in kept for i, k in enumerate(kinds) if k == 0) > 0.95 * kinds.count(0)


def test_without_labels_every_document_stays(spark):
    rows, labels, _ = corpus()
    docs, none = documents(spark, rows), spark.createDataFrame(labels, LABELS).limit(0)
    assert {r.copies for r in mix(docs, none).collect()} == {1} and sample(docs, none).count() == len(rows)


def test_fitted_sample_has_one_row_per_repeated_id(spark, monkeypatch):
    rows, labels, _ = corpus()
    rows += [(i, f"{rows[i][1]} copy {j}") for i in (1, 3, 5) for j in range(150)]
    seen, real = [], mixing.regress
    monkeypatch.setattr(mixing, "regress", lambda domain, *rest: seen.append(len(domain)) or real(domain, *rest))
    labels = labels[:6]
    train(documents(spark, rows), spark.createDataFrame([(i, int(i != 3), int(i == 5), "x", "y", 1) for i, *_ in labels], LABELS), sample_rows=6)
    assert seen == [6]
