import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa

import basketlens.llm.lm as lm
from basketlens.llm.lm import score_texts
from helpers import documents, tokens


def corpus(n=400):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        lang = "ab"[i % 2]
        rows.append((i, " ".join(f"{lang}{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 60))) % 3000)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "Never SEEN words"), (5, rows[5][1]), (None, "a1 a2"), (n + 3, "A1 " * 5000)]


def brute(rows):
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    counts = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            counts.update([*tokens(t), ("end",)])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, t), h in zip(rows, held):
        w = [*tokens(t), ("end",)]
        out.append((i, h, len(w), sum(counts[x] > 0 for x in w), n, sum(log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def test_base_scores_and_better_held_out_scores(spark, monkeypatch):
    for head in (lm.HEAD, 50):                     # with few counts in the tasks, the rest is joined
        monkeypatch.setattr(lm, "HEAD", head)
        rows = corpus()
        got = score_texts(documents(spark, rows)).collect()
        key = lambda x: (str(x[0]), x[2])
        want = sorted(brute(rows), key=key)
        assert len(got) == len(want)
        for a, b in zip(sorted(map(tuple, got), key=key), want):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
        held = [r for r in got if r.held_out]
        assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up_to_one(spark):
    """Over all texts of one token: every seen token, and what the smoothing leaves for unseen ones of each class."""
    rows = [(i, t) for i, t in corpus(60) if t]
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(t))
    seen = sorted(counts)
    h, cls, _ = lm.token_stream(pa.array(seen))
    single = {w for w, _ in counts.most_common(lm.SINGLE)} if len(seen) > lm.SINGLE else set(seen)
    got = {r.doc_id: 10 ** r.score for r in score_texts(documents(spark, rows + [(10_000 + 10 * k, w) for k, w in enumerate(seen)])).collect()}
    table = lm.log_table(*lm.train_nce(np.random.default_rng(1).integers(0, 9, (40, 40)).astype(float), epochs=2))
    assert np.allclose((10 ** table).sum(1), 1)
    assert len(got) and single and 0 < sum(got[10_000 + 10 * k] for k in range(len(seen))) <= 1 + 1e-9


def test_nce_approaches_the_conditional_shares():
    rng = np.random.default_rng(12)
    true = rng.dirichlet(np.full(30, 0.3), 30)
    pairs = true * rng.integers(200, 5000, 30)[:, None]
    model = 10 ** lm.log_table(*lm.train_nce(pairs, dims=24, epochs=200))
    unigram = pairs.sum(0) / pairs.sum()
    kl = lambda q: (pairs * np.log(np.maximum(true, 1e-12) / q)).sum() / pairs.sum()
    assert kl(model) < 0.35 * kl(unigram[None, :].repeat(30, 0))


def test_empty_table_and_no_training_rows(spark):
    assert score_texts(documents(spark, [])).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = score_texts(documents(spark, [(held, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and np.isfinite(row.score) and abs(row.base_score) < 1e-9
