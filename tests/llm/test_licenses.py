import numpy as np

from basketlens.llm.licenses import IN_ORDER, PHRASES, TEMPLATES, block_words, need, scan, template_words
from helpers import documents, prose, words


def brute(rows, templates, threshold):
    out = []
    for doc_id, text in rows:
        w = words(text)
        places, base = [], set()
        for phrase, label in PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        labels, score = set(base), 0.0
        for label, t in templates:
            t = words(t)
            size, s, pairs = block_words(t), set(t), set(zip(t, t[1:]))
            start = 0
            while True:
                block = w[start:start + size]
                common = len(set(block) & s)
                if common >= need(len(s), threshold) and (not pairs or len(set(zip(block, block[1:])) & pairs) >= need(len(pairs), IN_ORDER)):
                    labels.add(label)
                    score = max(score, common / len(s))
                if start + size >= len(w):
                    break
                start += size // 2
        out.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else score))
    return out


def test_same_as_comparing_every_block_with_every_template(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        w = prose(rng, int(rng.integers(0, 150)), 60).split()
        if i % 3 == 0:
            t = TEMPLATES[i // 3 % len(TEMPLATES)][1].split()
            drop = int(rng.integers(0, 3))
            t = [x for k, x in enumerate(t) if k not in set(rng.integers(0, len(t), drop))]
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = t
        rows.append((i, "\n".join([" ".join(w).upper(), "Under the MIT license." * (i % 2)])))
    rows += [(500, None), (510, ""), (520, "cc by nc cc by-nc CC/BY/NC"), (530, "under the mit license"), (530, "under the mit license"), (None, "Apache License, Version 2.0"),
             (540, "all " + "x " * 100 + "rights reserved"), (550, "all rights " + "y " * 15 + "reserved")]
    for threshold in (0.9, 0.6):
        got = scan(documents(spark, rows), threshold=threshold).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, TEMPLATES, threshold)))
    assert scan(documents(spark, [])).count() == 0


def test_own_templates_of_any_length(spark):
    templates = (("long", " ".join(f"t{i}" for i in range(90))), ("one", "only"))
    rows = [(1, "x " * 500 + " ".join(f"t{i}" for i in range(85)) + " y" * 300), (2, "t1 t2 only"), (3, "x")]
    got = {r.doc_id: r.labels for r in scan(documents(spark, rows), templates=templates).collect()}
    assert got == {1: "long", 2: "one", 3: ""}


def test_scattered_words_are_no_notice(spark):
    rows = [(1, "all of the rights to these seats were reserved"), (2, "state reserved water rights for all"), (3, "Copyright 2020. All rights reserved.")]
    assert {r.doc_id: (r.labels, r.score) for r in scan(documents(spark, rows)).collect()} == {1: ("", 0.0), 2: ("", 0.0), 3: ("all-rights-reserved", 1.0)}


def test_whole_licence_texts_among_long_prose(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"{prose(rng, 700)} {t} {prose(rng, 300)}") for i, (_, t) in enumerate(TEMPLATES)]
    got = {r.doc_id: r.labels.split(",") for r in scan(documents(spark, rows)).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(TEMPLATES))
    assert "bsd" not in got[3] and block_words(template_words(TEMPLATES[3][1])) == 512
