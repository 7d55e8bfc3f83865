import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketlens.llm import align as module
from basketlens.llm.align import Tokenizers, align_counts, pieces, read_files, terminals
from helpers import documents

FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    return Tokenizers(*read_files())


def groups_of(t, text):
    """[(A ids, B ids)] of a text by walking both token lists, or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    sides = []
    for ids, strings in ((t.a.encode(" " + text, add_special_tokens=False).ids, t.a_bytes), (t.b.encode(text), t.b_bytes)):
        words = [strings.raw[strings.begin[i]: strings.begin[i] + strings.size[i]].tobytes() for i in ids]
        if b"".join(words) != raw:
            return None
        sides.append((ids, np.cumsum([len(w) for w in words]).tolist()))
    (a, ends_a), (b, ends_b) = sides
    common = sorted(set(ends_a) & set(ends_b))
    out, before = [], 0
    for end in common:
        out.append(([x for x, e in zip(a, ends_a) if before < e <= end], [x for x, e in zip(b, ends_b) if before < e <= end]))
        before = end
    return out


def brute(t, texts):
    groups = [groups_of(t, x) for x in texts]
    count = Counter()
    for g in groups:
        count.update({(x, y) for a, b in g or [] for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g in groups:
        links = [(x, y) for a, b in g or [] for x in a for y in b]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(links), sum(count[x] == best[x[0]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return out


def corpus():
    rng = np.random.default_rng(11)
    alphabet = list("abcdefghijklmnop  \n\t.,'—éßñ中文字😀👩‍👩‍👧0123456789<|>_ABC")
    texts = ["".join(rng.choice(alphabet, int(rng.integers(1, 90)))) for _ in range(60)]
    texts += ["The quick brown fox jumps over the lazy dog. " * k for k in range(1, 8)] + ["internationalization " * 3] * 4
    texts += [None, "", " ", "   ", "\n\n", "<|endoftext|>", "a<|endoftext|>b", "<s></s><unk>", "<0x41>", "x ▁y", "\x00\x01", "é ﬁ ½", "a" * 3000, "ab" * 900, " " * 500 + "z", "=" * 777, "中" * 800, "𝔘𝔫𝔦 " * 30]
    return texts


def test_same_groups_and_counts_as_walking_both_lists(spark, tokenizers):
    texts = corpus()
    got = {r.doc_id: r for r in align_counts(documents(spark, list(enumerate(texts)))).collect()}
    for i, want in enumerate(brute(tokenizers, texts)):
        assert tuple(got[i][f] for f in FIELDS) == want, texts[i]
    assert sum(r.n_a == 0 for r in got.values()) == 3 and sum(r.n_a > 0 for r in got.values()) > 60


@pytest.mark.parametrize("head", [0, 40])
def test_rare_pairs_meet_their_counts_in_a_join(spark, tokenizers, monkeypatch, head):
    monkeypatch.setattr(module, "LARGE", 3)
    monkeypatch.setattr(module, "SLICE", 50)
    monkeypatch.setattr(module, "BATCH", 200)
    monkeypatch.setattr(module, "ROWS", 7)
    texts = corpus()[60:] + ["one two  three four\nfive six " * 40 + "▁"]
    got = {r.doc_id: r for r in align_counts(documents(spark, list(enumerate(texts))), head=head).collect()}
    for i, want in enumerate(brute(tokenizers, texts)):
        assert tuple(got[i][f] for f in FIELDS) == want, texts[i]


def test_long_texts_in_pieces_are_as_whole_ones(tokenizers, monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(40):
        text = "".join(rng.choice(list("ab  ' \n é中.7"), 400))
        text = text.strip() or "x"
        got = module.align_pieces(tokenizers, pieces(text, 30))
        whole, = module.align_pieces(tokenizers, [text])
        assert len(got) > 3 and " ".join(pieces(text, 30)) == text
        assert sum(x[0] for x in got) == whole[0] and sum(x[1] for x in got) == whole[1]
        assert b"".join(x[3] for x in got) == whole[3]
    assert pieces("x" * 100, 10) == ["x" * 100] and pieces("", 10) == [""]


def test_no_piece_of_b_has_a_blank_behind_other_characters(tokenizers):
    strings = tokenizers.b_bytes
    assert not [i for i in range(tokenizers.n_b) if b" " in strings.raw[strings.begin[i]: strings.begin[i] + strings.size[i]].tobytes().lstrip(b" ")]


def test_pointers_end_where_both_sides_end():
    rng = np.random.default_rng(4)
    for size in (1, 30, 5000):
        ends = [np.unique(np.append(rng.integers(1, 3 * size + 1, size), 3 * size)) for _ in range(2)]
        if size == 5000:
            ends = [np.append(np.arange(2, 30_000, 2), 30_000), np.append(np.arange(1, 29_999, 2), 30_000)]       # one long chain
        common = np.intersect1d(*ends)
        label = terminals(*ends)
        assert (ends[0][label] == common[np.searchsorted(common, np.concatenate(ends))]).all()


def test_repeated_rows_null_ids_and_empty_tables(spark, tokenizers):
    texts = ["same text", "same text", "same text", None]
    df = documents(spark, [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, None)])
    out = align_counts(df)
    assert out.columns == ["doc_id", *FIELDS]
    assert sorted(tuple(r[f] for f in FIELDS) for r in out.collect()) == sorted(brute(tokenizers, texts))
    assert align_counts(documents(spark, [])).count() == 0


def test_ranks_give_the_ids_of_the_file(tokenizers):
    rng = np.random.default_rng(9)
    marks = [" {c}", "a{c}b{c}{c} {c}1", "{c}'s{c}\n{c}  {c}"]
    texts = corpus()[:60] + [marks[k % 3].format(c=chr(c)) for k, c in enumerate(rng.integers(0x80, 0x30000, 6000)) if not 0xD800 <= c <= 0xDFFF]
    texts = [x for x in texts if x]
    assert tokenizers.ranked is not None
    fast, tokenizers.ranked = tokenizers.a_ids(texts), None
    try:
        slow = tokenizers.a_ids(texts)
    finally:
        tokenizers.__init__(*read_files())
    assert all((x == y).all() for x, y in zip(fast, slow, strict=True))
