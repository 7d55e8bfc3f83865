import numpy as np
import pyarrow as pa

from basketlens.llm import tokens as T
from helpers import tokens, words


def test_tokens_match_the_patterns_at_any_slice_size(monkeypatch):
    texts = [None, "", "Hello, wOrld hello", "É été Été 12-b\x00c", "a" * 10, "x y " * 300, "!!!", "q" * 5000 + " z", "ß ü　k", "end "]
    for size in (64, 1 << 17):
        monkeypatch.setattr(T, "SLICE", size)
        for kind, plain in ((T.WORDS, words), (T.SPACED, tokens)):
            h, bounds = T.token_hashes(pa.array(texts), kind)
            seen = {}
            for i, text in enumerate(texts):
                want = plain(text)
                assert bounds[i + 1] - bounds[i] == len(want)
                for w, x in zip(want, h[bounds[i]:bounds[i + 1]]):
                    assert seen.setdefault(w, x) == x
            assert len(set(seen.values())) == len(seen)


def test_sliced_and_empty_columns():
    column = pa.array(["a b", None, "c d e", ""])
    h, bounds = T.token_hashes(column.slice(2))
    assert bounds.tolist() == [0, 3, 3]
    assert len(T.token_hashes(pa.array([], pa.string()))[0]) == 0
    assert T.token_hashes(column.cast(pa.large_string()))[1].tolist() == [0, 2, 2, 5, 5]
    assert h[0] == T.token_hashes(pa.array(["c"]))[0][0]


def test_shingles_are_sets_of_runs():
    h, bounds = T.token_hashes(pa.array(["a b c d e f", "a b", "", "a b c d e", "b a"]))
    g, gb = T.shingle_hashes(h, bounds, 5)
    assert np.diff(gb).tolist() == [2, 1, 0, 1, 1]
    assert g[gb[0]] == g[gb[3]] and g[gb[1]] != g[gb[4]]
