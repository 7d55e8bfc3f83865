"""Vectorised tokens of Arrow text columns: 64-bit token hashes, no Python object per token.

A token's hash is a polynomial over its bytes modulo 2^64, taken from prefix
sums and then mixed. Texts are cut at token boundaries into slices of about
``SLICE`` bytes, so memory does not grow with a text's length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 17
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return raw | ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def WORDS(low: np.ndarray) -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+: every byte of a non-ASCII character belongs to a word."""
    return (low - np.uint8(97) < 26) | (low - np.uint8(48) < 10) | (low >= 128)


def SPACED(low: np.ndarray) -> np.ndarray:
    """Bytes of tokens [^\\x20\\x09-\\x0D]+."""
    return (low != 32) & (low - np.uint8(9) >= 5)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def token_hashes(texts: pa.Array, kind=WORDS, last_bytes: bool = False):
    """(hash of each token, bounds): tokens of row i are hashes[bounds[i]:bounds[i+1]], in order.

    With ``last_bytes``, a third array holds the last two bytes of each token (last * 256 + the one before, or 0).
    """
    raw, offsets = text_bytes(texts)
    n = len(raw)
    low = lower_bytes(raw)
    inside = kind(low)
    first = np.zeros(n + 1, bool)
    first[offsets] = True                          # a row begins here
    hashes, begins, lasts, a = [], [], [], 0
    while a < n:
        b = min(n, a + SLICE)
        if b < n and not first[b]:                 # cut behind a separator or where a row begins
            tail = max(a, b - 4096)
            back = np.flatnonzero(~inside[tail:b] | first[tail + 1: b + 1])
            if len(back):
                b = tail + int(back[-1]) + 1
            else:
                rest = np.flatnonzero(~inside[b:] | first[b + 1:])
                b = b + int(rest[0]) + 1 if len(rest) else n
        w = inside[a:b]
        s, e = w.copy(), w.copy()
        s[1:] &= ~w[:-1] | first[a + 1: b]
        e[:-1] &= ~w[1:] | first[a + 1: b]
        s, e = np.flatnonzero(s), np.flatnonzero(e)
        if len(s):
            up, down = _powers(max(SLICE, 1 << (b - a - 1).bit_length()))
            terms = low[a:b].astype(np.uint64)
            terms += U64(1)
            terms *= up[: b - a]
            total = np.cumsum(terms)
            hashes.append(mix((total[e] - total[s] + terms[s]) * down[s] + (e - s).astype(np.uint64)))
            begins.append(s + a)
            if last_bytes:
                lasts.append(low[a + e].astype(np.int64) * 256 + np.where(e > s, low[a + np.maximum(e - 1, 0)], 0))
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    bounds = np.searchsorted(begin, offsets)
    if last_bytes:
        return h, bounds, np.concatenate(lasts) if lasts else np.zeros(0, np.int64)
    return h, bounds


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` tokens, bounds). A row of fewer tokens, but not none, has one shingle: all of them."""
    n = np.diff(bounds)
    out = np.maximum(n - size + 1, np.minimum(n, 1))
    new = np.zeros(len(out) + 1, np.int64)
    np.cumsum(out, out=new[1:])
    row = np.repeat(np.arange(len(n)), out)
    at = np.arange(new[-1]) - new[row] + bounds[row]
    short = np.flatnonzero(n < size)                # rows whose one shingle is not full
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    acc = np.zeros(len(at), np.uint64)
    left = bounds[row + 1] - at if len(short) else None
    for k in range(size):
        term = padded[at + k]
        if left is not None:
            term[left <= k] = 0
        acc = (acc ^ term ^ (acc >> U64(29))) * U64(0xBF58476D1CE4E5B9 + 2 * k)
    return mix(acc + (np.minimum(left, size).astype(np.uint64) if left is not None else U64(size))), new
