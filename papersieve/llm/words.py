"""Words and word shingles of many texts at once, in numpy.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; as those are
ASCII, splitting the UTF-8 bytes equals splitting the text.  Words and
shingles are named by 64-bit hashes (polynomials over a fixed random byte
table, then a bijective mixer).
"""

from __future__ import annotations

import numpy as np

U = np.uint64
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240501))
BYTE_HASH = _rng.integers(0, 2**64, 256, dtype=np.uint64)
LOWER_BYTE_HASH = BYTE_HASH[LOWER]
PLACE = _rng.integers(0, 2**64, 64, dtype=np.uint64) | U(1)
BASE = int(_rng.integers(0, 2**63)) * 2 + 1
BASE_INVERSE = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_spans(buf: np.ndarray, offsets: np.ndarray, of: np.ndarray = IS_WORD):
    """Start and end of every word (run of the bytes ``of``), and how many words
    each text has."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    inside = of[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, offsets))


_powers = {"n": 0}


def _powers_to(n: int):
    if n > (1 << 20):  # one very long text: not kept
        return _make_powers(n)
    if _powers["n"] < n:
        size = 1 << max(19, int(n - 1).bit_length())
        _powers["up"], _powers["down"] = _make_powers(size)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def _make_powers(n: int):
    up, down = np.full(n, U(BASE)), np.full(n, U(BASE_INVERSE))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(buf, starts, ends, lower: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span (A-Z as a-z if ``lower``)."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _powers_to(len(buf))
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((LOWER_BYTE_HASH if lower else BYTE_HASH)[buf] * up[:len(buf)],
              out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * PLACE[63])


def windows(hashes: np.ndarray, counts: np.ndarray, width: int):
    """Hash of every run of ``width`` words inside one text, with the index
    of its first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = hashes[:n - width + 1] * PLACE[0]
    for j in range(1, width):
        h = h + hashes[j:n - width + 1 + j] * PLACE[j]
    ends = np.repeat(np.cumsum(counts), counts)
    first = np.flatnonzero(np.arange(n - width + 1) + width <= ends[:n - width + 1])
    return mix(h[first]), first


def shingle_sets(buf, offsets, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased.  A
    text of fewer than ``width`` words has its whole sequence as one; one
    without words has none."""
    starts, ends, counts = word_spans(buf, offsets)
    h = span_hashes(buf, starts, ends, lower=True)
    shingles, first = windows(h, counts, width)
    word_at = np.concatenate([[0], np.cumsum(counts)])
    cut = np.searchsorted(first, word_at)
    out = []
    for d, n in enumerate(counts):
        if n >= width:
            out.append(np.unique(shingles[cut[d]:cut[d + 1]]))
        elif n:
            own = h[word_at[d]:word_at[d + 1]]
            total = (own * PLACE[:n]).sum(dtype=U, keepdims=True)
            out.append(mix(total + np.full(1, n, U) * PLACE[62]))
        else:
            out.append(np.zeros(0, U))
    return out
