"""Words of a slice of texts as 64-bit hashes, with no loop over words.

Words are runs of bytes other than blanks (0x20, 0x09-0x0D), with A-Z in lower case. A hash is a sum over the word's
bytes with powers of an odd number, taken from running sums and brought to the word's start by inverse
powers; all arithmetic is modulo 2^64. Two words of a corpus share a hash with probability about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Powers that a worker keeps between slices, at most.
KEPT = (2 << 20) + (64 << 10)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on every bit of the number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, or more. Those of an ordinary slice are kept; a very long text's are let go with it."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = n if n > KEPT else min(KEPT, 1 << (n - 1).bit_length())
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps, out=steps))
    if size <= KEPT:
        _POWERS[:] = made
    return made[0], made[1]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, number of words before each text and after the last, first byte, last byte, length) of string ``texts``.

    Null texts have no words.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start, stop = int(ends[0]), int(ends[-1])
    empty = np.zeros(0, np.uint8)
    if stop == start:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), empty, empty, np.zeros(0, np.int64)
    raw = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[start:stop]]
    ends = ends - start
    inside = ~_BLANK[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = ends[:-1][ends[:-1] < len(raw)]
    before[edges] = False  # a word ends with its text
    firsts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[ends[1:][ends[1:] > 0] - 1] = False
    lasts = np.flatnonzero(inside & ~after)
    powers, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers[: len(raw)], out=sums[1:])
    h = mixed((sums[lasts + 1] - sums[firsts]) * inverse[firsts] + (lasts - firsts).astype(np.uint64))
    return h, np.searchsorted(firsts, ends), raw[firsts], raw[lasts], lasts - firsts + 1


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Of each text its sorted distinct shingle hashes; fewer words than ``size`` are one shingle, none is empty."""
    h, at, *_ = words(texts)
    out: list[np.ndarray] = []
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - size + 1 + k]
        rolled = mixed(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mixed(one * np.uint64(3) + h[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
