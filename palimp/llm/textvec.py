"""Whole-batch text vectorisation: words, shingles and byte classes as numpy arrays, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240917)
#: A random odd 64-bit value for each byte; LOWER maps A-Z to a-z first.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
P = U(0x9E3779B97F4A7C15)
P_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Text bytes handled at once; a longer single text is still handled whole.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Powers:
    """P**i and P**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 1)
            self.up, self.down = (np.multiply.accumulate(np.r_[U(1), np.full(size - 1, p, U)]) for p in (P, P_INV))
        return self.up[:n], self.down[:n]


def slices(col: pa.Array | pa.ChunkedArray, size: int = SLICE):
    """(first row, bytes, offsets) of runs of rows of about `size` bytes; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, count=n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the index of each text's first word (one more entry at the end)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each span's bytes as `table` maps them; the same at every place."""
    up, down = powers.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(table[buf] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * LOWER[7])


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text and, for each, its text; a text of fewer words is one shingle, an empty one none."""
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    if len(h) >= n:
        x = mix(h[: len(h) - n + 1].copy())
        for k in range(1, n):
            x = mix(x + h[k : len(h) - n + 1 + k] * (P + U(2 * k)))
        whole = doc[: len(x)] == doc[n - 1 :]
        x, of = x[whole], doc[: len(whole)][whole]
    else:
        x, of = np.empty(0, U), np.empty(0, np.int64)
    for d in np.flatnonzero((words > 0) & (words < n)):
        own = mix(h[first[d] : first[d + 1]] + U(int(words[d])))
        for k in range(1, len(own)):
            own[0] = mix(own[:1] + own[k : k + 1] * (P + U(2 * k)))[0]
        x, of = np.r_[x, mix(own[:1] + U(977))], np.r_[of, d]
    return x, of


def distinct(x: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, ascending, one text after the other; the offsets of the texts."""
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    keep = np.r_[True, (x[1:] != x[:-1]) | (of[1:] != of[:-1])][: len(x)]
    x, of = x[keep], of[keep]
    return x, np.searchsorted(of, np.arange(n + 1))
