"""Vectorised text kernels over Arrow string buffers.

Every kernel reads the UTF-8 bytes of a batch in place, a bounded slice at a
time, so memory follows the slice and not the batch or the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once.
SLICE = 1 << 20

U64 = np.uint64
#: Multiplier of the polynomial hash; odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1

#: White space of the word contract: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Classes of bytes for words: 0 white space, 1 anything else.
WORD = (~IS_SPACE).astype(np.uint8)

#: Classes of bytes for words and marks: 0 white space and controls, 1 letters, digits and all non-ASCII bytes, 2 marks.
WORD_MARK = np.full(256, 2, np.uint8)
WORD_MARK[:33] = 0
WORD_MARK[127] = 0
WORD_MARK[128:] = 1
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    WORD_MARK[_lo:_hi] = 1


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def tidy(run: Callable) -> Callable:
    """A function of batches that gives memory back when a task ends: workers live on, and what one task let go of is no use to the next stage."""

    def call(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return call


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.empty(n, U64)
    down = np.empty(n, U64)
    up[0] = down[0] = 1
    inverse = pow(_BASE, -1, 1 << 64)
    base, back, k = _BASE, inverse, 1
    while k < n:  # doubling: x**(k+i) = x**k * x**i
        m = min(k, n - k)
        up[k : k + m] = up[:m] * U64(base)
        down[k : k + m] = down[:m] * U64(back)
        base, back, k = base * base % (1 << 64), back * back % (1 << 64), 2 * k
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE + 4096
    while size < n:
        size *= 2
    return _powers(size)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets as int64, null flags) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else column.chunk(0)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    if nulls.any():
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), nulls
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets, nulls


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row is a range by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def segments(raw: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0). Rows over `limit` come in
    several segments, each cut at the first white space from `limit` on, so no word is cut."""
    for i, j in slices(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= limit:
            yield i, j, raw[lo:hi], offsets[i : j + 1] - lo
            continue
        while lo < hi:
            cut = min(lo + limit, hi)
            while cut < hi:
                found = np.flatnonzero(IS_SPACE[raw[cut : min(cut + 65536, hi)]])
                if len(found):
                    cut += int(found[0]) + 1
                    break
                cut = min(cut + 65536, hi)
            yield i, j, raw[lo:cut], np.array([0, cut - lo], np.int64)
            lo = cut


def runs(b: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero class, none across rows."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = classes[b]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    live = c[at[:-1]] != 0
    return at[:-1][live], at[1:][live]


def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of b[start:end], independent of position."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(b) + 1)
    c = np.empty(len(b) + 1, U64)
    c[0] = 0
    np.cumsum(BYTE_CODE[b] * up[: len(b)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U64))


def words(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORD, lower: bool = True, limit: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each row)."""
    counts = np.zeros(len(offsets) - 1, np.int64)
    out = []
    for i, j, b, off in segments(raw, offsets, limit):
        if lower:
            b = LOWER[b]
        s, e = runs(b, off, classes)
        out.append(hashes(b, s, e))
        counts[i:j] += np.diff(np.searchsorted(s, off))
    return (np.concatenate(out) if out else np.zeros(0, U64)), counts


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + (b ^ (b >> U64(32))))


def shingles(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the `width`-word shingles in order, number of each row). A row
    with 1 to width-1 words has its whole sequence as its one shingle."""
    ends = np.cumsum(counts)
    begins = ends - counts
    g = h
    for k in range(1, width):
        g = pair(g[:-1], h[k:]) if len(h) > k else np.zeros(0, U64)
    full = np.maximum(counts - width + 1, 0)
    pick = np.repeat(begins, full) + (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full))
    out, per = g[pick] if len(pick) else np.zeros(0, U64), full.copy()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.empty(len(short), U64)
        for i, r in enumerate(short):
            x = h[begins[r] : begins[r] + 1]
            for k in range(1, counts[r]):
                x = pair(x, h[begins[r] + k : begins[r] + k + 1])
            whole[i] = mix(x ^ U64(int(counts[r])))[0]
        per[short] = 1
        merged = np.empty(per.sum(), U64)
        at = np.cumsum(per) - per
        is_short = np.zeros(len(merged), bool)
        is_short[at[short]] = True
        merged[is_short] = whole
        merged[~is_short] = out
        out = merged
    return out, per


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of `counts` values; empty groups give 0."""
    c = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    return c[at[1:]] - c[at[:-1]]
