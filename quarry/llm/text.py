"""Vectorised text kernels on Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  In UTF-8 those
bytes occur only as themselves, so working on bytes is the same as working on
code points.  All kernels take a slice of many documents at once: ``buf`` is
the concatenated bytes and ``off`` the documents' offsets in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_CHUNK, _LONG = 1 << 18, 4096
_BYTE = np.random.default_rng(0x5EED).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_MULT = np.random.default_rng(0xFACE).integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        n = _CHUNK + _LONG + 1
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, limit: int = _CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends as byte positions, and each document's offset into them; ``between`` marks the bytes that end a word."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = between[buf]
    before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    edges = off[(off > 0) & (off < len(buf))]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ordered, disjoint spans of buf."""
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + _CHUNK)))
        part = buf[base : min(int(ends[hi - 1]), base + _CHUNK + _LONG)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        s, e = starts[lo:hi] - base, np.minimum(ends[lo:hi] - base, len(part))
        out[lo:hi] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_ODD)
        lo = hi
    out = mix(out)
    for i in np.flatnonzero(ends - starts > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive values of h; of the whole of h if it is shorter (none if empty)."""
    if not len(h):
        return h
    n_here = min(n, len(h))
    total = np.zeros(len(h) - n_here + 1, np.uint64)
    for k in range(n_here):
        total += h[k : len(h) - n_here + 1 + k] * _MULT[k % 64]
    return mix(total + np.uint64(n_here))


def sequence_hash(h: np.ndarray) -> int:
    """One 64-bit hash of the whole sequence."""
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(h).tobytes())


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
