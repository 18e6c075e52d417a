"""SuperMinHash signatures and exact shingle sets of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from . import text

BANDS, ROWS = 26, 5
_PART = 8192
_EMPTY = np.uint64(2**64 - 1)
_STEP = np.random.default_rng(0xD1CE).integers(0, 2**64, 4096, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles, A-Z lower-cased.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    for _, _, buf, off in text.slices(column):
        buf = text.LOWER[buf]
        starts, ends, at = text.words(buf, off)
        h = text.hash_spans(buf, starts, ends)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(text.grams(h[a:b], n))


def signature(elements: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit hashes as m integers round << 32 | fraction.

    Every element draws a random permutation of the m components and gives the
    k-th of them a value in [k, k + 1); a component keeps its least value.
    Round k is worked out for all elements at once, and the rounds stop when
    no later one can lower a component.  The least is the same for any order
    of the elements, so large sets are worked through in parts.
    """
    out = np.full(m, _EMPTY, np.uint64)
    for lo in range(0, len(elements), _PART):
        e = elements[lo : lo + _PART]
        rows = np.arange(len(e))
        order = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
        for k in range(m):
            if int(out.max()) >> 32 < k:
                break
            x = text.mix(e ^ _STEP[k])
            j = k + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - k) >> np.uint64(32)).astype(np.int64)
            place = order[rows, j]
            order[rows, j] = order[:, k]
            np.minimum.at(out, place, np.uint64(k << 32) | (x >> np.uint64(32)))
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit key per band of the signature."""
    return [text.signed(xxhash.xxh3_64_intdigest(sig[b * rows : (b + 1) * rows].tobytes(), seed=b)) for b in range(bands)]
