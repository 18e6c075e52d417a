"""Embedding of texts: a pluggable protocol and a deterministic default.

The default hashes words and the character trigrams inside them into signed
buckets and normalises the result.  It needs no model files; texts with the
same words are similar, meanings it does not know.
"""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import wraps
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VECTOR_DIMENSION

log = logging.getLogger(__name__)
SLICE = 128  # texts that a worker holds as strings at a time
_WORD = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    dimension: int

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


def retry(times: int = 3, delay: float = 0.5, backoff: float = 2.0, errors: tuple[type[Exception], ...] = (RuntimeError, OSError)) -> Callable:
    """Repeat a call that fails with one of the errors, waiting longer each time."""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def call(*args, **kwargs):
            wait = delay
            for k in range(times):
                try:
                    return f(*args, **kwargs)
                except errors:
                    if k == times - 1:
                        raise
                    time.sleep(wait)
                    wait *= backoff

        return call

    return around


class HashingEmbedder:
    CACHED = 50_000  # words whose buckets a worker keeps, some 30 MB

    def __init__(self, dimension: int = VECTOR_DIMENSION, trigram_weight: float = 0.25):
        self.dimension, self.trigram_weight = dimension, trigram_weight
        self._words: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # what common words add

    def __getstate__(self):
        return {"dimension": self.dimension, "trigram_weight": self.trigram_weight, "_words": {}}

    def _word(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that a word changes, and by how much."""
        found = self._words.get(word)
        if found is None:
            grams = [word] + (["\0" + word[i : i + 3] for i in range(len(word) - 2)] if len(word) > 3 else [])
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams))
            by = np.where(h >> np.uint64(63), 1.0, -1.0)
            by[1:] *= self.trigram_weight
            found = (h % np.uint64(self.dimension)).astype(np.int64), by
            if len(self._words) >= self.CACHED:
                self._words.clear()
            if len(word) <= 40:
                self._words[word] = found
        return found

    def embed_text(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return self.embed_array(texts).tolist() if texts else []

    def embed_array(self, texts: Sequence[str]) -> np.ndarray:
        """The vectors as rows.  Weights are sums of powers of two, so any order of adding gives the same."""
        v = np.zeros((len(texts), self.dimension))
        for row, text in enumerate(texts):
            parts = [self._word(w) for w in _WORD.findall(text.lower())]
            if parts:
                v[row] = np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), self.dimension)
        norm = np.linalg.norm(v, axis=1)
        v[norm == 0, 0] = 1.0
        return (v / np.where(norm == 0, 1.0, norm)[:, None]).astype(np.float32)


def embed(text: Column, embedder: Embedder | None = None, batch_size: int = 32, lenient: bool = False) -> Column:
    """The vectors of a text column; a worker calls the embedder batch by batch, with retries.

    If a batch fails for good its texts are tried one by one; lenient gives
    null for those that fail then, otherwise the error ends the query.
    """
    model = embedder or HashingEmbedder()

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = retry()(model.embed_batch)

        def vectors(texts: list[str]) -> list[list[float] | None]:
            try:
                return call(texts)
            except Exception:
                if not lenient:
                    raise
                if len(texts) == 1:
                    log.exception("a text cannot be embedded")
                    return [None]
                return [v for t in texts for v in vectors([t])]

        for texts in batches:
            # A few texts at a time are Python strings; the rest of a batch is Arrow's.
            held = lambda size: (texts.slice(i, size).fill_null("").to_pylist() for i in range(0, len(texts), size))  # noqa: E731, B023
            if hasattr(model, "embed_array"):
                found = np.concatenate([model.embed_array(few) for few in held(SLICE)]) if len(texts) else np.zeros((0, 1), np.float32)
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * np.int32(found.shape[1]))
                yield pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
            else:
                made = [pa.array(vectors(few), pa.list_(pa.float32())) for few in held(batch_size)]
                yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float32()))
            pa.default_memory_pool().release_unused()

    return run.asNondeterministic()(text)  # else a filter on the vectors has them made twice


def with_vectors(chunks: DataFrame, embedder: Embedder | None = None, batch_size: int = 32, lenient: bool = False) -> DataFrame:
    return chunks.withColumn("vector", embed(F.col("text"), embedder, batch_size, lenient))
