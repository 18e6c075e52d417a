"""An interpolated modified Kneser-Ney n-gram model of order 2 or 3, counted in Spark.

The model is a set of files in the shared folder, sorted arrays that workers
map into memory: word hashes and counts in ranges of the hash, whose positions
are the word ids; for each word the numbers of its continuations; pairs of ids
with their counts, in shards; and, at order 3, hashes of triples with their
counts, and what their contexts need to know beside the pairs.  Nothing of it
passes through the driver but a few sums per file.

The highest order counts occurrences, the lower ones the different words that
come before.  Counting sends sorted, delta-coded blocks of counts instead of
rows.  A shard holds the pairs of some contexts; a context with very many
pairs is divided among shards by its second word, and triples are dealt by
their own hash, so no shard grows with a frequent word.  The number of shards
follows the number of tokens; that of the vocabulary's parts follows the square
root of the text's bytes, as a vocabulary grows slower than its text.  What many
tasks have for one part is merged in steps, some blocks at a time.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, text

END = np.uint64(0x0E4D0E4D0E4D0E4D)  # stands for the end of a text among word hashes
FLUSH = 4_000_000  # tokens that a task counts at once
SHARD = 2_000_000  # tokens per shard of pairs, and pairs of one context per shard
BLOCK_BYTES = 1 << 25  # of text that a task counts at once, about
FAN = 64  # tasks whose blocks of one part are merged at once


# Files of arrays ---------------------------------------------------------------------------


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def _write(path: str, array: np.ndarray) -> None:
    """Atomically, so that a repeated task leaves the same file."""
    here, name = _local(path), f"{path}.{uuid.uuid4().hex}"
    if here:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        temp = _local(name)
        array.tofile(temp)
        os.replace(temp, here)
        return
    system, to = pafs.FileSystem.from_uri(path)
    _, temp = pafs.FileSystem.from_uri(name)
    with system.open_output_stream(temp) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data)
    system.move(temp, to)


def _copied(path: str) -> str | None:
    """The copy of a remote file that all workers of an executor share, in its own temporary folder; None if there is no such file.

    It goes when the worker that made it ends; others have it mapped by then or copy it anew.
    """
    system, source = pafs.FileSystem.from_uri(path)
    if system.get_file_info(source).type == pafs.FileType.NotFound:
        return None
    folder = os.path.join(tempfile.gettempdir(), "quarry-" + os.path.basename(os.path.dirname(source)))
    here = os.path.join(folder, os.path.basename(source))
    if not os.path.exists(here):
        os.makedirs(folder, exist_ok=True)
        atexit.register(shutil.rmtree, folder, True)
        with tempfile.NamedTemporaryFile(dir=folder, delete=False) as copy, system.open_input_stream(source) as data:
            while block := data.read(1 << 22):
                copy.write(block)
        os.replace(copy.name, here)
    return here


def _map(path: str, kind: type) -> np.ndarray:
    """The mapped array of a file; an empty one if nothing was written."""
    here = _local(path)
    if here is None:
        try:
            here = _copied(path)
            return np.memmap(here, kind, "r") if here and os.path.getsize(here) else np.zeros(0, kind)
        except FileNotFoundError:  # another worker has just ended and taken the copy along
            return _map(path, kind)
    return np.memmap(here, kind, "r") if os.path.exists(here) and os.path.getsize(here) else np.zeros(0, kind)


def _write_counts(path: str, counts: np.ndarray) -> None:
    """In four bytes each, or eight where they need them."""
    _write(path, counts.astype(np.uint32 if not len(counts) or counts.max() < 2**32 else np.uint64))


def _map_counts(path: str, n: int) -> np.ndarray:
    found = _map(path, np.uint32)
    return found.view(np.uint64) if n and len(found) == 2 * n else found


# Blocks of sorted numbers ------------------------------------------------------------------


def _pack(x: np.ndarray, sort: bool) -> bytes:
    """Sorted values as differences; then byte by byte, compressed."""
    d = np.diff(x, prepend=x.dtype.type(0)) if sort else x
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(len(d), d.itemsize).T)
    return pa.compress(planes.data, codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, n: int, kind: type, sort: bool) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if sort else x


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values (a row or a matrix)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first, axis=0) if len(first) else values


_BLOCK = "part int, n int, keys binary, counts binary"


def _blocks(parts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch | None:
    """One row per part; keys are sorted."""
    order = np.argsort(parts, kind="stable")
    parts, keys, counts = parts[order], keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
    ends = [*first[1:], len(parts)]
    spans = list(zip(first, ends, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(parts[first].astype(np.int32)), pa.array([b - a for a, b in spans], pa.int32()), pa.array([_pack(keys[a:b], True) for a, b in spans], pa.binary()), pa.array([_pack(counts[a:b], False) for a, b in spans], pa.binary())], ["part", "n", "keys", "counts"])


def _merged(table: pa.Table, counts: type, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    keys, values = [], []
    for r in table.select(["n", "keys", "counts"]).to_pylist():
        keys.append(_unpack(r["keys"], r["n"], np.uint64, True))
        values.append(_unpack(r["counts"], r["n"] * width, counts, False).astype(np.int64).reshape(-1, width))
    k, v = _summed(np.concatenate(keys), np.concatenate(values))
    return k, v if width > 1 else v.ravel()


def _steps(sources: int) -> int:
    """Steps of merging after which a part has FAN blocks, at most, of so many."""
    steps = 0
    while sources > FAN:
        sources, steps = -(-sources // FAN), steps + 1
    return steps


def _gathered(blocks: DataFrame, steps: int, width: int = 1) -> DataFrame:
    """Blocks (counts in eight bytes) with those of FAN tasks for a part merged to one, so many times."""

    def merge(table: pa.Table) -> pa.Table:
        k, c = _merged(table, np.uint64, width)
        packed = _pack(np.ascontiguousarray(c).astype(np.uint64).ravel(), False)
        return pa.table({"part": table["part"][:1], "lot": table["lot"][:1], "n": pa.array([len(k)], pa.int32()), "keys": pa.array([_pack(k, True)], pa.binary()), "counts": pa.array([packed], pa.binary())})

    rows = blocks.select("part", F.spark_partition_id().alias("lot"), "n", "keys", "counts")
    for _ in range(steps):
        rows = rows.withColumn("lot", F.floor(F.col("lot") / FAN).cast("int")).groupBy("part", "lot").applyInArrow(merge, "part int, lot int, n int, keys binary, counts binary")
    return rows.drop("lot")


# Tokens ------------------------------------------------------------------------------------


def _texts(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of many documents, each with END last, and the documents' offsets."""
    for _, _, buf, off in text.slices(column, limit):
        buf = text.LOWER[buf]
        starts, ends, at = text.words(buf, off)
        h = text.hash_spans(buf, starts, ends)
        yield np.insert(h, at[1:], END), at + np.arange(len(at))


@dataclass
class Model:
    """Where the model's files are, and its few scalars."""

    path: str
    words: int  # parts of the vocabulary
    order: int = 2
    bytes: int = 0  # of the texts
    pairs: int = 0  # shards of pairs
    triples: int = 0  # shards of triples
    sizes: list[int] = field(default_factory=list)  # word types in each part of the vocabulary
    tokens: int = 0
    documents: int = 0
    top: tuple[float, float, float] = (0.0, 0.0, 0.0)  # discounts of triples
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)  # of pairs
    lower: tuple[float, float, float] = (0.0, 0.0, 0.0)  # of words
    types: int = 0  # of pairs
    lower_left: float = 1.0  # what the discounts of the lower order leave

    @property
    def vocabulary(self) -> int:
        return sum(self.sizes)

    def file(self, kind: str, part: int) -> str:
        return f"{self.path}/{kind}-{part:06d}"


class _Words:
    """The mapped vocabulary."""

    def __init__(self, model: Model):
        self.model = model
        self.start = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)
        self.hashes = [_map(model.file("word", p), np.uint64) if n else np.zeros(0, np.uint64) for p, n in enumerate(model.sizes)]
        self.counts = [_map(model.file("count", p), np.int64) if n else np.zeros(0, np.int64) for p, n in enumerate(model.sizes)]

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        """Ids of tokens, -1 where unknown."""
        distinct, back = np.unique(tokens, return_inverse=True)
        out = np.full(len(distinct), -1, np.int64)
        part = _word_part(distinct, self.model.words)
        edge = np.searchsorted(part, np.arange(self.model.words + 1))
        for p in np.unique(part):
            q, h = distinct[edge[p] : edge[p + 1]], self.hashes[p]
            if len(h):
                at = np.minimum(np.searchsorted(h, q), len(h) - 1)
                out[edge[p] : edge[p + 1]] = np.where(h[at] == q, at + self.start[p], -1)
        return out[back]

    def of(self, arrays: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Values of the parts' arrays (of one row per word) at distinct, sorted ids."""
        out = np.zeros((len(ids), *arrays[0].shape[1:]), np.float64)
        edge = np.searchsorted(ids, self.start)
        for p in range(self.model.words):
            if edge[p] < edge[p + 1]:
                out[edge[p] : edge[p + 1]] = arrays[p][ids[edge[p] : edge[p + 1]] - self.start[p]]
        return out


def _word_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pair_part(first: np.ndarray, second: np.ndarray, count: np.ndarray, parts: int) -> np.ndarray:
    """The shard of a pair of ids; count: of the first, in training."""
    salt = text.mix(second.astype(np.uint64)) % (count.astype(np.int64) // SHARD + 1).astype(np.uint64)
    return (text.mix((first.astype(np.uint64) << np.uint64(20)) + salt) % np.uint64(parts)).astype(np.int64)


_kept: dict[str, object] = {}


def _once(key: str, make):
    """One mapped model in a worker; another takes its place."""
    if key not in _kept:
        for old in [k for k in _kept if k.split("|")[0] != key.split("|")[0]]:
            del _kept[old]
        _kept[key] = make()
    return _kept[key]


# Training ----------------------------------------------------------------------------------


def _count_words(docs: DataFrame, model: Model) -> Model:
    def count(batches):
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return _blocks(_word_part(h, model.words), h, c.astype(np.uint64))

        for batch in batches:
            for tokens, _ in _texts(batch.column(0)):
                held.append(tokens)
                n += len(tokens)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        h, c = _merged(table, np.uint64)
        _write(model.file("word", part), h)
        _write(model.file("count", part), c)
        return pa.table({"part": pa.array([part], pa.int32()), "types": pa.array([len(h)], pa.int64()), "tokens": pa.array([c.sum()], pa.int64()), "ends": pa.array([c[h == END].sum()], pa.int64())})

    blocks = _gathered(docs.mapInArrow(count, _BLOCK), _steps(model.bytes // BLOCK_BYTES))
    rows = blocks.groupBy("part").applyInArrow(merge, "part int, types long, tokens long, ends long").collect()  # one row per part
    model.sizes = [0] * model.words
    for r in rows:
        model.sizes[r.part] = r.types
        model.tokens += r.tokens
        model.documents += r.ends
    if model.vocabulary >= 2**32 - 1:
        raise ValueError("more than 2**32 word types")
    return model


def _discounts(n: Iterable[int]) -> tuple[float, float, float]:
    """From the numbers of types seen once to four times; halves where they say nothing."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0
    made = [k - (k + 1) * y * b / a if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(made, 1))


def _pair_ids(words: _Words, tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each token and of the one before it; before a text stands the id after the last word's."""
    ids = words.ids(tokens)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[off[:-1]] = words.model.vocabulary
    return before, ids


def _two_before(before: np.ndarray, off: np.ndarray, begin: int) -> np.ndarray:
    """Ids of the tokens before those before; the id before a text stands there twice."""
    out = np.empty_like(before)
    out[1:] = before[:-1]
    out[off[:-1]] = begin
    return out


def _packed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)


def _unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _triple_keys(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of triples from packed contexts and last ids."""
    return text.mix(context ^ text.mix(last.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _word_counts(words: _Words, first: np.ndarray) -> np.ndarray:
    """Training counts of the first ids of pairs (sorted, distinct or not), which divide large contexts among shards."""
    distinct, back = np.unique(first, return_inverse=True)
    inside = distinct < words.model.vocabulary
    out = np.full(len(distinct), float(words.model.documents))
    out[inside] = words.of(words.counts, distinct[inside])
    return out[back]


def _pair_blocks(words: _Words, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    first, second = _unpacked(keys)
    return _blocks(_pair_part(first, second, _word_counts(words, first), words.model.pairs), keys, counts)


def _by_count(c: np.ndarray) -> np.ndarray:
    """Columns: is the count one, two, three or more?"""
    return np.stack([c == 1, c == 2, c >= 3], 1).astype(np.int64)


def _first_counts(c: np.ndarray) -> list[int]:
    return [int((c == x).sum()) for x in (1, 2, 3, 4)]


_SIDES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("once", T.ArrayType(T.LongType()))])


def _as_sides(parts: np.ndarray, keys: np.ndarray, values: np.ndarray, once: list[int]) -> pa.Table:
    """Blocks of sorted keys and rows of values for each part; once goes with the first."""
    order = np.argsort(parts, kind="stable")
    parts, keys, values = parts[order], keys[order], values[order]
    edge = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])) if len(parts) else np.zeros(1, np.int64)
    spans = list(zip(edge[:-1], edge[1:], strict=True))
    pack = lambda x: _pack(np.ascontiguousarray(x).astype(np.uint64).ravel(), False)  # noqa: E731  most of the eight bytes are zero and compress away
    return pa.table({"part": pa.array([int(parts[a]) for a, _ in spans], pa.int32()), "n": pa.array([b - a for a, b in spans], pa.int32()), "keys": pa.array([_pack(keys[a:b], True) for a, b in spans], pa.binary()), "counts": pa.array([pack(values[a:b]) for a, b in spans], pa.binary()), "once": pa.array([once if not k else None for k in range(len(spans))], pa.list_(pa.int64()))})


def _sums_of(around: DataFrame) -> tuple[float, float, float]:
    """The discounts that the numbers of types in once give."""
    return _discounts(around.where("once IS NOT NULL").agg(*(F.coalesce(F.sum(F.col("once")[k]), F.lit(0)) for k in range(4))).first())


def _count_triples(docs: DataFrame, model: Model) -> DataFrame:
    """Write the triples; for each pair, in blocks: as a context, its count and how many triples are seen once, twice, more; as an end, its triples."""
    model.triples = max(4, -(-model.tokens // SHARD))

    def count(batches):
        words = _once(model.path + "|words", lambda: _Words(model))
        held, n = [], 0

        def flush():
            uv, w = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((w, uv))
            uv, w = uv[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (uv[1:] != uv[:-1]) | (w[1:] != w[:-1])]))
            uv, w, c = uv[first], w[first], np.diff(np.concatenate([first, [len(uv)]])).astype(np.uint32)
            part = (_triple_keys(uv, w) % np.uint64(model.triples)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            uv, w, c, part = uv[order], w[order], c[order], part[order]
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            spans = list(zip(edge[:-1], edge[1:], strict=True))
            packed = lambda x, sort: pa.array([_pack(x[a:b], sort) for a, b in spans], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array([b - a for a, b in spans], pa.int32()), packed(uv, True), packed(w, False), packed(c, False)], ["part", "n", "contexts", "lasts", "counts"])

        for batch in batches:
            for tokens, off in _texts(batch.column(0)):
                before, ids = _pair_ids(words, tokens, off)
                held.append((_packed(_two_before(before, off, model.vocabulary), before), ids.astype(np.uint32)))
                n += len(ids)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        words, part = _once(model.path + "|words", lambda: _Words(model)), table["part"][0].as_py()
        rows = table.select(["n", "contexts", "lasts", "counts"]).to_pylist()
        joined = lambda name, kind, sort: np.concatenate([_unpack(r[name], r["n"], kind, sort) for r in rows])
        uv, w, c = joined("contexts", np.uint64, True), joined("lasts", np.uint32, False), joined("counts", np.uint32, False).astype(np.int64)
        order = np.lexsort((w, uv))
        uv, w, c = uv[order], w[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (uv[1:] != uv[:-1]) | (w[1:] != w[:-1])]))
        uv, w, c = uv[first], w[first], np.add.reduceat(c, first)
        keys = _triple_keys(uv, w)
        order = np.argsort(keys)
        _write(model.file("triple", part), keys[order])
        _write_counts(model.file("triples", part), c[order])
        starts = np.column_stack([c, _by_count(c), np.zeros(len(c), np.int64)])
        ends = np.tile(np.array([0, 0, 0, 0, 1], np.int64), (len(c), 1))
        pairs, values = _summed(np.concatenate([uv, _packed(uv & np.uint64(0xFFFFFFFF), w)]), np.concatenate([starts, ends]))
        a, b = _unpacked(pairs)
        return _as_sides(_pair_part(a, b, _word_counts(words, a), model.pairs), pairs, values, _first_counts(c))

    around = scratch.table(docs.mapInArrow(count, "part int, n int, contexts binary, lasts binary, counts binary").groupBy("part").applyInArrow(merge, _SIDES), "triples")
    model.top = _sums_of(around)
    return around.drop("once")


def _count_pairs(docs: DataFrame, model: Model) -> Model:
    model.pairs = max(4, -(-model.tokens // SHARD))
    top = model.order == 2

    def count(batches):
        words = _once(model.path + "|words", lambda: _Words(model))
        held, n = [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            return _pair_blocks(words, k, c.astype(np.uint32))

        for batch in batches:
            for tokens, off in _texts(batch.column(0)):
                held.append(_packed(*_pair_ids(words, tokens, off)))
                n += len(held[-1])
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    start = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)

    def merge(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        k, c = _merged(table, np.uint32 if top else np.uint64, 1 if top else 5)
        if not top:
            _write(model.file("context", part), k)
            _write(model.file("contexts", part), np.ascontiguousarray(c[:, :4]).astype(np.int64))
            k, c = k[c[:, 4] > 0], c[c[:, 4] > 0, 4]
        _write(model.file("pair", part), k)
        _write_counts(model.file("pairs", part), c)
        # What the words of this shard's pairs need to know: as contexts, pairs counted once, twice, more, and all counts; as followers, pairs.
        first, second = k >> np.uint64(32), k & np.uint64(0xFFFFFFFF)
        before = np.column_stack([_by_count(c), np.zeros(len(c), np.int64), c])
        after = np.tile(np.array([0, 0, 0, 1, 0], np.int64), (len(c), 1))
        ids, values = _summed(np.concatenate([first, second]), np.concatenate([before, after]))
        at = np.minimum(np.searchsorted(start, ids.astype(np.int64), "right") - 1, model.words)
        return _as_sides(at, ids, values, _first_counts(c))

    blocks = docs.mapInArrow(count, _BLOCK) if top else _count_triples(docs, model)
    around = scratch.table(blocks.groupBy("part").applyInArrow(merge, _SIDES), "pairs")
    model.discounts = _sums_of(around)

    def sides_of(table: pa.Table) -> pa.Table:
        """For each word of a part: contexts' kinds of pairs (3 numbers), the number of words before it, and its count as a context."""
        part = table["part"][0].as_py()
        ids, values = _merged(table, np.uint64, 5)
        low, size = (int(start[part]), model.sizes[part]) if part < model.words else (model.vocabulary, 1)
        full = np.zeros((size, 5), np.int64)
        full[ids.astype(np.int64) - low] = values
        _write(model.file("side", part), full)
        seen = full[:, 3]
        return pa.table({"n": pa.array([[*_first_counts(seen), int((seen > 2).sum()), int(seen.sum())]], pa.list_(pa.int64()))})

    lower = _gathered(around, _steps(model.pairs), 5).groupBy("part").applyInArrow(sides_of, "n array<long>").agg(*(F.coalesce(F.sum(F.col("n")[k]), F.lit(0)) for k in range(6))).first()
    model.lower, model.types = _discounts(lower[:4]), lower[5]
    d = model.lower
    model.lower_left = (d[0] * lower[0] + d[1] * lower[1] + d[2] * lower[4]) / lower[5] if lower[5] else 1.0
    return model


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """A model of all texts of docs; null counts as empty, and no rows give a model without words."""
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    spark = docs.sparkSession
    slim = docs.select(text_col)
    size = slim.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), math.isqrt(size >> 20))
    model = Model(scratch.new_dir(spark, "ngrams"), parts, order, size)
    return _count_pairs(slim, _count_words(slim, model))


# Scoring -----------------------------------------------------------------------------------


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, _once(model.path + "|words", lambda: _Words(model))
        self.side = [_map(model.file("side", p), np.int64).reshape(-1, 5) if n else np.zeros((0, 5), np.int64) for p, n in enumerate(model.sizes)]
        self.begin = _map(model.file("side", model.words), np.int64).reshape(-1, 5) if model.documents else np.zeros((1, 5), np.int64)
        self.shards: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

    def _shard(self, kind: str, p: int) -> tuple[np.ndarray, np.ndarray]:
        if (kind, p) not in self.shards:
            keys = _map(self.model.file(kind, p), np.uint64)  # none, if nothing fell into this shard
            name = self.model.file(kind + "s", p)
            self.shards[kind, p] = keys, _map(name, np.int64).reshape(-1, 4) if kind == "context" else _map_counts(name, len(keys))
        return self.shards[kind, p]

    def _found(self, kind: str, keys: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
        """The values of keys in the shards of a kind, zero where they are not."""
        out = np.zeros((len(keys), 4) if kind == "context" else len(keys), np.int64)
        order = np.argsort(part, kind="stable")
        asked = keys[order]
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.unique(part):
            a, b = edge[p], edge[p + 1]
            have, values = self._shard(kind, int(p))
            if len(have):
                at = np.minimum(np.searchsorted(have, asked[a:b]), len(have) - 1)
                hit = have[at] == asked[a:b]
                out[order[a:b][hit]] = values[at[hit]]
        return out

    def _of_pairs(self, kind: str, keys: np.ndarray) -> np.ndarray:
        """Values of packed pairs of known ids, sorted and distinct."""
        first, second = _unpacked(keys)
        return self._found(kind, keys, _pair_part(first, second, _word_counts(self.words, first), self.model.pairs), self.model.pairs)

    def score(self, tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each document."""
        m, words = self.model, self.words
        before, ids = _pair_ids(words, tokens, off)
        # Words: counts, and probabilities of the lowest order.
        distinct, back = np.unique(ids, return_inverse=True)
        known = distinct >= 0
        c, seen = np.zeros(len(distinct)), np.zeros(len(distinct))
        if known.any():
            c[known] = words.of(words.counts, distinct[known])
            seen[known] = words.of(self.side, distinct[known])[:, 3]
        cut = np.array([0.0, *m.lower])[np.minimum(seen, 3).astype(np.int64)]
        low = np.maximum(seen - cut, 0) / max(m.types, 1) + m.lower_left / (m.vocabulary + 1)
        base = np.log10((c + 1) / (m.tokens + m.vocabulary + 1))
        # Contexts of one word: counts, and what their discounts leave.
        contexts, context = np.unique(before, return_inverse=True)
        at = contexts >= 0
        sides = np.zeros((len(contexts), 5))
        if at.any():
            inner = at & (contexts < m.vocabulary)
            sides[inner] = words.of(self.side, contexts[inner])
            sides[at & ~inner] = self.begin[0]
        count, left = sides[:, 4], np.ones(len(contexts))
        used = count > 0
        left[used] = sides[used, :3] @ np.array(m.discounts) / count[used]
        # Pairs.
        p = left[context] * low[back]
        both = np.flatnonzero((ids >= 0) & (before >= 0) & used[context])
        if len(both):
            key, pair = np.unique(_packed(before[both], ids[both]), return_inverse=True)
            n = self._of_pairs("pair", key)
            gain = np.maximum(n - np.array([0.0, *m.discounts])[np.minimum(n, 3)], 0)
            p[both] += gain[pair] / count[context[both]]
        if m.order == 3:
            p = self._of_triples(before, ids, off, p)
        sums = lambda x: np.add.reduceat(x, off[:-1]) if len(off) > 1 else x[:0]
        return sums((ids >= 0).astype(np.int64)), sums(base[back]), sums(np.log10(p))

    def _of_triples(self, before: np.ndarray, ids: np.ndarray, off: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities after two words, from those after one."""
        m = self.model
        earlier = _two_before(before, off, m.vocabulary)
        here = np.flatnonzero((earlier >= 0) & (before >= 0))
        if not len(here):
            return p
        keys, context = np.unique(_packed(earlier[here], before[here]), return_inverse=True)
        about = self._of_pairs("context", keys).astype(np.float64)
        seen = about[context, 0] > 0
        here, context = here[seen], context[seen]
        total = about[context, 0]
        left = about[context, 1:] @ np.array(m.top) / total
        gain = np.zeros(len(here))
        known = np.flatnonzero(ids[here] >= 0)
        if len(known):
            triples, back = np.unique(_triple_keys(keys[context[known]], ids[here[known]]), return_inverse=True)
            n = self._found("triple", triples, (triples % np.uint64(m.triples)).astype(np.int64), m.triples)
            gain[known] = np.maximum(n - np.array([0.0, *m.top])[np.minimum(n, 3)], 0)[back]
        out = p.copy()
        out[here] = gain / total + left * p[here]
        return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_tokens, n_known, train_tokens, base_score, score and perplexity for every row of docs.

    The tokens of a text are its words, A-Z lower-cased, and one end; a null
    text has the end alone, and texts of any length are scored whole.  score is
    the log10 probability of the tokens, base_score that of an add-one unigram
    model of the same training texts.  Rows with equal or null ids are all
    scored, each on its own; an empty table gives no rows, and other columns of
    docs, whatever their names, take no part.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), *carry, text_col)
    at = 1 + len(carry)

    def run(batches):
        scorer = _once(model.path + "|scorer", lambda: _Scorer(model))
        for batch in scratch.cut(batches):
            n, known, base, own = [], [], [], []
            for tokens, off in _texts(batch.column(at)):
                k, b, s = scorer.score(tokens, off)
                n.append(np.diff(off)), known.append(k), base.append(b), own.append(s)
            if n:
                n, known, base, own = map(np.concatenate, (n, known, base, own))
                made = [n.astype(np.int64), known, np.full(len(n), model.tokens, np.int64), base, own, 10.0 ** (-own / n)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *map(pa.array, made)], [*batch.schema.names[:at], "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    types = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("perplexity", T.DoubleType())]
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[:at], *(T.StructField(k, t) for k, t in types)]))


def held_out_scores(docs: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Scores of all documents under a model of those outside one fold; held_out marks the fold.

    The fold of a document is crc32 of its id as text, so rows with equal ids
    are in one fold; a null id is in none.  Without training texts every token
    is unknown; an empty table gives no rows.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).alias("doc_id"), out, F.col(text_col).alias("text"))
    model = train(rows.where("NOT held_out"), order=order)
    return score(rows, model, carry=("held_out",))
