"""Repeated passages across documents: seed and extend on winnowed anchors.

Every window of ``length`` words has one anchor, the right-most of the least
hashes of its SEED-word grams, which is the same in every document that has
the window.  So two documents that share a window share an anchor at the same
place in it.

1. Seeds: all anchors of all documents, each with a hash of its surroundings:
   as many words on both sides as any window around the anchor can have.
2. Join on anchors.  Occurrences with equal surroundings agree as far as these
   reach: all but the one in the least document are repeats over them.
3. Where the surroundings of an anchor differ between documents, one occurrence
   of each kind is extended word by word to both sides against the one in the
   anchor's least document; the maximal common span is a repeat if it has
   ``length`` words.
4. Two other occurrences can share more with each other than with the least
   one: then they leave it at the same place with the same next word.  Only
   occurrences that share this word with another document are extended window
   by window, and windows are joined on their hashes.
5. What is covered is put together to maximal spans for each document.

The number of rows grows with the number of occurrences, never with that of
pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, text

SEED = 16
GROUP = 256  # occurrences of an anchor that are extended in one group, about
_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 65536)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class _Spans:
    """Hashes of any runs of words of one document."""

    def __init__(self, h: np.ndarray):
        up, self.down = _power(len(h) + 1)
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return text.mix((self.total[end] - self.total[start]) * self.down[start])


def anchors(h: np.ndarray, length: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a document of word hashes h."""
    if len(h) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = text.grams(h, seed)
    width = length - seed + 1
    view = np.lib.stride_tricks.sliding_window_view(g, width)
    at = np.arange(len(view)) + width - 1 - np.argmin(view[:, ::-1], axis=1)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, g[at]


def _documents(column: pa.Array):
    """(index, word hashes) of each text."""
    for lo, _, buf, off in text.slices(column):
        starts, ends, at = text.words(buf, off)
        h = text.hash_spans(buf, starts, ends)
        for i in range(len(off) - 1):
            yield lo + i, h[at[i] : at[i + 1]]


def _key(h: np.ndarray) -> int:
    """31 bits that tell texts of equal ids apart."""
    return text.sequence_hash(h) & 0x7FFFFFFF


def _seeds(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, anchor, around (hash of the surroundings), tag (key << 32 | place)."""
    reach = length - SEED

    def run(batches):
        for batch in scratch.cut(batches):
            ids = batch.column(0)
            owner, a, c, tag = [], [], [], []
            for i, h in _documents(batch.column(1)):
                at, g = anchors(h, length)
                if not len(at) or not ids[i].is_valid:
                    continue
                left, right = np.maximum(at - reach, 0), np.minimum(at + length, len(h))
                sides = (at - left) * 4096 + (right - at)
                owner.append(np.full(len(at), i))
                a.append(g)
                c.append(_Spans(h).of(left, right) ^ text.mix(sides.astype(np.uint64)))
                tag.append((_key(h) << 32) | at)
            if owner:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(owner))), *(pa.array(np.concatenate(x).view(np.int64)) for x in (a, c, tag))], ["doc_id", "anchor", "around", "tag"])

    return docs.mapInArrow(run, "doc_id long, anchor long, around long, tag long")


def _surroundings(docs: DataFrame, length: int) -> DataFrame:
    """Of rows (doc_id, text, todo: structs tag, anchor, parts, least) each occurrence with the words around it.

    anchor, salt, later (0: in the anchor's least document, whose occurrences go to all parts), doc_id, tag, left (words before the anchor), words (hashes).
    A task gives each occurrence once; Spark makes the copies for the parts, row by row.
    """
    reach = length - SEED

    def run(batches):
        for batch in scratch.cut(batches, 128):
            ids, todo = batch.column(0), batch.column(2)
            out: dict[str, list] = {k: [] for k in ("anchor", "salt", "parts", "later", "owner", "tag", "left", "words")}
            for i, h in _documents(batch.column(1)):
                key = _key(h)
                for r in todo[i].as_py():
                    at = r["tag"] & 0xFFFFFFFF
                    if r["tag"] >> 32 != key:
                        continue
                    low = max(at - reach, 0)
                    around = h[low : at + length].tobytes()
                    salt = text.mix(np.array([r["tag"] ^ ids[i].as_py() << 20], np.int64).view(np.uint64))[0] % np.uint64(r["parts"])
                    for k, v in zip(out, (r["anchor"], int(salt), r["parts"], int(not r["least"]), i, r["tag"], at - low, around), strict=True):
                        out[k].append(v)
            if out["tag"]:
                types = {"anchor": pa.int64(), "salt": pa.int32(), "parts": pa.int32(), "later": pa.int32(), "tag": pa.int64(), "left": pa.int32(), "words": pa.binary()}
                made = {k: ids.take(pa.array(v)) if k == "owner" else pa.array(v, types[k]) for k, v in out.items()}
                yield pa.RecordBatch.from_arrays(list(made.values()), ["anchor", "salt", "parts", "later", "doc_id", "tag", "left", "words"])

    once = docs.mapInArrow(run, "anchor long, salt int, parts int, later int, doc_id long, tag long, left int, words binary")
    salts = F.when(F.col("later") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("salt"))
    return once.select("anchor", F.explode(salts).alias("salt"), "later", "doc_id", "tag", "left", "words")


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """The number of leading values in which a and b agree."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def _extended(around: DataFrame, length: int) -> DataFrame:
    """doc_id, tag, start and end (of a repeat, else null), before and after: where and how an occurrence leaves the least one (null: not at all).

    The first occurrence of an anchor in its least document is held while the
    others of the group go by.
    """

    def leaves(anchor: int, side: int, n: int, words: np.ndarray) -> int | None:
        if n >= len(words):
            return None
        mixed = text.mix(np.array([anchor], np.int64).view(np.uint64) + np.uint64(2 * n + side)) ^ words[n : n + 1]
        return text.signed(int(text.mix(mixed)[0]))

    def run(batches):
        group, hub, hub_left, hub_doc = None, None, 0, 0
        for batch in batches:
            starts, ends, before, after = [], [], [], []
            for r in batch.to_pylist():
                words, left, at = np.frombuffer(r["words"], np.uint64), r["left"], r["tag"] & 0xFFFFFFFF
                if (r["anchor"], r["salt"]) != group:
                    group, hub, hub_left, hub_doc = (r["anchor"], r["salt"]), words, left, r["doc_id"]
                back = _same(words[:left][::-1], hub[:hub_left][::-1])
                on = _same(words[left:], hub[hub_left:])
                found = r["doc_id"] > hub_doc and back + on >= length
                starts.append(at - back if found else None)
                ends.append(at + on if found else None)
                before.append(leaves(r["anchor"], 0, back, words[:left][::-1]))
                after.append(leaves(r["anchor"], 1, on, words[left:]))
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), *(pa.array(x, pa.int64()) for x in (starts, ends, before, after))], ["doc_id", "tag", "start", "end", "before", "after"])

    grouped = around.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "later", "doc_id", "tag")
    return grouped.mapInArrow(run, "doc_id long, tag long, start long, end long, before long, after long")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """The windows around the tags of each document: doc_id, tag (key << 32 | start), window."""
    reach = length - SEED

    def run(batches):
        for batch in scratch.cut(batches, 128):
            ids, tags = batch.column(0), batch.column(2)
            owner, w, tag = [], [], []
            for i, h in _documents(batch.column(1)):
                key, t = _key(h), np.array(tags[i].as_py(), np.int64)
                at = t[t >> 32 == key] & 0xFFFFFFFF
                if not len(at):
                    continue
                inside = np.zeros(len(h) - length + 2, np.int64)  # +1 where windows around an anchor begin, -1 after them
                np.add.at(inside, np.maximum(at - reach, 0), 1)
                np.add.at(inside, np.minimum(at + 1, len(h) - length + 1), -1)
                s = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
                owner.append(np.full(len(s), i))
                w.append(_Spans(h).of(s, s + length))
                tag.append((key << 32) | s)
            if owner:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(owner))), *(pa.array(np.concatenate(x).view(np.int64)) for x in (tag, w))], ["doc_id", "tag", "window"])

    return docs.mapInArrow(run, "doc_id long, tag long, window long")


def repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ranges (array of structs key, start, end in words) of documents with words to remove.

    The ranges cover the windows of so many words that also start in a document
    with a smaller id; key tells documents of equal ids apart.  Ranges can
    overlap.  A document with a null id, a null text or fewer words has none.
    """
    if not SEED <= length <= 4095 - SEED:
        raise ValueError(f"length must be between {SEED} and {4095 - SEED} words")
    reach = length - SEED
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seeds = scratch.table(_seeds(slim, length), "seeds")
    kinds = seeds.groupBy("anchor", "around").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = kinds.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.count("*").alias("kinds")).where("lo < hi")
    kinds = scratch.table(kinds.join(shared.select("anchor", "kinds", "lo"), "anchor"), "kinds")
    # Repeats over all their surroundings, or in the least document of their kind and to be extended.
    found = seeds.join(kinds.select("anchor", "around", "least", "kinds", "lo"), ["anchor", "around"]).where("doc_id > least OR kinds > 1")
    found = scratch.table(found.select("doc_id", "tag", "anchor", (F.col("doc_id") > F.col("least")).alias("done"), F.ceil(F.col("kinds") / GROUP).cast("int").alias("parts"), (F.col("doc_id") == F.col("lo")).alias("least")), "found")
    place = F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF))
    key = F.shiftright("tag", 32)
    whole = found.where("done").select("doc_id", F.struct(key.alias("key"), F.greatest(place - reach, F.lit(0)).alias("start"), (place + length).alias("end")).alias("range"))
    todo = found.where("NOT done").groupBy("doc_id").agg(F.collect_set(F.struct("tag", "anchor", "parts", "least")).alias("todo"))
    extended = scratch.table(_extended(_surroundings(slim.join(todo, "doc_id").select("doc_id", "text", "todo"), length), length), "extended")
    spans = extended.where("start IS NOT NULL").select("doc_id", F.struct(key.alias("key"), "start", "end").alias("range"))
    # Two documents that leave the least one alike may have more in common than it.
    ways = extended.select("doc_id", "tag", F.explode(F.array("before", "after")).alias("way")).where("way IS NOT NULL")
    alike = ways.groupBy("way").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("way")
    more = ways.join(alike, "way").groupBy("doc_id").agg(F.collect_set("tag").alias("tags"))
    windows = scratch.table(_windows(slim.join(more, "doc_id").select("doc_id", "text", "tags"), length), "windows")
    least = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    later = windows.join(least, "window").where("doc_id > least")
    later = later.select("doc_id", F.struct(key.alias("key"), place.alias("start"), (place + length).alias("end")).alias("range"))
    return whole.unionByName(spans).unionByName(later).groupBy("doc_id").agg(F.collect_list("range").alias("ranges"))


def maximal(n: int, ranges: list[dict], key: int) -> np.ndarray:
    """A mask of the words in the ranges with this key."""
    edge = np.zeros(n + 1, np.int64)
    for r in ranges:
        if r["key"] == key:
            edge[min(r["start"], n)] += 1
            edge[min(r["end"], n)] -= 1
    return np.cumsum(edge)[:-1] > 0


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def remove(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", prefix: str = "_") -> DataFrame:
    """docs with n_words, n_removed, spans (removed ranges of words, start and end) and kept added, named with the prefix.

    kept is the text without the removed words: unchanged (null stays null) if
    none is removed, else the kept words joined by one space.  All rows stay,
    repeated ones, too; a document's rows with equal ids are judged by their
    own texts, and rows with a null id lose nothing.  Texts are searched whole.
    An empty table gives no rows.  A column of docs that has the name of an
    added one is refused (give a prefix).
    """
    extra = [T.StructField(prefix + "n_words", T.LongType()), T.StructField(prefix + "n_removed", T.LongType()), T.StructField(prefix + "spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField(prefix + "kept", T.StringType())]
    names = docs.columns
    if {f.name.lower() for f in extra} & {c.lower() for c in names}:
        raise ValueError("a column of the input has the name of an added one; give a prefix")
    found = scratch.table(repeats(docs, length, id_col, text_col), "repeats")
    p = scratch.unused(docs, "_quarry_r_")
    found = found.select(F.col("doc_id").alias(p + "id"), F.col("ranges").alias(p + "ranges"))
    joined = docs.join(found, docs[id_col] == found[p + "id"], "left").drop(p + "id")
    at = names.index(text_col)

    def run(batches):
        for batch in scratch.cut(batches, 128):
            ranges = batch.column(len(names))
            n, gone, spans, kept = [], [], [], []
            for x, r in zip(batch.column(at), ranges, strict=True):
                raw = (x.as_py() or "").encode()
                ws = raw.split()
                n.append(len(ws))
                if not r.is_valid or not ws:
                    gone.append(0), spans.append([]), kept.append(x.as_py())
                    continue
                mask = maximal(len(ws), r.as_py(), _key(_hashes(raw)))
                gone.append(int(mask.sum()))
                spans.append(_spans(mask))
                kept.append(b" ".join(w for w, m in zip(ws, mask.tolist(), strict=True) if not m).decode() if mask.any() else x.as_py())
            made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [*names, *(f.name for f in extra)])

    return joined.mapInArrow(run, T.StructType(docs.schema.fields + extra))


def _hashes(raw: bytes) -> np.ndarray:
    buf = np.frombuffer(raw, np.uint8)
    starts, ends, _ = text.words(buf, np.array([0, len(buf)]))
    return text.hash_spans(buf, starts, ends)


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) for every row of docs.

    Null texts have no words; the rest is as in remove.  Other columns of docs,
    whatever their names, take no part.
    """
    removed = remove(docs.select("doc_id", "text"), length)

    def run(batches):
        for batch in scratch.cut(batches):
            d = {k: batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "_n_words", "_n_removed", "_kept")}
            sha = [hashlib.sha256(b" ".join((x.as_py() or "").encode().split())).hexdigest() for x in d["_kept"]]
            yield pa.RecordBatch.from_arrays([d["doc_id"], d["_n_words"], d["_n_removed"], pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removed.mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(k, T.LongType()) for k in ("n_words", "n_removed")), T.StructField("kept_sha256", T.StringType())]))
