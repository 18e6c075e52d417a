"""Benchmark decontamination: winnowed fingerprints, joined and extended to whole spans.

A window is a run of ``length`` words of an item (of all its words, if it has
fewer).  Of the GRAM-word grams of each window the right-most least hash is its
fingerprint, so any text that has the window has the fingerprint at the same
place in it, and every shared span of ``length`` words is found.

1. Fingerprints of the items' windows are a table; a bitmap of fixed size over
   them is the only thing that is broadcast whatever the size of the benchmark.
2. One pass over the documents keeps the fingerprints that the bitmap lets
   through, each with the windows around it.  Texts with equal words are one.
3. Fingerprints of documents and items are joined; what is left is extended to
   the windows on both sides of the fingerprint, which are joined to those of
   the items by two 64-bit hashes.  Overlapping windows grow together to spans.
4. Texts that share the same windows have the same items, which are gathered
   once for each different set of windows.

Rows follow the occurrences of fingerprints, never pairs of documents and items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, text

GRAM = 5
BITS = 1 << 25  # of the bitmap: 4 MiB
_PART = 1 << 18
_MULT = np.random.default_rng(0xC0DE).integers(0, 2**64, (2, 64), dtype=np.uint64) | np.uint64(1)

BETWEEN = np.ones(256, bool)
BETWEEN[0x30:0x3A] = BETWEEN[0x61:0x7B] = BETWEEN[0x80:] = False

_FOUND = "doc_id long, n_words long, s1 long, s2 long, fp long, start long, size int, h1 long, h2 long"
_NONE = {"n_hit": "0L", "spans": "CAST(array() AS array<struct<start:bigint,end:bigint>>)", "items": "CAST(array() AS array<string>)"}


def _runs(h: np.ndarray, starts: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of the n values of h from each start; ``which`` tells two independent hashes apart."""
    total = np.full(len(starts), n, np.uint64)
    for k in range(n):
        total += h[starts + k] * _MULT[which, k % 64]
        if k % 64 == 63:
            total = text.mix(total)
    return text.mix(total)


def _windows(h: np.ndarray, end: np.ndarray, length: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in lo..hi of the windows within one text, whose last word is before end, and their fingerprints."""
    starts = np.arange(lo, hi)
    starts = starts[starts + length <= end[lo:hi]]
    if length <= GRAM or not len(starts):
        return starts, _runs(h, starts, length)
    width = length - GRAM + 1
    grams = _runs(h, np.arange(starts[0], starts[-1] + width), GRAM)
    at = starts - starts[0]
    best = grams[at]
    for k in range(1, width):
        np.minimum(best, grams[at + k], out=best)
    return starts, best


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, each text's offset into them) of runs of texts, A-Z lower-cased."""
    for lo, _, buf, off in text.slices(column):
        buf = text.LOWER[buf]
        starts, ends, at = text.words(buf, off, BETWEEN)
        yield lo, text.hash_spans(buf, starts, ends), at


def _digest(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(np.ascontiguousarray(h).tobytes())
    return text.signed(d >> 64), text.signed(d & (2**64 - 1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _item_windows(items: DataFrame, length: int) -> DataFrame:
    """Every window of every item: item_id, i1, i2 (a digest of the item's words), fp, size, h1, h2."""

    def run(batches):
        for batch in scratch.cut(batches):
            for first, h, at in _texts(batch.column(1)):
                for d in range(len(at) - 1):
                    words = h[at[d] : at[d + 1]]
                    size = min(length, len(words))
                    i1, i2 = _digest(words)
                    for lo in range(0, len(words) - size + 1 if size else 0, _PART):
                        hi = min(lo + _PART, len(words) - size + 1)
                        starts, fp = _windows(words, np.full(len(words), len(words)), size, lo, hi) if size == length else (np.array([0]), _runs(words, np.array([0]), size))
                        n = len(starts)
                        ids = batch.column(0).take(pa.array(np.full(n, first + d)))
                        same = [pa.array(np.full(n, x, np.int64)) for x in (i1, i2)]
                        yield pa.RecordBatch.from_arrays([ids, *same, _signed(fp), pa.array(np.full(n, size, np.int32)), _signed(_runs(words, starts, size)), _signed(_runs(words, starts, size, 1))], ["item_id", "i1", "i2", "fp", "size", "h1", "h2"])

    return items.mapInArrow(run, "item_id long, i1 long, i2 long, fp long, size int, h1 long, h2 long")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """BITS bits, of which those at the fingerprints (modulo BITS) are set; its size does not depend on their number."""
    place = prints.select(F.col("fp").bitwiseAND(F.lit(BITS - 1)).alias("p"))
    found = place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _candidates(docs: DataFrame, length: int, short: list[int], bitmap) -> DataFrame:
    """A row for each document (fp null), and one for each of its windows whose fingerprint passes the bitmap.

    doc_id, n_words, s1 and s2 (a digest of the text's words, null without candidates), fp, start, size, h1, h2.
    """

    def rows(n: int, **columns) -> pa.RecordBatch:
        kinds = {"size": pa.int32()}
        names = [f.split()[0] for f in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, kinds.get(k, pa.int64())) for k in names], names)

    def run(batches):
        bits = bitmap.value
        for batch in scratch.cut(batches):
            n_words, s1, s2 = np.zeros(len(batch), np.int64), [None] * len(batch), [None] * len(batch)
            for first, h, at in _texts(batch.column(1)):
                counts = np.diff(at)
                n_words[first : first + len(counts)] = counts
                end = np.repeat(at[1:], counts)
                for size in (*short, length):
                    for lo in range(0, len(h), _PART):
                        starts, fp = _windows(h, end, size, lo, min(lo + _PART, len(h))) if size == length else _short(h, end, size, lo, min(lo + _PART, len(h)))
                        place = fp & np.uint64(BITS - 1)
                        some = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
                        if not some.any():
                            continue
                        starts, fp = starts[some], fp[some]
                        doc = np.searchsorted(at, starts, "right") - 1
                        for d in np.unique(doc):
                            if s1[first + d] is None:
                                s1[first + d], s2[first + d] = _digest(h[at[d] : at[d + 1]])
                        keys = {k: pa.array([s[first + d] for d in doc], pa.int64()) for k, s in (("s1", s1), ("s2", s2))}
                        yield rows(len(doc), **keys, fp=_signed(fp), start=pa.array(starts - at[doc]), size=pa.array(np.full(len(doc), size, np.int32)), h1=_signed(_runs(h, starts, size)), h2=_signed(_runs(h, starts, size, 1)))
            yield rows(len(batch), doc_id=batch.column(0), n_words=pa.array(n_words), s1=pa.array(s1, pa.int64()), s2=pa.array(s2, pa.int64()))

    return docs.mapInArrow(run, _FOUND)


def _short(h: np.ndarray, end: np.ndarray, size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """As _windows, for items of fewer words, whose whole run is the fingerprint."""
    starts = np.arange(lo, hi)
    starts = starts[starts + size <= end[lo:hi]]
    return starts, _runs(h, starts, size)


def scan(docs: DataFrame, items: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans, items and contaminated for every row of docs.

    spans are the ranges of words (start, end; apart and ascending) covered by
    windows of items, n_hit their words, items the ids of the items with such
    windows, as strings in their order.  Words are runs of ASCII letters and
    digits (A-Z lower-cased) and of all characters beyond ASCII.

    A null or wordless text has no words, as a document and as an item.  Rows
    with a null or repeated doc_id are judged each by their own text; items
    with a null id mark words and are not listed, and items of one id are
    listed once.  Texts are read whole, whatever their length.  An empty table
    of items leaves all documents clean, one of documents gives no rows; other
    columns, whatever their names, take no part.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM} words")
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = scratch.table(_item_windows(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")), length), "windows")
    short = sorted(r.size for r in bench.where(F.col("size") < length).select("size").distinct().collect())  # at most length - 1
    seen = scratch.table(_candidates(slim, length, short, spark.sparkContext.broadcast(_bitmap(bench))), "candidates")
    where = ["s1", "s2", "start", "size"]
    window = ["size", "h1", "h2"]
    # Fingerprints first, then the windows around them.
    hits = seen.where("fp IS NOT NULL").select(*where, "fp", "h1", "h2").distinct().join(bench.select("fp").distinct(), "fp", "left_semi")
    matches = scratch.table(hits.join(bench.select(*window).distinct(), window, "left_semi").select(*where, "h1", "h2"), "matches")
    return _assembled(seen, matches, bench, window)


def _assembled(seen: DataFrame, matches: DataFrame, bench: DataFrame, window: list[str]) -> DataFrame:
    one = ["s1", "s2"]
    before = Window.partitionBy(*one).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    ranges = matches.select(*one, "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    ranges = ranges.withColumn("apart", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)).withColumn("span", F.sum("apart").over(upto))
    spans = ranges.groupBy(*one, "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(*one).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # Texts with the same windows have the same items.
    kind = ["n", "x", "y"]
    sets = matches.select(*one, *window).distinct().groupBy(*one).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h1", "h2", "size")).alias("x"), F.bit_xor(F.xxhash64("size", "h2", "h1")).alias("y"))
    first = sets.groupBy(*kind).agg(F.min(F.struct(*one)).alias("t")).select(*kind, "t.s1", "t.s2")
    item = ["i1", "i2"]
    listed = matches.select(*one, *window).distinct().join(first, one).select(*kind, *window)
    listed = listed.join(bench.select(*window, *item).distinct(), window).select(*kind, *item).distinct()
    listed = listed.join(bench.where("item_id IS NOT NULL").select("item_id", *item).distinct(), item)
    items = listed.groupBy(*kind).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    judged = scratch.table(spans.join(sets, one).join(items, kind, "left").select(*one, "n_hit", "spans", "items"), "judged")
    rows = seen.where("fp IS NULL")
    dirty = rows.where("s1 IS NOT NULL").join(judged, one, "left").selectExpr("doc_id", "n_words", *(f"coalesce({k}, {v}) {k}" for k, v in _NONE.items()))
    clean = rows.where("s1 IS NULL").selectExpr("doc_id", "n_words", *(f"{v} {k}" for k, v in _NONE.items()))
    return clean.unionByName(dirty).withColumn("contaminated", F.col("n_hit") > 0)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the items' ids, joined by commas) and contaminated; the rest is as in scan."""
    return scan(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")
