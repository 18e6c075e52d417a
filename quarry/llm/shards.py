"""Contiguous shards of nearly equal bytes over atomic groups of equal texts.

Groups are ordered by the first 60 bits of the md5 of their text.  The smallest capacity for
which a greedy pass fits the groups into the shards is found by binary search;
the shards are then cut at that capacity.  The driver never sees the groups:
it sees sums over ranges of hashes, and asks for finer ranges only where a cut
can fall, until the answer is exact.  Groups larger than an even share of what
is left get shards of their own first.

Only DataFrame functions are used.
"""

from __future__ import annotations

import bisect
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import scratch

BITS, FIRST_BITS, STEP_BITS = 60, 12, 8


def key(c: Column) -> Column:
    """The first bits of an md5, which other engines have, too."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


class Segment(NamedTuple):
    """The groups whose hash lies in a range: low is the smallest hash, atomic says that there is one group."""

    low: int
    high: int
    bytes: int
    shift: int

    @property
    def atomic(self) -> bool:
        return self.low == self.high


class Plan(NamedTuple):
    capacity: int
    cuts: list[int]  # the smallest hash of each contiguous shard but the first
    own: list[int]  # hashes of groups with a shard of their own, from the last shard down
    shards: int


def _sums(rows: DataFrame, shift: int) -> list[Segment]:
    by = rows.groupBy(F.shiftright("h", shift).alias("p")).agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("size").alias("b"))
    return sorted(Segment(r.low, r.high, r.b, shift) for r in by.collect())


def _refine(rows: DataFrame, segments: list[Segment], wanted: set[int]) -> list[Segment]:
    """segments with those at the wanted places replaced by finer ones."""
    out = [s for i, s in enumerate(segments) if i not in wanted]
    for shift in {segments[i].shift for i in wanted}:
        prefixes = [segments[i].low >> shift for i in wanted if segments[i].shift == shift]
        out += _sums(rows.where(F.shiftright("h", shift).isin(prefixes)), max(0, shift - STEP_BITS))
    return sorted(out)


def _walk(cum: list[int], segments: list[Segment], capacity: int, shards: int, hopeful: bool, base: int = 0) -> tuple[bool, list[int]]:
    """Greedy filling: does it fit, and the places of the segments in which it cuts.

    A segment of several groups can be cut somewhere inside: hopeful takes the
    best place that could exist, otherwise its start is taken.
    """
    hit = []
    for _ in range(shards):
        limit = base + capacity
        if limit >= cum[-1]:
            return True, hit
        i = bisect.bisect_right(cum, limit) - 1
        hit.append(i)
        base = limit if hopeful and not segments[i].atomic else cum[i]
    return base >= cum[-1], hit


def _least(cum: list[int], segments: list[Segment], shards: int, hopeful: bool) -> int:
    lo, hi = -(-cum[-1] // shards), cum[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        if _walk(cum, segments, mid, shards, hopeful)[0]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def plan(rows: DataFrame, shards: int) -> Plan:
    """The cuts for rows with a group hash h (long) and a size (long)."""
    segments = _sums(rows, BITS - FIRST_BITS)
    own: list[int] = []
    while segments and shards - len(own) > 1:
        share = sum(s.bytes for s in segments) / (shards - len(own))
        large = {i for i, s in enumerate(segments) if s.bytes > share}
        if not large:
            break
        if vague := {i for i in large if not segments[i].atomic}:
            segments = _refine(rows, segments, vague)
            continue
        top = max(large, key=lambda i: segments[i].bytes)
        own.append(segments.pop(top).low)
    left = shards - len(own)
    while True:
        cum = [0, *accumulate(s.bytes for s in segments)]
        low, high = (_least(cum, segments, left, hopeful) for hopeful in (True, False))
        wanted: set[int] = set()
        if low < high:
            for capacity in (low, high - 1, high):
                early, late = (_walk(cum, segments, capacity, left, hopeful)[1] for hopeful in (False, True))
                for a, b in zip(early, late, strict=False):
                    wanted |= set(range(min(a, b), max(a, b) + 1))
                wanted |= {*early, *late}
            wanted = {i for i in wanted if not segments[i].atomic}
        if not wanted:
            cuts, wanted = _cut(cum, segments, high, left)
            if not wanted:
                return Plan(high, cuts, own, shards)
        segments = _refine(rows, segments, wanted)


def _cut(cum: list[int], segments: list[Segment], capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """First hashes of the shards after the first.

    Each shard ends at the boundary nearest to an even share of what is left,
    within the capacity and as long as the rest still fits; else as far as the
    capacity goes.  Also returns segments that must be known better.
    """
    base, cuts = 0, []
    for left in range(shards, 1, -1):
        if base >= cum[-1]:
            break
        even = base + (cum[-1] - base) / left
        i = bisect.bisect_right(cum, even) - 1
        far = bisect.bisect_right(cum, base + capacity) - 1
        if vague := {k for k in (i, far) if k < len(segments) and not segments[k].atomic}:
            return [], vague
        near = i + (i + 1 < len(cum) and cum[i + 1] - even < even - cum[i])
        choices = [k for k in (near, i, far) if base < cum[k] <= base + capacity]
        k = next((k for k in choices if _walk(cum, segments, capacity, left - 1, False, cum[k])[0]), far)
        if k >= len(segments):
            break
        cuts.append(segments[k].low)
        base = cum[k]
    return cuts, set()


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of docs.

    A null text counts as empty; texts of any length are hashed whole.  Equal
    texts share a shard; slots run from 0 without gaps in every shard, in the
    order of the md5 of the ids.  Rows with equal or null ids are all kept.  An
    empty table gives no rows; other columns of docs, whatever their names,
    take no part.
    """
    spark = docs.sparkSession
    body, doc = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), key(body).alias("h"), key(doc).alias("place"))
    rows = scratch.table(rows, "shards")
    p = plan(rows, shards)
    shard = sum((F.when(F.col("h") >= F.lit(c), 1).otherwise(0) for c in p.cuts), F.lit(0))
    for k, h in enumerate(p.own):
        shard = F.when(F.col("h") == F.lit(h), shards - 1 - k).otherwise(shard)
    # Slots are counted in ranges of places, of which there are enough for a task's share to stay small.
    parts = max(64, min(16384, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "place", F.shiftright("place", BITS - parts.bit_length()).alias("part"))
    counts = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("place", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("n") - 1).cast("long").alias("slot"))
