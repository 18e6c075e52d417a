"""Tries of conversations' prefixes, by names for blocks of turns.

1. Naming: each different value gets one whole number, dense from 0, by a
   distinct table that is numbered partition by partition and joined back.
2. Turns are named by a SHA-256 of role and text.  Blocks of 2^k turns that
   begin at a multiple of 2^k are named by the pair of names of their halves,
   level by level.
3. A prefix of d turns is made of one block for each bit of d, the largest
   first.  From the largest blocks down, all prefixes whose least bit is 2^k
   are named by the pair (prefix without that bit, block): as many rounds as
   the longest length has bits.
4. A node is a name of prefixes of one depth.  Its smallest member represents
   it, and a (conversation, depth) represents one node at most.  So what is
   summed over a subtree is a sum over the node's members of sums along their
   own turns, from the node's depth on: of leaves that they represent, and of
   the code points of turns that they do not, which is what sharing saves.

Steps are joins and aggregations of rows of numbers, and range sorts where
turns have an order; none walks down the trie level by level, and no
conversation or node is gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

CHUNK = 4096  # ids that are put into one string, at most
_LOCAL = (1 << 33) - 1  # the part of monotonically_increasing_id() that counts within a partition
_NODE = ["depth", "name"]


def _counts(marked: DataFrame) -> list[tuple[int, int]]:
    """(partition, rows) of a table with a column mark of monotonically_increasing_id()."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for part, n in zip(*np.unique(batch.column(0).to_numpy() >> 33, return_counts=True), strict=True):
                seen[int(part)] = seen.get(int(part), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["part", "n"])

    total: dict[int, int] = {}
    for r in marked.select("mark").mapInArrow(run, "part long, n long").collect():  # a few rows for each partition
        total[r.part] = total.get(r.part, 0) + r.n
    return sorted(total.items())


def _named(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """rows with name, a whole number from 0 without gaps for each different key."""
    marked = scratch.table(rows.select(*key).distinct().withColumn("mark", F.monotonically_increasing_id()), "names")
    begun, upto = [], 0
    for part, n in _counts(marked):
        begun.append((part, upto))
        upto += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(begun or [(0, 0)], "part long, begun long"))
    dense = marked.withColumn("part", F.shiftright("mark", 33)).join(offsets, "part")
    dense = dense.select(*key, (F.col("begun") + F.col("mark").bitwiseAND(F.lit(_LOCAL))).alias("name"))
    return scratch.table(rows.join(dense, key), label)


def _prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, depth and name of every prefix of one turn or more of turns (conv_id, place from 1, digest)."""
    blocks = [_named(turns.select("conv_id", (F.col("place") - 1).alias("j"), "digest"), ["digest"], "blocks").select("conv_id", "j", "name")]
    odd = F.col("j").bitwiseAND(F.lit(1)) == 1
    while 2 ** len(blocks) <= longest:
        halves = blocks[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"))
        blocks.append(_named(halves.where("b IS NOT NULL"), ["a", "b"], "blocks").select("conv_id", "j", "name"))
    made = None
    for k in reversed(range(len(blocks))):
        last = blocks[k].where(~odd).select("conv_id", (F.col("j") * 2**k).alias("before"), F.col("name").alias("b"))
        pairs = last.where("before = 0").withColumn("a", F.lit(0).cast("long"))
        if made is not None:
            pairs = pairs.unionByName(last.where("before > 0").join(made.select("conv_id", F.col("depth").alias("before"), F.col("name").alias("a")), ["conv_id", "before"]))
        named = _named(pairs, ["before", "a", "b"], "prefixes").select("conv_id", (F.col("before") + 2**k).alias("depth"), "name")
        made = named if made is None else made.unionByName(named)
    return made


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and points of turns (conv_id, turn, role, text), by turn (null first), role and text.

    A null role or text is empty; points are the code points of the text.
    Rows with a null conv_id are left out.
    """
    t = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    t = t.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    t = scratch.table(t.select("conv_id", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), F.length("text").cast("long").alias("points"), F.monotonically_increasing_id().alias("seq")), "turns")
    # A conversation may lie in several partitions; in each, its rows are together.
    parts = t.groupBy("conv_id", F.shiftright("seq", 33).alias("part")).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part"))
    parts = parts.select("conv_id", "part", (upto - F.col("n") + 1 - F.col("first")).alias("shift"))
    return t.withColumn("part", F.shiftright("seq", 33)).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("seq") + F.col("shift")).alias("place"), "digest", "points")


def _from_there_on(rows: DataFrame, sums: list[str]) -> DataFrame:
    """rows (conv_id, depth) in which each of the columns is its sum over the conversation's rows from that depth on."""
    dealt = scratch.table(rows.repartitionByRange("conv_id", "depth").withColumn("part", F.spark_partition_id()), "dealt")
    later = Window.partitionBy("conv_id").orderBy(F.col("part").desc())
    parts = dealt.groupBy("conv_id", "part").agg(*(F.sum(c).alias(c + "_all") for c in sums))
    parts = parts.select("conv_id", "part", *((F.sum(c + "_all").over(later) - F.col(c + "_all")).alias(c + "_later") for c in sums))
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("depth").desc())
    local = dealt.withColumns({c: F.sum(c).over(within) for c in sums})
    return local.join(parts, ["conv_id", "part"]).select(*(c for c in rows.columns if c not in sums), *((F.col(c) + F.col(c + "_later")).alias(c) for c in sums))


def _hashed(ends: DataFrame) -> DataFrame:
    """depth, name and ends_sha256 (of the conv_ids, ascending, joined by commas).

    A range sort deals the ids of one node to as many tasks as they fill; each
    joins up to CHUNK of them, and only such strings pass through the node's
    one hash, as a stream.
    """

    def joined(batches):
        for batch in batches:
            depth, name, ids = (batch.column(k).to_numpy() for k in range(3))
            new = np.flatnonzero((depth[1:] != depth[:-1]) | (name[1:] != name[:-1])) + 1
            edges = np.concatenate([[0], new, [len(ids)]])
            cuts = sorted({*edges.tolist(), *(x for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > CHUNK for x in range(a, b, CHUNK))})
            text = list(map(str, ids.tolist()))
            at = cuts[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(depth[at]), pa.array(name[at]), pa.array(ids[at]), pa.array([",".join(text[a:b]) for a, b in zip(at, cuts[1:], strict=True)])], [*_NODE, "first", "ids"])

    def digest(batches):
        node, sha = None, None
        for batch in batches:
            out = []
            for depth, name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (depth, name) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = (depth, name), hashlib.sha256(ids.encode())
            yield _batch(out)
        if node is not None:
            yield _batch([(*node, sha.hexdigest())])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*_NODE, "ends_sha256"])

    chunks = ends.select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(joined, "depth long, name long, first long, ids string")
    return chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digest, "depth long, name long, ends_sha256 string")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each different prefix of the conversations; turns as from ordered(), convs has every conv_id, also of those without turns.

    conv_id (the smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.  Without
    conversations there are no rows.
    """
    turns = scratch.table(turns.select("conv_id", "place", "digest", "points"), "rebuilt")
    convs = convs.select("conv_id").distinct()
    longest, least = turns.agg(F.max("place")).head()[0] or 0, convs.agg(F.min("conv_id")).head()[0]
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("size"))
    root = convs.join(sizes, "conv_id", "left").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("points"), F.col("size").isNull().alias("last"))
    rows = root
    if longest:
        named = turns.withColumnRenamed("place", "depth").join(_prefixes(turns, longest), ["conv_id", "depth"])
        rows = root.unionByName(named.join(sizes, "conv_id").select("conv_id", "depth", "name", "points", (F.col("depth") == F.col("size")).alias("last")))
    rows = scratch.table(rows, "prefixes")
    found = scratch.table(rows.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("last").alias("leaf")), "nodes")
    # What a (conversation, depth) represents: a node, a leaf, the child of its node.
    own = found.select("conv_id", "depth", F.lit(1).alias("own"), F.col("leaf").cast("int").alias("leaf"), F.lit(0).alias("child"))
    child = found.where("depth > 0").select("conv_id", F.col("depth") - 1, F.lit(0), F.lit(0), F.lit(1))
    stands = own.union(child).groupBy("conv_id", "depth").agg(*(F.max(c).cast("long").alias(c) for c in ("own", "leaf", "child")))
    stands = scratch.table(stands, "stands")
    weighed = rows.join(stands, ["conv_id", "depth"], "left").select("conv_id", *_NODE, F.coalesce("leaf", F.lit(0)).cast("long").alias("n_leaves"), F.when(F.col("own") == 1, 0).otherwise(F.col("points")).alias("saved_tokens"), F.coalesce("child", F.lit(0)).cast("long").alias("n_children"))
    sums = _from_there_on(weighed, ["n_leaves", "saved_tokens"]).groupBy(*_NODE).agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    # Mostly a node's parent has the same smallest member; else it is looked up by the parent's name.
    above = found.where("depth > 1").select("conv_id", "depth", (F.col("depth") - 1).alias("up"))
    tops = above.join(stands.where("own = 1").select("conv_id", F.col("depth").alias("up")), ["conv_id", "up"], "left_anti")
    named = tops.join(rows.select("conv_id", F.col("depth").alias("up"), F.col("name").alias("up_name")), ["conv_id", "up"])
    other = named.join(found.select(F.col("depth").alias("up"), F.col("name").alias("up_name"), F.col("conv_id").alias("other")), ["up", "up_name"]).select("conv_id", "depth", "other")
    parent = F.when(F.col("depth") == 1, F.lit(least)).when(F.col("depth") > 1, F.coalesce("other", "conv_id"))
    out = found.join(other, ["conv_id", "depth"], "left").withColumn("parent_conv_id", parent.cast("long"))
    out = out.join(sums, _NODE).join(_hashed(rows.where("last")), _NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def trie(turns: DataFrame) -> DataFrame:
    """nodes() of conversations as they are: turns has conv_id, turn, role and text.

    Turns go by turn (null first), then role and text; a null role or text is
    empty; rows with a null conv_id are left out; repeated rows are turns of
    their own.  Texts and conversations may have any length.  An empty table
    gives no rows; other columns, whatever their names, take no part.
    """
    t = ordered(turns)
    return nodes(t, turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (as from ordered()) and the ids of conversations that share the beginnings of each hundred's first.

    Conversation c gets the first h turns of c - c % 100 (all if it has fewer,
    none if there is no such conversation), then its own after its first h; h
    is the unsigned CRC-32 of c in decimal, modulo 6.
    """
    t = scratch.table(ordered(turns), "ordered")
    convs = t.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("first"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"))
    heads = t.where("place <= 5 AND conv_id % 100 = 0").groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "points"))).alias("head"))  # five at most
    convs = scratch.table(convs.join(heads, "first", "left").select("conv_id", "h", F.slice(F.coalesce("head", F.expr("CAST(array() AS array<struct<place:bigint,digest:binary,points:bigint>>)")), F.lit(1), F.col("h").cast("int")).alias("head")), "heads")
    begun = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    rest = t.join(convs.select("conv_id", "h", F.size("head").alias("b")), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("b")).alias("place"), "digest", "points")
    return begun.unionByName(rest), convs.select("conv_id")


def digest(turns: DataFrame) -> DataFrame:
    """nodes() of the conversations as rebuilt() makes them; nulls, ties and empty tables as in trie()."""
    return nodes(*rebuilt(turns))
