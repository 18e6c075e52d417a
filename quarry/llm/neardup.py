"""Near-duplicate documents: SuperMinHash, banding, verification, union-find grouping.

1. Documents with equal shingle sets are one class; one set per class goes on.
2. Sets that share a band of their signatures are in one bucket.  Each set is
   compared in full with the least document of its buckets, and confirmed
   links are joined to components.
3. Where the sets of a bucket are still in several components, all of them of
   like size are compared, in blocks of bounded size.  A block joins what it
   finds linked and gives a forest: fewer links than it has components, never
   pairs.  So no link within a bucket is lost.
4. Links between components join these; a document has its class's component.

For two sets with a Jaccard similarity of 0.8 the chance to share no band is
(1 - 0.8**5)**26, about 3 in 100,000.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash, scratch, text
from .components import components, least

BLOCK = 60_000  # shingles in a block, about
SETS = 500  # sets in a block, about: the sizes of intersections of two blocks are 8 MB


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, set_a, set_b (a 128-bit digest of the set) and the band keys."""

    def run(batches):
        for batch in scratch.cut(batches):
            n, a, b, bands = [], [], [], []
            for s in minhash.shingle_sets(batch.column(1), words):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                a.append(text.signed(digest >> 64))
                b.append(text.signed(digest & (2**64 - 1)))
                bands.append(minhash.band_keys(minhash.signature(s, minhash.BANDS * minhash.ROWS), minhash.BANDS, minhash.ROWS) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n and the set as sorted 64-bit integers in a binary."""

    def run(batches):
        for batch in scratch.cut(batches):
            sets = list(minhash.shingle_sets(batch.column(1), words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "elements"])

    return docs.mapInArrow(run, "doc_id long, n long, elements binary")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v whose sets su, sv are similar enough, compared in full."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of the sets, through a dense product over shared elements, a few columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    column = (np.cumsum(times > 1) - 1)[place[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[shared][order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return total


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Of the sets of one block, or of two, a forest of links between components: each that is linked to another, to the least it is joined with."""
    sizes, comps, side = (np.array(table[k]) for k in ("n", "component", "side"))
    u = v = np.zeros(0, np.int64)
    if len(np.unique(comps)) > 1:
        both = _counts([np.frombuffer(e, np.uint64) for e in table["elements"].to_pylist()])
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        linked &= comps[:, None] < comps[None, :]
        if len(np.unique(side)) > 1:
            linked &= side[:, None] != side[None, :]
        x, y = np.nonzero(linked)
        nodes, root = least(comps[x], comps[y])
        u, v = nodes[nodes != root], root[nodes != root]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


_GROUP = ("key", "size", "lower", "larger", "higher")


def _meetings(members: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Which sets meet in which group of one or two blocks (_GROUP, doc_id, component, side), so that all that can link components of a bucket (key, doc_id, n) do.

    Of buckets with the same members one is looked at.  Its sets are dealt to
    classes of size: sets that are similar enough are in one class or in two
    neighbouring ones, so no others meet; and a class is dealt to blocks of
    bounded size, of which each two meet once.  Two blocks of the component
    that has most of the bucket's sets never meet.
    """
    m = members.join(comps, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"), "n")
    about = (F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("count"), F.sum(F.shiftright(F.xxhash64("doc_id"), 32)).alias("h1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("h2"))
    mixed = m.groupBy("key").agg(*about).where("lo < hi").groupBy("count", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    width = float(np.log(100 / percent)) * (1 + 1e-9)
    m = m.join(mixed, "key").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    # Sets of the bucket's largest component can be linked with each other to no effect: they meet the rest alone.
    most = m.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component"))["component"].alias("main"))
    m = m.join(most, "key").withColumn("rest", F.col("component") != F.col("main")).drop("main")
    needed = lambda who: F.coalesce(F.greatest(F.ceil(F.sum(F.when(who, F.col("n"))) / BLOCK), F.ceil(F.count_if(who) / SETS)), F.lit(0)).cast("int")
    blocks = m.groupBy("key", "size").agg(needed(F.col("rest")).alias("few"), needed(~F.col("rest")).alias("many"))
    at = lambda step, name: blocks.select("key", (F.col("size") - step).alias("size"), F.col("few").alias(name), (F.col("few") + F.col("many")).alias(name + "_all"))
    m = m.join(at(0, "own"), ["key", "size"]).join(at(1, "above"), ["key", "size"], "left").join(at(-1, "below"), ["key", "size"], "left")
    # In a class blocks of the rest come first, then those of the largest component.
    dealt = F.xxhash64("doc_id", "key")
    m = m.withColumn("block", F.when(F.col("rest"), F.pmod(dealt, F.col("own"))).otherwise(F.col("own") + F.pmod(dealt, F.col("own_all") - F.col("own"))).cast("int"))
    pair = lambda size, lower, larger, higher, side: F.struct(size.alias("size"), lower.alias("lower"), larger.alias("larger"), higher.alias("higher"), side.alias("side"))
    meeting = "array<struct<size:int,lower:int,larger:int,higher:int,side:int>>"
    size, block = F.col("size"), F.col("block")

    def met(name: str, one: Callable[[Column], Column]) -> Column:
        n = F.when(F.col("rest"), F.col(name + "_all")).otherwise(F.col(name))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast(meeting))

    same = met("own", lambda q: pair(size, F.least(block, q), size, F.greatest(block, q), block))
    with_above = met("above", lambda q: pair(size, block, size + 1, q, F.lit(-1)))
    with_below = met("below", lambda q: pair(size - 1, q, size, block, F.lit(-2)))
    return m.select("key", "doc_id", "component", F.explode(F.concat(*(x.cast(meeting) for x in (same, with_above, with_below)))).alias("meets")).select("key", "doc_id", "component", "meets.*")


def _leftover_links(members: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links u, v between components that have linked sets in one bucket (key, doc_id, n)."""
    m = scratch.table(_meetings(members, comps, percent), "meetings")  # read twice, made once
    # Groups whose members are all of one component can give nothing.
    live = m.groupBy(*_GROUP).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(*_GROUP)
    full = m.join(live, list(_GROUP)).join(sets, "doc_id")
    return full.groupBy(*_GROUP).applyInArrow(lambda t: _block_links(t, percent), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets
    of distinct shingles of so many words, A-Z lower-cased; a text with fewer
    words is one shingle, and one without words (or null) has an empty set and
    no links.  component_id is the least id reachable, kept says that it is the
    document's own.  Rows with a null id link with nothing and are kept with a
    null component_id; rows with equal ids are one node.  Sets hold all
    shingles of a text, whatever its length.  An empty table gives no rows;
    other columns of docs, whatever their names, take no part.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.table(_signatures(slim, words), "signatures")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    classes = scratch.table(classes, "classes")
    copies = usable.join(classes.where("rep < top").select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    banded = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("doc_id"), "n")
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub < top").select("key", "hub")
    members = scratch.table(banded.join(buckets, "key"), "members")
    wanted = members.select("doc_id").distinct()
    sets = scratch.table(_sets(slim.join(wanted, "doc_id", "left_semi"), words), "sets")
    sets = sets.where("n > 0")
    pairs = members.where("doc_id <> hub").select(F.col("doc_id").alias("u"), F.col("hub").alias("v"), "n").distinct()
    one = sets.select(F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("elements").alias("su"))
    two = sets.select(F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("elements").alias("sv"))
    close = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    linked = _linked(pairs.join(one, "u").join(two, "v").where(close), percent)
    # An id with several texts is one node: it joins the classes of all of them.
    several = usable.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("u"))
    comps = components(linked.unionByName(copies.join(several, "u", "left_semi")))
    more = scratch.table(_leftover_links(members, sets, comps, percent), "links")
    if more.head(1):
        joined = components(more).select(F.col("node").alias("part"), F.col("component").alias("whole"))
        far = comps.join(joined, comps["component"] == joined["part"], "left").select("node", F.coalesce("whole", "component").alias("component"))
        alone = joined.join(comps.select(F.col("node").alias("part")), "part", "left_anti").select("part", "whole")
        comps = scratch.table(far.union(alone), "components")
    of_copies = copies.join(comps, F.col("v") == F.col("node"), "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))
    found = of_copies.unionByName(comps).groupBy("node").agg(F.min("component").alias("component"))
    d = signed.select("doc_id", F.col("n").alias("n_shingles"))
    joined = d.join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which no near-duplicate has a smaller id, with docs' columns.

    Texts without words and rows with a null id have no duplicates and stay;
    rows with equal ids stay or go together; an empty table gives no rows, and
    columns may have any names.
    """
    found = near_duplicates(docs, words, percent, id_col, text_col)
    gone = scratch.table(found.where("NOT kept").select(F.col("doc_id").alias(scratch.unused(docs, "_quarry_gone"))).distinct(), "duplicates")
    return docs.join(gone, docs[id_col] == gone[gone.columns[0]], "left_anti")
