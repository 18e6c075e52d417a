"""Connected components: forests within tasks, then alternating large-star and small-star steps.

First every task joins the edges it reads and passes on a forest of them, one
link for each node to the least node of its tree.  If what is left is within
the bound of a task (TASK edges), one task joins it.  Beyond that, star steps
go on until nothing changes: each is an aggregation with map-side combining
and an equi-join, and no adjacency list is ever gathered.  The edges of each
round are a table in the shared folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

TASK = 1 << 20  # edges that a task holds at once: some 100 MB with all that is made of them


def least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges u, v and the least node that each can reach."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _forests(edges: DataFrame, loops: bool = False) -> DataFrame:
    """u, v: each node (with loops also the roots) linked to the least of those it is joined to by up to TASK edges of its partition."""

    def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, root = least(*(np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(2)))
        some = slice(None) if loops else nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(root[some])], ["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= TASK and not loops:
                yield joined(held)
                held, n = [], 0
        if held:
            yield joined(held)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or smaller (small) neighbours to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        below = both.where("v < u").join(low, "u")
        moved = below.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest reachable node) for every node of an edge of u and v (longs).

    Nodes without an edge to another node are left out.  Loops, repeated edges
    and an empty table do no harm.
    """
    spark = edges.sparkSession
    now = scratch.table(_forests(edges.where("u <> v")), "edges")
    if now.count() <= TASK:
        return scratch.table(_forests(now.coalesce(1), loops=True), "components").select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        after = scratch.table(_star(_star(now, True), False), "edges")
        scratch.drop_table(spark, now)
        now = after
        # Done when every node points at one other, which points at none.
        one = now.groupBy("u").count().where("count > 1").head(1)
        if not one and not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").head(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
