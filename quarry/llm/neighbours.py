"""Approximate nearest neighbours by NN-descent and greedy graph search.

Nodes, one for each distinct vector, are dealt by hash to blocks of bounded
size, and each block has a graph of its own: for each node its nearest known
others there.  It starts from neighbours in the order of random-hyperplane
codes and improves round by round: neighbours of a node, to it and from it,
are compared with each other, since a neighbour of a neighbour is likely a
neighbour.  Only lists that changed take part again, and groups are bounded by
the degree of the graph, whatever the data, because nodes that many others
point at take part with a sample.

Every query walks the graph of every block: from the nodes whose codes are most
like its own (and from its own node, where that is) it opens the best of its
nodes that it has not opened yet, until none is left, and remembers what it has
met, so that nothing is compared twice.  Each block gives its best, of which
Spark keeps the best of all.  So neither recall nor a task's memory changes as
the table grows: it only has more blocks.  Building takes work in proportion to
the nodes, searching in proportion to queries times blocks.

Similarities are double precision on double-precision unit vectors, and what a
query keeps gets its exact cosine.

Equal vectors are one node with its smallest ids, so copies cost nothing and
none of them is missed.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

DEGREE, TREES, LEAF, BEAM = 32, 4, 512, 128  # degree and beam: at least, see sizes
EACH = 6  # of a node's best in one group that are offered to its list
BITS = 62  # hyperplanes of a code
ENTRIES = 64  # nodes of each tree where a walk begins
WIDTH = 8  # nodes that a query opens in one step
BLOCK, BLOCK_BYTES = 16_384, 64 << 20  # nodes of a block, about, and bytes of their vectors
TOGETHER = 256  # queries that walk a block together
ROOM = 1 << 20  # numbers in the arrays that are compared at once
SAME = 1e-12  # similarities that differ by less may be ties of the exact cosine


def sizes(n: int) -> tuple[int, int]:
    """Degree and beam for n nodes: they follow the logarithm of n."""
    log = int(np.ceil(np.log2(max(n, 2))))
    return max(DEGREE, 2 * log), max(BEAM, 8 * log)


def _units(vectors: pa.Array) -> np.ndarray:
    rows = np.array(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # squares stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _floats(units: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(units.to_pylist()), kind).reshape(len(units), -1).astype(np.float64, copy=False)


def usable(v: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _nodes(rows: DataFrame, copies: int) -> DataFrame:
    """node (least id), members (the least ids of equal vectors, so many), vector, unit (float64 bytes) of each distinct vector."""
    first = Window.partitionBy("vector").orderBy("vec_id")
    some = rows.select("vec_id", "vector").withColumn("n", F.row_number().over(first)).where(F.col("n") <= copies)
    nodes = some.groupBy("vector").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_set("vec_id")).alias("members"))
    kind = rows.schema["vector"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            units = _units(batch.column(2)) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([u.tobytes() for u in units], pa.binary())], [*batch.schema.names, "unit"])

    return nodes.select("node", "members", "vector").mapInArrow(run, f"node long, members array<long>, vector {kind}, unit binary")


def _codes(units: np.ndarray, tree: int) -> np.ndarray:
    """On which side of a tree's random hyperplanes each vector is; like vectors come near each other in the order of codes."""
    planes = np.random.default_rng(1000 + tree).standard_normal((units.shape[1], BITS))
    return ((units @ planes) > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])


def _places(rows: np.ndarray) -> np.ndarray:
    """The place of each entry of a sorted array among its equals."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def _once(values: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class _Lists:
    """The neighbour lists of a block's nodes: others (-1: none yet), best first, their sims, and which are fresh."""

    def __init__(self, n: int, degree: int) -> None:
        self.others, self.sims, self.fresh = np.full((n, degree), -1), np.full((n, degree), -3.0), np.zeros((n, degree), bool)

    def offer(self, v: np.ndarray, u: np.ndarray, sim: np.ndarray) -> None:
        """Put nodes u into the lists of v, where they are not there and nearer than what is."""
        n, degree = self.others.shape
        some = ~(self.others[v] == u[:, None]).any(1)
        v, u, sim = v[some], u[some], sim[some]
        order = np.lexsort((u, -sim, v))
        v, u, sim = v[order], u[order], sim[order]
        some = np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1]))[: len(v)]
        v, u, sim = v[some], u[some], sim[some]
        place = _places(v)
        some = place < degree
        v, u, sim, place = v[some], u[some], sim[some], place[some]
        rows = _once(v)
        row = np.searchsorted(rows, v)
        more = int(place.max(initial=-1)) + 1
        wide = []
        for own, offered, none in ((self.others, u, -1), (self.sims, sim, -3.0), (self.fresh, True, False)):
            both = np.concatenate([own[rows], np.full((len(rows), more), none, own.dtype)], axis=1)
            both[row, degree + place] = offered
            wide.append(both)
        best = np.argsort(-wide[1], axis=1, kind="stable")[:, :degree]
        for own, both in zip((self.others, self.sims, self.fresh), wide, strict=True):
            own[rows] = np.take_along_axis(both, best, 1)

    def around(self, chance: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """The group of each node, its neighbours to it and from it (-1 behind the last), fresh ones first; and how many are fresh."""
        n, degree = self.others.shape
        held = self.others >= 0
        v, u, fresh = np.nonzero(held)[0], self.others[held], self.fresh[held]
        order = np.lexsort((chance.random(len(u)), u))
        back = order[_places(u[order]) < degree]
        pair, fresh = np.concatenate([v * n + u, u[back] * n + v[back]]), np.concatenate([fresh, fresh[back]])
        order = np.lexsort((~fresh, pair))
        order = order[_places(pair[order]) == 0]
        v, u, fresh = pair[order] // n, pair[order] % n, fresh[order]
        order = np.lexsort((~fresh, v))
        groups = np.full((n, 2 * degree), -1)
        groups[v[order], _places(v[order])] = u[order]
        return groups, np.bincount(v, fresh, n).astype(int)


def _first(units: np.ndarray, lists: _Lists, trees: int) -> None:
    """First neighbours: the best among LEAF nodes that follow each other in a tree's codes."""
    degree = lists.others.shape[1]
    for t in range(trees):
        order = np.argsort(_codes(units, t), kind="stable")
        found = []
        for lo in range(0, len(order), LEAF):
            leaf = order[lo : lo + LEAF]
            k = min(degree, len(leaf) - 1)
            if k:
                sim = units[leaf] @ units[leaf].T
                np.fill_diagonal(sim, -3)
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                found.append((np.repeat(leaf, k), leaf[best].ravel(), np.take_along_axis(sim, best, 1).ravel()))
        if found:
            lists.offer(*map(np.concatenate, zip(*found, strict=True)))


def _better(units: np.ndarray, lists: _Lists, chance: np.random.Generator) -> None:
    """One round: in the group of each node its fresh ones and the others are compared, and each is offered its best EACH of them."""
    groups, fresh = lists.around(chance)
    lists.fresh[:] = False
    least = np.append(np.where(lists.others[:, -1] >= 0, lists.sims[:, -1], -2.0), 9.0)  # nothing is offered to nobody
    order = np.argsort(-fresh, kind="stable")
    order = order[fresh[order] > 0]
    step = max(1, ROOM // (groups.shape[1] * max(groups.shape[1], units.shape[1])))
    found = []
    for lo in range(0, len(order), step):
        group, n = groups[order[lo : lo + step]], fresh[order[lo : lo + step]]
        group = group[:, : (group >= 0).sum(1).max()]
        new = group[:, : n.max()].copy()
        new[np.arange(new.shape[1]) >= n[:, None]] = -1
        sim = units[new] @ units[group].transpose(0, 2, 1)
        sim[(new[:, :, None] == group[:, None, :]) | (new < 0)[:, :, None] | (group < 0)[:, None, :]] = -3
        for one, two, sims in ((new, group, sim), (group, new, sim.transpose(0, 2, 1))):
            g, i, j = np.nonzero(sims > least[one][:, :, None])
            s = sims[g, i, j]
            best = np.lexsort((-s, g * sims.shape[1] + i))
            best = best[_places((g * sims.shape[1] + i)[best]) < EACH]
            g, i, j = g[best], i[best], j[best]
            found.append((one[g, i], two[g, j], s[best]))
    if found:
        lists.offer(*map(np.concatenate, zip(*found, strict=True)))


def _descent(units: np.ndarray, degree: int, rounds: int | None, trees: int) -> np.ndarray:
    """The links of each node, its neighbours and as many at most that have it as theirs (-1 behind the last); see graph."""
    lists, chance, done = _Lists(len(units), degree), np.random.default_rng(1), 0
    _first(units, lists, trees)
    while done != rounds:
        _better(units, lists, chance)
        done += 1
        if lists.fresh.sum() <= 0.01 * lists.fresh.size:
            break
    held = lists.others >= 0
    v, u, sim = np.nonzero(held)[0], lists.others[held], lists.sims[held]
    order = np.lexsort((v, -sim, u))
    back = order[_places(u[order]) < degree]
    v, u = np.divmod(_once(np.concatenate([v * len(units) + u, u[back] * len(units) + v[back]])), len(units))
    links = np.full((len(units), 2 * degree), -1)
    links[v, _places(v)] = u
    return links


def graph(nodes: DataFrame, n: int, degree: int = DEGREE, rounds: int | None = None, trees: int = TREES, size: int = BLOCK) -> DataFrame:
    """block, node, unit, others: n nodes (node, unit) in blocks of about size, with the nodes of the block that each is linked with.

    Lists of a block improve until under 1 % of their entries change in a round, or for so many rounds.
    """
    blocks = max(1, -(-n // size))

    def run(batches):
        for table in _groups(batches):
            ids, links = table["node"].to_numpy(), _descent(_floats(table["unit"]), degree, rounds, trees)
            held = links >= 0
            others = pa.ListArray.from_arrays(np.append(0, held.sum(1).cumsum()).astype(np.int32), pa.array(ids[links[held]]))
            yield from pa.table([*table.columns, others], ["block", "node", "unit", "others"]).to_batches()

    dealt = nodes.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), "node", "unit")
    dealt = dealt.repartitionById(blocks, "block").sortWithinPartitions("block", "node")  # a task for each block
    return dealt.mapInArrow(run, "block int, node long, unit binary, others array<long>")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        c = batch.column(0).to_numpy()
        for lo, hi in zip(edges := [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1)], [*edges[1:], len(c)], strict=True):
            if held and held[-1].column(0)[-1].as_py() != c[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _walk(asked: np.ndarray, units: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of each query's last beam, best first (-1 behind the last), and their sims; see search."""
    n, q = len(units), len(asked)
    met = np.zeros(q * n, bool)
    nodes, sims, opened = np.full((q, beam), -1), np.full((q, beam), -3.0), np.ones((q, beam), bool)
    rows, offered = np.arange(q), entries  # the nodes that the queries of these rows come by
    while len(rows):
        pair = (rows[:, None] * n + offered)[offered >= 0]
        pair = _once(pair[~met[pair]])
        met[pair] = True
        row, node = np.divmod(pair, n)
        sim = np.zeros(len(pair))
        ends = np.searchsorted(row, np.arange(q + 1)).tolist()
        for k, (lo, hi) in enumerate(itertools.pairwise(ends)):
            if hi > lo:
                sim[lo:hi] = units[node[lo:hi]] @ asked[k]
        some = sim > sims[row, -1]
        row, node, sim = row[some], node[some], sim[some]
        place = _places(row)
        more = int(place.max(initial=-1)) + 1
        wide = [np.concatenate([own, np.full((q, more), none, own.dtype)], axis=1) for own, none in ((nodes, -1), (sims, -3.0), (opened, True))]
        for own, values in zip(wide, (node, sim, False), strict=True):
            own[row, beam + place] = values
        best = np.argsort(-wide[1], axis=1, kind="stable")[:, :beam]
        nodes, sims, opened = (np.take_along_axis(own, best, 1) for own in wide)
        now = ~opened & (np.cumsum(~opened, axis=1) <= (beam if width is None else width))
        opened |= now
        rows, at = np.nonzero(now)
        offered = links[nodes[rows, at]]
    return nodes, sims


def _walked(queries: DataFrame, graphs: DataFrame, blocks: int, beam: int, width: int | None, keep: int | None, kind: type = np.float64) -> DataFrame:
    """start, node, sim: what the queries (start, one) find in each block of graphs, their whole beams, or the best so many and their ties."""

    def run(batches):
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by("node")  # of one block
        query = pc.is_null(table["others"])
        graph, asked = table.filter(pc.invert(query)), table.filter(query)
        if not len(graph) or not len(asked):
            return
        ids, units, starts = graph["node"].to_numpy(), _floats(graph["unit"], kind), asked["node"].to_numpy()
        others = graph["others"].combine_chunks()
        count = pc.list_value_length(others).to_numpy()
        v = np.repeat(np.arange(len(ids)), count)
        links = np.full((len(ids), max(1, count.max())), -1)
        links[v, _places(v)] = np.searchsorted(ids, others.flatten().to_numpy())
        trees = []
        for t in range(TREES):
            codes = _codes(units, t)
            order = np.argsort(codes, kind="stable")
            trees.append((order, codes[order]))
        for lo in range(0, len(starts), TOGETHER):
            some, one = starts[lo : lo + TOGETHER], _floats(asked["unit"].slice(lo, TOGETHER), kind)
            own = np.minimum(np.searchsorted(ids, some), len(ids) - 1)
            entries = [np.where(ids[own] == some, own, -1)[:, None]]
            for t, (order, codes) in enumerate(trees):
                first = np.searchsorted(codes, _codes(one, t)) - ENTRIES // 2
                entries.append(order[np.clip(first[:, None] + np.arange(ENTRIES), 0, len(ids) - 1)])
            nodes, sims = _walk(one, units, links, np.concatenate(entries, axis=1), beam, width)
            least = sims[:, min(keep, beam) - 1] - SAME if keep else np.full(len(some), -2.5)
            row, place = np.nonzero((nodes >= 0) & (sims >= least[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(some[row]), pa.array(ids[nodes[row, place]]), pa.array(sims[row, place])], ["start", "node", "sim"])

    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("start").alias("node"), F.col("one").alias("unit"), F.lit(None).cast("array<bigint>").alias("others"))
    both = graphs.select("block", "node", "unit", "others").unionByName(asked)
    return both.repartitionById(blocks, "block").mapInArrow(run, "start long, node long, sim double")  # a task for each block


def search(starts: DataFrame, nodes: DataFrame, links: DataFrame, beam: int = BEAM, width: int | None = None) -> DataFrame:
    """start, node, sim: the best nodes that greedy search finds in one graph (node, unit of float32 bytes; links v, u) from each start node (a column start), itself among them.

    A step opens the best unopened nodes of each beam, width of them or all, the
    beam being the best nodes met so far; what has been met is kept, so no node is
    compared twice with a start.  The search ends when every node of every beam
    is opened: beams only get better, so it does end.
    """
    own = starts.join(nodes.select(F.col("node").alias("start"), F.col("unit").alias("one")), "start")
    others = links.groupBy("v").agg(F.collect_set("u").alias("others"))
    graphs = nodes.select("node", "unit").join(others, F.col("node") == F.col("v"), "left")
    graphs = graphs.select(F.lit(0).alias("block"), "node", "unit", F.coalesce("others", F.array().cast("array<bigint>")).alias("others"))
    return _walked(own, graphs, 1, beam, width, None, np.float32)


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    degree: int | None = None,
    rounds: int | None = None,
    beam: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, itself excepted.

    is_query makes a condition from the id column.  Nearness is the cosine in
    double precision on the original vectors, ties go to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do rows with a null id or a vector of another length than most;
    rows that are wholly equal count once.  An empty table gives no rows, and
    other columns of vectors, whatever their names, take no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (length.d if length else 0))
    nodes = scratch.table(_nodes(rows, k + 1), "nodes")
    n = nodes.count()
    size = max(2, min(BLOCK, BLOCK_BYTES // (8 * max(1, length.d if length else 1))))
    degree, beam = degree or sizes(min(n, size))[0], beam or sizes(min(n, size))[1]
    graphs = scratch.table(graph(nodes, n, degree, rounds, size=size), "graphs")
    queries = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    queries = scratch.table(queries.join(nodes.select("vector", "node"), "vector").select("query_id", F.col("node").alias("start"), F.col("vector").alias("asked")), "queries")
    asked = nodes.join(queries.select(F.col("start").alias("node")).distinct(), "node").select(F.col("node").alias("start"), F.col("unit").alias("one"))
    found = _walked(asked, graphs, max(1, -(-n // size)), max(beam, k + 1), WIDTH, k + 1)
    # Of all blocks: the best k, the query's own node, and what may tie with the last of them.
    best = found.groupBy("start").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "node"))).alias("best"))
    last = F.coalesce(F.get("best", F.lit(k))["far"], F.lit(2.0)) + SAME
    found = best.select("start", F.explode(F.filter("best", lambda x: x.far <= last)).alias("one")).select("start", "one.node")
    pairs = queries.join(found, "start").join(nodes.select("node", "members", "vector"), "node")
    scored = pairs.select("query_id", F.explode("members").alias("vec_id"), _cosine(F.col("asked"), F.col("vector")).alias("score")).where("query_id <> vec_id")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
