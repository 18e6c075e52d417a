"""Top-k retrieval: vectors, BM25 keywords, and both fused by reciprocal rank.

Filters come before the top k, thresholds after it.  Ties go by path, first
line and place in the file.  Every search returns chunk columns, the raw
measure, score in [0, 1] and rank from 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import similarity, with_value
from .filters import Filters

K1, B, RRF = 1.2, 0.75, 60
TOKENS = r"[^\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+"
TIES = ("path", "start_line", "chunk_seq")
SLIM = (*TIES, "chunk_type", "language", "branch")  # what ties and filters ask, kept with postings
FETCH = ("chunk_id", "bucket")  # what finds a chunk's row; the bucket, where there is one, prunes the scan
SMALL = 10_000  # rows of a result up to which it is broadcast
GATHER = 1 << 20  # tokens of rows whose postings are gathered at once


def resolve_mode(mode: str | None, query_text: str | None, query_vector: Sequence[float] | None) -> str:
    """The search mode; ValueError if it is unknown or lacks its input."""
    has_text, has_vector = bool(query_text), query_vector is not None and len(query_vector) > 0
    if mode is None:
        mode = "hybrid" if has_text and has_vector else "vector" if has_vector else "fts" if has_text else ""
        if not mode:
            raise ValueError("a search needs a text or a vector")
    if mode not in ("vector", "fts", "hybrid"):
        raise ValueError(f"Invalid search mode: {mode}")
    if mode == "vector" and not has_vector:
        raise ValueError("vector search needs a query vector")
    if mode in ("fts", "hybrid") and not has_text:
        raise ValueError(f"{mode} search needs a query text")
    return mode


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKENS), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    """The tokens of a query, as tokens() makes them."""
    return [t for t in regex.split(TOKENS, query.lower()) if t]


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def _top(scored: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows with their ranks; the sort is a top-k, so only these rows meet in one task."""
    first = scored.orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _ties(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in TIES if c in df.columns]


def vector_search(chunks: DataFrame, query: Sequence[float], limit: int, filters: Filters = Filters(), distance: str = "l2sq", vectors: DataFrame | None = None) -> DataFrame:
    """The nearest chunks, by exact distances; score is 1 / (1 + distance).

    vectors (chunk_id, vector; an id once) are those of chunks that hold none
    themselves: distances alone meet the chunks, and whole rows are fetched
    for the best.
    """
    d = squared_distance(F.col("vector"), query)
    measured = lambda df: df.where(F.size("vector") == len(query)).withColumn("distance", F.sqrt(d) if distance == "l2" else d)
    scored = lambda df: df.withColumn("score", similarity(F.col("distance")))
    if vectors is None:
        found = measured(filters.apply(chunks))
        return _top(scored(found), [F.col("distance"), *_ties(found)], limit)
    best = _near(chunks, measured(vectors), limit, filters).select(*(c for c in FETCH if c in chunks.columns), "distance", "rank")
    return scored(chunks.join(_few(best, limit), [c for c in FETCH if c in chunks.columns]))


def _near(chunks: DataFrame, measured: DataFrame, limit: int, filters: Filters) -> DataFrame:
    """What finds the nearest chunks and what ties ask, distance and rank, by distances that are known by chunk_id."""
    slim = filters.apply(chunks).select(*(c for c in FETCH if c in chunks.columns), *_ties(chunks)).join(measured.select("chunk_id", "distance"), "chunk_id")
    return _top(slim, [F.col("distance"), *_ties(slim)], limit)


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def _counted(ts: Column) -> Column:
    """(term, tf) of an array of tokens that is not empty: runs of the sorted array."""
    runs = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: (k == 1) | (F.get(s, k - 1) != F.get(s, k - 2)))
    one = lambda s, f: F.transform(f, lambda k, i: F.struct(F.get(s, k - 1).alias("term"), (F.coalesce(F.get(f, i + 1), F.size(s) + 1) - k).cast("long").alias("tf")))
    return with_value(F.array_sort(ts), lambda s: with_value(runs(s), lambda f: one(s, f)))


def postings(chunks: DataFrame, id_col: str = "chunk_id", keep: Sequence[str] = (), once: bool = False) -> DataFrame:
    """term, chunk_id, tf, dl (length of the chunk in tokens) and columns to keep: the inverted index, to be kept beside a store.

    Where every id comes once, each row's terms are counted in place and nothing is shuffled.
    """
    t = chunks.select(F.col(id_col).alias("chunk_id"), *keep, tokens(F.col("text")).alias("ts"))
    if once:
        rows = t.where(F.size("ts") > 0).select("chunk_id", *keep, F.size("ts").alias("dl"), F.explode(_counted(F.col("ts"))).alias("hit"))
        return rows.select("hit.term", "chunk_id", "hit.tf", "dl", *keep)
    rows = t.select("chunk_id", *keep, F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return rows.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), *(F.any_value(c).alias(c) for c in ("dl", *keep)))


def gathered(chunks: DataFrame, per_block: int, id_col: str = "chunk_id", most: int = GATHER) -> DataFrame:
    """term, block, cf, ids, tfs, dls: the inverted index as lists, where every id (a long) comes once.

    A list has the postings of a term in one range of per_block ids (a block),
    as far as they are among rows that come together, of so many tokens at most
    or one row; its ids ascend, and cf is the sum of its tfs.  Nothing is
    shuffled, and a row of text makes no row for each of its terms.
    """

    def run(batches):
        for batch in batches:
            ids, ts = batch.column(0).to_numpy(), batch.column(1)
            ends = pc.list_value_length(ts).to_numpy().cumsum()
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
                yield from _lists(ids[lo:hi], ts.slice(lo, hi - lo), per_block)
                lo = hi

    t = chunks.select(id_col, F.split(F.lower(F.coalesce("text", F.lit(""))), TOKENS).alias("ts"))
    return t.mapInArrow(run, "term string, block long, cf long, ids array<long>, tfs array<int>, dls array<int>")


def _lists(ids: np.ndarray, ts: pa.Array, per_block: int) -> Iterator[pa.RecordBatch]:
    words = ts.flatten().dictionary_encode()
    order = np.argsort(ids)
    ids, place = ids[order], np.argsort(order)
    row, code = np.repeat(place, pc.list_value_length(ts).to_numpy()), words.indices.to_numpy()
    if (none := pc.index(words.dictionary, "").as_py()) >= 0:  # splitting leaves it at both ends
        row, code = row[code != none], code[code != none]
    if not len(row):
        return
    dls = np.bincount(row, minlength=len(ids)).astype(np.int32)
    pair = np.sort(code * np.int64(len(ids)) + row)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    tfs = np.diff(np.append(first, len(pair)))
    code, row = np.divmod(pair[first], len(ids))
    block = ids[row] // per_block
    cut = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
    offsets = pa.array(np.append(cut, len(code)), pa.int32())
    columns = [words.dictionary.take(pa.array(code[cut])), pa.array(block[cut]), pa.array(np.add.reduceat(tfs, cut))]
    columns += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids[row], tfs.astype(np.int32), dls[row])]
    yield pa.RecordBatch.from_arrays(columns, ["term", "block", "cf", "ids", "tfs", "dls"])


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length in tokens."""
    return chunks.agg(F.count("*").alias("n"), F.avg(n_tokens(F.col("text"))).alias("avgdl"))


def _hits(chunks: DataFrame, terms: Sequence[str], id_col: str, keep: Sequence[str]) -> DataFrame:
    """The postings of some terms by a scan: neither texts nor other terms are shuffled."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(terms)})(?![\p{{L}}\p{{N}}])"), F.lit(0))
    t = chunks.select(F.col(id_col).alias("chunk_id"), *keep, "text", found.alias("ts")).where(F.size("ts") > 0)
    t = t.select("chunk_id", *keep, n_tokens(F.col("text")).alias("dl"), F.array_distinct("ts").alias("terms"), "ts")
    one = F.explode(F.transform("terms", lambda x: F.struct(x.alias("term"), F.size(F.filter("ts", lambda y: y == x)).alias("tf"))))
    return t.select("chunk_id", *keep, "dl", one.alias("hit")).select("hit.term", "chunk_id", F.col("hit.tf").cast("long").alias("tf"), "dl", *keep)


def bm25(chunks: DataFrame, query: str, id_col: str = "chunk_id", index: DataFrame | None = None, stats: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """chunk_id, bm25 and columns to keep of the chunks that hold a query term; frequencies are those of the whole store.

    With a kept index chunks are not read.
    """
    terms = sorted(set(query_terms(query)))
    if not terms:
        return chunks.limit(0).select(F.col(id_col).alias("chunk_id"), F.lit(0.0).alias("bm25"), *keep)
    index = _hits(chunks, terms, id_col, keep) if index is None else index.where(F.col("term").isin(*terms))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    scored = index.join(F.broadcast(df), "term")  # as many rows as the query has terms
    stats = corpus_stats(chunks) if stats is None else stats
    one = stats.select(F.struct("n", "avgdl").alias("s")).scalar()
    scored = scored.withColumn("s", one)
    idf = F.log(1 + (F.col("s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("s.avgdl")))
    return scored.groupBy("chunk_id").agg(F.sum(part).alias("bm25"), *(F.any_value(c).alias(c) for c in keep))


def _few(df: DataFrame, limit: int) -> DataFrame:
    """df, to be broadcast if its bound of rows is small."""
    return F.broadcast(df) if limit <= SMALL else df


def _fts_top(chunks: DataFrame, query: str, limit: int, filters: Filters, index: DataFrame | None, stats: DataFrame | None) -> DataFrame:
    """chunk_id, bm25, rank and what ties ask, of the best chunks: found among the hits, without the chunks' texts and vectors."""
    keep = [c for c in (*SLIM, "bucket") if c in chunks.columns]
    if index is not None and not set(keep) <= set(index.columns):
        hits = filters.apply(chunks).select("chunk_id", *keep).join(bm25(chunks, query, index=index, stats=stats), "chunk_id")
    else:
        hits = filters.apply(bm25(chunks, query, index=index, stats=stats, keep=keep))
    return _top(hits.select("chunk_id", "bm25", *(c for c in (*TIES, "bucket") if c in keep)), [F.desc("bm25"), *_ties(hits)], limit)


def fts_search(chunks: DataFrame, query: str, limit: int, filters: Filters = Filters(), index: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """The best chunks by BM25; score is bm25 / (1 + bm25).  Whole rows are fetched for the best alone."""
    by = [c for c in FETCH if c in chunks.columns]
    best = _fts_top(chunks, query, limit, filters, index, stats).select(*by, "bm25", "rank")
    found = chunks.join(_few(best, limit), by)
    return found.withColumn("score", F.col("bm25") / (1 + F.col("bm25")))


def hybrid_search(chunks: DataFrame, query: str, vector: Sequence[float] | None, limit: int, filters: Filters = Filters(), fts_weight: float = 0.5, index: DataFrame | None = None, stats: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Both searches' best, fused: rrf = (1 - w) / (60 + rank) + w / (60 + rank); score = 61 * rrf.

    Without keyword hits the order is that of the vectors.  For vectors beside
    the chunks see vector_search; no text is joined with them.
    """
    if vector is None:
        return fts_search(chunks, query, limit, filters, index, stats)
    by, ties = [c for c in FETCH if c in chunks.columns], [c for c in TIES if c in chunks.columns]
    both = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"w.{c}")).alias(c)
    words = _fts_top(chunks, query, limit, filters, index, stats).select(*by, *ties, F.col("rank").alias("fts_rank"))
    if vectors is None:
        near = vector_search(chunks, vector, limit, filters)
    else:
        near = _near(chunks, vectors.where(F.size("vector") == len(vector)).withColumn("distance", squared_distance(F.col("vector"), vector)), limit, filters)
    near = near.select(*by, *ties, F.col("rank").alias("vector_rank"))
    fused = near.alias("n").join(words.alias("w"), F.col("n.chunk_id") == F.col("w.chunk_id"), "full_outer").select(*map(both, (*by, *ties)), "vector_rank", "fts_rank")
    part = lambda c, w: F.coalesce(F.lit(w) / (RRF + F.col(c)), F.lit(0.0))
    fused = fused.withColumn("rrf", part("vector_rank", 1 - fts_weight) + part("fts_rank", fts_weight))
    best = _top(fused, [F.desc("rrf"), *_ties(fused)], limit).select(*by, "vector_rank", "fts_rank", "rrf", "rank")
    return chunks.join(_few(best, limit), by).withColumn("score", F.col("rrf") * (RRF + 1))


def search(
    chunks: DataFrame,
    query_text: str | None = None,
    query_vector: Sequence[float] | None = None,
    limit: int = 10,
    mode: str | None = None,
    filters: Filters = Filters(),
    min_score: float | None = None,
    fts_weight: float = 0.5,
    index: DataFrame | None = None,
    stats: DataFrame | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    mode = resolve_mode(mode, query_text, query_vector)
    if limit < 0:
        raise ValueError("the limit must not be negative")
    if mode == "vector":
        found = vector_search(chunks, query_vector, limit, filters, vectors=vectors)
    elif mode == "fts":
        found = fts_search(chunks, query_text, limit, filters, index, stats)
    else:
        found = hybrid_search(chunks, query_text, query_vector, limit, filters, fts_weight, index, stats, vectors)
    return found if min_score is None else found.where(F.col("score") >= min_score)
