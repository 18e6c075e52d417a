"""Builds a keyword index of a table of documents, with BM25 weights worked out.

    python -m jobs.keyword_index --documents IN --out OUT [--config jobs/keyword_index.toml]

OUT/terms      bucket=B: term, df (documents), cf (occurrences), idf
OUT/postings   bucket=B: term, block, df, most (the greatest weight), n, and lists of even order:
               ids (of documents, ascending), tfs, dls (tokens of the document), weights
OUT/blocks     bucket=B: term, block, most, n: the postings without their lists, each term and block once
OUT/corpus     documents, tokens
OUT/counted    lists before they are weighed

A bucket holds the terms of one hash.  Within its files postings are in the
order of terms and documents, those of a term in one block as a row of lists;
postings() gives a row for each.  So a search reads the buckets of its terms alone,
and of these the row groups that hold them.  Frequent terms are split over
files of even size by Spark's rebalancing; no task gets all postings of a term.

A block is a range of documents' ids.  No document of a block has more than the
sum of its terms' greatest weights there, so a search scores the most promising
blocks first, and then only blocks that can still come up to the worst of the
best so far.  Its result is that of scoring everything.  A run writes all
tables anew.
"""

from __future__ import annotations

import argparse
import contextlib
import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import file_hash
from quarry.logs import setup
from quarry.operators import search

from . import config

log = logging.getLogger("quarry.jobs.keyword_index")

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
COUNTED = "term string, block long, cf long, ids array<long>, tfs array<int>, dls array<int>, bucket int"
TERM = "term string, df long, cf long, idf double, bucket int"
BLOCK = "term string, block long, most double, n long, bucket int"
FIRST = 4  # blocks that a search scores first, besides one for each result
FEW = 1000  # blocks that are named in a filter; more are joined
WEIGH = 1 << 19  # postings that are weighed at once, besides those of one block
LISTS = "term string, block long, df long, most double, n long, ids array<long>, tfs array<int>, dls array<int>, weights array<double>, bucket int"


@dataclass(frozen=True)
class Settings:
    id_column: str = "doc_id"
    text_column: str = "text"
    buckets: int = 64
    documents_per_block: int = 4096


def _bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def documents_of(table: DataFrame, settings: Settings) -> DataFrame:
    """doc_id and text, once for each id: of rows with equal ids the text with the greatest hash counts; rows without an id do not."""
    docs = table.select(F.col(settings.id_column).cast("long").alias("doc_id"), F.coalesce(F.col(settings.text_column), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    if docs.groupBy("doc_id").count().where("count > 1").head(1):
        docs = docs.groupBy("doc_id").agg(F.max_by("text", file_hash(F.col("text").cast("binary"))).alias("text"))
    return docs


def run(spark: SparkSession, documents: str, out: str, settings: Settings = Settings()) -> dict[str, int]:
    """Write the index of all documents; how many documents, terms and postings it has."""
    out = out.rstrip("/")
    log.info("reading %s", documents)
    docs = documents_of(spark.read.parquet(documents), settings)
    bucket = _bucket(F.col("term"), settings.buckets).alias("bucket")
    search.gathered(docs, settings.documents_per_block, "doc_id").select("*", bucket).write.mode("overwrite").parquet(f"{out}/counted")
    counted = spark.read.schema(COUNTED).parquet(f"{out}/counted")
    n = docs.count()
    terms = counted.groupBy("term", "bucket").agg(F.sum(F.size("ids")).alias("df"), F.sum("cf").alias("cf"))
    terms = terms.withColumn("idf", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    terms.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/terms")
    known = spark.read.schema(TERM).parquet(f"{out}/terms")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    about = known.agg(F.lit(n).cast("long").alias("documents"), total("cf").alias("tokens"), F.count("*").alias("terms"), total("df").alias("postings")).first()
    spark.createDataFrame([(n, about.tokens)], "documents long, tokens long").coalesce(1).write.mode("overwrite").parquet(f"{out}/corpus")
    found = counted.join(known.select("term", "df", "idf"), "term")
    dealt = found.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "block")
    with _written_as_they_come(spark, settings.buckets):
        _weighed(dealt, about.tokens / n if about.tokens else 1.0).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/postings")
    lists = spark.read.schema(LISTS).parquet(f"{out}/postings")
    blocks = lists.groupBy("bucket", "term", "block").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
    blocks.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/blocks")
    wrote = about.asDict()
    log.info("%d documents of %d tokens read; %d terms and %d postings written to %s", *wrote.values(), out)
    return wrote


@contextlib.contextmanager
def _written_as_they_come(spark: SparkSession, folders: int) -> Iterator[None]:
    """What is written inside is not sorted once more by folder, which would cost its order: a task has a file open for each; the setting is the session's own again afterwards."""
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(folders))
    try:
        yield
    finally:
        spark.conf.set(_WRITERS, before)


def _weighed(lists: DataFrame, mean: float) -> DataFrame:
    """Lists with weights, those of one term and block as one; they come and go in the order of bucket, term and block."""

    def run(batches):
        for table in _whole(batches):
            starts = _starts(table)
            row = np.repeat(np.arange(len(table)), pc.list_value_length(table["ids"]).to_numpy())
            ids, tf, dl = (table[c].combine_chunks().flatten().to_numpy() for c in ("ids", "tfs", "dls"))
            group = (np.cumsum(starts) - 1)[row]
            order = np.lexsort((ids, group))
            row, ids, tf, dl = row[order], ids[order], tf[order], dl[order]
            weight = table["idf"].to_numpy()[row] * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * dl / mean))
            first = np.searchsorted(group, np.arange(starts.sum()))
            offsets = pa.array(np.append(first, len(ids)), pa.int32())
            about = table.select(["term", "block", "df", "bucket"]).take(pa.array(np.flatnonzero(starts)))
            columns = [about["term"], about["block"], about["df"], pa.array(np.maximum.reduceat(weight, first)), pa.array(np.diff(np.append(first, len(ids))))]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, tf, dl, weight)]
            yield from pa.table([*columns, about["bucket"]], ["term", "block", "df", "most", "n", "ids", "tfs", "dls", "weights", "bucket"]).to_batches(1 << 14)

    return lists.select("bucket", "term", "block", "df", "idf", "ids", "tfs", "dls").mapInArrow(run, LISTS)


def _starts(table: pa.Table) -> np.ndarray:
    """Which rows of a table in order begin a block of a term."""
    term, block = table["term"].combine_chunks(), table["block"].to_numpy()
    return np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1]))


def _whole(batches: Iterator[pa.RecordBatch], most: int = WEIGH) -> Iterator[pa.Table]:
    """The rows in tables that part no block of a term, of so many postings and one such block at most."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        starts = np.flatnonzero(_starts(table))
        done = np.append(0, pc.list_value_length(table["ids"]).to_numpy().cumsum())[starts]  # postings before each block
        lo = 0
        while lo < len(starts) - 1:
            hi = min(max(lo + 1, int(np.searchsorted(done, done[lo] + most, "right")) - 1), len(starts) - 1)
            yield table.slice(starts[lo], starts[hi] - starts[lo])
            lo = hi
        held = table.slice(starts[lo])
    if held is not None:
        yield held


def postings(spark: SparkSession, out: str) -> DataFrame:
    """term, doc_id, block, tf, dl, df, weight, bucket of every posting."""
    lists = spark.read.schema(LISTS).parquet(f"{out.rstrip('/')}/postings")
    each = lists.select("term", "block", "df", "bucket", F.inline(F.arrays_zip("ids", "tfs", "dls", "weights")).alias("doc_id", "tf", "dl", "weight"))
    return each.select("term", "doc_id", "block", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"), "df", "weight", "bucket")


def _scored(hits: DataFrame, limit: int) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.sum("weight").alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(limit)


def promising(hits: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """The blocks (block, most, n) of a query that can hold one of its best documents; hits and blocks are of its terms alone."""
    bounds = blocks.groupBy("block").agg(F.sum("most").alias("most"), F.sum("n").alias("n"))
    first = [r.block for r in bounds.orderBy(F.desc("most"), "block").limit(limit + FIRST).collect()]
    worst = _scored(hits.where(F.col("block").isin(first)), limit).agg(F.count("*").alias("n"), F.min("bm25").alias("bm25")).first()
    if worst.n < limit:
        return bounds
    return bounds.where(F.col("most") >= worst.bm25 * (1 - 1e-9))  # sums of the same weights may differ in their last digits


def lookup(spark: SparkSession, out: str, query: str, limit: int = 10, settings: Settings = Settings()) -> DataFrame:
    """doc_id and bm25 of the best documents for a query, from the buckets of its terms and the blocks that matter; ties go by id."""
    hits, blocks = _of_terms(spark, out, query, settings)
    wanted = promising(hits, blocks, limit).select("block")
    some = [r.block for r in wanted.limit(FEW + 1).collect()]
    return _scored(hits.where(F.col("block").isin(some)) if len(some) <= FEW else hits.join(wanted, "block", "left_semi"), limit)


def _of_terms(spark: SparkSession, out: str, query: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The postings and blocks of the query's terms."""
    wanted = sorted(set(search.query_terms(query)))
    numbers = sorted({zlib.crc32(t.encode()) % settings.buckets for t in wanted})
    mine = F.col("bucket").isin(numbers) & F.col("term").isin(wanted)
    return postings(spark, out).where(mine), spark.read.schema(BLOCK).parquet(f"{out.rstrip('/')}/blocks").where(mine)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Build a keyword index of a table of documents.")
    p.add_argument("--documents", required=True, help="Parquet table of documents")
    p.add_argument("--out", required=True)
    p.add_argument("--config", help="TOML file with settings")
    a = p.parse_args(args)
    setup("INFO")
    spark = SparkSession.builder.appName("keyword index").getOrCreate()
    try:
        run(spark, a.documents, a.out, config.load(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
