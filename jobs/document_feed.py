"""Keeps a table of chunks up to date with a growing folder of documents.

    python -m jobs.document_feed --documents IN --out OUT --checkpoint DIR [--config jobs/document_feed.toml]

Documents come as Parquet files (doc_id, text, lang, source) that are added to
the folder IN (or as one file); a document that comes again replaces its earlier version.  A run
takes the files that no run has taken yet, and ends.

OUT/versions   every version of every document, in chunks: batch=N/shelf=S
OUT/chunks     the latest version of every document: shelf=S

A shelf is a range of ids.  A batch writes its versions, then the shelves that
these touch anew, from the versions alone: so nothing is read and written at
once, a batch that is run again after a failure does the same, and its work
follows what is new and the shelves it falls into, not the whole table.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.columns import file_hash
from quarry.logs import setup
from quarry.operators.chunk import paragraph_chunks
from quarry.operators.search import n_tokens

from . import config

log = logging.getLogger("quarry.jobs.document_feed")
DOCUMENT = "doc_id long, text string, lang string, source string"


@dataclass(frozen=True)
class Settings:
    ids_per_shelf: int = 100_000
    files_per_batch: int = 1000
    files_per_shelf: int = 8
    max_words: int = 500
    overlap_words: int = 50


def newest(rows: DataFrame) -> DataFrame:
    """Of several rows of a document in one batch the one of the latest file, and there the one of the greatest hash."""
    order = F.struct("changed", "file", "file_hash")
    one = rows.groupBy("doc_id").agg(F.max_by(F.struct("text", "lang", "source", "changed", "file", "file_hash"), order).alias("d"))
    return one.select("doc_id", "d.*")


def chunked(documents: DataFrame, settings: Settings) -> DataFrame:
    """A row for each chunk of each document; one without a chunk for a document that has no text."""
    rest = [c for c in documents.columns if c != "text"]
    rows = documents.select(*rest, F.posexplode_outer(paragraph_chunks(F.col("text"), settings.max_words, settings.overlap_words)).alias("chunk_seq", "c"))
    return rows.select(*rest, "chunk_seq", "c.text", "c.start_line", "c.end_line", "c.chunk_type", n_tokens(F.col("c.text")).cast("long").alias("n_tokens"))


def latest(versions: DataFrame) -> DataFrame:
    """The chunks of each document's latest version."""
    order = F.struct("changed", "file", "batch")
    return versions.withColumn("newest", F.max(order).over(Window.partitionBy("doc_id"))).where(F.col("newest") == order).drop("newest", "changed", "file", "batch")


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _files(spark: SparkSession, documents: str, settings: Settings) -> DataFrame:
    """The stream of the files of a folder; a single file is its folder's only one of that name."""
    reader = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", settings.files_per_batch)
    path, fs = _path(spark, documents)
    if fs.exists(path) and fs.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(str(path.getParent()))
    return reader.parquet(documents)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Take what is new in the folder; how many batches, documents and chunks that were, and how many chunks there are now."""
    out = out.rstrip("/")
    taken = {"batches": 0, "documents": 0, "chunks": 0}

    def apply(batch: DataFrame, number: int) -> None:
        known = batch.where("doc_id IS NOT NULL").withColumn("file_hash", file_hash(F.coalesce("text", F.lit("")).cast("binary")))
        rows = chunked(newest(known), settings).withColumn("shelf", F.floor(F.col("doc_id") / settings.ids_per_shelf))
        place = f"{out}/versions/batch={number}"
        # A shelf's rows go to a few files of their own, whichever task has made them.
        rows.repartition("shelf", F.pmod(F.xxhash64("doc_id"), F.lit(settings.files_per_shelf))).write.mode("overwrite").partitionBy("shelf").parquet(place)
        written = batch.sparkSession.read.parquet(place)
        shelves = [r.shelf for r in written.select("shelf").distinct().collect()]  # a number for each folder just written
        counts = written.agg(F.countDistinct("doc_id").alias("documents"), F.count("chunk_seq").alias("chunks")).first()
        log.info("batch %d: %d documents in %d chunks written to %s", number, counts.documents, counts.chunks, place)
        if shelves:
            versions = batch.sparkSession.read.option("basePath", f"{out}/versions").schema(written.schema.add("batch", "integer")).parquet(f"{out}/versions")
            now = latest(versions.where(F.col("shelf").isin(shelves) & (F.col("batch") <= number)))
            now.repartition("shelf", F.pmod(F.xxhash64("doc_id"), F.lit(settings.files_per_shelf))).sortWithinPartitions("shelf", "doc_id", "chunk_seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shelf").parquet(f"{out}/chunks")
            log.info("batch %d: %d shelves written to %s/chunks", number, len(shelves), out)
        taken["batches"] += 1
        taken["documents"] += counts.documents
        taken["chunks"] += counts.chunks

    log.info("reading new files of %s, with the checkpoint %s", documents, checkpoint)
    stream = _files(spark, documents, settings)
    stream = stream.select("doc_id", "text", "lang", "source", F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"))
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    total = {"total_chunks": chunks(spark, out).where("chunk_seq IS NOT NULL").count()}
    log.info("%d batches, %d documents, %d chunks taken; %d chunks in %s/chunks", *taken.values(), *total.values(), out)
    return taken | total


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """The table of chunks as it stands: doc_id, lang, source, file_hash, chunk_seq, text, start_line, end_line, chunk_type, n_tokens, shelf."""
    schema = "doc_id long, lang string, source string, file_hash string, chunk_seq int, text string, start_line int, end_line int, chunk_type string, n_tokens long, shelf long"
    path, fs = _path(spark, f"{out}/chunks")
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/chunks")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Keep a table of chunks up to date with a growing folder of documents.")
    p.add_argument("--documents", required=True, help="folder of Parquet files with doc_id, text, lang, source")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", help="TOML file with settings")
    a = p.parse_args(args)
    setup("INFO")
    spark = SparkSession.builder.appName("document feed").getOrCreate()
    try:
        run(spark, a.documents, a.out, a.checkpoint, config.load(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
