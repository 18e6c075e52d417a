"""Aggregates over the chunk table.  None of them reads the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import size_mb


def language_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("language").agg(F.count("*").alias("chunks"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: total_files, total_chunks, total_size_bytes (characters), languages (chunks by language), last_indexed."""
    by = chunks.groupBy("language").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"), F.max("indexed_at").alias("last"))
    totals = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size_bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"), F.max("last").alias("last_indexed"))
    files = chunks.agg(F.countDistinct("path").alias("total_files"))
    return totals.withColumn("total_files", files.scalar()).select("total_files", "total_chunks", "total_size_bytes", "languages", "last_indexed")


def status(chunks: DataFrame) -> DataFrame:
    return as_status(index_stats(chunks))


def as_status(found: DataFrame) -> DataFrame:
    """The status that a row of index_stats gives."""
    return found.select("total_files", "total_chunks", size_mb(F.col("total_size_bytes")).alias("total_size_mb"), "languages", "last_indexed", (F.col("total_chunks") > 0).alias("indexed"))


def indexed_files(chunks: DataFrame, branch: str | None = None) -> DataFrame:
    return (chunks if branch is None else chunks.where(F.col("branch") == branch)).select("path").distinct()
