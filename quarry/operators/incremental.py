"""What has changed between the stored chunks and the files, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stored_hashes(chunks: DataFrame) -> DataFrame:
    """path, branch and one file_hash for each."""
    return chunks.groupBy("path", "branch").agg(F.min("file_hash").alias("stored_hash"))


def file_status(files: DataFrame, chunks: DataFrame, branch: str | None = None, force: bool = False) -> DataFrame:
    """files (path, file_hash, ...) with status new, changed or unchanged, against the branch's stored hashes."""
    stored = stored_hashes(chunks).where(F.col("branch").eqNullSafe(F.lit(branch))).select("path", "stored_hash")
    joined = files.join(stored, "path", "left")
    status = F.when(F.col("stored_hash").isNull(), "new").when((F.col("stored_hash") == F.col("file_hash")) & ~F.lit(force), "unchanged").otherwise("changed")
    return joined.withColumn("status", status).drop("stored_hash")


def deleted_files(files: DataFrame, chunks: DataFrame, branch: str | None = None, prefix: str = "", cleanup: bool = True) -> DataFrame:
    """Paths stored for the branch (under a prefix) that are no more among the files."""
    stored = chunks.where(F.col("branch").eqNullSafe(F.lit(branch)) & F.col("path").startswith(prefix)).select("path").distinct()
    return stored.join(files.select("path"), "path", "left_anti") if cleanup else stored.limit(0)


def delete_by_path(chunks: DataFrame, path: str) -> DataFrame:
    """The chunks that stay when a path goes, on all branches."""
    return chunks.where(~F.col("path").eqNullSafe(F.lit(path)))


def delete_by_branch(chunks: DataFrame, branch: str) -> DataFrame:
    """The chunks that stay when a branch goes; those without a branch stay."""
    return chunks.where(~F.coalesce(F.col("branch") == branch, F.lit(False)))


def upsert(chunks: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks without the (path, branch) pairs in gone, and with the new ones."""
    g = gone.select(F.col("path").alias("_p"), F.col("branch").alias("_b")).distinct()
    same: Column = (F.col("path") == F.col("_p")) & F.col("branch").eqNullSafe(F.col("_b"))
    return chunks.join(g, same, "left_anti").unionByName(new)


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("files"))
