"""From a tree of files to chunk rows, incrementally."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import decode_text, detect_language, file_hash, has_content
from ..operators import chunk, embed, incremental
from ..operators.known import KnownVectors
from ..progress import ProgressEvent, counted, reported
from ..sources import filetree, repository
from ..store import ChunkStore


def chunk_rows(files: DataFrame, branch: str | None, embedder: embed.Embedder | None = None, max_words: int = 500, overlap_words: int = 50, batch_size: int = 32, indexed_at: float | None = None, chunkers: Sequence[chunk.Chunker] = (), lenient: bool = False, known: KnownVectors | None = None) -> DataFrame:
    """Chunk-table rows (without ids) of files with path, content or text, and file_hash; lenient gives null vectors where the embedder fails.

    With known vectors only texts that have none yet are embedded.
    """
    text = F.col("text") if "text" in files.columns else decode_text(F.col("content"))
    slim = files.select("path", "file_hash", text.alias("text"), detect_language(F.col("path")).alias("language")).where(has_content(F.col("text")))
    rows = chunk.chunk_files(slim, max_words, overlap_words, chunkers=chunkers)
    rows = rows.withColumns({"branch": F.lit(branch).cast("string"), "indexed_at": F.lit(time.time() if indexed_at is None else indexed_at)})
    if known is not None:
        return known.attach(rows)
    # Models cost far more than chunking: chunks are dealt out evenly, whatever files they come from.
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return embed.with_vectors(rows.repartition(parts, "path", "chunk_seq"), embedder, batch_size, lenient)


@dataclass(frozen=True)
class IndexReport:
    """Numbers of files, the store's version, and the first files (path, status, reason) that were skipped or failed.

    no_chunks are new or changed files in which there is nothing to index.
    """

    indexed: int
    unchanged: int
    deleted: int
    version: str | None
    skipped: int = 0
    errors: int = 0
    no_chunks: int = 0
    problems: tuple[tuple[str, str, str], ...] = ()


PROBLEMS = 100  # in a report


class Indexer:
    def __init__(self, spark: SparkSession, store: ChunkStore, config: Config | None = None, embedder: embed.Embedder | None = None, chunkers: Sequence[chunk.Chunker] = ()):
        """An embedder with a name (model_id) embeds each text once for all paths and branches; its vectors are kept beside the store."""
        self.spark, self.store, self.config, self.embedder, self.chunkers = spark, store, config or Config(), embedder, tuple(chunkers)
        name = getattr(embedder, "model_id", None)
        self.known = KnownVectors(spark, f"{store.path}/vectors", embedder, name, self.config.embeddings["batch_size"]) if name else None

    def files(self, path: str | Path, report: bool = False) -> DataFrame:
        """The files to index below path, with paths relative to the project; with report also those that cannot be."""
        c = self.config.indexer
        found = filetree.scan(self.spark, path, c["exclude"], c["max_file_size"], report=report, keep=self.store.stage)
        base = Path(path).resolve()
        base = base.parent if base.is_file() else base
        root = self.config.project_root
        prefix = "" if base == root or root not in base.parents else base.relative_to(root).as_posix() + "/"
        return found.withColumn("path", F.concat(F.lit(prefix), "path")).withColumn("file_hash", file_hash(F.col("content")))

    def files_at(self, paths: DataFrame, report: bool = False) -> DataFrame:
        """The files of some paths (a column, relative to the project), by the same rules; no other file is looked at."""
        c = self.config.indexer
        found = filetree.read_paths(paths.select("path"), self.config.project_root, c["exclude"], c["max_file_size"], report=report)
        return found.withColumn("file_hash", file_hash(F.col("content")))

    def index_path(self, path: str | Path | None = None, force: bool = False, branch: str | None = None, progress: Callable[[ProgressEvent], None] | None = None) -> IndexReport:
        """Index what is new or changed below path and drop what is gone, in one new version."""
        path = self.config.project_root if path is None else path
        branch = branch or repository.current_branch(Path(path) if Path(path).is_dir() else Path(path).parent)
        files = self.files(path, report=True)
        single = Path(path).is_file()
        prefix = "" if single else self._prefix(path)
        return self.apply(files, branch, force, prefix, cleanup=self.config.get("git", "cleanup_deleted", default=True) and not single, progress=progress)

    def _prefix(self, path: str | Path) -> str:
        base, root = Path(path).resolve(), self.config.project_root
        return base.relative_to(root).as_posix() + "/" if base != root and root in base.parents else ""

    def apply(self, files: DataFrame, branch: str | None, force: bool = False, prefix: str = "", cleanup: bool = True, deleted: DataFrame | None = None, progress: Callable[[ProgressEvent], None] | None = None, paths: DataFrame | None = None) -> IndexReport:
        """Bring the store to what files say; deleted has further paths to drop.

        If it is known that files and deleted have some paths only (a column),
        no other buckets of the store are read.

        A file with an error is skipped, one that the embedder cannot work on
        counts as an error; both keep the chunks they have.  Contents are read
        once for their hashes, and again only of files that have changed.
        """
        c = self.config.indexer
        stored = self.store.chunks() if paths is None else self.store.chunks_at(paths)
        judged = incremental.file_status(files.select("path", "abs_path", "file_hash", "error"), stored, branch, force)
        judged = judged.withColumn("status", F.when(F.col("error").isNotNull(), "skipped").otherwise(F.col("status"))).persist(StorageLevel.MEMORY_AND_DISK)
        staged = None
        try:
            counts = {r.status: r.files for r in incremental.status_counts(judged).collect()}
            changed = judged.where(F.col("status").isin("new", "changed")).select("path", "abs_path")
            gone = incremental.deleted_files(judged, stored, branch, prefix, cleanup)
            if deleted is not None:
                gone = gone.unionByName(deleted.select("path").join(stored.select("path"), "path", "left_semi")).distinct()
            n_gone = gone.count()
            n_new = counts.get("new", 0) + counts.get("changed", 0)
            failed: list[tuple[str, str, str]] = []
            nothing: list[tuple[str, str, str]] = []
            n_failed = n_empty = 0
            if n_new:
                done = counted(self.spark)
                content = filetree.read_paths(changed, self.config.project_root, max_file_size=c["max_file_size"], report=True, done=done)
                content = content.where("error IS NULL").withColumn("file_hash", file_hash(F.col("content")))
                rows = chunk_rows(content, branch, self.embedder, c["max_chunk_size"], c["chunk_overlap"], self.config.embeddings["batch_size"], chunkers=self.chunkers, lenient=True, known=self.known)
                with reported(done, n_new, progress):
                    staged = self.store.stage(rows)
                bad = staged.where("vector IS NULL").select("path").distinct()
                failed = [(r.path, "error", "embedding failed") for r in bad.orderBy("path").limit(PROBLEMS).collect()]
                empty = changed.select("path").join(staged.select("path"), "path", "left_anti")
                n_empty = empty.count()
                nothing = [(r.path, "skipped", "no_chunks") for r in empty.orderBy("path").limit(PROBLEMS).collect()] if n_empty else []
                if failed:
                    n_failed = bad.count()
                    staged, changed = staged.join(bad, "path", "left_anti"), changed.join(bad, "path", "left_anti")
            if n_gone or n_new > n_failed:
                out = changed.select("path").unionByName(gone.select("path")).withColumn("branch", F.lit(branch).cast("string"))
                self.store.upsert(staged if staged is not None else None, out)
            skipped = judged.where("status = 'skipped'").orderBy("path").limit(PROBLEMS).collect() if counts.get("skipped") else []
        finally:
            judged.unpersist()
            self.store.clear_stage()
        problems = (*((r.path, "skipped", r.error) for r in skipped), *nothing, *failed)
        return IndexReport(n_new - n_failed - n_empty, counts.get("unchanged", 0), n_gone, self.store.version(), counts.get("skipped", 0), n_failed, n_empty, problems)
