"""The tool interface: search, status and index, as plain dictionaries."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import replace
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import FOLDER, Config
from .functions.columns import decode_text
from .operators.embed import Embedder, HashingEmbedder
from .operators.filters import Filters
from .operators import enhance
from .plans import retrieval
from .plans.indexing import Indexer
from .progress import ProgressEvent
from .store import ChunkStore

log = logging.getLogger(__name__)


class Service:
    """A project's store, configuration and embedder; nothing is opened before it is needed."""

    def __init__(self, spark: SparkSession, project_root: str | Path | None = None, embedder: Embedder | None = None):
        self.spark, self.project_root = spark, project_root
        self.config: Config | None = None
        self.store: ChunkStore | None = None
        self.embedder = embedder or HashingEmbedder()
        self.indexer: Indexer | None = None
        if project_root is not None:
            self.initialize(project_root)

    def initialize(self, project_root: str | Path) -> None:
        self.config = Config(project_root)
        self.store = ChunkStore(self.spark, str(self.config.project_root / FOLDER / "store"))
        self.indexer = Indexer(self.spark, self.store, self.config, self.embedder)

    def ctx_search(
        self,
        query: str,
        limit: int | None = None,
        file_filter: str | None = None,
        branch: str | None = None,
        extensions: Sequence[str] | None = None,
        directories: Sequence[str] | None = None,
        chunk_types: Sequence[str] | None = None,
        languages: Sequence[str] | None = None,
        mode: str | None = None,
        expand_context: bool | None = None,
        deduplicate: bool | None = None,
    ) -> dict[str, Any]:
        if self.store is None or self.config is None:
            return {"error": "Index not initialized. Run ctx_index first.", "results": []}
        try:
            options = retrieval.SearchOptions.of(self.config, limit, mode, deduplicate, expand_context)
            filters = Filters(extensions, directories, chunk_types, languages, file_filter, branch)
            vector = self.embedder.embed_batch([query])[0] if options.mode in ("vector", "hybrid") and query else None
            plain = replace(options, expand_context=False)
            make = lambda: retrieval.payload(retrieval.run(self.store.wide(), query, vector, plain, filters, None, *self.store.index())).orderBy("rank")
            rows = self.store.cached((query, plain, filters.key()), make)
            if rows and options.expand_context:  # from the files of the results alone, as they are now
                found = self.spark.createDataFrame(rows, retrieval.PAYLOAD).withColumnRenamed("code", "text")
                files = self.indexer.files_at(found.select("path")).select("path", decode_text(F.col("content")).alias("text"))
                found = enhance.expand_context(found, files, options.context_lines_before, options.context_lines_after, options.limit)
                rows = found.withColumnRenamed("text", "code").orderBy("rank").collect()
            results = [{k: v for k, v in r.asDict().items() if k != "rank"} for r in rows]
            return {"query": query, "mode": options.mode, "count": len(results), "results": results}
        except Exception as e:  # noqa: BLE001  the interface reports failures as values
            log.exception("search failed")
            return {"error": str(e), "results": []}

    def ctx_status(self) -> dict[str, Any]:
        if self.store is None:
            return {"error": "Index not initialized. Run ctx_index first.", "stats": None}
        try:
            return self.store.status().first().asDict()
        except Exception as e:  # noqa: BLE001
            log.exception("status failed")
            return {"error": str(e), "stats": None}

    def warm_up(self) -> None:
        """Load the embedder and look at the store, so that the first search does not wait for them."""
        self.embedder.embed_batch(["warm up"])
        if self.store is not None:
            self.store.manifest()

    def ctx_index(self, path: str = ".", force: bool = False, branch: str | None = None, progress: Callable[[ProgressEvent], None] | None = None) -> dict[str, Any]:
        if self.config is None or self.indexer is None:
            return {"error": "Config not initialized"}
        where = Path(path) if Path(path).is_absolute() else self.config.project_root / path
        if not where.exists():
            return {"error": f"Path does not exist: {path}"}
        try:
            report = self.indexer.index_path(where, force, branch, progress)
            problems = [dict(zip(("path", "status", "reason"), p, strict=True)) for p in report.problems]
            return {"path": str(where), "indexed": report.indexed, "unchanged": report.unchanged, "deleted": report.deleted, "skipped": report.skipped, "errors": report.errors, "no_chunks": report.no_chunks, "problems": problems, **{k: v for k, v in self.ctx_status().items() if k != "indexed"}}
        except Exception as e:  # noqa: BLE001
            log.exception("index run failed")
            return {"error": str(e)}
