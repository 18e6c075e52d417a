"""The whole search as one lazy plan: top k, threshold, overlap, recency, trimming, context."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import enhance, search
from ..operators.filters import Filters
from ..schema import RESULT_COLUMNS


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    mode: str | None = None
    min_score: float = 0.3
    fts_weight: float = 0.5
    deduplicate: bool = True
    overlap_threshold: float = 0.5
    recency_weight: float = 0.1
    expand_context: bool = False
    context_lines_before: int = 3
    context_lines_after: int = 3

    @classmethod
    def of(cls, config: Config, limit: int | None = None, mode: str | None = None, deduplicate: bool | None = None, expand_context: bool | None = None) -> SearchOptions:
        """Settings, under what a call says."""
        s = config.search
        pick = lambda given, name: s[name] if given is None else given
        same = ("min_score", "fts_weight", "overlap_threshold", "recency_weight", "context_lines_before", "context_lines_after")
        return cls(limit=pick(limit, "default_limit"), mode=pick(mode, "mode"), deduplicate=pick(deduplicate, "deduplicate"), expand_context=pick(expand_context, "expand_context"), **{k: s[k] for k in same})


def run(
    chunks: DataFrame,
    query_text: str | None,
    query_vector: Sequence[float] | None,
    options: SearchOptions = SearchOptions(),
    filters: Filters = Filters(),
    files: DataFrame | None = None,
    index: DataFrame | None = None,
    stats: DataFrame | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Result columns and rank.  files (path, text) are asked for context, if it is wanted; vectors are those of chunks without."""
    if options.limit < 0:
        raise ValueError("the limit must not be negative")
    wanted = options.limit * (2 if options.deduplicate else 1)
    found = search.search(chunks, query_text, query_vector, wanted, options.mode, filters, options.min_score, options.fts_weight, index, stats, vectors)
    if options.deduplicate:
        found = enhance.deduplicate(found, options.overlap_threshold)
    found = enhance.trim(enhance.rerank_by_recency(found, options.recency_weight), options.limit)
    if options.expand_context and files is not None:
        found = enhance.expand_context(found, files, options.context_lines_before, options.context_lines_after, options.limit)
    return found.select(*RESULT_COLUMNS, "rank").orderBy("rank")


#: What payload() gives.
PAYLOAD = "path string, start_line int, end_line int, code string, score double, language string, chunk_type string, name string, branch string, rank int"


def payload(results: DataFrame) -> DataFrame:
    """Results as tools show them: text is called code, scores have three decimals."""
    return results.select("path", "start_line", "end_line", F.col("text").alias("code"), F.round("score", 3).alias("score"), "language", "chunk_type", "name", "branch", "rank")
