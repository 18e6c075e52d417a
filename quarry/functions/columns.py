"""Scalar functions as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LANGUAGES


def detect_language(path: Column) -> Column:
    """The language of a path's last suffix, unknown without one."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, suffix), F.lit("unknown"))


def file_hash(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit(""))


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """UTF-8 text without invalid bytes, with line ends as newlines."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))


def has_content(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Common lines as a share of the shorter range."""
    common = F.greatest(F.lit(0), F.least(end1, end2) - F.greatest(start1, start2) + 1)
    return common / F.least(end1 - start1 + 1, end2 - start2 + 1)


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def size_mb(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def chunk_id(branch: Column, path: Column, seq: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.coalesce(branch, F.lit("")), path, seq.cast("string"), digest), 256)


def format_file_size(size: Column) -> Column:
    """B, KB, MB, GB, TB with one decimal."""
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.format_string("%.1f " + unit, (size / float(1024**k)).cast("double"))
        last = unit == "TB"
        out = (F.when(size < 1024 ** (k + 1), text) if out is None else out.otherwise(text) if last else out.when(size < 1024 ** (k + 1), text))
    return out


def format_duration(seconds: Column) -> Column:
    """2.5s, 1m 30s, 1h 15m."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm %ds", m, F.pmod(s, F.lit(60))))


def format_eta(seconds: Column) -> Column:
    """45s, 2m 5s, 1h 1m, unknown without a value."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(seconds.isNull(), "unknown").when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, F.pmod(s, F.lit(60)))).otherwise(F.format_string("%ds", s))


def stats_text(total_files: Column, total_chunks: Column, size: Column, languages: Column, last: Column) -> Column:
    """The index in a few lines: files, chunks, size, chunks by language, and when it was last written."""
    by = F.array_join(F.transform(F.array_sort(F.map_entries(languages)), lambda e: F.format_string("%s %d", e.key, e.value)), ", ")
    when = F.coalesce(F.date_format(F.timestamp_seconds(last), "yyyy-MM-dd HH:mm:ss"), F.lit("never"))
    return F.format_string("Files: %d\nChunks: %d\nSize: %s\nLanguages: %s\nLast indexed: %s", total_files, total_chunks, format_file_size(size), by, when)


def result_line(path: Column, start: Column, end: Column, score: Column, text: Column) -> Column:
    """path:start-end (score), then the beginning of the text."""
    return F.format_string("%s:%d-%d (%.3f)\n%s...", path, start, end, score.cast("double"), F.substring(text, 1, 100))


def with_value(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is made once for a row; inside a lambda Spark makes an expression again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
