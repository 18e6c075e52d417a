"""Chunkers: from files to rows of (chunk_seq, text, start_line, end_line, chunk_type, name).

Paragraph and header chunkers are Spark expressions; definitions in code need
a parser and run in an Arrow function.  All give no chunk for blank text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import has_content, strip, with_value
from ..schema import CODE_LANGUAGES
from .code_scan import definitions

CHUNK_TYPE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("chunk_type", T.StringType()), T.StructField("name", T.StringType())]))
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("chunk_type", pa.string()), ("name", pa.string())]))
HEADER = r"(?dU)^(#{1,6})\s+(.+)$"


def _chunk(text: Column, start: Column, end: Column, kind: str, name: Column | None = None) -> Column:
    return F.struct(text.alias("text"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.lit(kind).alias("chunk_type"), (F.lit(None) if name is None else name).cast("string").alias("name"))


def paragraph_chunks(text: Column, max_words: int = 500, overlap_words: int = 50) -> Column:
    """Paragraphs between blank lines; long ones in overlapping pieces of max_words words.

    Line numbers count the lines of paragraphs only, not the blank ones between.
    """
    if not 0 <= overlap_words < max_words:
        raise ValueError("the overlap must be smaller than the chunk size")
    step = max_words - overlap_words
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")

    def placed(ps: Column) -> Column:
        """Every paragraph with its first line: the lines' paragraphs, in order, and where these change."""
        sized = F.transform(ps, lambda p: F.struct(p.alias("text"), (F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + 1).alias("lines")))
        owners = F.flatten(F.transform(sized, lambda p, i: F.array_repeat(i, p.lines)))
        first = with_value(owners, lambda o: F.filter(F.sequence(F.lit(1), F.size(o)), lambda k: (k == 1) | (F.get(o, k - 1) != F.get(o, k - 2))))
        return F.zip_with(sized, first, lambda p, k: F.struct(p.text.alias("text"), k.alias("first"), p.lines.alias("lines")))

    def pieces(p: Column) -> Column:
        whole = F.array(_chunk(p.text, p.first, p.first + p.lines - 1, "paragraph"))

        def cut(words: Column) -> Column:
            n = F.size(words)
            windows = F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1), lambda k: _chunk(F.array_join(F.slice(words, k * step + 1, F.lit(max_words)), " "), p.first + k, p.first + k, "paragraph"))
            return F.when(n <= max_words, whole).otherwise(windows)

        return with_value(F.split(p.text, r"(?U)\s+"), cut)

    return F.when(has_content(text), with_value(paragraphs, lambda ps: F.flatten(F.transform(placed(ps), pieces))))


def section_chunks(text: Column) -> Column:
    """Sections from each header line (of any level) to the next; what precedes the first is one without a name."""

    def sections(lines: Column, heads: Column) -> Column:
        def section(i: Column, k: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1) - 1, F.size(lines))
            first = F.get(lines, i - 1)
            name = F.when(first.rlike(HEADER), strip(F.regexp_extract(first, HEADER, 2)))
            return _chunk(F.array_join(F.slice(lines, i, end - i + 1), "\n"), i, end, "section", name)

        return F.transform(heads, section)

    starts = lambda lines: F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | F.get(lines, i - 1).rlike(HEADER))
    return F.when(has_content(text), with_value(F.split(text, "\n"), lambda lines: with_value(starts(lines), lambda heads: sections(lines, heads))))


_SLICE = 32  # texts whose chunks are Python objects at a time; those of the rest of a batch are Arrow's


def _sliced(chunks: Callable[..., list], *columns: pa.Array) -> pa.Array:
    """The chunks of a batch of rows, made for a few rows at a time, so that a worker's memory does not follow the number of chunks in a batch."""
    out = [pa.array(chunks(*(c.slice(lo, _SLICE).to_pylist() for c in columns)), _ARROW) for lo in range(0, len(columns[0]), _SLICE)]
    made = pa.concat_arrays(out) if out else pa.array([], _ARROW)
    del out
    pa.default_memory_pool().release_unused()
    return made


def _code_chunks(texts: list[str | None], languages: list[str]) -> list[list[dict] | None]:
    out = []
    for t, lang in zip(texts, languages, strict=True):
        try:
            out.append([d._asdict() for d in definitions(t or "", lang)])
        except Exception:  # noqa: BLE001  a scanner's failure must not stop the job: the text is chunked by paragraphs
            out.append(None)
    return out


@F.arrow_udf(CHUNK_TYPE)
def _code_udf(text: pa.Array, language: pa.Array) -> pa.Array:
    return _sliced(_code_chunks, text, language)


#: Definitions in code; a text in which the scanner fails has no chunks here (see chunk_files).
code_chunks = _code_udf.asNondeterministic()  # else the filter that goes with an explode has every text scanned twice


class Chunker(Protocol):
    """Which languages it is for, and the chunks (CHUNK_TYPE; null or empty for none) of a text of them."""

    def wants(self, language: Column) -> Column: ...

    def chunks(self, text: Column, language: Column) -> Column: ...


class ParagraphChunker:
    """For every text; see paragraph_chunks."""

    def __init__(self, max_words: int = 500, overlap_words: int = 50):
        self.max_words, self.overlap_words = max_words, overlap_words

    def wants(self, language: Column) -> Column:
        return F.lit(True)

    def chunks(self, text: Column, language: Column) -> Column:
        return paragraph_chunks(text, self.max_words, self.overlap_words)


class SectionChunker:
    """For markdown; see section_chunks."""

    def wants(self, language: Column) -> Column:
        return language == "markdown"

    def chunks(self, text: Column, language: Column) -> Column:
        return section_chunks(text)


class CodeChunker:
    """For languages with a scanner; texts in which that fails go by paragraphs."""

    def __init__(self, max_words: int = 500):
        self.max_words = max_words

    def wants(self, language: Column) -> Column:
        return language.isin(*CODE_LANGUAGES)

    def chunks(self, text: Column, language: Column) -> Column:
        return F.coalesce(code_chunks(text, language), paragraph_chunks(text, self.max_words, 50 if self.max_words > 50 else 0))


class FunctionChunker:
    """A Python function from a text to dictionaries (text, start_line, end_line, chunk_type, name), for some languages."""

    def __init__(self, languages: Sequence[str], function: Callable[[str], Sequence[Mapping[str, Any]]]):
        self.languages, self.function = tuple(languages), function

    def wants(self, language: Column) -> Column:
        return language.isin(*self.languages)

    def chunks(self, text: Column, language: Column) -> Column:
        function = self.function

        @F.arrow_udf(CHUNK_TYPE)
        def run(texts: pa.Array) -> pa.Array:
            return _sliced(lambda few: [[{k: c.get(k) for k in _ARROW.value_type.names} for c in function(t or "")] for t in few], texts)

        return run.asNondeterministic()(text)


def default_chunkers(max_words: int = 500, overlap_words: int = 50) -> list[Chunker]:
    return [CodeChunker(max_words), SectionChunker(), ParagraphChunker(max_words, overlap_words)]


def chunk_files(files: DataFrame, max_words: int = 500, overlap_words: int = 50, text_col: str = "text", language_col: str = "language", chunkers: Sequence[Chunker] = ()) -> DataFrame:
    """One row per chunk: files' other columns, then chunk_seq, text, start_line, end_line, chunk_type and name.

    A file goes to the first chunker that wants its language; the given ones come before the usual.
    """
    rest = [c for c in files.columns if c != text_col]
    text, language = F.col(text_col), F.col(language_col)
    other = lambda df, chunks: df.select(*rest, F.posexplode(chunks).alias("chunk_seq", "chunk")).select(*rest, "chunk_seq", "chunk.*")
    parts, taken = [], F.lit(False)
    for chunker in [*chunkers, *default_chunkers(max_words, overlap_words)]:
        wanted = F.coalesce(chunker.wants(language), F.lit(False))
        parts.append(other(files.where(wanted & ~taken).withColumn("_chunks", chunker.chunks(text, language)), F.col("_chunks")))
        taken = taken | wanted
    return reduce(DataFrame.unionByName, parts)
