"""Predicates on chunks.  Values are literal: there are no wildcards and nothing is built into SQL text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ignore import compile_pattern


@dataclass(frozen=True)
class Filters:
    """All that are set hold together; empty ones are inactive."""

    extensions: Sequence[str] | None = None  # a path's end
    directories: Sequence[str] | None = None  # a path's beginning
    chunk_types: Sequence[str] | None = None
    languages: Sequence[str] | None = None
    file_filter: str | None = None  # anywhere in the path
    branch: str | None = None  # never matches a null branch
    glob: str | None = None  # a wildcard pattern on the whole path

    def condition(self) -> Column | None:
        path, found = F.col("path"), []
        any_of = lambda cs: reduce(lambda a, b: a | b, cs)
        if self.extensions:
            found.append(any_of([path.endswith(x) for x in self.extensions]))
        if self.directories:
            found.append(any_of([path.startswith(x) for x in self.directories]))
        if self.chunk_types:
            found.append(F.col("chunk_type").isin(*self.chunk_types))
        if self.languages:
            found.append(F.col("language").isin(*self.languages))
        if self.file_filter:
            found.append(path.contains(self.file_filter))
        if self.branch:
            found.append(F.col("branch") == self.branch)
        if self.glob and (rule := compile_pattern(self.glob)):
            found.append(path.rlike("(?s)" + rule[1]))
        return reduce(lambda a, b: a & b, found) if found else None

    def apply(self, chunks: DataFrame) -> DataFrame:
        c = self.condition()
        return chunks if c is None else chunks.where(c)

    def key(self) -> tuple:
        return tuple((f.name, tuple(v) if isinstance(v := getattr(self, f.name), (list, tuple)) else v) for f in fields(self))
