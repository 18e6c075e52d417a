"""What happens to results after the top k: overlap removal, recency, trimming, context.

Inputs are results of a search: at most a few thousand rows with score and rank.
"""

from __future__ import annotations

import bisect
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import overlap
from .search import SMALL


def ranked(results: DataFrame, *order: Column) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


class _Kept:
    """Ranges of lines that stay, in the order of their starts.

    Of two that stay none lies within the other (that is all of the shorter
    one), so their ends have the same order; and where the threshold is below
    1, only some 1 / (1 - threshold) of them can lie over one line.
    """

    def __init__(self, threshold: float):
        self.threshold, self.starts, self.ends = threshold, [], []

    def add(self, start: int, end: int) -> bool:
        """Keep the range, unless it shares too much with one that is kept."""
        k = bisect.bisect_left(self.starts, start)
        clash = lambda i: (min(end, self.ends[i]) - max(start, self.starts[i]) + 1) / min(end - start + 1, self.ends[i] - self.starts[i] + 1) >= self.threshold
        if self.threshold <= 0:
            free = not self.starts
        elif self.threshold > 1:
            free = True
        else:
            few = self.threshold == 1  # then only the neighbours can hold it, or lie in it
            left = itertools.takewhile(lambda i: self.ends[i] >= start, range(k - 1, -1, -1))
            right = itertools.takewhile(lambda i: self.starts[i] <= end, range(k, len(self.starts)))
            free = not any(map(clash, itertools.islice(left, 1 if few else None))) and not any(map(clash, itertools.islice(right, 1 if few else None)))
        if free:
            self.starts.insert(k, start), self.ends.insert(k, end)
        return free


def without_overlap(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Within a path, the best first: a chunk goes if it shares so much of its lines with a chunk that stays.

    Ranks are all different and ranges have a line at least.  The greedy choice
    goes through each path's ranges, not its texts, in their order, and looks
    at the few that can lie over the same lines.  _first is the best rank of
    the path.
    """

    def run(batches):
        path, kept, begun = None, _Kept(threshold), False
        for batch in batches:
            out = []
            for name, rank, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if name != path or not begun:
                    path, kept, begun = name, _Kept(threshold), True
                if kept.add(start, end):
                    out.append(rank)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["_rank"])

    slim = results.select("path", "score", F.col("rank").cast("long").alias("rank"), "start_line", "end_line")
    chosen = slim.repartition("path").sortWithinPartitions("path", F.desc("score"), "rank").mapInArrow(run, "_rank long")
    best = results.groupBy("path").agg(F.min("rank").alias("_first"))
    return results.join(chosen, F.col("rank") == F.col("_rank"), "left_semi").join(best, "path").select("_first", *results.columns)


def _folded(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """without_overlap() of the few results of a search, as a fold over each path's rows."""
    columns = results.columns
    row = F.struct((-F.col("score")).alias("_s"), F.col("rank").alias("_r"), F.struct(*columns).alias("row"))
    by_path = results.groupBy("path").agg(F.sort_array(F.collect_list(row)).alias("c"), F.min("rank").alias("_first"))
    clash = lambda a, b: overlap(a.row.start_line, a.row.end_line, b.row.start_line, b.row.end_line) >= threshold
    kept = F.aggregate("c", F.slice("c", 1, 0), lambda done, x: F.when(F.exists(done, lambda y: clash(x, y)), done).otherwise(F.concat(done, F.array(x))))
    return by_path.select("_first", F.explode(kept).alias("k")).select("_first", "k.row.*")


def deduplicate(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The results of a search without overlap, ranked anew."""
    return ranked(_folded(results, threshold), F.desc("score"), F.col("_first"), F.col("rank")).drop("_first")


def ages(results: DataFrame) -> DataFrame:
    """One row with the oldest and newest indexed_at, for tables too large for one task."""
    return results.agg(F.min("indexed_at").alias("low"), F.max("indexed_at").alias("high"))


def boosted(results: DataFrame, weight: float = 0.1, about: DataFrame | None = None) -> DataFrame:
    """score + weight * (how recent, 0 to 1), at most 1; as it is if all are equally old.

    about is ages() of a large table; a search's few results are looked at in one task.
    """
    if about is None:
        everything = Window.partitionBy()
        timed = results.withColumns({"_low": F.min("indexed_at").over(everything), "_high": F.max("indexed_at").over(everything)})
    else:
        timed = results.withColumn("_ages", about.select(F.struct("low", "high")).scalar()).select(*results.columns, F.col("_ages.low").alias("_low"), F.col("_ages.high").alias("_high"))
    span = F.col("_high") - F.col("_low")
    score = F.when(span == 0, F.col("score")).otherwise(F.least(F.lit(1.0), F.col("score") + weight * F.try_divide(F.col("indexed_at") - F.col("_low"), span)))
    return timed.withColumns({"score": score, "_same": span == 0}).drop("_low", "_high")


def rerank_by_recency(results: DataFrame, weight: float = 0.1) -> DataFrame:
    """Results boosted by recency and ranked anew; the order stays where all are equally old."""
    if not weight:
        return results
    order = F.when(F.col("_same"), F.lit(0.0)).otherwise(-F.col("score"))
    return ranked(boosted(results, weight), order, F.col("rank")).drop("_same")


def trim(results: DataFrame, limit: int) -> DataFrame:
    return results.where(F.col("rank") <= limit)


def expand_context(results: DataFrame, files: DataFrame, before: int = 3, after: int = 3, limit: int | None = None) -> DataFrame:
    """Texts and lines widened in the files (path, text) as they are now; without its file a row stays as it is.

    The result paths select files before their texts are read further; they
    are broadcast if the limit of the results is known and small.
    """
    paths = results.select("path").distinct()
    paths = F.broadcast(paths) if limit is not None and limit <= SMALL else paths
    lines = files.join(paths, "path", "left_semi").select("path", F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0)).alias("_lines")).dropDuplicates(["path"])
    joined = results.join(lines, "path", "left")
    n = F.size("_lines")
    start, end = F.greatest(F.lit(1), F.col("start_line") - before), F.least(n, F.col("end_line") + after)
    usable = F.col("_lines").isNotNull() & (start <= end)
    wide = joined.withColumns({"_start": start, "_end": end, "_ok": usable})
    text = F.array_join(F.slice("_lines", F.col("_start"), F.greatest(F.col("_end") - F.col("_start") + 1, F.lit(0))), "")
    return wide.withColumns({"text": F.when(F.col("_ok"), text).otherwise(F.col("text")), "start_line": F.when(F.col("_ok"), F.col("_start")).otherwise(F.col("start_line")), "end_line": F.when(F.col("_ok"), F.col("_end")).otherwise(F.col("end_line"))}).select(*results.columns)
