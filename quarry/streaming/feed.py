"""Change feed: file events to index changes, with Structured Streaming.

Events come as JSON lines (path, event_type, event_time, seq) in a directory.
A moved file is an event deleted for the old path and created for the new.
Within a micro-batch the last event of a path wins; with a quiet period the
last event of a path is held in the stream's state until none has come for so
long.  Batches are applied through the same incremental plan as an index run,
so applying one again after a failure changes nothing.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.indexing import Indexer

log = logging.getLogger(__name__)
EVENT = T.StructType([T.StructField("path", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("event_time", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("dest_path", T.StringType())])


def read_events(spark: SparkSession, directory: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_batch).json(directory)


def split_moves(events: DataFrame) -> DataFrame:
    """path, event_type, event_time, seq: a move becomes a deletion and a creation."""
    pair = F.when(F.col("event_type") == "moved", F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("event_type")), F.struct(F.col("dest_path").alias("path"), F.lit("created").alias("event_type")))).otherwise(F.array(F.struct("path", "event_type")))
    return events.select(F.explode(pair).alias("e"), "event_time", "seq").select("e.path", "e.event_type", "event_time", "seq").where(F.col("path").isNotNull())


def last_event(events: DataFrame) -> DataFrame:
    """path and its last event_type."""
    return events.groupBy("path").agg(F.max_by("event_type", F.struct("event_time", "seq")).alias("event_type"))


def debounce(events: DataFrame, gap: str = "10 seconds", time_col: str = "event_time", by: str | None = None, watermark: str | None = None) -> DataFrame:
    """Bursts of events with quiet times between: start, end, events; over all, or by a column.

    A burst over all events is one key; the keyed form spreads over the cluster.
    """
    e = events.withWatermark(time_col, watermark) if watermark else events
    keys = [F.session_window(time_col, gap).alias("w"), *([F.col(by)] if by else [])]
    return e.groupBy(*keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *([by] if by else []), "events")


def settle(events: DataFrame, quiet: float) -> DataFrame:
    """path and its last event_type, of a stream of events, once none has come for the path for so many seconds.

    What waits is the stream's state, a row for each path: it outlives the
    query, and what has been quiet meanwhile comes with the next start.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            event_type, _, _ = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "event_type": [event_type]})
            return
        last = state.get if state.exists else ("", -(2**63), -(2**63))
        for batch in batches:
            for event_type, at, seq in zip(batch["event_type"], batch["at"], batch["seq"], strict=True):
                if (at, seq) >= last[1:]:
                    last = (event_type, at, seq)
        state.update((str(last[0]), int(last[1]), int(last[2])))
        state.setTimeoutDuration(int(quiet * 1000))

    timed = events.select("path", "event_type", F.coalesce(F.unix_micros("event_time"), F.lit(0)).alias("at"), F.coalesce("seq", F.lit(0)).alias("seq"))
    return timed.groupBy("path").applyInPandasWithState(run, "path string, event_type string", "event_type string, at long, seq long", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Watcher:
    """Keeps a store up to date with a project directory, fed by event files.

    With a quiet period a path is looked at when none of its events has come
    for so long; what waits lies in the checkpoint, and the next start() goes on
    with it.
    """

    def __init__(self, spark: SparkSession, indexer: Indexer, events: str, checkpoint: str, branch: str | None = None, on_change: Callable[[str, str], None] | None = None, quiet: float = 0.0):
        if not Path(indexer.config.project_root).is_dir():
            raise ValueError(f"not a directory: {indexer.config.project_root}")
        self.spark, self.indexer, self.events, self.checkpoint, self.branch, self.on_change, self.quiet = spark, indexer, events, checkpoint.rstrip("/"), branch, on_change, quiet
        self.query: StreamingQuery | None = None

    def apply(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Apply events now, then report each path's last one."""
        self._apply_last(last_event(split_moves(batch)))

    def _apply_last(self, last: DataFrame, batch_id: int | None = None) -> None:
        last = last.persist()
        try:
            if last.head(1):
                files = self.indexer.files_at(last.where("event_type <> 'deleted'"))  # these alone are read
                report = self.indexer.apply(files, self.branch, cleanup=False, deleted=last.where("event_type = 'deleted'"), paths=last)
                for problem in report.problems:
                    log.error("%s: %s (%s)", *problem)
                if self.on_change:
                    for r in last.toLocalIterator():
                        self.on_change(r.path, r.event_type)
        finally:
            last.unpersist()

    def start(self, interval: str | None = "1 second") -> StreamingQuery:
        """Run until stop(); without an interval, until the present events are applied, at once."""
        events = read_events(self.spark, self.events)
        if interval and self.quiet:
            # A stream that starts without new events runs no batch, in which what waits could come: a clock gives it one.
            clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
            ticks = clock.selectExpr("CAST(NULL AS string) path", "'' event_type", "timestamp event_time", "value seq")
            out = settle(split_moves(events).unionByName(ticks), self.quiet).writeStream.foreachBatch(self._apply_last)
        else:
            out = events.writeStream.foreachBatch(self.apply)
        out = out.option("checkpointLocation", self.checkpoint)
        self.query = (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
        return self.query

    def stop(self) -> None:
        """Stop; what waits stays in the checkpoint for the next start."""
        if self.query is not None:
            self.query.stop()

    @property
    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive
