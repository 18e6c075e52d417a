"""Progress of an index run: files read so far and the last one's name, rate, remaining time."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ProgressEvent:
    current: int
    total: int
    filename: str
    elapsed: float
    eta: float | None
    rate: float


def format_eta(seconds: float | None) -> str:
    if seconds is None:
        return "unknown"
    minutes, s = divmod(int(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes}m" if hours else f"{minutes}m {s}s" if minutes else f"{s}s"


def format_duration(seconds: float) -> str:
    return f"{seconds:.1f}s" if seconds < 60 else format_eta(seconds) if seconds < 3600 else "{}h {}m".format(*divmod(int(seconds) // 60, 60))


class ProgressTracker:
    def __init__(self, total: int, callback: Callable[[ProgressEvent], None] | None = None):
        self.total, self.callback, self.current, self.began = total, callback, 0, time.time()

    def update(self, filename: str = "", step: int = 1) -> ProgressEvent:
        self.current += step
        elapsed = time.time() - self.began
        rate = self.current / elapsed if elapsed > 0 else 0.0
        event = ProgressEvent(self.current, self.total, filename, elapsed, (self.total - self.current) / rate if rate else None, rate)
        if self.callback:
            self.callback(event)
        return event

    def summary(self) -> str:
        elapsed = time.time() - self.began
        return f"{self.current}/{self.total} files in {format_duration(elapsed)}"


class _Files(AccumulatorParam):
    """How many files, and the last one's name."""

    def zero(self, value: tuple[int, str]) -> tuple[int, str]:
        return 0, ""

    def addInPlace(self, a: tuple[int, str], b: tuple[int, str]) -> tuple[int, str]:  # noqa: N802
        return a[0] + b[0], b[1] or a[1]


def counted(spark: SparkSession) -> Accumulator:
    """What tasks add (1, name) to for each file they have read; a task that is run again adds its files again."""
    return spark.sparkContext.accumulator((0, ""), _Files())


@contextlib.contextmanager
def reported(done: Accumulator, total: int, callback: Callable[[ProgressEvent], None] | None, every: float = 0.5) -> Iterator[None]:
    """Reports the files that the tasks inside have read, of so many; the last report says that all are done.

    Counts come as tasks end, so many small tasks report often.
    """
    if callback is None:
        yield
        return
    tracker, over = ProgressTracker(total, callback), threading.Event()

    def watch() -> None:
        while not over.wait(every):
            now, name = done.value
            if tracker.current < now < total:
                tracker.update(name, now - tracker.current)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
        over.set()
        thread.join()
        tracker.update(done.value[1], total - tracker.current)
    finally:
        over.set()
        thread.join()
