"""Scan of a file tree.

Spark's own file sources leave out names that begin with a dot or underscore,
so executors list the directories.  A round takes a table of directories, each
with the ignore rules that hold in it, and gives their files and the next
table: directories below them, with their own rules added.  A task goes down
by itself until it has seen FOLDERS directories; what is left then is dealt
out anew.  The driver sees counts, never paths.  Contents are read in
partitions of about equal bytes.  The tree must be mounted at the same place on
all executors.
"""

from __future__ import annotations

import datetime as dt
import logging
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILE
from .ignore import IgnoreSpec, ancestor_ignore_lines, load_nested_ignore, placed_lines

log = logging.getLogger(__name__)
Keep = Callable[[DataFrame], DataFrame]
FOLDERS = 512  # directories that a task lists in a round
ROWS = 10_000

BYTES_PER_PARTITION = 16 << 20
OPEN_COST = 256 << 10


def walk(root: str, exclude: Sequence[str] = (), use_gitignore: bool = True) -> Iterator[tuple[str, str, int]]:
    """(relative path, absolute path, size) of every file that no rule leaves out, in the order of paths."""
    base = Path(root)
    if not base.exists():
        raise ValueError(f"Path does not exist: {root}")
    if base.is_file():
        yield base.name, str(base.resolve()), base.stat().st_size
        return
    rules = [x for x in (load_nested_ignore(base) if use_gitignore else None, IgnoreSpec(exclude)) if x is not None]
    for folder, folders, names in os.walk(base):
        folders.sort()
        for name in sorted(names):
            path = Path(folder) / name
            relative = path.relative_to(base).as_posix()
            if not any(r.matches(relative) for r in rules):
                try:
                    yield relative, str(path.resolve()), path.stat().st_size
                except OSError:
                    continue


TOO_LARGE = "larger than the limit"


def _read(relative: str, path: str, max_size: int) -> tuple:
    """A row of the scan; without its content, and with an error, if it is too large or cannot be read."""
    try:
        about = os.stat(path)
        changed = dt.datetime.fromtimestamp(about.st_mtime, dt.UTC).replace(tzinfo=None)
        if about.st_size > max_size:
            return relative, path, about.st_size, changed, None, TOO_LARGE
        with open(path, "rb") as f:
            content = f.read()
    except OSError as e:
        return relative, path, 0, None, None, f"cannot be read: {e.strerror}"
    return relative, path, len(content), changed, content, None


_LISTED = "kind string, path string, abs_path string, length long, lines array<string>"


def _expand(root: str, exclude: Sequence[str], gitignore: bool):
    """A function of batches of directories (path, lines: the rules from above): rows of files (kind f), and of directories to be listed yet (kind d)."""

    def entries(path: str, lines: list[str], left_out: IgnoreSpec, prune: bool) -> Iterator[tuple]:
        if gitignore:
            lines = lines + placed_lines(Path(root, path, ".gitignore"), path or ".")
        rules = IgnoreSpec(lines)
        try:
            found = sorted(os.scandir(os.path.join(root, path)), key=lambda e: e.name)
        except OSError as e:
            log.warning("%s is not listed: %s", path, e)
            return
        for entry in found:
            relative = f"{path}/{entry.name}" if path else entry.name
            if entry.is_dir(follow_symlinks=False):
                if not (prune and left_out.matches(relative + "/x")):
                    yield "d", relative, None, None, lines
            elif not (rules.matches(relative) or left_out.matches(relative)):
                try:
                    if not entry.is_dir():
                        yield "f", relative, os.path.realpath(entry.path), entry.stat().st_size, None
                except OSError:
                    continue

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = IgnoreSpec(exclude)
        prune = not any(x.startswith("!") for x in exclude)  # then nothing below an excluded directory comes back
        kinds = {"kind": pa.string(), "path": pa.string(), "abs_path": pa.string(), "length": pa.int64(), "lines": pa.list_(pa.string())}
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))
        seen, out = 0, []
        for batch in batches:
            todo = [(r["path"], r["lines"]) for r in batch.to_pylist()]
            while todo and seen < FOLDERS:
                for row in entries(*todo.pop(), left_out, prune):
                    (todo if row[0] == "d" else out).append((row[1], row[4]) if row[0] == "d" else row)
                    if len(out) >= ROWS:
                        yield batch_of(out)
                        out = []
                seen += 1
            out += [("d", path, None, None, lines) for path, lines in todo]
            for lo in range(0, len(out), ROWS):
                yield batch_of(out[lo : lo + ROWS])
            out = []

    return run


def listed(spark: SparkSession, root: str | Path, exclude: Sequence[str] = (), gitignore: bool = True, keep: Keep | None = None) -> DataFrame:
    """path, abs_path and length of every file under root that no rule leaves out.

    keep makes a round's table once (by writing it, say) and returns it;
    without it tables are persisted.
    """
    keep = keep or (lambda rows: rows.persist(StorageLevel.MEMORY_AND_DISK))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    run, rounds = _expand(str(root), exclude, gitignore), []
    todo = spark.createDataFrame([("", [])], "path string, lines array<string>").coalesce(1)
    while True:
        rounds.append(keep(todo.mapInArrow(run, _LISTED)))
        left = rounds[-1].where("kind = 'd'").select("path", "lines")
        n = left.count()
        if not n:
            return reduce(DataFrame.unionByName, rounds).where("kind = 'f'").select("path", "abs_path", "length")
        todo = left.repartition(min(n, 4 * parts), "path")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "abs_path": pa.string(), "length": pa.int64(), "mtime": pa.timestamp("us", "UTC"), "content": pa.binary(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))


def _contents(files: Iterable[tuple[str, str]], max_size: int, report: bool, done: Accumulator | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of (path, absolute path), in batches of bounded bytes; done counts them."""
    rows, size = [], 0
    for relative, where in files:
        row = _read(relative, where, max_size)
        if done is not None:
            done.add((1, relative))
        if row[-1] is None or report:
            rows.append(row)
            size += len(row[4] or b"") + OPEN_COST
        if size >= BYTES_PER_PARTITION:
            yield _batch(rows)
            rows, size = [], 0
    yield _batch(rows)


def scan(spark: SparkSession, root: str | Path, exclude: Sequence[str] = (), max_file_size: int = 1048576, gitignore: bool = True, report: bool = False, keep: Keep | None = None) -> DataFrame:
    """The files under root (or root itself, if a file): path, abs_path, length, mtime, content, error.

    Files that are too large or cannot be read are left out; with report they
    have a row without content that says why.  keep is as in listed().
    """
    base = Path(root)
    if not base.exists():
        raise ValueError(f"Path does not exist: {root}")
    if base.is_file():
        files = spark.createDataFrame([(base.name, str(base.resolve()), base.stat().st_size)], "path string, abs_path string, length long")
    else:
        files = listed(spark, base, exclude, gitignore, keep)
    if not report:
        files = files.where(F.col("length") <= max_file_size)
    size = files.agg(F.sum(F.least("length", F.lit(max_file_size)) + OPEN_COST)).first()[0] or 0
    dealt = files.select("path", "abs_path").repartition(1 + size // BYTES_PER_PARTITION, "path")

    def run(batches):
        yield from _contents(((p, a) for b in batches for p, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), max_file_size, report)

    return dealt.mapInArrow(run, FILE)


class _Rules:
    """The ignore rules for single paths: only the ignore files above a path are read."""

    def __init__(self, root: str, exclude: Sequence[str], gitignore: bool):
        self.root, self.exclude, self.gitignore = root, IgnoreSpec(exclude), gitignore
        self.folders: dict[str, IgnoreSpec] = {}

    def leave_out(self, relative: str) -> bool:
        folder = relative.rpartition("/")[0]
        if folder not in self.folders:
            self.folders[folder] = IgnoreSpec(ancestor_ignore_lines(self.root, folder) if self.gitignore else [])
        return self.folders[folder].matches(relative) or self.exclude.matches(relative)


def read_paths(paths: DataFrame, root: str | Path, exclude: Sequence[str] = (), max_file_size: int = 1048576, gitignore: bool = True, report: bool = False, done: Accumulator | None = None) -> DataFrame:
    """The rows of scan() for some paths (a column path, relative to root): nothing else of the tree is listed or read.

    Executors read the files where they are; paths that do not exist, lie
    outside root or are ignored have no row.  paths may have abs_path, too:
    then these files have been judged before, and no rule is asked.  done is
    from progress.counted().
    """
    judged = "abs_path" in paths.columns
    root = str(Path(root).resolve())

    def wanted(batches):
        rules = _Rules(root, exclude, gitignore)
        for batch in batches:
            for r in batch.to_pylist():
                where = r["abs_path"] if judged else os.path.realpath(os.path.join(root, r["path"]))
                if judged or where.startswith(root.rstrip("/") + "/") and not rules.leave_out(r["path"]) and os.path.isfile(where):
                    yield r["path"], where

    def run(batches):
        yield from _contents(wanted(batches), max_file_size, report, done)

    slim = paths.select("path", *(["abs_path"] if judged else [])).distinct()
    return slim.mapInArrow(run, FILE)
