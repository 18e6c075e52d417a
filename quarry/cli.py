"""Command line: init, index, search, status, clean, version."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__, config


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--project", default=".")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    x = commands.add_parser("index")
    x.add_argument("path", nargs="?", default=".")
    x.add_argument("--force", action="store_true")
    x.add_argument("--branch")
    x = commands.add_parser("search")
    x.add_argument("query")
    x.add_argument("--limit", type=int)
    x.add_argument("--mode", choices=["vector", "fts", "hybrid"])
    for name in ("extensions", "directories", "chunk-types", "languages"):
        x.add_argument(f"--{name}", nargs="*")
    x.add_argument("--file-filter")
    x.add_argument("--branch")
    x.add_argument("--expand", action="store_true")
    x.add_argument("--no-dedup", action="store_true")
    x.add_argument("--brief", action="store_true", help="the beginning of each result only")
    x.add_argument("--json", action="store_true")
    x = commands.add_parser("status")
    x.add_argument("--json", action="store_true")
    x = commands.add_parser("clean")
    x.add_argument("--yes", action="store_true")
    commands.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "version":
        print(f"quarry {__version__}")
        return 0
    if a.command == "init":
        try:
            print(f"wrote {config.init(a.project)}")
        except FileExistsError:
            print("already initialized", file=sys.stderr)
            return 1
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .api import Service
    from .functions.columns import result_line, stats_text
    from .progress import format_eta

    service = Service(SparkSession.builder.appName("quarry").getOrCreate(), a.project)
    if a.command == "index":
        show = lambda e: print(f"{e.current}/{e.total} files, {format_eta(e.eta)} left  {e.filename}", file=sys.stderr)
        out = service.ctx_index(a.path, a.force, a.branch, show)
    elif a.command == "status":
        out = service.ctx_status()
        if not a.json and "error" not in out:
            s = service.store.stats()
            print(s.select(stats_text(*(s[c] for c in ("total_files", "total_chunks", "total_size_bytes", "languages", "last_indexed"))).alias("text")).first().text)
            return 0
    elif a.command == "clean":
        if not a.yes:
            print("clean deletes the whole index; say --yes", file=sys.stderr)
            return 1
        service.store.clear_all()
        out = {"cleaned": True}
    else:
        out = service.ctx_search(a.query, a.limit, a.file_filter, a.branch, a.extensions, a.directories, a.chunk_types, a.languages, a.mode, a.expand, False if a.no_dedup else None)
        if not a.json and "error" not in out:
            if a.brief and out["results"]:
                rows = service.spark.createDataFrame([(k, r["path"], r["start_line"], r["end_line"], r["score"], r["code"]) for k, r in enumerate(out["results"])], "k int, path string, s int, e int, score double, text string")
                print(*(r.line for r in rows.orderBy("k").select(result_line(*map(F.col, ("path", "s", "e", "score", "text"))).alias("line")).collect()), sep="\n")
                return 0
            for r in out["results"]:
                print(f"{r['path']}:{r['start_line']}-{r['end_line']}  {r['score']:.3f}  {r['name'] or ''}\n{r['code']}\n")
            return 0
    print(json.dumps(out, indent=2, default=str))
    return 1 if "error" in out else 0


if __name__ == "__main__":
    sys.exit(main())
