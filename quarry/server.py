"""The tools over standard input and output: JSON-RPC, one message per line."""

from __future__ import annotations

import json
import logging
import sys
import threading
from collections.abc import Callable
from typing import Any, TextIO

from . import __version__
from .api import Service

log = logging.getLogger(__name__)
_TEXT, _LIST = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
TOOLS = {
    "ctx_search": ("Search the index", {"query": _TEXT, "limit": {"type": "integer"}, "file_filter": _TEXT, "branch": _TEXT, "extensions": _LIST, "directories": _LIST, "chunk_types": _LIST, "languages": _LIST, "mode": _TEXT, "expand_context": {"type": "boolean"}, "deduplicate": {"type": "boolean"}}, ["query"]),
    "ctx_status": ("Statistics of the index", {}, []),
    "ctx_index": ("Index a path", {"path": _TEXT, "force": {"type": "boolean"}, "branch": _TEXT}, []),
}


class Server:
    def __init__(self, service: Service):
        self.service = service

    def handle(self, message: dict[str, Any]) -> dict[str, Any] | None:
        """The answer to a message; None to notifications."""
        if "id" not in message:
            return None
        make: Callable[[dict], Any] | None = {"initialize": self._initialize, "ping": lambda p: {}, "tools/list": self._list, "tools/call": self._call}.get(message.get("method", ""))
        answer: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
        if make is None:
            return answer | {"error": {"code": -32601, "message": "unknown method"}}
        try:
            return answer | {"result": make(message.get("params") or {})}
        except (KeyError, TypeError) as e:
            return answer | {"error": {"code": -32602, "message": str(e)}}

    def _initialize(self, params: dict) -> dict:
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": __version__}}

    def _list(self, params: dict) -> dict:
        return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}

    def _warm_up(self) -> None:
        try:
            self.service.warm_up()
        except Exception:  # noqa: BLE001  the first call will show what is wrong
            log.exception("warm-up failed")

    def _call(self, params: dict) -> dict:
        name = params["name"]
        if name not in TOOLS:
            raise KeyError(f"unknown tool {name}")
        result = getattr(self.service, name)(**(params.get("arguments") or {}))
        return {"content": [{"type": "text", "text": json.dumps(result, default=str)}], "isError": "error" in result}

    def serve(self, source: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
        threading.Thread(target=self._warm_up, daemon=True).start()
        for line in source:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if answer is not None:
                out.write(json.dumps(answer) + "\n")
                out.flush()


def main() -> None:
    from pyspark.sql import SparkSession

    root = sys.argv[1] if len(sys.argv) > 1 else "."
    spark = SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    Server(Service(spark, root)).serve()


if __name__ == "__main__":
    main()
