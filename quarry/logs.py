"""Logging to the console and to a rotating file, as lines or as JSON."""

from __future__ import annotations

import json
import logging
import logging.handlers
from pathlib import Path

NAME = "quarry"


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out)


def setup(level: str = "INFO", file: str | Path | None = None, as_json: bool = False, max_bytes: int = 10 << 20, backups: int = 5) -> logging.Logger:
    logger = logging.getLogger(NAME)
    logger.setLevel(level.upper())
    logger.handlers.clear()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file is not None:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.handlers.RotatingFileHandler(file, maxBytes=max_bytes, backupCount=backups))
    for h in handlers:
        h.setFormatter(JsonFormatter() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(h)
    return logger
