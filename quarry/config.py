"""Configuration: TOML over defaults."""

from __future__ import annotations

import copy
import logging
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)

FOLDER, FILE = ".quarry", "config.toml"
#: The default settings.
DEFAULTS: dict[str, dict[str, Any]] = {
    "indexer": {
        "exclude": ["node_modules", "*.min.js", "dist", "build", ".venv", "venv", "__pycache__", "*.pyc", ".git", FOLDER],
        "max_file_size": 1048576,
        "max_chunk_size": 500,
        "chunk_overlap": 50,
    },
    "embeddings": {"batch_size": 32},
    "search": {
        "default_limit": 10, "min_score": 0.3, "mode": "hybrid", "fts_weight": 0.5, "deduplicate": True, "overlap_threshold": 0.5,
        "expand_context": False, "context_lines_before": 3, "context_lines_after": 3, "recency_weight": 0.1,
    },
    "git": {"cleanup_deleted": True},
}
ALIASES = {("indexer", "exclude_patterns"): "exclude", ("indexer", "max_file_size_bytes"): "max_file_size"}


def _over(base: dict, top: Mapping) -> dict:
    for k, v in top.items():
        base[k] = _over(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), dict) else copy.deepcopy(v)
    return base


class Config:
    """Settings of a project; a missing or broken file gives the defaults."""

    def __init__(self, project_root: str | Path | None = None):
        self.project_root = Path(project_root or ".").resolve()
        self.values = copy.deepcopy(DEFAULTS)
        path = self.project_root / FOLDER / FILE
        if path.exists():
            try:
                found = tomllib.loads(path.read_text(encoding="utf-8"))
            except (OSError, ValueError) as e:
                log.warning("%s is not used: %s", path, e)
            else:
                for (section, old), new in ALIASES.items():
                    if isinstance(found.get(section), dict) and old in found[section]:
                        found[section].setdefault(new, found[section].pop(old))
                _over(self.values, found)

    def get(self, *keys: str, default: Any = None) -> Any:
        at: Any = self.values
        for k in keys:
            if not isinstance(at, Mapping) or k not in at:
                return default
            at = at[k]
        return at

    def set(self, *keys_and_value: Any) -> None:
        *keys, value = keys_and_value
        if not keys:
            raise ValueError("set() needs a key and a value")
        at = self.values
        for k in keys[:-1]:
            at = at.setdefault(k, {})
        at[keys[-1]] = value

    indexer = property(lambda self: self.values["indexer"])
    embeddings = property(lambda self: self.values["embeddings"])
    search = property(lambda self: self.values["search"])


def toml(values: Mapping[str, Mapping[str, Any]] = DEFAULTS) -> str:
    """Settings as TOML."""

    def one(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return str(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    return "\n".join(f"[{section}]\n" + "".join(f"{k} = {one(v)}\n" for k, v in body.items()) for section, body in values.items())


def init(project_root: str | Path) -> Path:
    """Write the default configuration; FileExistsError if the project has one."""
    folder = Path(project_root) / FOLDER
    folder.mkdir()
    (folder / FILE).write_text(toml(), encoding="utf-8")
    return folder / FILE
