"""What git says about a directory."""

from __future__ import annotations

import subprocess
from pathlib import Path


def _git(path: str | Path, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=path, capture_output=True, text=True, timeout=5, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def current_branch(path: str | Path) -> str | None:
    """The branch, detached-<short commit> on a detached head, None outside a repository."""
    branch = _git(path, "rev-parse", "--abbrev-ref", "HEAD")
    if branch != "HEAD":
        return branch or None
    commit = _git(path, "rev-parse", "--short", "HEAD")
    return f"detached-{commit}" if commit else None


def is_repository(path: str | Path) -> bool:
    return _git(path, "rev-parse", "--git-dir") is not None


def repository_root(path: str | Path) -> Path | None:
    found = _git(path, "rev-parse", "--show-toplevel")
    return Path(found) if found else None
