"""Wildcard patterns of ignore files, as ordered regular expressions of which the last match wins."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Iterable
from pathlib import Path

log = logging.getLogger(__name__)


#: The end of a path; unlike $ it means the same in Python and Java, also before a line break.
END = r"(?![\s\S])"


def _literal(c: str) -> str:
    """One character for use inside a class, with the same meaning in Python and Java."""
    return c if c.isalnum() or ord(c) > 127 else "\\" + c


def _class(body: str) -> str:
    """A bracket expression as a regular expression; it never matches a slash, and a reversed range has no members."""
    negated = body[:1] in ("!", "^")
    body, members, i = body[negated:], [], 0
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            if body[i] <= body[i + 2]:
                members.append(f"{_literal(body[i])}-{_literal(body[i + 2])}")
            i += 3
        else:
            members.append(_literal(body[i]))
            i += 1
    if negated:
        return "[^/" + "".join(members) + "]"
    return "(?!/)[" + "".join(members) + "]" if members else r"[^\s\S]"


def _segment(s: str) -> str:
    """One path segment of a pattern as a regular expression."""
    out, i = [], 0
    while i < len(s):
        c = s[i]
        i += 1
        if c == "*":
            while i < len(s) and s[i] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i < len(s):
            out.append(re.escape(s[i]))
            i += 1
        elif c == "[" and (end := s.find("]", i + (s[i : i + 1] in ("!", "^")) + 1)) > 0:
            out.append(_class(s[i:end]))
            i = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def compile_pattern(line: str) -> tuple[bool, str] | None:
    """(ignores, regular expression) of a line; None for blank lines and comments."""
    line = line.rstrip("\n\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line.strip() or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    body = line[1:] if not ignores else line
    folder = body.endswith("/")
    parts = [p for p in body.strip("/").split("/")]
    if parts == [""]:
        return None
    anchored = "/" in body.rstrip("/")
    out = "" if anchored else "(?:.*/)?"
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            out += ".*" if last else "(?:.*/)?"
        else:
            out += _segment(p) + ("" if last else "/")
    if parts[-1] == "**":
        return ignores, f"^{out}{END}"
    return ignores, f"^{out}" + ("/.*" if folder else "(?:/.*)?") + END


class IgnoreSpec:
    """An ordered list of patterns."""

    def __init__(self, lines: Iterable[str]):
        self.rules = [(ignores, re.compile(rx, re.S)) for ignores, rx in filter(None, map(compile_pattern, lines))]

    def matches(self, path: str) -> bool:
        path = path.replace(os.sep, "/").lstrip("/")
        for ignores, rx in reversed(self.rules):
            if rx.match(path):
                return ignores
        return False


def placed_lines(path: Path, where: str) -> list[str]:
    """The lines of an ignore file in a directory, written from the root."""
    out = []
    if not path.is_file():
        return out
    try:
        lines = path.read_text(encoding="utf-8").splitlines()
    except (OSError, UnicodeError) as e:
        log.warning("%s is not used: %s", path, e)
        return out
    for line in lines:
        if where == "." or not line.strip() or line.lstrip().startswith("#"):
            out.append(line)
        else:
            sign = "!" if line.startswith("!") else ""
            out.append(f"{sign}{where}/{line[len(sign) :].lstrip('/')}")
    return out


def nested_ignore_lines(root: str | Path) -> list[str]:
    """The lines of all .gitignore files under root; those of subdirectories hold for their directory.

    A nested pattern is put behind its directory's name, which anchors it: it
    does not reach into deeper directories unless it says so.
    """
    root = Path(root)
    return [x for path in sorted(root.rglob(".gitignore")) for x in placed_lines(path, path.parent.relative_to(root).as_posix())]


def ancestor_ignore_lines(root: str | Path, folder: str) -> list[str]:
    """Those of the nested lines that can hold for files in a folder (relative to root): of the folder and the ones above it."""
    root, where = Path(root), Path(folder or ".")
    folders = [where, *where.parents] if folder else [where]
    return [x for f in reversed(folders) if (path := root / f / ".gitignore").is_file() for x in placed_lines(path, f.as_posix())]


def load_nested_ignore(root: str | Path) -> IgnoreSpec | None:
    """The ignore rules of a tree; None if it has no patterns."""
    lines = nested_ignore_lines(root)
    return IgnoreSpec(lines) if lines else None
