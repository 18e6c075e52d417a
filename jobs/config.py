"""Settings of jobs: a dataclass for each, filled from a small TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import fields
from typing import TypeVar

S = TypeVar("S")


def load(kind: type[S], file: str | None) -> S:
    """The settings of a kind, with the values of the file over the defaults; unknown names and values of another type are errors."""
    if file is None:
        return kind()
    with open(file, "rb") as f:
        given = tomllib.load(f)
    known = {f.name: f for f in fields(kind)}
    for name, value in given.items():
        if name not in known:
            raise ValueError(f"{file}: unknown setting {name}; there are {', '.join(known)}")
        if type(value) is not type(known[name].default):
            raise ValueError(f"{file}: {name} must be a {type(known[name].default).__name__}")
    return kind(**given)
