"""File events from listings: what was created, modified or deleted since the last look.

Spark's file streams never report deletions or changes of a known file, so a
poller compares listings and writes the differences as JSON lines, which the
change feed reads.  The last listing is kept beside the events; a poll that
was interrupted is repeated by the next one.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import threading
from collections.abc import Mapping, Sequence
from pathlib import Path

from ..sources.filetree import walk

Listing = dict[str, tuple[int, ...]]  # path: (modification time in ns, size, number of the file in its file system)


def listing(root: str | Path, exclude: Sequence[str] = (), max_file_size: int = 1048576, gitignore: bool = True) -> Listing:
    """The files that would be indexed; larger ones and ignored ones are not seen."""
    out: Listing = {}
    for relative, path, size in walk(str(root), exclude, gitignore):
        if size <= max_file_size:
            try:
                about = os.stat(path)
                out[relative] = (about.st_mtime_ns, about.st_size, about.st_ino)
            except OSError:
                continue
    return out


def moves(before: Mapping[str, tuple[int, ...]], after: Mapping[str, tuple[int, ...]]) -> dict[str, str]:
    """Old and new path of files that have another path but are the same file, unchanged."""
    lost = {v: p for p, v in before.items() if p not in after and len(v) > 2}
    return {lost[v]: p for p, v in sorted(after.items()) if p not in before and v in lost}


def changes(before: Mapping[str, tuple[int, ...]], after: Mapping[str, tuple[int, ...]]) -> list[tuple[str, str]]:
    """(path, event type), in the order of paths; a move shows as a deletion and a creation."""
    kind = lambda p: "deleted" if p not in after else "created" if p not in before else "modified"
    return [(p, kind(p)) for p in sorted({*before, *after}) if before.get(p) != after.get(p)]


class TreePoller:
    def __init__(self, root: str | Path, events: str | Path, exclude: Sequence[str] = (), max_file_size: int = 1048576):
        if not Path(root).is_dir():
            raise ValueError(f"not a directory: {root}")
        self.root, self.events, self.exclude, self.max_file_size = Path(root), Path(events), list(exclude), max_file_size
        self.state = self.events / ".listing.json"  # hidden from Spark's file source
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def _last(self) -> tuple[int, Listing]:
        if not self.state.exists():
            return 0, {}
        kept = json.loads(self.state.read_text())
        return kept["seq"], {p: tuple(v) for p, v in kept["files"].items()}

    def _put(self, path: Path, text: str) -> None:
        temp = path.with_name(f".{path.name}.tmp")
        temp.write_text(text)
        os.replace(temp, path)

    def start_from_here(self) -> None:
        """Take the present files as known."""
        self.events.mkdir(parents=True, exist_ok=True)
        self._put(self.state, json.dumps({"seq": self._last()[0], "files": listing(self.root, self.exclude, self.max_file_size)}))

    def poll(self) -> list[tuple[str, str]]:
        """Write an event file for what has changed; the changes."""
        self.events.mkdir(parents=True, exist_ok=True)
        seq, before = self._last()
        after = listing(self.root, self.exclude, self.max_file_size)
        found = changes(before, after)
        if found:
            now = dt.datetime.now(dt.UTC).isoformat()
            moved = moves(before, after)
            shown = [(p, "moved" if p in moved else t) for p, t in found if p not in moved.values()]
            rows = [json.dumps({"path": p, "event_type": t, "event_time": now, "seq": seq + k} | ({"dest_path": moved[p]} if p in moved else {})) for k, (p, t) in enumerate(shown, 1)]
            self._put(self.events / f"events-{seq + len(found):012d}.json", "\n".join(rows) + "\n")
            self._put(self.state, json.dumps({"seq": seq + len(found), "files": after}))
        return found

    def start(self, interval: float = 0.5) -> None:
        """Poll in the background until stop()."""

        def run() -> None:
            while not self._stop.wait(interval):
                self.poll()

        self._stop.clear()
        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
            self._thread = None

    @property
    def is_running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()
