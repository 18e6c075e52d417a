import io
import json

import pytest

from quarry.api import Service
from quarry.server import Server
from quarry.streaming import feed
from quarry.streaming.listing import TreePoller, changes


def test_changes():
    assert changes({"a": (1, 1), "b": (1, 1), "c": (1, 1)}, {"a": (1, 1), "b": (2, 1), "d": (1, 1)}) == [("b", "modified"), ("c", "deleted"), ("d", "created")]


def test_moves(tmp_path):
    root, events = tmp_path / "p", tmp_path / "events"
    root.mkdir()
    (root / "a.py").write_text("a = 1\n")
    (root / "b.py").write_text("b = 1\n")
    poller = TreePoller(root, events)
    poller.start_from_here()
    (root / "a.py").rename(root / "c.py")
    (root / "b.py").unlink()
    assert poller.poll() == [("a.py", "deleted"), ("b.py", "deleted"), ("c.py", "created")]
    rows = [json.loads(x) for x in next(events.glob("events-*.json")).read_text().splitlines()]
    assert [(r["path"], r["event_type"], r.get("dest_path")) for r in rows] == [("a.py", "moved", "c.py"), ("b.py", "deleted", None)]


def test_poller_feeds_the_watcher(spark, tmp_path):
    root, events = tmp_path / "p", tmp_path / "events"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    pass\n")
    (root / "b.txt").write_text("old words\n")
    s = Service(spark, root)
    s.ctx_index(".")
    poller = TreePoller(root, events, s.config.indexer["exclude"])
    poller.start_from_here()
    assert poller.poll() == []
    (root / "b.txt").unlink()
    (root / "a.py").write_text("def b():\n    pass\n")
    (root / "big.txt").write_text("x" * 2_000_000)
    assert poller.poll() == [("a.py", "modified"), ("b.txt", "deleted")]
    watcher = feed.Watcher(spark, s.indexer, str(events), str(tmp_path / "check"))
    watcher.start(None).awaitTermination(120)
    assert {(r.path, r.name) for r in s.store.chunks().collect()} == {("a.py", "b")}
    watcher.start(None).awaitTermination(120)  # nothing new: nothing happens
    version = s.store.version()
    poller.start(0.05)
    assert poller.is_running
    poller.stop()
    assert not poller.is_running and s.store.version() == version
    with pytest.raises(ValueError):
        TreePoller(root / "a.py", events)


def test_server(spark, tmp_path):
    (tmp_path / "n.md").write_text("# Head\nsome words\n" + "".join(f"# Other {i}\ntext\n" for i in range(9)))
    server = Server(Service(spark, tmp_path))
    ask = lambda method, **params: {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
    lines = [ask("initialize"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, ask("tools/list"), ask("tools/call", name="ctx_index", arguments={"path": "."}), ask("tools/call", name="ctx_search", arguments={"query": "words", "mode": "fts"}), ask("tools/call", name="other"), ask("nothing")]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(map(json.dumps, lines)) + "\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == 7 and got[0]["result"]["serverInfo"]["name"] == "quarry" and len(got[1]["result"]["tools"]) == 3
    assert json.loads(got[3]["result"]["content"][0]["text"])["results"][0]["path"] == "n.md"
    assert got[4]["error"]["code"] == -32602 and got[5]["error"]["code"] == -32601 and got[6]["error"]["code"] == -32700
