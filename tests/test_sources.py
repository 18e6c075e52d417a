import os
import random
import re
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.config import DEFAULTS, FOLDER, Config, init
from quarry.sources import filetree, repository
from quarry.sources.ignore import IgnoreSpec, compile_pattern, load_nested_ignore


def put(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.mark.parametrize(
    "lines, path, ignored",
    [
        (["*.log"], "a/b.log", True), (["*.log"], "a/b.logs", False), (["build"], "x/build/y.txt", True), (["/build"], "x/build/y.txt", False),
        (["build/"], "build", False), (["build/"], "build/a", True), (["a/*.c"], "a/x.c", True), (["a/*.c"], "a/b/x.c", False), (["a/**/c"], "a/c", True),
        (["a/**/c"], "a/b/b/c", True), (["**/t.py"], "x/y/t.py", True), (["a/**"], "a/b/c", True), (["a/**"], "a", False), (["*.log", "!keep.log"], "keep.log", False),
        (["!keep.log", "*.log"], "keep.log", True), (["# x", "", "\\#y"], "#y", True), (["f[0-9].t"], "f3.t", True), (["f[!0-9].t"], "f3.t", False), (["a?c"], "abc", True),
        (["a?c"], "a/c", False), (["x "], "x", True), (["*.min.js"], "lib/q.min.js", True), (["node_modules"], "p/node_modules/q/r.js", True), (["\\!a"], "!a", True),
        (["[?-.]"], "a", False), (["[z-a]x"], "zx", False), (["[!z-a]x"], "zx", True), (["[^]a]"], "b", True), (["[^]a]"], "]", False), (["[^]a]"], "a", False),
        (["[]a]"], "]", True), (["[]a]"], "a", True), (["[a&&b]"], "&", True), (["[a&&b]"], "a", True), (["[a&&b]"], "b", True), (["[a&&b]"], "c", False),
        (["[\\d]"], "5", False), (["[\\d]"], "d", True), (["[\\d]"], "\\", True), (["x[.-0]y"], "x/y", False), (["x[!a]y"], "x/y", False), (["[a-]"], "-", True), (["[-a]"], "-", True),
        (["[[]"], "[", True), (["[[:a]"], ":", True), (["[]"], "[]", True), (["[!]"], "[!]", True), (["[~a~]"], "~", True), (["[a^]"], "^", True), (["a"], "a\n", False),
    ],
)
def test_patterns(lines, path, ignored):
    assert IgnoreSpec(lines).matches(path) is ignored


PATTERN = st.text(alphabet="ab*?[]!/\\.#^-&~z0 ", max_size=14)


@settings(deadline=None, max_examples=2000)
@given(PATTERN)
def test_any_pattern_compiles(p):
    IgnoreSpec([p]).matches("a/b.b")


def test_java_reads_patterns_as_python_does(spark):
    rng, alphabet = random.Random(8), "ab*?[]!/\\.^-&~z0"
    patterns = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(1500)] + ["[?-.]", "[^]a]", "[a&&b]", "[\\d]", "[!z-a]x"]
    paths = ["a", "b", "]", "ab", "a/b", "a.b", "[a]", "&", "-", "zx", "z0/b", "\\", "^", "~", "a\n"]
    java = spark._jvm.java.util.regex.Pattern
    for p in patterns:
        if rule := compile_pattern(p):
            compiled = java.compile("(?s)" + rule[1])
            for x in paths:
                assert bool(re.compile(rule[1], re.S).search(x)) == compiled.matcher(x).find(), (p, rule[1], x)


def test_nested_rules(tmp_path):
    put(tmp_path, {".gitignore": "*.log\n", "sub/.gitignore": "# c\n*.tmp\n!keep.log\n"})
    spec = load_nested_ignore(tmp_path)
    assert spec.matches("x.log") and spec.matches("sub/a.tmp") and not spec.matches("a.tmp")
    assert not spec.matches("sub/deep/a.tmp")  # a nested pattern is anchored to its directory
    assert not spec.matches("sub/keep.log") and spec.matches("keep.log")
    assert load_nested_ignore(tmp_path / "none") is None


def test_scan(spark, tmp_path):
    put(tmp_path, {"a.py": "x", "_p/__init__.py": "y", ".hidden": "z", "node_modules/q.js": "n", "big.txt": "b" * 100, "bin": b"\xff\x00\xfe", ".gitignore": "*.log\n", "c.log": "l", "empty.txt": ""})
    got = {r.path: bytes(r.content) for r in filetree.scan(spark, tmp_path, ["node_modules"], 50).collect()}
    assert got == {"a.py": b"x", "_p/__init__.py": b"y", ".hidden": b"z", "bin": b"\xff\x00\xfe", ".gitignore": b"*.log\n", "empty.txt": b""}
    one = filetree.scan(spark, tmp_path / "a.py").collect()
    assert [(r.path, r.length) for r in one] == [("a.py", 1)]
    with pytest.raises(ValueError, match="does not exist"):
        filetree.scan(spark, tmp_path / "nothing")


def test_executors_list_what_a_walk_lists(spark, tmp_path, monkeypatch):
    """Few directories to a round, rules of all depths, links, names of every kind: the rows are those of a plain walk."""
    rng = random.Random(4)
    names = ["a", "b.py", "_c", ".d", "e f", "é", "node_modules", "x.log", "keep.log", "y.tmp"]
    files = {"/".join(rng.choice(names) + str(rng.randrange(3)) for _ in range(rng.randrange(1, 6))) + "/" + rng.choice(names): str(k) for k in range(150)}
    files |= {".gitignore": "*.tmp\n/a0/\n!keep.log\n", "a1/.gitignore": "x.log\n", "b.py1/.gitignore": "# no\n!y.tmp\n*.py\n", "node_modules/q/.gitignore": "!*", "node_modules/q/z.js": "z", "node_modules/keep.log": "k"}
    put(tmp_path, files)
    (tmp_path / "link").symlink_to(tmp_path / "a1")
    (tmp_path / "to_file").symlink_to(tmp_path / ".gitignore")
    (tmp_path / "broken").symlink_to(tmp_path / "nothing")
    for exclude in (["node_modules", "*.log"], ["node_modules", "!keep.log"]):
        want = sorted(filetree.walk(str(tmp_path), exclude))
        for folders in (1, 512):
            monkeypatch.setattr(filetree, "FOLDERS", folders)
            kept = []

            def keep(rows, kept=kept, n=folders):
                path = str(tmp_path.parent / f"{tmp_path.name}-{n}-{len(exclude[1])}-{len(kept)}")
                rows.write.parquet(path)
                kept.append(path)
                return spark.read.parquet(path)

            got = filetree.listed(spark, tmp_path, exclude, keep=keep)
            assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    assert filetree.scan(spark, tmp_path, ["node_modules"]).count() == len(list(filetree.walk(str(tmp_path), ["node_modules"])))


def test_contents_come_in_bounded_batches(tmp_path, monkeypatch):
    put(tmp_path, {f"f{k}": "x" * 1000 for k in range(20)})
    monkeypatch.setattr(filetree, "BYTES_PER_PARTITION", 5000)
    monkeypatch.setattr(filetree, "OPEN_COST", 100)
    sizes = [len(b) for b in filetree._contents(((f"f{k}", str(tmp_path / f"f{k}")) for k in range(20)), 10**6, True)]
    assert sum(sizes) == 20 and max(sizes) <= 5


def test_single_paths(spark, tmp_path):
    put(tmp_path, {"a.py": "x", "d/.gitignore": "*.log\n", "d/b.log": "no", "d/c.txt": "yes", "e/f.txt": "other", "big.txt": "b" * 100, "node_modules/q.js": "n"})
    (tmp_path / "out.txt").symlink_to("/etc/hostname")
    paths = spark.createDataFrame([(p,) for p in ("a.py", "d/b.log", "d/c.txt", "gone", "big.txt", "node_modules/q.js", "out.txt", "../x", "a.py", "d")], "path string")
    got = {r.path: r.content and bytes(r.content) for r in filetree.read_paths(paths, tmp_path, ["node_modules"], 50).collect()}
    assert got == {"a.py": b"x", "d/c.txt": b"yes"}
    told = {r.path: r.error for r in filetree.read_paths(paths, tmp_path, ["node_modules"], 50, report=True).collect()}
    assert told == {"a.py": None, "d/c.txt": None, "big.txt": "larger than the limit"}
    assert {r.path for r in filetree.scan(spark, tmp_path, ["node_modules"], 50, report=True).where("error IS NOT NULL").collect()} == {"big.txt"}


def test_repository(tmp_path):
    assert repository.current_branch(tmp_path) is None and not repository.is_repository(tmp_path)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    put(tmp_path, {"f": "x"})
    git("add", ".")
    git("commit", "-qm", "x")
    git("checkout", "-qb", "feature-x")
    assert repository.current_branch(tmp_path) == "feature-x" and os.path.samefile(repository.repository_root(tmp_path), tmp_path)
    git("checkout", "-q", "--detach")
    assert repository.current_branch(tmp_path).startswith("detached-")


def test_config(tmp_path):
    assert Config(tmp_path).get("search", "mode") == "hybrid"
    path = init(tmp_path)
    assert Config(tmp_path).values == DEFAULTS
    with pytest.raises(FileExistsError):
        init(tmp_path)
    path.write_text("[search]\nmode = 'fts'\n[indexer]\nmax_file_size_bytes = 7\n")
    c = Config(tmp_path)
    assert c.search["mode"] == "fts" and c.get("search", "min_score") == 0.3 and c.indexer["max_file_size"] == 7
    c.set("search", "mode", "vector")
    assert c.get("search", "mode") == "vector" and DEFAULTS["search"]["mode"] == "hybrid" and c.get("a", "b", default=3) == 3
    path.write_text("not = = toml")
    assert Config(tmp_path).values == DEFAULTS and path.parent.name == FOLDER
