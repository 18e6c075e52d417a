import itertools
import json
import math
import random
import re
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.api import Service
from quarry.operators import enhance, incremental, search, stats
from quarry.operators.embed import HashingEmbedder, embed, retry
from quarry.operators.filters import Filters
from quarry.plans import retrieval
from quarry.store import ChunkStore
from quarry.streaming import feed

COLUMNS = "chunk_id string, path string, start_line int, end_line int, chunk_seq int, text string, language string, chunk_type string, name string, branch string, indexed_at double, vector array<float>, file_hash string"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(4)
    e = HashingEmbedder(16)
    rows = []
    for i in range(80):
        text = " ".join(rng.choice(["def", "authenticate", "user", "token", "parse", "file", "tree", "x1"]) for _ in range(rng.randrange(2, 15)))
        rows.append((f"c{i}", rng.choice(["src/a.py", "src/b.js", "lib/happy", "src2/c.py"]), 1 + i % 30, 5 + i % 30 + i % 7, i, text, rng.choice(["python", "text"]), rng.choice(["function", "class"]), None, rng.choice([None, "main", "dev"]), 1000.0 + i, e.embed_text(text), f"h{i % 9}"))
    return spark.createDataFrame(rows, COLUMNS).cache()


def test_modes():
    assert search.resolve_mode(None, "q", [1.0]) == "hybrid" and search.resolve_mode(None, "q", None) == "fts" and search.resolve_mode(None, None, [1.0]) == "vector"
    for bad in ((None, None, None), ("vector", "q", None), ("fts", None, [1.0]), ("hybrid", "", [1.0]), ("other", "q", [1.0])):
        with pytest.raises(ValueError):
            search.resolve_mode(*bad)


def test_vector_search_is_exact(chunks):
    q = HashingEmbedder(16).embed_text("parse file")
    got = [r.chunk_id for r in search.vector_search(chunks, q, 10).orderBy("rank").collect()]
    rows = chunks.collect()
    d = lambda r: (round(sum((float(a) - float(b)) ** 2 for a, b in zip(r.vector, q, strict=True)), 12), r.path, r.start_line, r.chunk_seq)
    assert got == [r.chunk_id for r in sorted(rows, key=d)[:10]]


def test_bm25_and_kept_index(chunks):
    rows = chunks.collect()
    bags = {r.chunk_id: r.text.split() for r in rows}
    n, avg = len(rows), sum(map(len, bags.values())) / len(rows)
    want = {}
    for c, bag in bags.items():
        s = 0
        for t in {"authenticate", "tree"}:
            df = sum(t in b for b in bags.values())
            tf = bag.count(t)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / avg))
        if s:
            want[c] = s
    got = {r.chunk_id: r.bm25 for r in search.bm25(chunks, "Authenticate, TREE! tree").collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    kept = search.bm25(chunks, "authenticate tree", index=search.postings(chunks), stats=search.corpus_stats(chunks))
    assert {r.chunk_id: round(r.bm25, 9) for r in kept.collect()} == {c: round(s, 9) for c, s in want.items()}
    assert search.fts_search(chunks, "nothing like this", 5).count() == 0


def test_scores_and_weights(chunks):
    q = HashingEmbedder(16).embed_text("user token")
    for w in (0.0, 0.5, 1.0):
        rows = search.hybrid_search(chunks, "user token", q, 8, fts_weight=w).orderBy("rank").collect()
        assert all(0 <= r.score <= 1 for r in rows) and [r.rank for r in rows] == list(range(1, len(rows) + 1))
    near = [r.chunk_id for r in search.vector_search(chunks, q, 8).orderBy("rank").collect()]
    assert [r.chunk_id for r in search.hybrid_search(chunks, "zzz", q, 8).orderBy("rank").collect()] == near


@pytest.mark.parametrize("filters", [Filters(extensions=["py"]), Filters(directories=["src"]), Filters(languages=["python"], branch="main"), Filters(file_filter=".py", chunk_types=["class"]), Filters(glob="src/*.py"), Filters()])
def test_filters_come_before_the_top(chunks, filters):
    q = HashingEmbedder(16).embed_text("user")
    a = search.vector_search(chunks, q, 7, filters).select("chunk_id", "rank").collect()
    b = search.vector_search(filters.apply(chunks), q, 7).select("chunk_id", "rank").collect()
    assert sorted(a) == sorted(b)


def test_filters_are_literal(chunks):
    assert Filters(file_filter="%").apply(chunks).count() == 0 and Filters(directories=["src_"]).apply(chunks).count() == 0
    assert Filters(branch="o'hara").apply(chunks).count() == 0
    assert Filters(extensions=["py"]).apply(chunks).where("path = 'lib/happy'").count() == chunks.where("path = 'lib/happy'").count() > 0 or Filters(extensions=["py"]).apply(chunks).count() > 0


def greedy(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: r["rank"]):
        def share(k):
            common = max(0, min(r["end_line"], k["end_line"]) - max(r["start_line"], k["start_line"]) + 1)
            return common / min(r["end_line"] - r["start_line"] + 1, k["end_line"] - k["start_line"] + 1)
        if not any(k["path"] == r["path"] and share(k) >= threshold for k in kept):
            kept.append(r)
    return [r["chunk_id"] for r in kept]


def test_overlap_removal_is_greedy(chunks):
    q = HashingEmbedder(16).embed_text("user file")
    found = search.vector_search(chunks, q, 60)
    rows = [r.asDict() for r in found.collect()]
    for threshold in (0.1, 0.5, 1.0):
        assert sorted(r.chunk_id for r in enhance.without_overlap(found, threshold).collect()) == sorted(greedy(rows, threshold))
        got = enhance.deduplicate(found, threshold).orderBy("rank").collect()
        assert sorted(r.chunk_id for r in got) == sorted(greedy(rows, threshold))
        assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


@pytest.mark.parametrize("threshold", [0, 0.1, 0.5, 0.9, 1.0, 1.5])
def test_kept_ranges_are_those_of_all_comparisons(threshold):
    for seed in range(200):
        rng = random.Random(seed)
        spread, longest = rng.choice([(30, 10), (300, 40), (40, 200)])
        ranges = [(a, a + rng.randrange(longest)) for a in (rng.randrange(spread) for _ in range(60))]
        rows = [{"rank": k, "path": "p", "chunk_id": k, "start_line": a, "end_line": b} for k, (a, b) in enumerate(ranges)]
        kept = enhance._Kept(threshold)
        assert [k for k, r in enumerate(ranges) if kept.add(*r)] == greedy(rows, threshold)


def test_overlap_of_one_path_with_100_000_chunks(spark):
    """Ranges of one path, of which every third stays; whole rows are not folded."""
    many = spark.range(100_000).selectExpr("'big.py' path", "1.0 - id / 1e6 score", "id rank", "CAST(id * 4 AS int) start_line", "CAST(id * 4 + 11 AS int) end_line", "repeat('x', 100) text")
    began = time.time()
    got = enhance.without_overlap(many, 0.5)
    assert got.agg(F.count("*"), F.max("_first")).first() == (50_000, 0) and time.time() - began < 60
    assert got.columns == ["_first", *many.columns]


def test_recency(chunks, spark):
    found = search.vector_search(chunks, HashingEmbedder(16).embed_text("x1"), 10)
    rows = {r.chunk_id: r for r in found.collect()}
    low, high = min(r.indexed_at for r in rows.values()), max(r.indexed_at for r in rows.values())
    got = enhance.rerank_by_recency(found, 0.2).orderBy("rank").collect()
    for r in got:
        assert abs(r.score - min(1.0, rows[r.chunk_id].score + 0.2 * (r.indexed_at - low) / (high - low))) < 1e-12
    assert enhance.rerank_by_recency(found, 0.0) is found
    same = found.withColumn("indexed_at", F.lit(5.0))
    assert [r.chunk_id for r in enhance.rerank_by_recency(same).orderBy("rank").collect()] == [r.chunk_id for r in found.orderBy("rank").collect()]


def test_context(spark):
    text = "".join(f"line {i}\n" for i in range(1, 21))
    files = spark.createDataFrame([("f", text), ("short", "a\nb\nc")], "path string, text string")
    results = spark.createDataFrame([("f", 10, 12, "old"), ("short", 1, 1, "old"), ("gone", 3, 4, "old"), ("short", 90, 99, "old")], "path string, start_line int, end_line int, text string")
    got = {(r.path, r.start_line, r.end_line): r.text for r in enhance.expand_context(results, files, 2, 2).collect()}
    assert got["f", 8, 14] == "".join(f"line {i}\n" for i in range(8, 15)) and got["short", 1, 3] == "a\nb\nc" and got["gone", 3, 4] == "old" and got["short", 90, 99] == "old"


def test_plan_prunes_and_bounds(chunks, tmp_path):
    path = str(tmp_path / "c")
    chunks.write.parquet(path)
    stored = chunks.sparkSession.read.parquet(path)
    from quarry.operators import stats

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan(stats.index_stats(stored)).split("ReadSchema")[1]
    q = HashingEmbedder(16).embed_text("x")
    assert "TakeOrderedAndProject" in plan(search.vector_search(stored, q, 5).drop("rank")) and "PushedFilters: [" in plan(Filters(languages=["python"]).apply(stored))


def exchanged(df):
    """The columns that each exchange of a plan carries."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


def test_keyword_search_moves_neither_texts_nor_vectors(chunks, spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    store.add(chunks)
    for filters in (Filters(), Filters(languages=["python"], directories=["src"])):
        for kept in (True, False):
            index, about = store.index() if kept else (None, None)
            found = search.fts_search(store.wide(), "authenticate tree", 5, filters, index, about)
            moved = exchanged(found)
            assert moved and not any(re.search(r"\b(text|vector|name|file_hash)#", m) for m in moved)
            want = search.fts_search(chunks, "authenticate tree", 5, filters)
            assert [(r.rank, r.path, r.text, round(r.bm25, 9)) for r in found.orderBy("rank").collect()] == [(r.rank, r.path, r.text, round(r.bm25, 9)) for r in want.orderBy("rank").collect()]
    q = HashingEmbedder(16).embed_text("user token")
    got = search.hybrid_search(store.wide(), "user token", q, 8, index=store.index()[0], stats=store.index()[1]).orderBy("rank").collect()
    assert [(r.path, r.text) for r in got] == [(r.path, r.text) for r in search.hybrid_search(chunks, "user token", q, 8).orderBy("rank").collect()]
    assert search.fts_search(store.wide(), " !", 5).count() == 0


def rows_of(store, version=None):
    return sorted((r.path, r.branch or "", r.chunk_seq, r.text) for r in store.chunks(version).collect())


def written(store, kind=""):
    """Bytes of the files below a folder of the store."""
    return sum(p.stat().st_size for p in (Path(store.path) / kind).rglob("*") if p.is_file())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def checked(store):
    """The manifest's sums and the postings are those of the chunks."""
    n, tokens = store.index()[1].first()
    want = search.corpus_stats(store.chunks()).first()
    assert n == want.n == store.count() and abs(tokens - want.avgdl) < 1e-9
    summed, scanned = store.stats(), stats.index_stats(store.chunks())
    assert summed.first() == scanned.first() and summed.columns == scanned.columns and [f.dataType for f in summed.schema] == [f.dataType for f in scanned.schema]
    assert "parquet" not in plan_of(summed).lower() and "parquet" in plan_of(scanned).lower()
    assert store.index()[0].select("chunk_id").distinct().count() == store.chunks().where(search.n_tokens(F.col("text")) > 0).select("chunk_id").distinct().count()


def test_changes_write_what_changes(chunks, spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    many = chunks.withColumn("path", F.concat("path", F.lit("/"), "chunk_seq")).cache()
    assert store.version() is None and store.count() == 0 and store.index() == (None, None)
    store.add(many)
    first, pieces = store.version(), lambda: {b: set(p) for b, p in store.manifest()["buckets"].items()}
    all_rows, before = rows_of(store), pieces()
    path = all_rows[0][0]
    assert store.delete_by_path("nowhere") == 0 and store.version() == first
    assert store.delete_by_path(path) == 1 and pieces() == before
    assert rows_of(store) == all_rows[1:] and rows_of(store, first) == all_rows and store.file_hash(path) is None and store.file_hash(all_rows[1][0])
    checked(store)
    store.add(many.where(F.col("path") == path))  # back again: a piece more, nothing rewritten
    added = pieces()
    assert rows_of(store) == all_rows and all(before.get(b, set()) <= added[b] for b in added) and sum(added[b] != before.get(b) for b in added) == 1
    changed = many.where(F.col("path") == path).withColumn("text", F.lit("wholly new words"))
    store.upsert(changed, changed.select("path", "branch"))
    assert all(added[b] <= pieces()[b] for b in added) and sum(pieces()[b] != added[b] for b in added) == 1
    assert [r.path for r in store.search("wholly", mode="fts").collect()] == [path]
    checked(store)
    assert store.count() == 80
    for _ in range(10):
        store.add(changed.withColumn("chunk_seq", F.lit(99)))
    assert max(map(len, pieces().values())) <= 9
    n_main = store.chunks().where("branch = 'main'").count()
    held = pieces()
    assert store.delete_by_branch("main") == n_main > 0 and store.chunks().where("branch = 'main'").count() == 0 and store.delete_by_branch("main") == 0
    assert sum(pieces().get(b) != held[b] for b in held) < len(held)
    store.add(many.where("branch = 'main'"))  # the branch again, with what it had
    assert store.chunks().where("branch = 'main'").count() == many.where("branch = 'main'").count()
    checked(store)
    now = rows_of(store)
    store.vacuum(1)
    assert rows_of(store) == now and len(store._names("manifests")) == 1 and store.search("user", mode="fts").count() > 0


def test_deletions_write_kilobytes_whatever_the_bucket(chunks, spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=1)
    text = F.concat_ws(" ", *(F.sha2(F.concat("path", F.lit(str(k))), 256) for k in range(40)))  # 2.6 KB that do not compress
    store.add(chunks.crossJoin(spark.range(50)).withColumn("path", F.concat("path", F.lit("/"), "chunk_seq", F.lit("/"), "id")).drop("id").withColumn("text", text))
    whole = written(store)
    assert whole > 4_000_000
    paths = sorted(r.path for r in store.indexed_files().limit(6).collect())
    assert store.delete_by_path(paths[0]) == 1
    assert written(store) - whole < 20_000 and written(store, "chunks") + written(store, "postings") > 0.99 * whole
    store.upsert(None, spark.createDataFrame([(p, b) for p in paths[1:] for b in ("main", "dev", None)], "path string, branch string"))
    assert store.chunks().where(F.col("path").isin(paths)).count() == 0 and written(store) - whole < 40_000
    checked(store)
    before = written(store)
    store.delete_by_branch("main")
    assert written(store, "gone") < 40_000 or written(store) < before  # nothing but the manifest, or what is left of buckets that are half gone
    checked(store)


def test_statistics_add_up_from_the_manifest(chunks, spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=2, split=30)
    assert store.stats().first().asDict() == {"total_files": 0, "total_chunks": 0, "total_size_bytes": 0, "languages": {}, "last_indexed": None}
    assert store.status().first().indexed is False
    store.add(chunks)
    checked(store)
    other = chunks.withColumn("branch", F.lit("other")).withColumn("indexed_at", F.col("indexed_at") + 1000)
    store.add(other)  # the same paths once more: files stay as many
    checked(store)
    store.add(chunks.withColumn("path", F.concat(F.lit("x/"), "path", "chunk_seq")).withColumn("language", F.lit("other")))
    checked(store)
    store.delete_by_branch("other")  # the last time goes with it
    checked(store)
    for row in store.indexed_files().limit(3).collect():
        store.delete_by_path(row.path)
    checked(store)
    store.upsert(other, chunks.select("path", "branch").distinct())
    checked(store)
    store.commit(chunks.limit(5))
    checked(store)
    # A manifest of a writer that did not sum up is scanned; a change sums up what it can.
    before = store.version()
    old = {k: v for k, v in store.manifest(before).items() if k != "about"}
    old["buckets"] = {b: {p: c[:2] for p, c in pieces.items()} for b, pieces in old["buckets"].items()}
    store._publish(old, before)
    assert store.stats().first() == stats.index_stats(store.chunks()).first() and "parquet" in plan_of(store.stats()).lower()
    store.delete_by_path(store.indexed_files().first().path)
    assert store.stats().first() == stats.index_stats(store.chunks()).first()
    store.commit(chunks)
    checked(store)


def test_many_deletions_are_put_together(chunks, spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarry.store.LISTS", 3)
    monkeypatch.setattr("quarry.store.GONE", 6)
    monkeypatch.setattr("quarry.store.FEW", 1)
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=1)
    many = chunks.withColumn("path", F.concat("path", F.lit("/"), "chunk_seq")).cache()
    store.add(many)
    left = rows_of(store)
    for k in range(3):
        drop = {left[0][0], left[1][0]} if k % 2 else {left[0][0]}
        store.upsert(None, many.where(F.col("path").isin(list(drop))).select("path", "branch"))
        left = [r for r in left if r[0] not in drop]
        assert rows_of(store) == left and sum(g["branch"] is None for g in store.manifest()["gone"].values()) <= 3
    monkeypatch.setattr("quarry.store.LISTS", 1)
    for _ in range(3):
        assert store.delete_by_path(left[0][0]) == 1
        left = left[1:]
        assert rows_of(store) == left and len(store.manifest()["gone"]) <= 1
    checked(store)


def test_buckets_split_as_the_store_grows(chunks, spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=2, split=30)
    versions, n = {}, 0
    for k, times in enumerate((1, 3, 12)):
        new = chunks.crossJoin(spark.range(times)).withColumn("path", F.concat(F.lit(f"r{k}/"), "path", F.lit("/"), "chunk_seq", F.lit("/"), "id")).drop("id")
        store.add(new)
        n += 80 * times
        versions[store.version()] = rows_of(store)
        assert store.count() == n == len(versions[store.version()])
        held = [sum(c[0] for c in p.values()) for p in store.manifest()["buckets"].values()]
        assert max(held) <= 45 and len(held) > n / 45
    assert all(rows_of(store, v) == rows for v, rows in versions.items())  # readers of older versions, with fewer buckets
    where = {r.path: r.bucket for r in store.wide().select("path", "bucket").collect()}
    assert all(store.bucket(p) == b for p, b in where.items())
    one = sorted(where)[5]
    assert store.file_hash(one) and store.delete_by_path(one) == 1 and store.count() == n - 1 and store.file_hash(one) is None
    store.upsert(chunks.limit(1).withColumn("path", F.lit(one)), spark.createDataFrame([(one, None)], "path string, branch string"))
    assert store.count() == n
    assert {r.path for r in store.chunks_at(spark.createDataFrame([(one,)], "path string")).collect()} == {one}
    checked(store)
    alone = ChunkStore(spark, str(tmp_path / "one"), buckets=2, split=10)
    alone.add(chunks.withColumn("path", F.lit("one/path")))  # cannot be split
    assert alone.count() == 80 and len(alone.manifest()["buckets"]) == 1


def test_readers_never_see_a_half_made_version(chunks, spark, tmp_path):
    store, reader = (ChunkStore(spark, str(tmp_path / "s"), buckets=4) for _ in range(2))
    store.add(chunks)
    seen, over = [], threading.Event()

    def read():
        while not over.is_set():
            seen.append(reader.count())

    thread = threading.Thread(target=read)
    thread.start()
    for k in range(3):
        store.add(chunks.limit(10).withColumn("path", F.lit(f"more/{k}")))
    over.set()
    thread.join()
    assert set(seen) <= {80, 90, 100, 110} and seen == sorted(seen)
    before = store.version()
    store.add(chunks.limit(1))
    with pytest.raises(RuntimeError, match="another writer"):
        reader._publish(reader.manifest(before), before)


def test_embedder(spark):
    e = HashingEmbedder()
    a, b, c = (np.array(e.embed_text(t)) for t in ("parse the file", "the file parse", "quite other words"))
    assert len(a) == 384 and abs(np.linalg.norm(a) - 1) < 1e-6 and a @ b > 0.99 > 0.5 > a @ c
    assert e.embed_batch([]) == [] and abs(np.linalg.norm(e.embed_text("")) - 1) < 1e-6
    df = spark.createDataFrame([("x",), (None,)], "t string").select(embed(F.col("t"), HashingEmbedder(8)).alias("v"))
    assert all(len(r.v) == 8 for r in df.collect())
    calls = itertools.count()

    @retry(3, 0.0)
    def flaky():
        if next(calls) < 2:
            raise OSError
        return "ok"

    assert flaky() == "ok"


def test_incremental(spark):
    stored = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", "3", None), ("a", "9", "dev")], "path string, file_hash string, branch string")
    files = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, file_hash string")
    status = lambda **k: {r.path: r.status for r in incremental.file_status(files, stored, **k).collect()}
    assert status() == {"a": "unchanged", "b": "changed", "d": "new"} and status(force=True)["a"] == "changed" and status(branch="dev")["a"] == "changed"
    assert [r.path for r in incremental.deleted_files(files, stored).collect()] == ["c"]
    assert incremental.deleted_files(files, stored, cleanup=False).count() == 0
    assert incremental.delete_by_branch(stored, "dev").count() == 3 and incremental.delete_by_path(stored, "a").count() == 2


@pytest.fixture
def project(tmp_path):
    put = lambda name, body: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(body))
    put("src/auth.py", "def authenticate_user(name, password):\n    return check(name, password)\n\n\ndef logout():\n    pass\n")
    put("README.md", "# Title\nhow to authenticate\n## Usage\nrun it\n")
    put("notes.txt", "first\n\nsecond paragraph\n")
    return tmp_path, put


def test_service(spark, project):
    root, put = project
    assert "error" in Service(spark).ctx_search("x") and "error" in Service(spark).ctx_status() and "error" in Service(spark).ctx_index()
    s = Service(spark, root)
    assert s.ctx_status()["indexed"] is False and s.ctx_search("x")["count"] == 0
    first = s.ctx_index(".")
    assert (first["indexed"], first["unchanged"], first["total_files"], first["total_chunks"]) == (3, 0, 3, 6)
    assert "error" in s.ctx_index("nowhere")
    top = s.ctx_search("authenticate user", limit=3)
    assert "authenticate_user" in {r["name"] for r in top["results"]} and set(top["results"][0]) == {"path", "start_line", "end_line", "code", "score", "language", "chunk_type", "name", "branch"}
    assert s.ctx_search("authenticate", limit=0)["results"] == [] and "error" in s.ctx_search("a", limit=-1) and "error" in s.ctx_search("a", mode="x")
    assert {r["path"] for r in s.ctx_search("authenticate", languages=["markdown"], mode="fts")["results"]} <= {"README.md"}
    put("src/auth.py", "def changed():\n    pass\n")
    (root / "notes.txt").unlink()
    again = s.ctx_index(".")
    assert (again["indexed"], again["unchanged"], again["deleted"], again["total_files"]) == (1, 1, 1, 2)
    assert s.ctx_search("authenticate user", mode="fts", directories=["src/"])["results"] == []
    fresh = Service(spark, root)
    fresh.store = ChunkStore(spark, str(root / "other"))
    fresh.indexer.store = fresh.store
    fresh.ctx_index(".", force=True)
    key = lambda st: sorted((r.path, r.chunk_seq, r.text) for r in st.chunks().collect())
    assert key(fresh.store) == key(s.store)
    assert s.store.delete_by_path("README.md") == 2 and s.store.delete_by_path("README.md") == 0
    s.store.vacuum(1)
    assert s.store.count() == 1
    s.store.clear_all()
    assert s.store.count() == 0


def test_problems_of_files_are_reported(spark, project):
    class Fragile(HashingEmbedder):
        """Fails on one text, and has no vectorised form."""

        embed_array = property()

        def embed_batch(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("no vector for this")
            plain = HashingEmbedder(self.dimension)
            return [plain.embed_text(t) for t in texts]

    root, put = project
    put("bad.txt", "some poison here\n")
    put("big.txt", "x" * 2_000_000)
    (root / "dead.txt").symlink_to(root / "nothing")
    s = Service(spark, root, Fragile(16))
    seen = []
    out = s.ctx_index(".", progress=seen.append)
    assert (out["indexed"], out["errors"], out["skipped"], out["total_files"]) == (3, 1, 1, 3)
    assert {(p["path"], p["status"], p["reason"]) for p in out["problems"]} == {("bad.txt", "error", "embedding failed"), ("big.txt", "skipped", "larger than the limit")}
    assert seen and (seen[-1].current, seen[-1].total) == (4, 4) and [e.current for e in seen] == sorted(e.current for e in seen)
    assert seen[-1].filename in {"src/auth.py", "README.md", "notes.txt", "bad.txt"}
    put("nothing.txt", " \n\n")
    out = s.ctx_index(".")
    assert (out["indexed"], out["no_chunks"], out["errors"]) == (0, 1, 1) and {"path": "nothing.txt", "status": "skipped", "reason": "no_chunks"} in out["problems"]
    (root / "nothing.txt").unlink()
    put("bad.txt", "healed now\n")
    assert s.ctx_index(".")["indexed"] == 1 and s.store.count() == 7
    put("bad.txt", "poison again\n")
    out = s.ctx_index(".")
    assert out["errors"] == 1 and out["total_files"] == 4  # what was known of the file stays


def test_context_reads_only_result_files(spark, project, monkeypatch):
    root, put = project
    put("src/long.py", "".join(f"# note {i}\n" for i in range(9)) + "def needle():\n    return 1\n\n# after\n")
    s = Service(spark, root)
    s.ctx_index(".")
    monkeypatch.setattr(s.indexer, "files", lambda *a, **k: pytest.fail("the tree was read"))
    plain, wide = (s.ctx_search("needle", mode="fts", expand_context=x)["results"][0] for x in (False, True))
    assert plain["code"] in wide["code"] and wide["start_line"] < plain["start_line"] and "# after" in wide["code"]


def test_own_chunkers(spark):
    from quarry import FunctionChunker
    from quarry.operators import chunk

    rows = [("a.rs", "fn x\nfn y\n", "rust"), ("b.md", "# h\ntext", "markdown"), ("c", "words", None)]
    lines = FunctionChunker(["rust"], lambda t: [{"text": x, "start_line": k, "end_line": k, "chunk_type": "line", "name": x[3:]} for k, x in enumerate(t.splitlines(), 1)])
    got = {(r.path, r.chunk_seq, r.chunk_type, r.name) for r in chunk.chunk_files(spark.createDataFrame(rows, "path string, text string, language string"), chunkers=[lines]).collect()}
    assert got == {("a.rs", 0, "line", "x"), ("a.rs", 1, "line", "y"), ("b.md", 0, "section", "h"), ("c", 0, "paragraph", None)}


def test_texts_are_embedded_once_for_all_branches(spark, tmp_path):
    """A model with a name: a second branch, a copied file and a repeated run embed only what differs."""
    seen = tmp_path / "seen"
    seen.mkdir()

    class Model:
        dimension, model_id = 4, "test-1"

        def embed_batch(self, texts):
            (seen / f"{time.time_ns()}-{threading.get_ident()}").write_text("\n".join(json.dumps(t) for t in texts))
            if any("cannot" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), 1.0, 0.0, 0.0] for t in texts]

    def embedded():
        texts = [json.loads(x) for p in sorted(seen.iterdir()) for x in p.read_text().split("\n") if x]
        for p in list(seen.iterdir()):
            p.unlink()
        return texts

    tree = tmp_path / "tree"
    tree.mkdir()
    for k in range(5):
        (tree / f"f{k}.txt").write_text(f"text number {k}\n\nthe same paragraph\n")
    s = Service(spark, tree, embedder=Model())
    assert s.ctx_index(".", branch="main")["indexed"] == 5 and sorted(embedded()) == ["text number 0", "text number 1", "text number 2", "text number 3", "text number 4", "the same paragraph"]
    (tree / "f4.txt").write_text("another text\n\nthe same paragraph\n")
    assert s.ctx_index(".", branch="dev")["indexed"] == 5 and embedded() == ["another text"]
    assert s.ctx_index(".", force=True, branch="dev")["indexed"] == 5 and embedded() == []
    assert s.store.count() == 20 and s.store.chunks().where("vector[0] <> length(text)").count() == 0
    (tree / "bad.txt").write_text("this cannot be embedded")
    got = s.ctx_index(".", branch="dev")
    assert (got["errors"], got["indexed"]) == (1, 0) and set(embedded()) == {"this cannot be embedded"}
    other = Model()
    other.model_id = "test-2"
    assert Service(spark, tree, embedder=other).ctx_index(".", force=True, branch="dev")["indexed"] == 5 and len(set(embedded())) == 7


def until(holds, seconds=90):
    end = time.time() + seconds
    while not holds() and time.time() < end:
        time.sleep(0.1)
    assert holds()


def test_quiet_period(spark, project, tmp_path_factory):
    """Events of a path wait in the stream's state; a query that is killed inside the quiet time loses nothing."""
    root, put = project
    s = Service(spark, root)
    s.ctx_index(".")
    events, check = tmp_path_factory.mktemp("events"), tmp_path_factory.mktemp("check")
    seen = []

    def watcher(quiet):
        return feed.Watcher(spark, s.indexer, str(events), str(check), on_change=lambda p, t: seen.append((p, t)), quiet=quiet)

    def event(k, path, kind="modified"):
        (events / f"{k}.json").write_text(json.dumps({"path": path, "event_type": kind, "event_time": f"2024-01-01T00:00:{k:02}Z", "seq": k}))

    def waiting(w):
        progress = w.query.lastProgress
        return progress.stateOperators[0].numRowsTotal if progress and progress.stateOperators else 0

    version = s.store.version()
    for k in range(3):
        put("new.py", f"def fresh{k}():\n    pass\n")
        event(k, "new.py")
    event(3, "notes.txt", "deleted")
    w = watcher(20.0)
    w.start("200 milliseconds")
    until(lambda: waiting(w) == 2)
    w.query.stop()  # inside the quiet time
    assert not seen and s.store.version() == version
    w = watcher(20.0)
    w.start("200 milliseconds")
    until(lambda: len(seen) == 2 or not w.is_running)
    assert w.is_running, w.query.exception()
    until(lambda: waiting(w) == 0)
    w.stop()
    assert sorted(seen) == [("new.py", "modified"), ("notes.txt", "deleted")] and not w.is_running
    assert {r.name for r in s.store.chunks().where("path = 'new.py'").collect()} == {"fresh2"}
    assert s.store.chunks().where("path = 'notes.txt'").count() == 0


def test_subdirectory_keeps_the_rest(spark, project):
    root, put = project
    s = Service(spark, root)
    s.ctx_index(".")
    put("src/more.py", "def more():\n    pass\n")
    s.ctx_index("src")
    assert {r.path for r in s.store.indexed_files().collect()} == {"src/auth.py", "src/more.py", "README.md", "notes.txt"}
    put("notes.txt", "   \n")
    s.ctx_index(".")
    assert "notes.txt" not in {r.path for r in s.store.indexed_files().collect()}


def test_watcher(spark, project, tmp_path_factory):
    root, put = project
    s = Service(spark, root)
    s.ctx_index(".")
    events, check = tmp_path_factory.mktemp("events"), tmp_path_factory.mktemp("check")
    seen = []
    w = feed.Watcher(spark, s.indexer, str(events), str(check), on_change=lambda p, t: seen.append((p, t)))
    put("new.py", "def fresh():\n    pass\n")
    (root / "notes.txt").unlink()
    rows = [("new.py", "created", 1, 1), ("new.py", "modified", 2, 2), ("notes.txt", "modified", 1, 3), ("notes.txt", "deleted", 5, 4)]
    (events / "a.json").write_text("\n".join(json.dumps({"path": p, "event_type": t, "event_time": f"2024-01-01T00:00:0{k}Z", "seq": n}) for p, t, k, n in rows))
    w.start(None).awaitTermination(120)
    assert not w.is_running and sorted(seen) == [("new.py", "modified"), ("notes.txt", "deleted")]
    assert {r.path for r in s.store.indexed_files().collect()} == {"src/auth.py", "README.md", "new.py"}
    with pytest.raises(ValueError):
        s.config.project_root = root / "README.md"
        feed.Watcher(spark, s.indexer, str(events), str(check))


def test_moves_and_bursts(spark):
    e = spark.createDataFrame([("a", "moved", 0, 1, "b"), ("b", "modified", 3, 2, None), ("c", "created", 60, 3, None)], "path string, event_type string, t int, seq long, dest_path string").withColumn("event_time", F.timestamp_seconds("t")).drop("t")
    assert {r.path: r.event_type for r in feed.last_event(feed.split_moves(e)).collect()} == {"a": "deleted", "b": "modified", "c": "created"}
    assert sorted(r.events for r in feed.debounce(e, "10 seconds").collect()) == [1, 2]


def test_pipeline_order(chunks):
    q = HashingEmbedder(16).embed_text("user")
    got = retrieval.run(chunks, "user", q, retrieval.SearchOptions(limit=5, mode="hybrid")).collect()
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and len(got) <= 5
    assert retrieval.run(chunks, "user", q, retrieval.SearchOptions(limit=0)).collect() == []


def test_command_line(spark, project, capsys, monkeypatch):
    root, _ = project
    assert cli.main(["version"]) == 0 and cli.main(["--project", str(root), "init"]) == 0 and cli.main(["--project", str(root), "init"]) == 1
    monkeypatch.setattr("pyspark.sql.SparkSession.stop", lambda self: None)
    assert cli.main(["--project", str(root), "index"]) == 0 and cli.main(["--project", str(root), "search", "authenticate", "--mode", "fts", "--json"]) == 0
    assert "authenticate" in capsys.readouterr().out
    assert cli.main(["--project", str(root), "search", "authenticate", "--mode", "fts", "--brief"]) == 0
    assert re.search(r"^src/auth\.py:1-2 \(0\.\d{3}\)\ndef authenticate_user", capsys.readouterr().out, re.M)
    assert cli.main(["--project", str(root), "clean"]) == 1 and cli.main(["--project", str(root), "clean", "--yes"]) == 0


def test_vectors_beside_the_chunks_give_the_same_and_texts_are_not_joined_with_them(spark, chunks):
    """As joined chunks, of which some have no vector; no exchange of the plan carries a text."""
    q = HashingEmbedder(16).embed_text("user token")
    vectors = chunks.where("chunk_seq % 4 <> 1").select("chunk_id", "vector")
    joined, bare = chunks.drop("vector").join(vectors, "chunk_id", "left"), chunks.drop("vector")
    for filters in (Filters(), Filters(languages=["python"])):
        for mode in ("hybrid", "vector"):
            found = [[(r.chunk_id, r.rank, round(r.score, 9)) for r in search.search(c, "user token", q, 9, mode, filters, vectors=v).orderBy("rank").collect()] for c, v in ((joined, None), (bare, vectors))]
            assert found[0] == found[1] and len(found[0]) == 9
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        from quarry import queries

        for name in ("hybrid_rrf", "search_pipeline"):
            text = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*Project \[[^\n]*\btext#", text)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_embedding_holds_few_words_and_few_texts(spark, monkeypatch):
    e = HashingEmbedder(16)
    e.embed_batch([" ".join(f"w{i}" for i in range(120_000))])
    assert len(e._words) <= 50_000
    texts = [(i, None if i == 7 else f"text number {i}") for i in range(1000)]

    class Counting(HashingEmbedder):
        def embed_array(self, few):
            assert len(few) <= 128
            return super().embed_array(few)

    got = spark.createDataFrame(texts, "i long, text string").coalesce(1).select("i", embed(F.col("text"), Counting(16)).alias("v")).collect()
    assert {r.i: r.v for r in got} == {i: e.embed_text(t or "") for i, t in texts}


def test_postings_of_single_ids_are_counted_in_place(spark):
    rows = [(str(i), t) for i, t in enumerate(["b a b", "", None, "x", "Z z é É 1 1 1", " - "])]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got, want = search.postings(df, once=True), search.postings(df)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) and got.count() == 6
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
