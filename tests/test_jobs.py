"""The jobs on copies of the given tables: growing input, runs that are repeated or broken off, settings, command lines."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import config, document_feed, keyword_index
from jobs import queries as registered
from quarry.operators import search

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
SMALL = document_feed.Settings(ids_per_shelf=50, max_words=40, overlap_words=10)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *names):
    return sorted(str(tuple(r[c] for c in (names or df.columns))) for r in df.collect())


def expected(docs, settings):
    """The chunks of documents, without a stream."""
    d = docs.where("doc_id IS NOT NULL").withColumns({"changed": F.lit(0), "file": F.lit(""), "file_hash": F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)})
    return document_feed.chunked(document_feed.newest(d), settings).drop("changed", "file").withColumn("shelf", F.floor(F.col("doc_id") / settings.ids_per_shelf))


COLUMNS = ("doc_id", "lang", "source", "file_hash", "chunk_seq", "text", "start_line", "end_line", "chunk_type", "n_tokens", "shelf")


def files(where):
    return {p: p.stat().st_mtime_ns for p in Path(where).rglob("*.parquet")}


def test_feed_takes_only_what_is_new(spark, tmp_path):
    docs, source, out, mark = documents(spark), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    docs.where("doc_id < 100").write.parquet(source)
    first = document_feed.run(spark, source, out, mark, SMALL)
    assert first["documents"] == 100 and rows(document_feed.chunks(spark, out), *COLUMNS) == rows(expected(docs.where("doc_id < 100"), SMALL), *COLUMNS)
    before = files(out)
    again = document_feed.run(spark, source, out, mark, SMALL)
    assert again == {"batches": 0, "documents": 0, "chunks": 0, "total_chunks": first["total_chunks"]} and files(out) == before
    # More documents, and new versions of two old ones: only their shelves are written.
    changed = docs.where("doc_id IN (3, 7)").withColumn("text", F.when(F.col("doc_id") == 3, F.lit("new words here")))
    docs.where("doc_id BETWEEN 100 AND 149").unionByName(changed).write.mode("append").parquet(source)
    second = document_feed.run(spark, source, out, mark, SMALL)
    now = docs.where("doc_id < 150 AND doc_id NOT IN (3, 7)").unionByName(changed)
    assert second["documents"] == 52 and rows(document_feed.chunks(spark, out), *COLUMNS) == rows(expected(now, SMALL), *COLUMNS)
    assert {r.text for r in document_feed.chunks(spark, out).where("doc_id = 3").collect()} == {"new words here"}
    assert [r.chunk_seq for r in document_feed.chunks(spark, out).where("doc_id = 7").collect()] == [None]
    assert {p for p in files(out) if "/chunks/shelf=1/" in str(p)} <= set(before)


def test_a_batch_that_is_broken_off_is_done_again(spark, tmp_path, monkeypatch):
    docs, source, out, mark = documents(spark), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    docs.where("doc_id < 60").write.parquet(source)
    document_feed.run(spark, source, out, mark, SMALL)
    docs.where("doc_id >= 60").write.mode("append").parquet(source)
    broken = lambda versions: (_ for _ in ()).throw(RuntimeError("lost"))  # noqa: E731  after the versions are written
    with monkeypatch.context() as m:
        m.setattr(document_feed, "latest", broken)
        with pytest.raises(Exception, match="lost"):
            document_feed.run(spark, source, out, mark, SMALL)
    assert document_feed.chunks(spark, out).select("doc_id").distinct().count() == 60
    document_feed.run(spark, source, out, mark, SMALL)
    assert rows(document_feed.chunks(spark, out), *COLUMNS) == rows(expected(docs, SMALL), *COLUMNS)


def test_feed_of_odd_rows_and_of_an_empty_folder(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    Path(source).mkdir()
    assert document_feed.run(spark, source, out, mark)["total_chunks"] == 0 and document_feed.chunks(spark, out).collect() == []
    odd = [(1, None, "en", "a"), (2, " \n\n ", None, None), (None, "lost", "en", "a"), (3, "x\n\ny  z\n", "en", "a"), (4, "b", "en", "a"), (4, "c", "en", "a"), (-1, "word " * 2000, "en", "a")]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(source)
    document_feed.run(spark, source, out, mark)
    got = document_feed.chunks(spark, out)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("chunk_seq").alias("n")).collect()} == {1: 0, 2: 0, 3: 2, 4: 1, -1: 5}
    assert got.where("doc_id = 4").first().text == max("bc", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    assert got.where("doc_id = -1").first().shelf == -1


def test_batches_of_few_files_give_the_same(spark, tmp_path):
    docs, source = documents(spark), str(tmp_path / "in")
    docs.repartition(6).write.parquet(source)
    few = document_feed.Settings(files_per_batch=2, ids_per_shelf=50, max_words=40, overlap_words=10)
    assert document_feed.run(spark, source, str(tmp_path / "out"), str(tmp_path / "mark"), few)["batches"] == 3
    assert rows(document_feed.chunks(spark, str(tmp_path / "out")), *COLUMNS) == rows(expected(docs, SMALL), *COLUMNS)


def test_index_is_what_the_library_counts(spark, tmp_path):
    docs, out = documents(spark), str(tmp_path / "out")
    wrote = keyword_index.run(spark, f"{SF}/documents.parquet", out)
    want = search.postings(docs, "doc_id").selectExpr("term", "chunk_id doc_id", "tf", "CAST(dl AS long) dl")
    got = keyword_index.postings(spark, out)
    assert wrote["documents"] == docs.count() and wrote["postings"] == want.count()
    assert rows(got.select("term", "doc_id", "tf", "dl")) == rows(want)
    before = rows(got)
    keyword_index.run(spark, f"{SF}/documents.parquet", out)
    assert rows(keyword_index.postings(spark, out)) == before


def test_index_keeps_lists_and_not_a_row_for_each_posting(spark, tmp_path):
    """Ids in no order, negative ones too, over many files and small batches: lists of a term and block are merged where they meet, in order."""
    source, out, settings = str(tmp_path / "in"), str(tmp_path / "out"), keyword_index.Settings(documents_per_block=64, buckets=4)
    docs = documents(spark).select((F.col("doc_id") * 7 - 300).alias("doc_id"), "text").orderBy(F.xxhash64("doc_id"))
    docs.repartition(5).write.parquet(source)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.maxConcurrentOutputFileWriters")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
        wrote = keyword_index.run(spark, source, out, settings)
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before["spark.sql.maxConcurrentOutputFileWriters"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got, want = keyword_index.postings(spark, out), search.postings(docs, "doc_id")
    assert rows(got.select("term", "doc_id", "tf", "dl")) == rows(want.selectExpr("term", "chunk_id doc_id", "tf", "CAST(dl AS long) dl"))
    assert got.where("block <> floor(doc_id / 64)").count() == 0
    stats = search.corpus_stats(docs).first()
    assert wrote["tokens"] == round(stats.avgdl * stats.n) and wrote["terms"] == want.select("term").distinct().count()
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("dl") / stats.avgdl))
    assert got.where(F.abs(weight - F.col("weight")) > 1e-12).count() == 0
    kept = spark.read.parquet(f"{out}/postings")
    blocks = spark.read.parquet(f"{out}/blocks")
    assert kept.count() == blocks.count() < wrote["postings"]
    assert rows(blocks.select("term", "block", "most", "n")) == rows(got.groupBy("term", "block").agg(F.max("weight").alias("most"), F.count("*").alias("n")))
    for f in Path(out, "postings").rglob("*.parquet"):
        read = spark.read.parquet(str(f)).select("term", "block", "ids").collect()
        assert all(list(r.ids) == sorted(r.ids) for r in read)
        keys = [(r.term.encode(), r.block) for r in read]
        assert keys == sorted(set(keys))


def test_lookup_reads_its_buckets_and_ranks_like_the_library(spark, tmp_path):
    docs, out = documents(spark), str(tmp_path / "out")
    keyword_index.run(spark, f"{SF}/documents.parquet", out)
    for query in ("thand ing le und", "the", "no such words 123456789"):
        found = keyword_index.lookup(spark, out, query, 10)
        want = search.bm25(docs, query, "doc_id").orderBy(F.desc(F.round("bm25", 9)), "chunk_id").limit(10).collect()
        assert [(r.doc_id, round(r.bm25, 6)) for r in found.collect()] == [(r.chunk_id, round(r.bm25, 6)) for r in want]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan


def test_lookup_scores_only_blocks_that_can_matter(spark, tmp_path):
    """A rare word beside the most frequent one: the result is the whole one, most blocks and postings are passed over."""
    out, settings = str(tmp_path / "out"), keyword_index.Settings(documents_per_block=8, buckets=4)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the "), F.when(F.col("id") % 331 == 7, "needle ").otherwise(""), F.repeat(F.lit("the "), (F.col("id") % 5).cast("int")), F.repeat(F.lit("filler "), 9)).alias("text"))
    docs.write.parquet(str(tmp_path / "in"))
    keyword_index.run(spark, str(tmp_path / "in"), out, settings)
    for query, limit, share in (("the needle", 5, 0.1), ("needle", 3, 1.0), ("the", 10, 1.0), ("the needle filler", 6, 0.1), ("the needle", 50, 1.0)):
        want = search.bm25(docs, query, "doc_id").orderBy(F.desc(F.round("bm25", 9)), "chunk_id").limit(limit).collect()
        got = keyword_index.lookup(spark, out, query, limit, settings).collect()
        assert [(r.doc_id, round(r.bm25, 6)) for r in got] == [(r.chunk_id, round(r.bm25, 6)) for r in want]
        hits, blocks = keyword_index._of_terms(spark, out, query, settings)
        read, whole = keyword_index.promising(hits, blocks, limit), blocks.select("block").distinct().count()
        assert read.count() <= share * whole
        assert read.agg(F.sum("n")).first()[0] <= share * hits.count() * 1.01


def test_index_of_odd_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    odd = [(1, None), (2, "-- !"), (None, "lost words"), (3, "a b a"), (4, "b"), (4, "c")]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(source)
    assert keyword_index.run(spark, source, out) == {"documents": 4, "tokens": 4, "terms": 3 if max("bc", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()) == "c" else 2, "postings": 3}
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(source)
    assert keyword_index.run(spark, source, out) == {"documents": 0, "tokens": 0, "terms": 0, "postings": 0}


def test_settings(tmp_path):
    for kind, name in ((document_feed.Settings, "document_feed"), (keyword_index.Settings, "keyword_index")):
        assert config.load(kind, str(ROOT / "jobs" / f"{name}.toml")) == kind() == config.load(kind, None)
    bad = tmp_path / "bad.toml"
    for text in ("bucket = 3", "buckets = 'many'"):
        bad.write_text(text)
        with pytest.raises(ValueError):
            config.load(keyword_index.Settings, str(bad))


@pytest.mark.parametrize("job, extra", [("document_feed", ["--checkpoint", "mark"]), ("keyword_index", [])])
def test_command_lines(spark, tmp_path, job, extra):
    args = [sys.executable, "-m", f"jobs.{job}", "--documents", f"{SF}/documents.parquet", "--out", str(tmp_path / "out"), "--config", f"jobs/{job}.toml", *(str(tmp_path / x) if x == "mark" else x for x in extra)]
    done = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "written to" in done.stderr or "chunks taken" in done.stderr
    read = document_feed.chunks if job == "document_feed" else keyword_index.postings
    assert read(spark, str(tmp_path / "out")).count() > 0


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_registered_jobs_match_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registered.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({registered.oracle_sql()[name]})").fetchall()
    assert rows(df, *names) == sorted(map(str, want)) and len(want) > 100
    assert not spark.streams.active
