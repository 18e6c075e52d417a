"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import licenses, mixing, neardup, neighbours, ngrams, pages, pieces, quality, repeats, scratch, shards

from .helpers import documents, empty
from .test_search_text_models import MODEL

CLASH = ["doc_key", "key", "size", "source_size", "shard", "h", "part", "node", "component", "u", "v", "tag", "anchor", "host", "kept", "n", "failed_base", "same", "row", "body", "_kept", "_n_words", "_quarry_q_n_words", "_quarry_m_copies", "_quarry_gone", "_quarry_r_id", "n_words", "taken", "license", "score", "held_out", "path"]

BY_DOCUMENT = {
    "near_duplicates": neardup.near_duplicates,
    "keep_first": neardup.keep_first,
    "encode_documents": lambda d: pieces.encode_documents(d, MODEL),
    "judge": quality.judge,
    "keep_good": quality.keep_good,
    "mix": mixing.mix,
    "sample": mixing.sample,
    "held_out_scores": ngrams.held_out_scores,
    "assign": shards.assign,
    "scan": lambda d: licenses.scan(d, F.concat_ws("/", "source", F.col("doc_id").cast("string"))),
    "digest": repeats.digest,
    "remove": lambda d: repeats.remove(d, prefix=scratch.unused(d, "r_")),
}
SOME = {"keep_first", "keep_good", "sample"}  # give some rows of the input, the others one row for each


def clashing(df):
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_documents(spark, name):
    run = BY_DOCUMENT[name]
    docs = documents(spark).unionByName(spark.createDataFrame([(2000, "long word " * 15_000, "en", "s1", 1), (2000, "long word " * 15_000, "en", "s1", 1), (None, None, None, None, None)], documents(spark).schema))
    plain, odd = run(docs), run(clashing(docs))
    assert run(empty(spark)).collect() == []
    assert run(clashing(empty(spark))).collect() == []
    rows = sorted(map(str, odd.select(*plain.columns).collect()))
    assert rows == sorted(map(str, plain.collect()))
    if name not in SOME:
        assert len(rows) == docs.count()
    else:
        assert odd.columns == clashing(docs).columns


def test_pages(spark):
    df = spark.createDataFrame([(1, "http://h.e/a", "<p>x</p><p>y</p>"), (1, "http://h.e/a", "<p>x</p><p>y</p>"), (None, None, None), (2, "http://h.e/b", ""), (3, "", "<p>" * 20_000 + "deep"), (4, "http://h.e/c", "<p>word</p>" * 3000), (5, "http://h.e/d", "<p>word</p>" * 2990)], "page_id long, url string, html string")
    got = sorted(map(str, pages.extract(df).collect()))
    assert sorted(map(str, pages.extract(clashing(df)).collect())) == got and len(got) == 7
    assert pages.extract(clashing(df).limit(0)).collect() == []


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(None, [1.0, 1.0, 1.0]), (100, None), (5, [5.0, 1.0, 2.0])], "vec_id long, embedding array<float>")
    run = lambda d: sorted(map(str, neighbours.nearest(d, lambda i: i % 10 == 0, 3).collect()))
    odd = df.select("*", *(F.lit(0).alias(c) for c in ("query_id", "node", "vector", "start", "score", "members", "place", "d")))
    assert run(odd) == run(df) and len(run(df)) == 18
    assert run(odd.limit(0)) == []


def test_one_fold_or_no_table_of_one(spark):
    same = spark.createDataFrame([(7, "a b a b"), (7, "a b a b"), (7, "c"), (None, "a")], "doc_id long, text string")
    got = ngrams.held_out_scores(same).collect()
    assert len(got) == 4 and len({r.held_out for r in got if r.doc_id == 7}) == 1 and all(r.score < 0 for r in got)


def test_settings_of_the_session_stay(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    repeats.digest(documents(spark)).collect()
    assert [spark.conf.get(k) for k in keys] == before


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default="": "")

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session)
