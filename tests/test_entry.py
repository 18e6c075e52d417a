import duckdb
import pytest

import __spark_entry__ as entry
from quarry import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_queries_match_sql(spark, db, name):
    df = engine.queries()[name](spark, SF)
    names = ", ".join(sorted(df.columns))
    want = db.execute(f"SELECT {names} FROM ({engine.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_every_query_is_registered():
    assert set(engine.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
