"""The registered queries against their SQL, over the smallest tables."""

import duckdb
import pytest

from quarry.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(str, want))
