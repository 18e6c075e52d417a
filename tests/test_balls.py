"""Nearest neighbours by balls are those of a whole scan, with fewer vectors read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import balls, search


def scan(df, q, k):
    found = search._top(df.withColumn("distance", search.squared_distance(F.col("vector"), q)), [F.col("distance"), F.col("id")], k)
    return [(r.rank, r.id, r.distance) for r in found.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 16))
    x = [(k, [float(v) for v in middles[k % 20] + rng.normal(size=16) * 0.1]) for k in range(2000)]
    x += [(5000 + k, x[3][1]) for k in range(300)]  # a third and more of a ball alike
    return spark.createDataFrame(x, "id long, vector array<float>").repartition(4)


def test_results_are_those_of_a_scan(spark, clustered, tmp_path):
    path = str(tmp_path / "b")
    balls.build(clustered, path)
    assert spark.read.parquet(f"{path}/rows").count() == 2300
    rng = np.random.default_rng(6)
    queries = [list(clustered.where("id = 7").first().vector), list(clustered.where("id = 3").first().vector), rng.normal(size=16).tolist(), [0.0] * 16, (rng.normal(size=16) * 100).tolist()]
    reads = []
    for q in queries:
        for k in (1, 10, 310):
            found, n = balls.search(spark, path, q, k, ["id"])
            assert [(r.rank, r.id, r.distance) for r in found.orderBy("rank").collect()] == scan(clustered, q, k)
            reads.append(n)
    assert reads[1] < 2300 / 4  # the ten nearest of a vector of the table
    found, n = balls.search(spark, path, queries[0], 5000, ["id"])
    assert n == 2300 == found.count()
    plan = balls.search(spark, path, queries[0], 5, ["id"])[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [ball" in plan and "TakeOrderedAndProject" in plan


def test_odd_vectors(spark, tmp_path):
    path = str(tmp_path / "b")
    odd = [(1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [0.0, 0.0]), (7, [0.0, 0.0]), (None, [1.0, 0.0])]
    balls.build(spark.createDataFrame(odd, "id long, vector array<float>"), path)
    found, _ = balls.search(spark, path, [0.0, 0.0], 10, ["id"])
    assert [r.id for r in found.orderBy("rank").collect()] == [6, 7, None]
    balls.build(spark.createDataFrame([], "id long, vector array<float>"), path)
    found, n = balls.search(spark, path, [0.0, 0.0], 10, ["id"])
    assert n == 0 and found.collect() == []
