"""Exact nearest neighbours that leave most vectors unread: balls and the triangle inequality.

build() gives every vector to the nearest of some centres and writes the
vectors by centre, with the radius of each ball.  No vector of a ball is nearer
to a query than its centre's distance less its radius.  search() scans the
nearest balls first; the k-th best distance found there bounds the rest: only
balls that reach nearer are read, so the result is that of a whole scan.

Centres are taken from a sample of bounded size (CENTRES of SAMPLE vectors, by
hash) and only they are broadcast, at most LARGEST bytes of them; every vector
is indexed, whatever the centres are like.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import _top, squared_distance

CENTRES = 1024  # at most; the square root of the number of vectors, if that is less
SAMPLE = 20_000  # vectors from which centres are chosen
LARGEST = 16 << 20
SLACK = 1e-6  # relative, for rounding


def _centres(vectors: DataFrame, n: int) -> np.ndarray:
    """Some of the vectors, far from each other: each next one of a sample is the farthest from those before."""
    some = vectors.select("vector", F.xxhash64("vector").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).toArrow()
    if not len(some):
        return np.zeros((0, 0))
    x = np.array(some["vector"].to_pylist(), np.float64)
    count = max(1, min(CENTRES, math.isqrt(n), LARGEST // (8 * x.shape[1]), len(x)))
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def build(vectors: DataFrame, path: str) -> None:
    """Write vectors (a column vector, arrays of one length, and others) to path/rows, by ball, and path/balls: ball, centre, radius, n.

    Rows whose vector is null, or holds a null or a number that is not finite, are left out.
    """
    spark = vectors.sparkSession
    good = vectors.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("vector") > 0))
    centres = _centres(good, good.count())
    shared = spark.sparkContext.broadcast(centres)
    lengths = (centres**2).sum(1)

    def run(batches):
        c = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                column = part.column(part.schema.get_field_index("vector"))
                x = np.array(column.to_pylist(), np.float64).reshape(len(part), -1)
                ball = (lengths - 2 * (x @ c.T)).argmin(1)
                distance = np.sqrt(((x - c[ball]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ball, pa.int32()), pa.array(distance)], [*part.schema.names, "ball", "distance"])

    schema = T.StructType([*good.schema.fields, T.StructField("ball", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    good.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    dealt = good.mapInArrow(run, schema)
    # Rebalancing splits what is too large for a file, however many vectors are alike.
    dealt.hint("rebalance", F.col("ball")).write.mode("overwrite").partitionBy("ball").parquet(f"{path}/rows")
    about = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("ball").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "ball int, centre array<double>")
    known.join(about, "ball").coalesce(1).write.mode("overwrite").parquet(f"{path}/balls")


def search(spark: SparkSession, path: str, query: Sequence[float], limit: int, ties: Sequence[str]) -> tuple[DataFrame, int]:
    """The nearest rows with distance (squared) and rank, ties by the given columns; and how many vectors were read for them."""
    balls = spark.read.parquet(f"{path}/balls").toArrow()  # at most CENTRES rows
    schema = T.StructType([*spark.read.parquet(f"{path}/schema").schema.fields, T.StructField("ball", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    if not len(balls) or limit < 1:
        return _nearest(rows.limit(0), query, limit, ties), 0
    q = np.asarray(query, np.float64)
    gap = np.sqrt(((np.array(balls["centre"].to_pylist()) - q) ** 2).sum(1))
    radius, n, names = (balls[c].to_numpy() for c in ("radius", "n", "ball"))
    least = np.maximum(gap * (1 - SLACK) - radius * (1 + SLACK), 0)
    order = np.lexsort((gap, least))
    first = order[: int(np.searchsorted(np.cumsum(n[order]), limit)) + 1]
    near = _nearest(_in(rows, names[first]), query, limit, ties).agg(F.count("*").alias("n"), F.max("distance").alias("d")).first()
    reach = math.sqrt(near.d) * (1 + SLACK) if near.n >= limit else math.inf
    wanted = np.union1d(first, np.flatnonzero(least <= reach))
    return _nearest(_in(rows, names[wanted]), query, limit, ties), int(n[wanted].sum())


def _in(rows: DataFrame, balls: np.ndarray) -> DataFrame:
    return rows.where(F.col("ball").isin([int(b) for b in balls]))


def _nearest(rows: DataFrame, query: Sequence[float], limit: int, ties: Sequence[str]) -> DataFrame:
    found = rows.drop("ball").withColumn("distance", squared_distance(F.col("vector"), query))
    return _top(found, [F.col("distance"), *map(F.col, ties)], limit)
