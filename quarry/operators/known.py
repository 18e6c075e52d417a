"""Vectors by content: a text is embedded once, wherever and however often it occurs.

A table of (model, text_hash, vector) is kept beside the store.  Of new chunks
only the texts whose hash it lacks are embedded, each once; their vectors are
added to the table, and all chunks take theirs by a join.  A run that is
repeated after a failure may add a vector again; readers take one of equals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed import Embedder, with_vectors

SCHEMA = "text_hash string, vector array<float>"


class KnownVectors:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, model: str, batch_size: int = 32):
        """model names the embedder and its version: vectors of another name are another table."""
        self.spark, self.embedder, self.batch_size = spark, embedder, batch_size
        self.path = f"{path.rstrip('/')}/model={model}"

    def table(self) -> DataFrame:
        """text_hash and vector of every text that has been embedded."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def missing(self, chunks: DataFrame) -> DataFrame:
        """text_hash and text, once each, of the chunks' texts (a column text_hash, too) that the table lacks."""
        texts = chunks.groupBy("text_hash").agg(F.any_value("text").alias("text"))
        return texts.join(self.table().select("text_hash"), "text_hash", "left_anti")

    def attach(self, chunks: DataFrame) -> DataFrame:
        """chunks with vector; null where the embedder fails.  What is new is embedded and kept first."""
        hashed = chunks.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        new = with_vectors(self.missing(hashed).repartition(parts, "text_hash"), self.embedder, self.batch_size, lenient=True)
        # A folder of its own for each run: one that breaks off leaves nothing that is read.
        new.where("vector IS NOT NULL").select("text_hash", "vector").write.parquet(f"{self.path}/run={uuid.uuid4().hex}")
        vectors = self.table().groupBy("text_hash").agg(F.any_value("vector").alias("vector"))
        return hashed.join(vectors, "text_hash", "left").drop("text_hash")
