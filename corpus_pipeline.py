"""A training-data pipeline over documents: filter, de-duplicate, cut repeats, mix and encode.

Each stage takes what the one before has kept, as a table of its own; all but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, neardup, pieces, quality, repeats, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the quality rules or whose host is rejected; what stays is unchanged.

    Null and empty texts go; a null source is a host; repeated rows stay or go
    each on its own.  An empty table gives no rows, and columns may have any names.
    """
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates (five words, similarity 0.8 or more).

    Documents without words and rows with a null id are in no group; rows with
    equal ids stay or go together.  An empty table gives no rows, and columns
    may have any names.
    """
    return neardup.keep_first(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of 50-word windows that also start in a document with a smaller id; a changed text's words are joined by one space.

    All rows stay, in the columns they have; null texts and rows with a null
    id are not changed; n_chars follows the text where that changes.  An empty
    table gives no rows.
    """
    p = scratch.unused(docs, "_quarry_p_")
    cut = repeats.remove(docs, length=50, prefix=p)
    changed = {"text": F.col(p + "kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(p + "n_removed") > 0, F.length(p + "kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns(changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: rows as often as it has them, unchanged; sources without a name are one.

    A null text has no words; rows with equal ids and texts are mixed alike.
    An empty table gives no rows, and columns may have any names.
    """
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; a null text counts as empty, other columns take no part."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", filter_quality),
    ("near-duplicates", drop_near_duplicates),
    ("substring duplicates", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SentencePiece encoding is not expressible in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name.replace(" ", "-"))
    return docs
