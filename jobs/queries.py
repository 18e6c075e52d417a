"""The jobs as registered queries: each runs twice into one new folder and returns its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import search
from quarry.places import new_folder

from . import document_feed, keyword_index

Query = Callable[[SparkSession, str], DataFrame]


def job1_document_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents after two runs with one checkpoint, of which the second finds nothing new."""
    place = new_folder(spark, "job1")
    for _ in range(2):
        document_feed.run(spark, f"{sf_dir}/documents.parquet", f"{place}/out", f"{place}/checkpoint")
    return document_feed.chunks(spark, f"{place}/out").selectExpr("doc_id", "lang", "source", "file_hash", "chunk_seq", "text", "start_line", "end_line", "chunk_type", "n_tokens", "shelf")


def job2_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting of the index of all documents after two runs into one folder."""
    place = new_folder(spark, "job2")
    for _ in range(2):
        keyword_index.run(spark, f"{sf_dir}/documents.parquet", f"{place}/out")
    return keyword_index.postings(spark, f"{place}/out").selectExpr("term", "doc_id", "tf", "dl", "df", "round(weight, 6) weight", "bucket")


def queries() -> dict[str, Query]:
    return {"job1_document_feed": job1_document_feed, "job2_keyword_index": job2_keyword_index}


_FEED = document_feed.Settings()
_STEP = _FEED.max_words - _FEED.overlap_words
JOB1_SQL = rf"""
WITH d AS (
  SELECT doc_id, arg_max({{'text': text, 'lang': lang, 'source': source}}, sha256(coalesce(text, ''))) AS d, max(sha256(coalesce(text, ''))) AS file_hash FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
), split AS (
  SELECT doc_id, unnest(string_split(d.text, chr(10) || chr(10))) AS raw, unnest(range(len(string_split(d.text, chr(10) || chr(10))))) AS k FROM d
), paras AS (
  SELECT doc_id, k, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS p FROM split
), placed AS (
  SELECT *, len(string_split(p, chr(10))) AS lines, regexp_split_to_array(p, '\s+') AS ws FROM paras WHERE p <> ''
), started AS (
  SELECT *, 1 + coalesce(sum(lines) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM placed
), pieces AS (
  SELECT *, unnest(CASE WHEN len(ws) <= {_FEED.max_words} THEN [0] ELSE range(0, (len(ws) + {_STEP} - 1) // {_STEP}) END) AS i FROM started
), chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS chunk_seq, CASE WHEN len(ws) <= {_FEED.max_words} THEN p ELSE array_to_string(ws[i * {_STEP} + 1 : i * {_STEP} + {_FEED.max_words}], ' ') END AS text,
    cur + i AS start_line, CASE WHEN len(ws) <= {_FEED.max_words} THEN cur + lines - 1 ELSE cur + i END AS end_line FROM pieces
)
SELECT doc_id, d.lang AS lang, d.source AS source, file_hash, chunk_seq::INT AS chunk_seq, c.text AS text, start_line::INT AS start_line, end_line::INT AS end_line, CASE WHEN c.text IS NOT NULL THEN 'paragraph' END AS chunk_type,
  len(regexp_extract_all(lower(c.text), '[\p{{L}}\p{{N}}]+'))::BIGINT AS n_tokens, floor(doc_id / {_FEED.ids_per_shelf})::BIGINT AS shelf
FROM d LEFT JOIN chunks c USING (doc_id)
"""

_BUCKETS = keyword_index.Settings().buckets
JOB2_SQL = rf"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), d AS (
  SELECT doc_id, arg_max(coalesce(text, ''), sha256(coalesce(text, ''))) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
), toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ts FROM d
), about AS (
  SELECT count(*)::DOUBLE AS n, sum(len(ts)) / count(*)::DOUBLE AS avgdl FROM toks
), tf AS (
  SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(ts) AS term, len(ts) AS dl FROM toks) GROUP BY doc_id, term
), df AS (
  SELECT term, count(*) AS df, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(term)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % {_BUCKETS} AS bucket
  FROM tf, polynomial GROUP BY term, t
)
SELECT term, doc_id, tf::BIGINT AS tf, dl::BIGINT AS dl, df::BIGINT AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * dl / avgdl)), 6) AS weight, bucket::INT AS bucket
FROM tf JOIN df USING (term), about
"""


def oracle_sql() -> dict[str, str]:
    return {"job1_document_feed": JOB1_SQL, "job2_keyword_index": JOB2_SQL}
