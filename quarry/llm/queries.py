"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, licenses, mixing, neardup, neighbours, ngrams, pages, pieces, quality, repeats, shards, tries


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, 5)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *quality.MEASURES, "base_failed", F.round("host_rate", 6).alias("host_rate"), "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngrams.held_out_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shards.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return licenses.scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_quality_rules": op4_quality_rules,
        "op5_mixing": op5_mixing,
        "op6_html_extraction": op6_html_extraction,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_sharding": op8_sharding,
        "op9_license_scan": op9_license_scan,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_decontamination": op11_decontamination,
        "op12_prefix_trie": op12_prefix_trie,
    }


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)
), ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(u, v) AS (
  SELECT u, v FROM ways UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u
), least AS (
  SELECT u, min(v) AS v FROM reach GROUP BY u
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least.v, doc_id)) AS component_id, least(doc_id, coalesce(least.v, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON u = doc_id
"""

OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup, word_chars < 2 * n_words OR word_chars > 12 * n_words AS length FROM measured
), bits AS (
  SELECT source, rule, bit FROM (SELECT source, unnest(['base', 'symbols', 'lines', 'length']) AS rule, unnest([base_failed, symbols, dup, length]) AS bit FROM failed)
), hosts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(bit::INT)::DOUBLE AS f FROM bits GROUP BY source, rule
), sums AS (
  SELECT rule, sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS k, sum(f * f / n) AS q, sum(n * n) AS r FROM hosts GROUP BY rule
), fitted AS (
  SELECT rule, m, m * (1 - m) AS noise, (q - n * m * m - m * (1 - m) * (k - 1)) / nullif(n - r / n, 0) AS spread FROM sums
), prior AS (
  SELECT rule, m, least(greatest(CASE WHEN noise > 0 AND spread > 0 THEN noise / spread - 1 ELSE 1e6 END, 1), 1e6) AS k FROM fitted
), rates AS (
  SELECT source, max((f + m * k) / (n + k)) AS host_rate FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines, base_failed, round(host_rate, 6) AS host_rate, NOT base_failed AND host_rate <= 0.5 AS kept
FROM failed JOIN rates ON failed.source IS NOT DISTINCT FROM rates.source
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    floor(-ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
      / (1 / (1 + 20 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', ''))) / greatest(length(coalesce(text, '')), 1))) * 17592186044416.0) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM d GROUP BY source
), water(step, level) AS (
  SELECT 1, 1.5 * sum(source_size) / sum(w) FROM s
  UNION ALL
  SELECT step + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (WHERE level * w >= 2 * source_size), 0)) / nullif(sum(w) FILTER (WHERE level * w < 2 * source_size), 0) FROM s)
  FROM water WHERE level IS NOT NULL AND step <= (SELECT count(*) FROM s)
), t AS (
  SELECT source, source_size, least(2 * source_size, w * coalesce((SELECT level FROM water ORDER BY step DESC LIMIT 1), 1e300)) AS target FROM s
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
), placed AS (
  SELECT d.*, source_size, target, epochs, target - epochs * source_size AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size) - size AS begun
  FROM d JOIN budgets ON d.source IS NOT DISTINCT FROM budgets.source
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 6) AS target, (size * (epochs + CASE WHEN begun + size / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""

OP8_SQL = r"""
WITH RECURSIVE polynomial AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM documents, polynomial
), sized AS (
  SELECT h, sum(size)::BIGINT AS b FROM docs GROUP BY h
), falling AS (
  SELECT h, b, row_number() OVER (ORDER BY b DESC, h) AS k, sum(b) OVER () - coalesce(sum(b) OVER (ORDER BY b DESC, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_bytes FROM sized
), own AS (
  SELECT h, k FROM falling WHERE k < coalesce((SELECT min(k) FROM falling WHERE k > 15 OR b <= left_bytes / (17 - k)), 1e9)
), about AS (
  SELECT 16 - (SELECT count(*) FROM own) AS shards, coalesce(sum(b), 0)::BIGINT AS total FROM sized WHERE h NOT IN (SELECT h FROM own)
), groups AS (
  SELECT h, b, sum(b) OVER (ORDER BY h)::BIGINT AS upto FROM sized WHERE h NOT IN (SELECT h FROM own)
), bounds AS (
  SELECT upto AS cum FROM groups UNION ALL SELECT 0
), tries(lo, hi, base, used) AS (
  SELECT CAST(ceil(total / shards) AS BIGINT), total, 0::BIGINT, 0::BIGINT FROM about
  UNION ALL
  SELECT CASE WHEN over AND base < total THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN over AND base >= total THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN over THEN 0 ELSE (SELECT max(cum) FROM bounds WHERE cum <= base + (lo + hi) // 2) END, CASE WHEN over THEN 0 ELSE used + 1 END
  FROM (SELECT tries.*, total, base >= total OR used >= shards AS over FROM tries, about) WHERE lo < hi
), capacity AS (
  SELECT min(hi) AS c FROM tries WHERE lo >= hi
), jumps(start, base, used) AS (
  SELECT cum, cum, 0 FROM bounds
  UNION ALL
  SELECT start, (SELECT max(cum) FROM bounds WHERE cum <= base + c), used + 1 FROM jumps, about, capacity WHERE base < total AND used < 17
), need AS (
  SELECT start AS cum, max(used) AS shards FROM jumps GROUP BY start
), cuts(left_shards, base) AS (
  SELECT shards, 0::BIGINT FROM about
  UNION ALL
  SELECT left_shards - 1, CASE
    WHEN near > base AND near <= base + c AND (SELECT shards FROM need WHERE cum = near) < left_shards THEN near
    WHEN low > base AND low <= base + c AND (SELECT shards FROM need WHERE cum = low) < left_shards THEN low ELSE far END
  FROM (
    SELECT *, CASE WHEN above - even < even - low THEN above ELSE low END AS near FROM (
      SELECT left_shards, base, c, total, base + (total - base) / left_shards AS even,
        (SELECT max(cum) FROM bounds WHERE cum <= base + (total - base) / left_shards) AS low, (SELECT min(cum) FROM bounds WHERE cum > base + (total - base) / left_shards) AS above,
        (SELECT max(cum) FROM bounds WHERE cum <= base + c) AS far
      FROM cuts, about, capacity WHERE left_shards > 1 AND base < total))
), firsts AS (
  SELECT DISTINCT h FROM cuts JOIN groups ON upto - b = base WHERE base > 0
), placed AS (
  SELECT docs.*, CASE WHEN own.k IS NOT NULL THEN 16 - own.k ELSE (SELECT count(*) FROM firsts WHERE firsts.h <= docs.h) END AS shard FROM docs LEFT JOIN own ON own.h = docs.h
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM placed
"""

OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i + 1 : i + 50], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM windows) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range(0, 50)) AS k)
), removed AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE [x FOR x, i IN ws IF NOT list_contains(ps, i - 1)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, ws, least(len(ws), 10) AS size FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0
), item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i + 1 : i + size], ' ') AS win FROM (SELECT *, unnest(range(0, len(ws) - size + 1)) AS i FROM b)
), sizes AS (
  SELECT DISTINCT size FROM b
), doc_windows AS (
  SELECT r, i, size, array_to_string(ws[i + 1 : i + size], ' ') AS win FROM (SELECT r, ws, size, unnest(range(0, len(ws) - size + 1)) AS i FROM d, sizes WHERE len(ws) >= size)
), hits AS (
  SELECT r, i, size, win FROM doc_windows WHERE (size, win) IN (SELECT size, win FROM item_windows)
), n AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits JOIN item_windows USING (size, win) WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN items USING (r)
"""

OP12_SQL = r"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT own.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 6 AS h FROM own, polynomial
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1 : a.h], a.turns[a.h + 1 :]) AS turns FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), places AS (
  SELECT conv_id, len(turns) AS size, d AS depth, turns[1 : d] AS prefix, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].text) END AS points FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = depth AS leaf, (count(*) - 1) * any_value(points) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM places GROUP BY depth, prefix
), above AS (
  SELECT a.depth, a.prefix, sum(x.leaf::INT) AS n_leaves, sum(x.saved) AS saved_tokens, count(*) FILTER (WHERE x.depth = a.depth + 1) AS n_children
  FROM nodes x JOIN places p ON p.conv_id = x.conv_id AND p.depth <= x.depth JOIN nodes a ON a.depth = p.depth AND a.prefix = p.prefix GROUP BY a.depth, a.prefix
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above USING (depth, prefix) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]
"""

ORACLE_SQL = {"op1_minhash_dedup": OP1_SQL, "op4_quality_rules": OP4_SQL, "op5_mixing": OP5_SQL, "op8_sharding": OP8_SQL, "op9_license_scan": licenses.oracle(), "op10_substring_dedup": OP10_SQL, "op11_decontamination": OP11_SQL, "op12_prefix_trie": OP12_SQL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
