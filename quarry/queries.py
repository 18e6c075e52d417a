"""The engine's registered queries over the driver's tables, and their SQL counterparts.

The reference data of the engine is a tree of files; here a chunk table is
derived from documents, the same way in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns
from .operators import balls, chunk, embed, enhance, incremental, search, stats
from .operators.filters import Filters
from .places import new_folder
from .plans import retrieval
from .streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
TEXT = "thand ing le und"
LIMIT = 20
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, *values: str) -> Column:
    out = None
    for k, v in enumerate(values[:-1]):
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(values[-1])


def virtual_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = _table(spark, sf_dir, "documents"), F.col("doc_id")
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".js").when(F.col("lang") == "de", ".md").otherwise(".txt")
    path = F.concat(_pick(i % 3, "src/", "lib/", "tests/"), "source", suffix)
    start = (1 + (i * 7) % 40).cast("int")
    return d.select(
        i.cast("string").alias("chunk_id"), "doc_id", "text", path.alias("path"), start.alias("start_line"), (start + 4 + (i % 13)).cast("int").alias("end_line"),
        _pick(i % 4, "function", "class", "section", "paragraph").alias("chunk_type"), F.lit(None).cast("string").alias("name"), columns.detect_language(path).alias("language"),
        columns.file_hash(F.encode("text", "utf-8")).alias("file_hash"), F.when(i % 5 == 0, None).when(i % 5 < 3, "main").otherwise("feature").alias("branch"),
        (F.lit(1.7e9) + i * 60).alias("indexed_at"), i.cast("int").alias("chunk_seq"), (((i * 37) % 1000) / 1000.0).alias("score"),
    )


CHUNKS = """chunks AS (
  SELECT doc_id::VARCHAR AS chunk_id, doc_id, text,
    (CASE doc_id % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/' ELSE 'tests/' END) || source || (CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.md' ELSE '.txt' END) AS path,
    (1 + (doc_id * 7) % 40)::INT AS start_line, (1 + (doc_id * 7) % 40 + 4 + doc_id % 13)::INT AS end_line,
    CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'section' ELSE 'paragraph' END AS chunk_type,
    CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'markdown' ELSE 'text' END AS language,
    sha256(text) AS file_hash, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 < 3 THEN 'main' ELSE 'feature' END AS branch,
    1.7e9::DOUBLE + doc_id * 60 AS indexed_at, doc_id::INT AS chunk_seq, ((doc_id * 37) % 1000) / 1000.0::DOUBLE AS score
  FROM documents)"""
VECTORS = """nearest AS (
  SELECT vec_id, label, d, row_number() OVER (ORDER BY d, vec_id) AS k FROM (
    SELECT e.vec_id, e.label, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))) AS d
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where}))"""


def _bm25_sql(limit_where: str = "true") -> str:
    terms = ", ".join(f"'{t}'" for t in sorted(set(search.query_terms(TEXT))))
    return rf"""toks AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS ts FROM chunks),
about AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM toks),
tf AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, unnest(ts) AS term, len(ts) AS dl FROM toks) WHERE term IN ({terms}) GROUP BY chunk_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN df USING (term), about GROUP BY chunk_id),
words AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, path, start_line, chunk_seq) AS k FROM bm JOIN chunks USING (chunk_id) WHERE {limit_where})"""


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


# Vectors -----------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return e, list(e.where("vec_id = 0").first().vector)


def _nearest(e: DataFrame, q: list[float]) -> DataFrame:
    found = search._top(e.withColumn("distance", search.squared_distance(F.col("vector"), q)).withColumn("score", columns.similarity(F.col("distance"))), [F.col("distance"), F.col("vec_id")], LIMIT)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@_add("vector_topk", f"WITH {VECTORS.format(where='true')} SELECT vec_id, label, round(1 / (1 + d), 6) AS score, k AS rank FROM nearest WHERE k <= {LIMIT}")
def _(spark, sf_dir):
    return _nearest(*_vectors(spark, sf_dir))


@_add("vector_topk_filtered", f"WITH {VECTORS.format(where='e.label IN (1, 2)')} SELECT vec_id, label, round(1 / (1 + d), 6) AS score, k AS rank FROM nearest WHERE k <= {LIMIT}")
def _(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    return _nearest(e.where(F.col("label").isin(1, 2)), q)


@_add("vector_min_score", f"WITH {VECTORS.format(where='true')} SELECT vec_id, label, round(1 / (1 + d), 6) AS score, k AS rank FROM nearest WHERE k <= {LIMIT} AND round(1 / (1 + d), 6) >= 0.45")
def _(spark, sf_dir):
    return _nearest(*_vectors(spark, sf_dir)).where(F.col("score") >= 0.45)


@_add("vector_topk_balls", f"WITH {VECTORS.format(where='true')} SELECT vec_id, label, round(1 / (1 + d), 6) AS score, k AS rank FROM nearest WHERE k <= {LIMIT}")
def _(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    place = new_folder(spark, "balls")
    balls.build(e, place)
    found, _ = balls.search(spark, place, q, LIMIT, ["vec_id"])
    return found.select("vec_id", "label", F.round(columns.similarity(F.col("distance")), 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Keywords and fusion -----------------------------------------------------------------------


def _fts(spark, sf_dir, filters=Filters()):
    found = search.fts_search(virtual_chunks(spark, sf_dir), TEXT, LIMIT, filters)
    return found.select("doc_id", "path", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FTS = "SELECT doc_id, path, round(bm25, 6) AS bm25, round(bm25 / (1 + bm25), 6) AS score, k AS rank FROM words"


@_add("fts_bm25", f"WITH {CHUNKS}, {_bm25_sql()} {_FTS} WHERE k <= {LIMIT}")
def _(spark, sf_dir):
    return _fts(spark, sf_dir)


@_add("fts_bm25_filtered", f"WITH {CHUNKS}, {_bm25_sql(chr(108) + 'anguage = ' + repr('python'))} {_FTS} WHERE k <= {LIMIT}")
def _(spark, sf_dir):
    return _fts(spark, sf_dir, Filters(languages=["python"]))


def _with_vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[float]]:
    """Chunks, their vectors by chunk_id, and the query's vector: texts and vectors are never joined."""
    e, q = _vectors(spark, sf_dir)
    return virtual_chunks(spark, sf_dir), e.select(F.col("vec_id").cast("string").alias("chunk_id"), "vector"), q


_JOINED = CHUNKS.replace("chunks AS", "every AS") + ",\nchunks AS (SELECT every.*, embedding FROM every LEFT JOIN embeddings ON doc_id = vec_id)"
_NEAR = """near AS (
  SELECT *, row_number() OVER (ORDER BY d, path, start_line, chunk_seq) AS v FROM (
    SELECT chunks.*, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (chunks.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (chunks.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))) AS d
    FROM chunks, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE chunks.embedding IS NOT NULL))"""


def _hybrid_sql(limit: int) -> str:
    return f"""{_JOINED}, {_bm25_sql()}, {_NEAR},
fused AS (SELECT coalesce(n.chunk_id, w.chunk_id) AS chunk_id, coalesce(0.5 / (60 + v), 0) + coalesce(0.5 / (60 + k), 0) AS rrf FROM (SELECT chunk_id, v FROM near WHERE v <= {limit}) n FULL JOIN (SELECT chunk_id, k FROM words WHERE k <= {limit}) w ON n.chunk_id = w.chunk_id),
hybrid AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, path, start_line, chunk_seq) AS r FROM fused JOIN chunks USING (chunk_id))"""


@_add("hybrid_rrf", f"WITH {_hybrid_sql(LIMIT)} SELECT doc_id, path, round(rrf * 61, 6) AS score, r AS rank FROM hybrid WHERE r <= {LIMIT}")
def _(spark, sf_dir):
    chunks, vectors, q = _with_vectors(spark, sf_dir)
    found = search.hybrid_search(chunks, TEXT, q, LIMIT, vectors=vectors)
    return found.select("doc_id", "path", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Filters -----------------------------------------------------------------------------------

for _name, _filters, _where in (
    ("filter_extension", Filters(extensions=[".py", "md"]), "suffix(path, '.py') OR suffix(path, 'md')"),
    ("filter_directory", Filters(directories=["src", "tests/"]), "starts_with(path, 'src') OR starts_with(path, 'tests/')"),
    ("filter_chunk_type", Filters(chunk_types=["class", "section"]), "chunk_type IN ('class', 'section')"),
    ("filter_language", Filters(languages=["python", "text"]), "language IN ('python', 'text')"),
    ("filter_substring", Filters(file_filter="src1"), "contains(path, 'src1')"),
    ("filter_branch", Filters(branch="main"), "branch = 'main'"),
    ("filter_glob", Filters(glob="src/src1*.py"), r"regexp_full_match(path, 'src/src1[^/]*\.py')"),
    ("filter_combined", Filters([".py", ".js"], ["lib/"], ["function", "paragraph"], None, "src", "feature"), "(suffix(path, '.py') OR suffix(path, '.js')) AND starts_with(path, 'lib/') AND chunk_type IN ('function', 'paragraph') AND contains(path, 'src') AND branch = 'feature'"),
):

    def _filtered(spark, sf_dir, filters=_filters):
        return filters.apply(virtual_chunks(spark, sf_dir)).select("doc_id", "path", "chunk_type", "language", "branch")

    _add(_name, f"WITH {CHUNKS} SELECT doc_id, path, chunk_type, language, branch FROM chunks WHERE {_where}")(_filtered)


# Chunkers ----------------------------------------------------------------------------------


def _paragraphs(spark, sf_dir, words, overlap):
    """Documents of a source and language in groups of ten become files with blank lines between them."""
    d = _table(spark, sf_dir, "documents")
    files = d.groupBy("source", "lang", F.floor(F.col("doc_id") / 200).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x.text), "\n\n").alias("text"))
    rows = files.select("source", "lang", "part", F.posexplode(chunk.paragraph_chunks(F.col("text"), words, overlap)).alias("seq", "c"))
    return rows.select("source", "lang", "part", F.col("c.text").alias("text"), "c.start_line", "c.end_line", "c.chunk_type")


def _paragraph_sql(words: int, overlap: int) -> str:
    step = words - overlap
    return rf"""WITH paras AS (SELECT source, lang, doc_id // 200 AS part, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS p FROM documents),
placed AS (SELECT *, len(string_split(p, chr(10))) AS lines, regexp_split_to_array(p, '\s+') AS ws FROM paras WHERE p <> ''),
started AS (SELECT *, 1 + coalesce(sum(lines) OVER (PARTITION BY source, lang, part ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM placed),
pieces AS (SELECT *, unnest(CASE WHEN len(ws) <= {words} THEN [0] ELSE range(0, (len(ws) + {step} - 1) // {step}) END) AS k FROM started)
SELECT source, lang, part::BIGINT AS part, CASE WHEN len(ws) <= {words} THEN p ELSE array_to_string(ws[k * {step} + 1 : k * {step} + {words}], ' ') END AS text,
  (cur + k)::INT AS start_line, (CASE WHEN len(ws) <= {words} THEN cur + lines - 1 ELSE cur + k END)::INT AS end_line, 'paragraph' AS chunk_type FROM pieces"""


@_add("chunk_fallback", _paragraph_sql(500, 50))
def _(spark, sf_dir):
    return _paragraphs(spark, sf_dir, 500, 50)


@_add("chunk_fallback_windows", _paragraph_sql(40, 15))
def _(spark, sf_dir):
    return _paragraphs(spark, sf_dir, 40, 15)


@_add("chunk_markdown", """WITH t AS (SELECT conv_id, turn, '# ' || role || chr(10) || text AS s FROM conversations),
files AS (SELECT conv_id, string_agg(s, chr(10) ORDER BY turn, s) AS text FROM t GROUP BY conv_id),
lines AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM files),
headed AS (SELECT *, regexp_matches(line, '^#{1,6}\\s+.+$') AS head FROM lines),
numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY no) AS section FROM headed)
SELECT conv_id, min(no)::INT AS start_line, max(no)::INT AS end_line, string_agg(line, chr(10) ORDER BY no) AS text, trim(regexp_extract(arg_min(line, no), '^#{1,6}\\s+(.+)$', 1)) AS name FROM numbered GROUP BY conv_id, section""".replace("\\\\", "\\"))
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("# "), "role", F.lit("\n"), "text").alias("s"))))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x.s), "\n").alias("text"))
    return files.select("conv_id", F.inline(chunk.section_chunks(F.col("text")))).select("conv_id", "start_line", "end_line", "text", "name")


# Sources made from documents: for each line of a text a block of six lines that has it as a comment, blocks taking turns.
# Beside each block stand the chunks it must give: first and last line in the block, type, name, text.
_CODE = {
    "python": (
        ("@cached\ndef f{k}(a):\n    # {line}\n    return a\n\n\n", [(1, 4, "function", "f{k}", "@cached\ndef f{k}(a):\n    # {line}\n    return a")]),
        ("class C{k}(Base):\n    def m(self):\n        # {line}\n        return {k}\n\n\n", [(1, 4, "class", "C{k}", "class C{k}(Base):\n    def m(self):\n        # {line}\n        return {k}"), (2, 4, "function", "m", "def m(self):\n        # {line}\n        return {k}")]),
    ),
    "javascript": (
        ("function f{k}(a) {\n  // {line}\n  return `x`;\n}\n\n\n", [(1, 4, "function", "f{k}", "function f{k}(a) {\n  // {line}\n  return `x`;\n}")]),
        ("class K{k} {\n  m() {\n    // {line}\n    return 1;\n  }\n}\n", [(1, 6, "class", "K{k}", "class K{k} {\n  m() {\n    // {line}\n    return 1;\n  }\n}"), (2, 5, "function", "m", "m() {\n    // {line}\n    return 1;\n  }")]),
    ),
    "typescript": (
        ("interface I{k} {\n  // {line}\n  a: string;\n}\n\n\n", [(1, 4, "interface", "I{k}", "interface I{k} {\n  // {line}\n  a: string;\n}")]),
        ("function g{k}(a: number): number {\n  // {line}\n  return a;\n}\ntype T{k} = string | number;\n\n", [(1, 4, "function", "g{k}", "function g{k}(a: number): number {\n  // {line}\n  return a;\n}"), (5, 5, "type", "T{k}", "type T{k} = string | number;")]),
    ),
    "go": (
        ("type S{k} struct {\n\t// {line}\n\tA int\n}\n\n\n", [(1, 4, "type", "S{k}", "S{k} struct {\n\t// {line}\n\tA int\n}")]),
        ("func (s *S) G{k}() int {\n\t// {line}\n\treturn 1\n}\n\n\n", [(1, 4, "function", "G{k}", "func (s *S) G{k}() int {\n\t// {line}\n\treturn 1\n}")]),
    ),
}
_BREAKS = r"[\x00-\x1f\x7f\u0085\u2028\u2029]"


def _code_sql(language: str) -> str:
    odd, even = (chunks for _, chunks in _CODE[language])
    quoted = lambda t: "E'" + t.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t") + "'"
    rows = ", ".join(f"({parity}, {n}, {first}, {last}, '{kind}', {quoted(name)}, {quoted(text)})" for parity, chunks in ((1, odd), (0, even)) for n, (first, last, kind, name, text) in enumerate(chunks))
    breaks = _BREAKS.replace(r"\u0085", r"\x{85}").replace(r"\u2028", r"\x{2028}").replace(r"\u2029", r"\x{2029}")
    return rf"""WITH expected(parity, n, first, last, kind, name, text) AS (VALUES {rows}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k FROM documents),
clean AS (SELECT doc_id, k, regexp_replace(line, '{breaks}', ' ', 'g') AS line FROM lines)
SELECT doc_id, (k // 2 * {len(odd)} + (k - 1) // 2 * {len(even)} + n)::INT AS chunk_seq, replace(replace(text, '{{k}}', k::VARCHAR), '{{line}}', line) AS text,
  (6 * (k - 1) + first)::INT AS start_line, (6 * (k - 1) + last)::INT AS end_line, kind AS chunk_type, replace(name, '{{k}}', k::VARCHAR) AS name FROM clean JOIN expected ON k % 2 = parity"""


for _language in _CODE:

    def _code(spark, sf_dir, language=_language):
        """Documents as sources: every line is a comment in a definition."""
        lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, _BREAKS, " "))

        def block(line: Column, i: Column) -> Column:
            made = [F.replace(F.replace(F.lit(t), F.lit("{k}"), (i + 1).cast("string")), F.lit("{line}"), line) for t, _ in _CODE[language]]
            return F.when(i % 2 == 0, made[0]).otherwise(made[1])

        files = _table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lines, block), "").alias("text"), F.lit(language).alias("language"))
        return chunk.chunk_files(files).select("doc_id", "chunk_seq", "text", "start_line", "end_line", "chunk_type", "name")

    _add(f"code_chunks_{_language}", _code_sql(_language))(_code)


# Scalar functions --------------------------------------------------------------------------


@_add("detect_language", "SELECT page_id, CASE WHEN regexp_matches(lower(p), '[^/]\\.html$') THEN 'unknown' WHEN page_id % 3 = 0 THEN 'typescript' WHEN page_id % 3 = 1 THEN 'c' ELSE 'yaml' END AS language FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)".replace("\\\\", "\\"))
def _(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", r"[?#].*$", "")
    path = F.when(F.lower(path).rlike(r"[^/]\.html$"), path).otherwise(F.concat(path, F.lit("/x"), _pick(F.col("page_id") % 3, ".TSX", ".h", ".yml")))
    return p.select("page_id", columns.detect_language(path).alias("language"))


@_add("file_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", columns.file_hash(F.encode("text", "utf-8")).alias("file_hash"))


@_add("size_gate", "SELECT page_id, octet_length(encode(html))::BIGINT AS size FROM pages WHERE octet_length(encode(html)) <= 4096")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size")).where("size <= 4096")


@_add("overlap_share", f"WITH {CHUNKS} SELECT doc_id, round(greatest(0, least(end_line, 20) - greatest(start_line, 10) + 1)::DOUBLE / least(end_line - start_line + 1, 11), 6) AS share FROM chunks")
def _(spark, sf_dir):
    return virtual_chunks(spark, sf_dir).select("doc_id", F.round(columns.overlap(F.col("start_line"), F.col("end_line"), F.lit(10), F.lit(20)), 6).alias("share"))


@_add("embed_hash")
def _(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", embed.embed(F.col("text"), embed.HashingEmbedder(64)).alias("vector"))


# Maintenance -------------------------------------------------------------------------------


def _files(spark, sf_dir) -> DataFrame:
    """Documents as files now: every tenth changed, every thirteenth gone."""
    d = _table(spark, sf_dir, "documents").where("doc_id % 13 <> 0")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), columns.file_hash(F.encode(text, "utf-8")).alias("file_hash"))


def _stored(spark, sf_dir) -> DataFrame:
    """What was indexed: all but every seventeenth document."""
    d = _table(spark, sf_dir, "documents").where("doc_id % 17 <> 1")
    return d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), columns.file_hash(F.encode("text", "utf-8")).alias("file_hash"), F.lit(None).cast("string").alias("branch"))


_DIFF = "files AS (SELECT 'd/' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' changed' ELSE text END) AS file_hash FROM documents WHERE doc_id % 13 <> 0), stored AS (SELECT 'd/' || doc_id AS path, sha256(text) AS file_hash FROM documents WHERE doc_id % 17 <> 1)"


@_add("incremental_diff", f"WITH {_DIFF} SELECT f.path, f.file_hash, CASE WHEN s.path IS NULL THEN 'new' WHEN s.file_hash = f.file_hash THEN 'unchanged' ELSE 'changed' END AS status FROM files f LEFT JOIN stored s USING (path)")
def _(spark, sf_dir):
    return incremental.file_status(_files(spark, sf_dir), _stored(spark, sf_dir))


@_add("status_counts", f"WITH {_DIFF} SELECT CASE WHEN s.path IS NULL THEN 'new' WHEN s.file_hash = f.file_hash THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS files FROM files f LEFT JOIN stored s USING (path) GROUP BY 1")
def _(spark, sf_dir):
    return incremental.status_counts(incremental.file_status(_files(spark, sf_dir), _stored(spark, sf_dir)))


@_add("deleted_files", f"WITH {_DIFF} SELECT path FROM stored EXCEPT SELECT path FROM files")
def _(spark, sf_dir):
    return incremental.deleted_files(_files(spark, sf_dir), _stored(spark, sf_dir))


@_add("upsert_store", f"WITH {_DIFF} SELECT path, f.file_hash FROM files f UNION ALL SELECT path, file_hash FROM stored WHERE false")
def _(spark, sf_dir):
    files, stored = _files(spark, sf_dir), _stored(spark, sf_dir)
    changed = incremental.file_status(files, stored).where("status <> 'unchanged'").select("path", "file_hash", F.lit(None).cast("string").alias("branch"))
    gone = incremental.deleted_files(files, stored).unionByName(changed.select("path")).withColumn("branch", F.lit(None).cast("string"))
    return incremental.upsert(stored, changed, gone).select("path", "file_hash")


@_add("delete_by_path", f"WITH {CHUNKS} SELECT doc_id, path FROM chunks WHERE path <> 'src/src3.js'")
def _(spark, sf_dir):
    return incremental.delete_by_path(virtual_chunks(spark, sf_dir), "src/src3.js").select("doc_id", "path")


@_add("delete_by_branch", f"WITH {CHUNKS} SELECT doc_id, branch FROM chunks WHERE branch IS DISTINCT FROM 'main'")
def _(spark, sf_dir):
    return incremental.delete_by_branch(virtual_chunks(spark, sf_dir), "main").select("doc_id", "branch")


@_add("indexed_files", f"WITH {CHUNKS} SELECT DISTINCT path FROM chunks")
def _(spark, sf_dir):
    return stats.indexed_files(virtual_chunks(spark, sf_dir))


@_add("indexed_files_by_branch", f"WITH {CHUNKS} SELECT DISTINCT path FROM chunks WHERE branch = 'feature'")
def _(spark, sf_dir):
    return stats.indexed_files(virtual_chunks(spark, sf_dir), "feature")


@_add("file_hash_lookup", f"WITH {CHUNKS} SELECT path, branch, min(file_hash) AS stored_hash FROM chunks GROUP BY path, branch")
def _(spark, sf_dir):
    return incremental.stored_hashes(virtual_chunks(spark, sf_dir))


# Aggregates --------------------------------------------------------------------------------


@_add("index_stats", f"WITH {CHUNKS} SELECT count(DISTINCT path) AS total_files, count(*) AS total_chunks, sum(length(text))::BIGINT AS total_size_bytes, (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM chunks GROUP BY 1)) AS languages, max(indexed_at) AS last_indexed FROM chunks")
def _(spark, sf_dir):
    s = stats.index_stats(virtual_chunks(spark, sf_dir))
    return s.withColumn("languages", F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ","))


@_add("index_status", f"WITH {CHUNKS} SELECT count(DISTINCT path) AS total_files, count(*) AS total_chunks, round(sum(length(text)) / 1048576, 2) AS total_size_mb, max(indexed_at) AS last_indexed, count(*) > 0 AS indexed FROM chunks")
def _(spark, sf_dir):
    return stats.status(virtual_chunks(spark, sf_dir)).drop("languages")


@_add("language_counts", f"WITH {CHUNKS} SELECT language, count(*) AS chunks FROM chunks GROUP BY language")
def _(spark, sf_dir):
    return stats.language_counts(virtual_chunks(spark, sf_dir))


@_add("corpus_stats", rf"WITH {CHUNKS} SELECT count(*) AS n, round(avg(len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''))), 6) AS avgdl FROM chunks")
def _(spark, sf_dir):
    return search.corpus_stats(virtual_chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@_add("postings", rf"WITH {CHUNKS}, t AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS ts FROM chunks) SELECT term, chunk_id, count(*) AS tf, any_value(dl)::INT AS dl FROM (SELECT chunk_id, unnest(ts) AS term, len(ts) AS dl FROM t) GROUP BY term, chunk_id")
def _(spark, sf_dir):
    several = _table(spark, sf_dir, "documents").groupBy("doc_id").count().where("count > 1").head(1)
    return search.postings(virtual_chunks(spark, sf_dir), once=not several)


# Enhancement -------------------------------------------------------------------------------


def _scored(spark, sf_dir) -> DataFrame:
    c = virtual_chunks(spark, sf_dir)
    # The place among all results, as a plan without one task for all: scores take 1000 values.
    return c.withColumn("rank", ((1 - F.col("score")) * 1000).cast("long") * 100_000_000 + F.col("doc_id"))


_DEDUP = f"""WITH RECURSIVE {CHUNKS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, doc_id) AS n FROM chunks),
steps AS (
  SELECT path, n, doc_id, true AS keep, [{{'s': start_line, 'e': end_line}}] AS kept FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.path, o.n, o.doc_id, ok.keep, CASE WHEN ok.keep THEN list_append(p.kept, {{'s': o.start_line, 'e': o.end_line}}) ELSE p.kept END
  FROM steps p JOIN ordered o ON o.path = p.path AND o.n = p.n + 1,
  LATERAL (SELECT len(list_filter(p.kept, lambda k: greatest(0, least(k.e, o.end_line) - greatest(k.s, o.start_line) + 1)::DOUBLE / least(k.e - k.s + 1, o.end_line - o.start_line + 1) >= 0.5)) = 0 AS keep) ok)
SELECT doc_id, path FROM steps WHERE keep"""


@_add("dedup_overlap", _DEDUP)
def _(spark, sf_dir):
    return enhance.without_overlap(_scored(spark, sf_dir)).select("doc_id", "path")


@_add("rerank_recency", f"WITH {CHUNKS}, r AS (SELECT *, (indexed_at - min(indexed_at) OVER ()) / (max(indexed_at) OVER () - min(indexed_at) OVER ()) AS norm FROM chunks) SELECT doc_id, round(least(1.0, score + 0.1 * norm), 6) AS score FROM r")
def _(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return enhance.boosted(scored, 0.1, enhance.ages(scored)).select("doc_id", F.round("score", 6).alias("score"))


@_add("expand_context", """WITH lines AS (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$') AS ls FROM documents),
spans AS (SELECT *, greatest(1, 2 + doc_id % 3 - 1) AS a, least(len(ls), 3 + doc_id % 3 + 2) AS b FROM lines)
SELECT doc_id, CASE WHEN a <= b THEN array_to_string(ls[a : b], '') ELSE 'original' END AS text, (CASE WHEN a <= b THEN a ELSE 2 + doc_id % 3 END)::INT AS start_line, (CASE WHEN a <= b THEN b ELSE 3 + doc_id % 3 END)::INT AS end_line FROM spans""".replace("\\\\n", "\\n"))
def _(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string")
    results = d.select("doc_id", path.alias("path"), F.lit("original").alias("text"), (2 + F.col("doc_id") % 3).cast("int").alias("start_line"), (3 + F.col("doc_id") % 3).cast("int").alias("end_line"))
    return enhance.expand_context(results, d.select(path.alias("path"), "text"), 1, 2).select("doc_id", "text", "start_line", "end_line")


def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hybrid search, overlap removal, recency and trimming in one plan."""
    chunks, vectors, q = _with_vectors(spark, sf_dir)
    found = retrieval.run(chunks, TEXT, q, retrieval.SearchOptions(limit=LIMIT, mode="hybrid"), vectors=vectors)
    return found.select("path", "start_line", "end_line", "language", "chunk_type", "branch", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_add("search_pipeline", f"""WITH RECURSIVE {_hybrid_sql(2 * LIMIT)},
good AS (SELECT *, rrf * 61 AS sc FROM hybrid WHERE r <= {2 * LIMIT} AND rrf * 61 >= 0.3),
ordered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sc DESC, r) AS n, min(r) OVER (PARTITION BY path) AS first FROM good),
steps AS (
  SELECT path, n, chunk_id, true AS keep, [{{'s': start_line, 'e': end_line}}] AS kept FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.path, o.n, o.chunk_id, ok.keep, CASE WHEN ok.keep THEN list_append(p.kept, {{'s': o.start_line, 'e': o.end_line}}) ELSE p.kept END
  FROM steps p JOIN ordered o ON o.path = p.path AND o.n = p.n + 1,
  LATERAL (SELECT len(list_filter(p.kept, lambda k: greatest(0, least(k.e, o.end_line) - greatest(k.s, o.start_line) + 1)::DOUBLE / least(k.e - k.s + 1, o.end_line - o.start_line + 1) >= 0.5)) = 0 AS keep) ok),
stay AS (SELECT o.*, row_number() OVER (ORDER BY sc DESC, first, r) AS place FROM ordered o JOIN steps s USING (chunk_id) WHERE s.keep),
timed AS (SELECT *, CASE WHEN max(indexed_at) OVER () = min(indexed_at) OVER () THEN sc ELSE least(1.0, sc + 0.1 * (indexed_at - min(indexed_at) OVER ()) / (max(indexed_at) OVER () - min(indexed_at) OVER ())) END AS fin FROM stay),
final AS (SELECT *, row_number() OVER (ORDER BY fin DESC, place) AS rank FROM timed)
SELECT path, start_line, end_line, language, chunk_type, branch, round(fin, 6) AS score, rank FROM final WHERE rank <= {LIMIT}""")(search_pipeline)


# Change feed -------------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), "event_type", F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("seq"))


@_add("change_feed_last_event", "SELECT 'u/' || user_id AS path, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return feed.last_event(_events(spark, sf_dir))


_GAPS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY {by} ORDER BY ts, event_id) + INTERVAL {gap} THEN 1 ELSE 0 END AS fresh, event_id FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY ts, event_id) AS burst FROM e)
SELECT {out} epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL {gap}) AS end_us, count(*) AS events FROM g GROUP BY {group}"""


def _bursts(df: DataFrame) -> DataFrame:
    return df.withColumns({"start_us": F.unix_micros("start"), "end_us": F.unix_micros("end")}).drop("start", "end")


@_add("debounce_sessions", _GAPS.format(by="1", gap="'10 minutes'", out="", group="burst"))
def _(spark, sf_dir):
    return _bursts(feed.debounce(_events(spark, sf_dir), "10 minutes"))


@_add("debounce_sessions_by_path", _GAPS.format(by="user_id", gap="'1 hour'", out="'u/' || user_id AS path,", group="user_id, burst"))
def _(spark, sf_dir):
    return _bursts(feed.debounce(_events(spark, sf_dir), "1 hour", by="path"))


@_add("progress", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS current, count(*) OVER (PARTITION BY source) AS total FROM documents")
def _(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("current"), F.count("*").over(Window.partitionBy("source")).alias("total"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
