"""Schemas and fixed values of the chunk table."""

from __future__ import annotations

from pyspark.sql import types as T

#: The columns of a chunk.
CHUNK = T.StructType(
    [
        T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("chunk_type", T.StringType(), False),
        T.StructField("name", T.StringType(), True),
        T.StructField("language", T.StringType(), False),
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("indexed_at", T.DoubleType(), False),
        T.StructField("branch", T.StringType(), True),
        T.StructField("chunk_seq", T.IntegerType(), False),
        T.StructField("chunk_id", T.StringType(), False),
    ]
)
#: The inverted index beside the chunks: what search.postings gives, with what ties and filters ask.
POSTING = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("tf", T.LongType()),
        T.StructField("dl", T.IntegerType()),
        *(CHUNK[name] for name in ("path", "start_line", "chunk_seq", "chunk_type", "language", "branch")),
    ]
)
FILE = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("abs_path", T.StringType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("mtime", T.TimestampType(), True),
        T.StructField("content", T.BinaryType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)
#: Columns that results show; chunk_id and chunk_seq are internal.
RESULT_COLUMNS = ("path", "start_line", "end_line", "text", "score", "language", "chunk_type", "name", "branch")

#: Languages by file suffix, and the languages with a scanner for definitions.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go",
    ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".md": "markdown", ".txt": "text",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
}
CODE_LANGUAGES = ("python", "javascript", "typescript", "go")
VECTOR_DIMENSION = 384
