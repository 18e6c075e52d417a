import hashlib
import html.parser
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quarry.llm import neighbours, ngrams, pages, pieces

from .helpers import documents, empty, rows, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
with open(MODEL, "rb") as f:
    own = pieces.Model(f.read())


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60) | st.text(alphabet="  abethois▁\n.é中😀TH<>0s/", max_size=80))
def test_encode_and_decode_as_the_library_does(t):
    t = t.encode("utf-8", "ignore").decode()
    ids = own.encode(t)
    want = library.encode(t, add_bos=True, add_eos=True)
    assert ids.tolist() == want
    assert own.decode(ids) == library.decode(want)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31999), max_size=12))
def test_decode_of_any_ids(ids):
    known = [i for i in ids if i != 0]  # the unknown id is never produced: bytes stand for characters without a piece
    assert own.decode(np.array(known, "<u4")) == library.decode(known)


def test_words_that_do_not_fit_the_cache_and_long_words():
    small = pieces.Model(open(MODEL, "rb").read(), cache=3)
    for t in ("a bb ccc dddd a bb ccc dddd", "z" * 3000, "ab" * 2000 + " " + "x=" * 100):
        assert small.encode(t).tolist() == library.encode(t, add_bos=True, add_eos=True)


def test_workers_that_have_encoded_hold_no_segments(spark):
    pieces.encode_documents(documents(spark), MODEL).collect()

    def held(batches):
        from quarry.llm import pieces

        for batch in batches:
            for m in pieces._models.values():
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(m.cache) + len(m.compatible)], pa.int64())})

    found = [r.n for r in spark.range(64, numPartitions=16).mapInArrow(held, "n long").collect()]
    assert found and max(found) == 0


def test_encode_documents(spark):
    docs = documents(spark).withColumnRenamed("lang", "n_tokens")
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in pieces.encode_documents(docs, MODEL, with_ids=True, with_text=True).collect()]
    want = []
    for i, t, *_ in rows():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        back = library.decode(ids)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back))
    assert sorted(got, key=str) == sorted(want, key=str)


# Language model ----------------------------------------------------------------------------


def plain_discounts(values):
    """Chen and Goodman's three, from the numbers of types seen once to four times."""
    n = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
    return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k] and n[k - 1] else k / 2, 0), k) for k in (1, 2, 3))]


def brute_scores(data, order=2):
    toks = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [x.encode().lower() for x in words(t)] + [0]) for i, t, *_ in data]
    c, top = Counter(), Counter()
    for _, out, t in toks:
        if not out:
            c.update(t)
            padded = [1] * (order - 1) + t
            top.update(tuple(padded[k : k + order]) for k in range(len(t)))
    levels = [top]  # counts of n-grams by falling order: occurrences, then different words before
    while len(next(iter(levels[-1]))) > 1:
        levels.append(Counter(g[1:] for g in levels[-1]))
    total, v = sum(c.values()), len(c)
    about = []
    for level in levels:
        sums, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, n in level.items():
            sums[g[:-1]] += n
            kinds[g[:-1]][min(n, 3) - 1] += 1
        about.append((level, plain_discounts(level.values()), sums, kinds))

    def p(gram, k=0):
        if not gram:
            return 1 / (v + 1)
        level, d, sums, kinds = about[k]
        lower = p(gram[1:], k + 1)
        if not sums[gram[:-1]]:
            return lower
        n = level[gram]
        return (max(n - d[min(n, 3)], 0) + sum(d[j + 1] * kinds[gram[:-1]][j] for j in range(3)) * lower) / sums[gram[:-1]]

    begin = (1,) * (order - 1)
    assert abs(sum(p((*begin, b)) for b in c) + p((*begin, "?")) - 1) < 1e-9

    def grams(t):
        padded = [1] * (order - 1) + t
        return [tuple(padded[k : k + order]) for k in range(len(t))]

    return [(i, out, len(t), sum(c[x] > 0 for x in t), total, sum(math.log10((c[x] + 1) / (total + v + 1)) for x in t), sum(math.log10(p(g)) for g in grams(t))) for i, out, t in toks]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_match_brute_force(spark, order):
    got = sorted((tuple(r)[:7] for r in ngrams.held_out_scores(documents(spark, n=120), order=order).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    want = sorted(brute_scores(rows(n=120), order), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_merging_in_steps_changes_nothing(spark, monkeypatch):
    score = lambda: sorted((tuple(r) for r in ngrams.held_out_scores(documents(spark, n=120).repartition(6)).collect()), key=str)
    want = score()
    assert [ngrams._steps(n) for n in (0, 64, 65, 4096, 4097)] == [0, 0, 1, 1, 2]
    for name, value in (("FAN", 2), ("BLOCK_BYTES", 1000), ("SHARD", 500)):
        monkeypatch.setattr(ngrams, name, value)
    got = score()
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_counts_beyond_four_bytes_and_absent_files(tmp_path):
    path = str(tmp_path / "x" / "counts")
    for c in ([3, 2**33], [3, 7], []):
        ngrams._write_counts(path, np.array(c, np.int64))
        assert ngrams._map_counts(path, len(c)).tolist() == c
    assert len(ngrams._map(str(tmp_path / "none"), np.uint64)) == 0


def test_remote_files_are_copied_once(tmp_path, monkeypatch):
    monkeypatch.setattr(ngrams, "_local", lambda path: None)
    monkeypatch.setattr(ngrams.tempfile, "tempdir", str(tmp_path / "own"))
    (tmp_path / "own").mkdir()
    (tmp_path / "model").mkdir()
    path = f"file://{tmp_path}/model/word-000000"
    ngrams._write(path, np.arange(5, dtype=np.uint64))
    assert ngrams._map(path, np.uint64).tolist() == [0, 1, 2, 3, 4]
    copy = tmp_path / "own" / "quarry-model" / "word-000000"
    made = copy.stat().st_mtime_ns
    assert ngrams._map(path, np.uint64).tolist() == [0, 1, 2, 3, 4] and copy.stat().st_mtime_ns == made
    assert len(ngrams._map(path + "-none", np.uint64)) == 0 and len(list(copy.parent.iterdir())) == 1


def test_pair_parts_split_frequent_contexts():
    second = np.arange(20_000)
    rare = ngrams._pair_part(np.full(20_000, 7), second, np.full(20_000, 1000.0), 64)
    often = ngrams._pair_part(np.full(20_000, 7), second, np.full(20_000, 40.0 * ngrams.SHARD), 64)
    assert len(set(rare.tolist())) == 1 and len(set(often.tolist())) > 20


def test_no_documents_and_no_training(spark):
    assert ngrams.held_out_scores(empty(spark)).collect() == []
    only = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = ngrams.held_out_scores(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in got) and len(got) == 2


def test_blocks_come_back():
    rng = np.random.default_rng(0)
    k = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64))
    assert (ngrams._unpack(ngrams._pack(k, True), 1000, np.uint64, True) == k).all()
    c = rng.integers(0, 9, 1000).astype(np.uint32)
    assert (ngrams._unpack(ngrams._pack(c, False), 1000, np.uint32, False) == c).all()


# Neighbours --------------------------------------------------------------------------------


def exact(data, k):
    usable = {(i, tuple(v)) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 16}
    out = {}
    for i, v in usable:
        if i % 5 == 0:
            best = defaultdict(lambda: -2.0)
            for j, w in usable:
                if j != i:
                    best[j] = max(best[j], float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))))
            out[i] = sorted(((-round(s, 9), j) for j, s in best.items()))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    base = np.float32(rng.standard_normal((300, 16)))
    data = [(i, base[i].tolist()) for i in range(300)] + [(300 + i, base[0].tolist()) for i in range(150)]
    data += [(501, None), (505, []), (510, [0.0] * 16), (515, [float("nan")] * 16), (520, [1.0] * 15 + [None]), (525, [float("inf")] + [0.0] * 15), (530, [1.0] * 3), (None, base[1].tolist()), (295, base[295].tolist())]
    rng_order = random.Random(1)
    rng_order.shuffle(data)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("node", T.StringType())])
    df = spark.createDataFrame([(*x, "n") for x in data], schema)
    got = defaultdict(list)
    for r in neighbours.nearest(df, lambda i: i % 5 == 0, 5, degree=12, beam=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact(data, 5)
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[q]} & {j for _, j in w}) for q, w in want.items())
    assert hits >= 0.95 * 5 * len(want)
    assert [j for j, _ in got[0]] == [300, 301, 302, 303, 304]  # of equal vectors the smallest ids
    for q, w in want.items():
        assert abs(got[q][0][1] + w[0][0]) < 1e-6


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0])], schema)
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(few, lambda i: i == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(spark.createDataFrame([], schema), lambda i: i == 0).collect() == []


def test_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(4)
    v = np.float32(rng.standard_normal(64) + 0.003 * rng.standard_normal((400, 64)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest(df, lambda i: i % 20 == 0, 5).collect():
        got[r.query_id].add(r.vec_id)
    unit = np.float64(v) / np.linalg.norm(np.float64(v), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 20):
        near = unit @ unit[q]
        near[q] = -3
        hits += len(got[q] & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.95 * 5 * 20


def test_search_goes_on_until_every_node_is_opened(spark):
    unit = lambda i: np.float32([math.cos(i / 20), math.sin(i / 20)]).tobytes()
    nodes = spark.createDataFrame([(i, unit(i)) for i in range(15)], "node long, unit binary").coalesce(1)
    links = spark.createDataFrame([(i, i + 1) for i in range(14)], "v long, u long").coalesce(1)
    got = neighbours.search(spark.createDataFrame([(0,)], "start long"), nodes, links, 20).collect()
    assert sorted(r.node for r in got) == list(range(15))
    assert neighbours.sizes(1000) == (32, 128) and neighbours.sizes(10**9) == (60, 240)


def test_neighbours_of_many_blocks_in_few_jobs(spark, monkeypatch):
    """Building and searching take no job for each round or step, and what is shuffled follows the vectors, not the pairs that are compared."""
    from quarry.llm import scratch

    rng = np.random.default_rng(6)
    near = rng.standard_normal((20, 64)).repeat(10, 0) + 0.003 * rng.standard_normal((200, 64))  # alike, but dealt to all blocks
    v = np.float32(np.concatenate([rng.standard_normal((2000, 64)), near]))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    written, table = [], scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, label: written.append(table(df, label)) or written[-1])
    monkeypatch.setattr(neighbours, "BLOCK", 300, raising=False)
    spark.sparkContext.setJobGroup("neighbours", "")
    found = neighbours.nearest(df, lambda i: i % 20 == 0, 5).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("neighbours")) <= 30
    spark.sparkContext.setJobGroup("", "")
    assert sum(t.count() for t in written) <= 3 * len(v)
    sizes = [r["count"] for r in written[1].groupBy("block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 400
    unit = np.float64(v) / np.linalg.norm(np.float64(v), axis=1, keepdims=True)
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12
    hits = 0
    for q in range(0, len(v), 20):
        sims = unit @ unit[q]
        sims[q] = -3
        want = np.argsort(-sims)[:5].tolist()
        assert len(got[q]) == 5 and (q < 2000 or got[q] == want)
        hits += len(set(got[q]) & set(want))
    assert hits >= 0.95 * 5 * len(got)


def test_a_walk_finds_its_way_from_far_and_compares_nothing_twice():
    t = np.arange(200) / 70
    units = np.stack([np.cos(t), np.sin(t)], axis=1)
    links = np.stack([np.arange(200) - 1, np.append(np.arange(1, 200), -1)], axis=1)  # a path
    nodes, sims = neighbours._walk(units[[0, 150]], units, links, np.array([[199], [3]]), 10, 2)
    assert nodes[0].tolist() == list(range(10)) and set(nodes[1].tolist()) >= set(range(147, 154))
    assert np.allclose(sims[0], units[:10] @ units[0]) and len(set(nodes[1].tolist())) == 10


# Pages -------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a>Menu</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">Cookies</div><div id="sidebar"><p>Side</p></div>
<article><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld<br>two&nbsp;&#233;<p>Three  <i>x</i>
<div class="ad">Buy</div><form><p>Sign</form><ul><li>a<li>b</ul></article>
<section id="comments"><article><p>First!</article></section><footer>F</footer>"""


def kept(page, compared=False):
    return [t for t, k in pages.lines(page) if k < pages.WEAK + compared]


def test_structure():
    assert kept(PAGE) == ["Title & more", "One bold", "two é", "Three x", "a", "b"]
    assert {t for t, _ in pages.lines(PAGE)} >= {"Site", "Menu", "Cookies", "Side", "Buy", "Sign", "First!", "F"}  # all that the page shows is compared
    assert pages.lines("") == [] and pages.lines("plain  text") == [("plain text", pages.PLAIN)]
    assert kept("<p>a < b and <unclosed 'x") == ["a < b and <unclosed 'x"]
    assert kept("<p>foo<span hidden>x</span>bar <a class=ad>y</a>z</p>") == ["foobar z"]
    assert kept("<aside><article>teaser</article></aside><div class='sidebar-right'><article>text</article></div>") == ["text"]
    weak = "<div class='tags'>one</div><p>two</p><article><div class='notice'>in</div></article>"
    assert kept(weak.split("<article>")[0]) == ["two"] and kept(weak.split("<article>")[0], True) == ["one", "two"] and kept(weak) == ["in"]


def test_comments_go_and_words_of_articles_stay():
    for kind in ("comment", "comment-body", "reply", "related", "share", "notice", "comments"):
        assert kept(f"<div class='{kind}'>reader 2 wrote: no</div><p>text</p>", True) == ["text"]
    for kind in ("comment", "comments", "reply-list", "ad", "advertisement"):
        assert kept(f"<article><p>text</p><div class='{kind}'><p>hi reader</p></div></article>") == ["text"]
    stays = "<article><p>See <span class='copyright'>Copyright law</span> and <a class='nav'>Link text</a>.</p><div class='subscription'>A subscription</div></article>"
    assert kept(stays) == ["See Copyright law and Link text.", "A subscription"]
    assert kept("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, <label>so</label> <svg><title>no</title><text>y</text></svg></p><form><label>Mail</label></form></article>") == ["Let x=2, so", "y"]


class Tree(html.parser.HTMLParser):
    """A plain reader of well-formed pages: the path of elements above each text and each block's border (None)."""

    EMPTY = {"br", "hr", "img", "input", "meta"}
    SILENT = {"script", "style", "title", "textarea", "noscript"}

    def __init__(self):
        super().__init__()
        self.path, self.found = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in pages._INLINE:
            self.found.append((None, None))
        if tag not in self.EMPTY:
            given = dict(attrs)
            words = set(re.findall("[a-z]+", " ".join((given.get(k) or "") for k in ("class", "id", "role")).lower()))
            self.path.append((tag, words, "hidden" in given or given.get("aria-hidden") == "true"))

    def handle_endtag(self, tag):
        self.path.pop()
        if tag not in pages._INLINE:
            self.found.append((None, None))

    def handle_data(self, data):
        if not self.SILENT & {tag for tag, *_ in self.path}:
            self.found.append((data, list(self.path)))


def judged(path):
    """What a text below these elements is: article, plain, weak, frame, bar, out, or None (not shown)."""
    inside, kind = False, pages.PLAIN
    for tag, words, hidden in path:
        has = lambda marks, words=words: bool(marks & words)
        if tag in ("html", "body"):
            continue
        if tag in pages._INLINE:
            if hidden or not inside and (has(pages._EXTRA) or has(pages._LAYOUT)):
                return None
        elif tag in ("article", "main"):
            kind = pages.OUT if tag == "article" and (has(pages._EXTRA) or has({"comment", "reply"})) else pages.PLAIN if kind in (pages.WEAK, pages.FRAME) else kind
            inside |= kind < pages.FRAME
        elif kind < pages.OUT:
            out = hidden or has(pages._WITHIN if inside else pages._EXTRA | pages._ASIDE) or tag in ("form", "select", "button")
            if out:
                kind = pages.OUT
            elif tag in ("nav", "footer", "aside") or tag == "header" and not inside:
                kind = pages.BAR
            elif has(pages._LAYOUT) and not (inside and tag == "header"):
                kind = max(kind, pages.FRAME)
            elif has(pages._WEAK) and kind == pages.PLAIN:
                kind = pages.WEAK
    return pages.ARTICLE if inside and kind < pages.FRAME else kind


def plain_lines(page):
    tree = Tree()
    tree.feed(page)
    tree.close()
    out, block, kind = [], "", None

    def end():
        nonlocal block
        if block.split():
            out.append((" ".join(block.split()), kind))
        block = ""

    for data, path in [*tree.found, (None, None)]:
        if data is None:
            end()
        elif (now := judged(path)) is not None:
            if block and now != kind:
                end()
            block, kind = block + data, now
    if any(tag in ("article", "main") and judged(path[: k + 1]) == pages.ARTICLE for _, path in tree.found if path for k, (tag, *_) in enumerate(path)):
        out = [(t, pages.OUT if k in (pages.PLAIN, pages.WEAK) else k) for t, k in out]
    return out


def random_page(rng, depth=0):
    blocks, inline = ["div", "section", "p", "ul", "nav", "aside", "footer", "header", "form", "article", "main", "script", "style"], ["b", "span", "a", "label", "math"]
    marks = ["", "", "", " class='comment'", " class=\"ad top\"", " id='sidebar'", " class='related'", " class='tags'", " hidden", " class='copyright'", " class='post body'"]
    out = []
    for _ in range(rng.randrange(1, 4)):
        out.append(f"w{rng.randrange(99)} &amp; {rng.choice(['x', 'y&#233;', ' '])} ")
        tag, mark = rng.choice(inline), rng.choice(marks)
        out.append(f"<{tag}{mark}>i{rng.randrange(99)}</{tag}>" if rng.random() < 0.5 else rng.choice(["<br>", "", "<!-- no -->"]))
        if depth < 4:
            tag, mark = rng.choice(blocks), rng.choice(marks)
            body = "var a = 1;" if tag in ("script", "style") else f"<b>t{rng.randrange(99)}</b> words" if tag == "p" else random_page(rng, depth + 1)
            out.append(f"<{tag}{mark}>{body}</{tag}>")
    return "".join(out)


def test_lines_are_those_of_a_plain_reader():
    for seed in range(600):
        page = random_page(random.Random(seed))
        assert pages.lines(page) == plain_lines(page), page


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="<>/pdiv&;!- \"'=abr", max_size=60))
def test_any_text_is_read(t):
    pages.lines(t)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14), st.sampled_from([0, 3, 10**6]))
def test_longest_common_subsequence(a, b, matches):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    assert pages._prefix_lengths(a, b).tolist() == n[-1]
    saved, pages.MATCHES = pages.MATCHES, matches
    try:
        got = pages.common(a, b)
    finally:
        pages.MATCHES = saved
    assert len(got) == n[-1][-1] and got == sorted(set(got))
    it = iter(b)
    assert all(a[i] in it for i in got)


def test_long_pages_of_few_different_lines():
    rng = random.Random(1)
    a, b = ([rng.randrange(3) for _ in range(12_000)] for _ in range(2))
    assert len(pages.common(a, b)) == pages._prefix_lengths(a, b)[-1]


def plain_common(a, b):
    """The places in a of a longest common subsequence, by the textbook's table."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_copies(a, b):
    same = plain_common(a, b)
    size = lambda x: len(x.split())
    return 20 * sum(size(a[i]) for i in same) >= 19 * sum(map(size, a)) and 20 * (max(len(a), len(b)) - len(same)) <= max(len(a), len(b))


def brute_pages(data):
    """The query without Spark: every page against the classes next to its own in the order of its host's paths."""
    read = {k: (re.sub(r"^https?://([^/]*).*", r"\1", u or "").lower(), re.sub(r"^https?://[^/]*|[?#].*", "", u or ""), plain_lines(h or "")) for k, (_, u, h) in enumerate(data)}
    key = lambda v: (v[0], tuple(v[2]))
    first = {}
    for v in sorted(read.values(), key=lambda v: v[:2]):
        first.setdefault(key(v), v)
    texts = lambda v: [t for t, _ in v[2]]
    runs = {}
    for v in first.values():
        mine = runs.setdefault(v[0], [])
        if mine and plain_copies(texts(v), texts(mine[-1][-1])):
            mine[-1].append(v)
        else:
            mine.append([v])
    out = []
    for k, (i, *_) in enumerate(data):
        v = first[key(read[k])]
        mine = runs[v[0]] if v[0] else []
        at = next((n for n, r in enumerate(mine) if v in r), 0)
        near = [mine[n][0] for n in (at - 2, at - 1, at + 1, at + 2) if 0 <= n < len(mine)]
        near = [x for x in near if not plain_copies(texts(v), texts(x))]
        votes = [sum(p in plain_common(texts(v), texts(x)) for x in near) for p in range(len(v[2]))]
        gone = {p for p, n in enumerate(votes) if near and n >= (2 if len(near) > 2 else 1)}
        keep = lambda p, kind: kind == pages.ARTICLE or kind < pages.FRAME and p not in gone and (kind == pages.PLAIN or near)
        text = " ".join(t for p, (t, kind) in enumerate(read[k][2]) if keep(p, kind))
        out.append((i, text, len(text), len(v[2]), sum(v[2][p][1] != pages.ARTICLE for p in gone)))
    return sorted(out, key=str)


def extracted(df):
    return sorted(((r.page_id, r.text, r.n_chars, r.n_lines, r.n_shared) for r in pages.extract(df).collect()), key=str)


def test_pages_match_a_plain_version(spark):
    rng = random.Random(6)
    word = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    menus, notices = [f"<nav><ul><li>{word(2)}</li><li>{word(2)}</li></ul></nav>" for _ in range(2)], [word(6) for _ in range(4)]  # no line twice in a page: then there is one longest common subsequence
    data = []
    for k in range(80):
        body = "".join(f"<p>{word(12)}</p>" for _ in range(rng.randrange(1, 6)))
        if k % 3 == 0:
            body = f"<article>{body}<p>{notices[2]}</p></article>"
        tail = f"<div class='{rng.choice(['tags', 'x', 'ad', 'cookie-note'])}'>{rng.choice([notices[0], notices[3]])}</div>"
        data.append((k, f"http://{rng.choice(['a', 'b', 'c'])}.example/{rng.choice('xyz')}/{rng.randrange(40)}-{k}", rng.choice(menus) + body + tail + f"<footer>{notices[1]}</footer>"))
    data += [(200 + k, f"http://a.example/x/{k}", data[4][2]) for k in range(6)] + [(300 + k, f"http://a.example/y/{k}", data[5][2] + f"<p>{k}</p>") for k in range(4)]
    data += [(400, "http://one.example/", menus[0] + "<p>lonely</p><div class='search'>find</div>"), (401, None, menus[0]), (402, "", None), (403, "http://a.example/x/0", data[4][2]), (None, "http://a.example/x/9", data[7][2]), data[0], data[0]]
    data.append((500, "http://a.example/long", "".join(f"<p>{word(9)}</p>" for _ in range(3000))))
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = extracted(df.selectExpr("*", "1 AS same", "2 AS texts", "3 AS host", "4 AS `row`"))
    assert got == brute_pages(data)
    assert sum(r[4] for r in got) > 100


def test_shared_lines_go_where_nothing_marks_the_article(spark):
    page = lambda k, body: (k, f"http://h.example/a/{k}", f"<html><body><div>Welcome to our site</div><p>{body}</p><div>All rights kept by us</div></body></html>")
    data = [page(1, "First story with words of its own that are many"), page(2, "Second story, quite unlike the other one in every way")]
    data += [(3, "http://other.example/x", "<p>Welcome to our site</p>"), (4, None, None), (5, "", ""), (6, "http://h.example/a/6", PAGE), (6, "http://h.example/a/6", PAGE)]
    copy = "<p>The same text on both pages, which is the article</p>"
    data += [(7, "http://c.example/1", copy), (8, "http://c.example/2", copy)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect())
    want = {1: "First story with words of its own that are many", 2: "Second story, quite unlike the other one in every way", 3: "Welcome to our site", 4: "", 5: "", 6: "Title & more One bold two é Three x a b", 7: copy[3:-4], 8: copy[3:-4]}
    assert got == sorted((i, want[i], len(want[i])) for i, *_ in data)
    assert pages.extract(df.limit(0)).collect() == []


def test_runs_of_copies_and_short_articles_lose_their_boilerplate(spark):
    menu = "".join(f"<div>Menu entry number {i} of the site</div>" for i in range(5))
    page = lambda k, body: (k, f"http://h.example/a/{k}", f"<html><body>{menu}<p>{body}</p></body></html>")
    texts = {1: "A short one", 2: "Copied text", 3: "Copied text", 4: "Copied text", 5: "Another short one"}
    df = spark.createDataFrame([page(k, t) for k, t in texts.items()], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == texts
    lines = [f"Line {i} of a long text that is the article" for i in range(40)]
    near = {k: " ".join([*lines, f"Printed {k}"]) for k in (2, 3, 4)}
    data = [page(1, "A short one")] + [page(k, "</p><p>".join([*lines, f"Printed {k}"])) for k in near] + [page(5, "Another one")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {1: "A short one", 5: "Another one"} | near
