"""Benchmark decontamination and prefix tries against plain versions."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from quarry.llm import contamination, tries

from .helpers import DOCS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = ["doc_id2", "s1", "s2", "fp", "start", "size", "h1", "h2", "n_words", "n_hit", "spans", "items", "item_id", "j", "a", "b", "before", "depth", "name", "place", "digest", "points", "seq", "part", "last", "h", "first"]


def clashing(df):
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH) if c not in df.columns))


def lower(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_scan(docs, items, length=10):
    windows = {}
    for item, t in items:
        ws = lower(t)
        for i in range(len(ws) - min(len(ws), length) + 1 if ws else 0):
            windows.setdefault(tuple(ws[i : i + length]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, t in docs:
        ws, hit, found = lower(t), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                w = tuple(ws[i : i + n])
                if w in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((doc, len(ws), len(hit), spans, sorted(map(str, found - {None})), bool(hit)))
    return sorted(out, key=str)


def texts(rng):
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    passages = [prose(n) for n in (10, 11, 14, 30, 60)]
    items = [(k, prose(8) + "? " + p.upper() + ". " + prose(7)) for k, p in enumerate(passages)]
    items += [(20 + k, passages[4]) for k in range(5)] + [(100, "Only Four Words Here"), (101, "single"), (102, ""), (103, None), (104, "... !"), (None, passages[0]), (5, passages[1]), (5, passages[1])]
    items += [(106, prose(9)), (107, "naïve 中文 w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    docs = [(k, prose(rng.randrange(40)) + " " + rng.choice(passages) + "\n" + prose(rng.randrange(40))) for k in range(40)]
    docs += [(200 + k, passages[4][5 * k :]) for k in range(6)]
    docs += [(300, None), (301, ""), (302, "-- !"), (303, "single"), (304, "x only, FOUR words-here single single"), (None, passages[2]), (7, passages[3]), (7, passages[3]), (305, "Naïve 中文 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (306, "naïve\x00中文;w1 w2 w3 w4 w5 w6 w7 w8")]
    docs += [(307, items[-2][1]), (308, " ".join(items[-2][1].split()[:8])), (309, (prose(3000) + " " + passages[0] + " ") * 15)]
    return docs, items


def got_scan(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, [[s.start, s.end] for s in r.spans], list(r["items"]), r.contaminated) for r in df.collect()), key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).repartition(3)
    return d, spark.createDataFrame(items, "item_id long, text string").repartition(2)


def test_scan_finds_what_a_plain_search_finds(spark):
    docs, items = texts(random.Random(3))
    d, b = frames(spark, docs, items)
    want = plain_scan(docs, items)
    assert got_scan(contamination.scan(d, b)) == want
    assert got_scan(contamination.scan(clashing(d), clashing(b))) == want
    assert got_scan(contamination.scan(d, b, length=12)) == plain_scan(docs, items, 12)


def test_scan_of_empty_tables(spark):
    docs, items = texts(random.Random(4))
    d, b = frames(spark, docs, items)
    assert contamination.scan(d.limit(0), b).collect() == []
    assert got_scan(contamination.scan(d, b.limit(0))) == plain_scan(docs, [])
    row = contamination.digest(d.where("doc_id = 300"), b).head()
    assert (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated) == (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_scan_of_one_passage_in_most_documents_and_items(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(15))
    docs = [(k, f"d{k} " * 3 + passage + f" e{k}") for k in range(3000)]
    items = [(k, f"i{k} " + passage + f" j{rng.randrange(9)}") for k in range(300)]
    got = got_scan(contamination.scan(*frames(spark, docs, items)))
    assert len(got) == 3000 and all(r[2:] == (15, [[3, 18]], sorted(map(str, range(300))), True) for r in got)


def test_parts_of_a_long_text(spark, monkeypatch):
    """Windows that lie over the border of two parts are found, too."""
    docs, items = texts(random.Random(6))
    monkeypatch.setattr(contamination, "_PART", 7)
    for size in (3, 10):
        import numpy as np

        h = np.arange(50, dtype=np.uint64)
        end = np.repeat([20, 50], [20, 30])
        f = contamination._windows if size == 10 else contamination._short
        found = [f(h, end, size, lo, min(lo + 7, 50)) for lo in range(0, 50, 7)]
        whole = f(h, end, size, 0, 50)
        assert [x for s, _ in found for x in s] == whole[0].tolist() and [x for _, p in found for x in p] == whole[1].tolist()


def plain_trie(convs):
    """convs: {id: [(role, text), ...]}"""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    rows = []
    for p, members in nodes.items():
        children = lambda x: sum(len(q) == len(x) + 1 for q in below[x])
        ends = sorted(c for c in members if len(convs[c]) == len(p))
        rows.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children(p), sum(not children(q) for q in below[p]), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below[p] if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def gathered(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    return own


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h, first = zlib.crc32(str(c).encode()) % 6, c - c % 100 if c >= 0 else c + (-c) % 100
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def conversations(seed=1, n=150):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -5, -100, 10**12, 10**12 + 3, 10**12 + 250]:
        same = rng.random() < 0.35
        for t in range(3 if same else rng.choice([1, 2, 2, 3, 5, 9, 17])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {t}" if same else f"{rng.randrange(2)}é😀"))
    rows += [(3, None, None, None), (3, None, "user", "b"), (3, 0, "user", "b"), (3, 0, "user", "b"), (None, 0, "user", "lost"), (4, 2, "", "long " * 30_000), (104, 2, "", "long " * 30_000), (700, 0, None, ""), (701, 0, "", None)]
    return rows


def got_trie(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_trie_is_the_plain_one(spark):
    rows = conversations()
    df = turns(spark, rows)
    own = gathered(rows)
    assert got_trie(tries.trie(df)) == plain_trie(own)
    assert got_trie(tries.digest(df)) == plain_trie(plain_rebuilt(own))
    assert got_trie(tries.digest(clashing(df))) == plain_trie(plain_rebuilt(own))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert tries.trie(turns(spark, []).limit(0)).collect() == []
    assert tries.digest(turns(spark, [(None, 1, "user", "x")])).collect() == []
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert got_trie(tries.digest(turns(spark, [(alone, 0, "user", "x")]))) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_trie_of_one_long_and_of_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 16)
    rows = [(0, t, "user", f"{t % 3}") for t in range(300)] + [(c, t, "user", f"{t % 3}") for c in range(1, 400) for t in range(2)]
    assert got_trie(tries.trie(turns(spark, rows))) == plain_trie(gathered(rows))


def test_names_are_dense(spark):
    df = spark.createDataFrame([(k, k % 37) for k in range(500)], "conv_id long, digest long").repartition(5)
    named = tries._named(df, ["digest"], "test").select("digest", "name").distinct().collect()
    assert sorted(r.name for r in named) == list(range(37))
