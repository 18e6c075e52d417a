import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import licenses, mixing, quality, shards
from quarry.llm.shards import Segment

from .helpers import DOCS, documents, empty, rows, words


def brute_measures(t):
    w, t = words(t), t or ""
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality_matches_brute_force(spark):
    got = [tuple(r) for r in quality.judge(documents(spark)).select("doc_id", *quality.MEASURES, "base_failed").collect()]
    want = []
    for i, t, *_ in rows():
        m = brute_measures(t)
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hosts_with_mostly_failures_are_rejected_and_small_ones_shrunk(spark):
    good, bad = " ".join(f"g{i}" for i in range(60)), "too short"
    data = [(i, good, None, "clean", 1) for i in range(300)] + [(1000 + i, bad, None, "junk", 1) for i in range(300)] + [(2000, good, None, "junk", 1), (2001, bad, None, "tiny", 1), (2002, good, None, "tiny", 1)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, DOCS)).collect()}
    assert got[0].kept and not got[1000].kept
    assert not got[2000].kept and got[2000].host_rejected and not got[2000].base_failed
    assert got[2002].kept and 0 < got[2002].host_rate < 0.6
    kept = quality.keep_good(spark.createDataFrame(data, DOCS))
    assert kept.columns == DOCS.names
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("rule, body", [("symbols", "#$%& " + " ".join(f"word{i}" for i in range(60)) + " ****" * 20), ("lines", "the same line again\n" * 9 + " ".join(f"word{i}" for i in range(60))), ("length", " ".join(f"averylongtoken{i:04d}" for i in range(60)))])
def test_hosts_fall_by_each_rule(spark, rule, body):
    good = " ".join(f"word{i}" for i in range(60))
    data = [(i, good, None, f"clean{i % 3}", 1) for i in range(300)] + [(1000 + i, f"{body} n{i}", None, "bad", 1) for i in range(100)] + [(2000, good, None, "bad", 1), (2001, body, None, "clean0", 1), (2002, body, None, None, 1)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, DOCS)).collect()}
    assert got[0].kept and got[2001].kept  # one document says little of its host
    assert not got[1000].kept and not got[2000].kept and got[2000].host_rejected and not got[1000].base_failed
    assert got[1000].host_rate == got[1000][f"host_rate_{rule}"] > 0.5 > got[0].host_rate
    assert 0 < got[2002][f"host_rate_{rule}"] < 1  # a host of one document is shrunk
    kept = quality.keep_good(spark.createDataFrame(data, DOCS)).collect()
    assert {r.doc_id for r in kept} == {i for i, r in got.items() if r.kept}


def test_clashing_names_are_refused_or_avoided(spark):
    docs = documents(spark).withColumnRenamed("lang", "n_words")
    with pytest.raises(ValueError):
        quality.with_measures(docs)
    assert quality.keep_good(docs).columns == docs.columns


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in sizes)
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [n for n in names if n not in full]
        level = (total - sum(full.values())) / sum(w[n] for n in rest) if rest else 0
        over = [n for n in rest if level * w[n] > cap * sizes[n] + 1e-9]
        if not over:
            return full | {n: level * w[n] for n in rest}
        full |= {n: cap * sizes[n] for n in over}


def test_mix_meets_targets(spark):
    data = rows(n=240)
    got = mixing.mix(documents(spark, n=240)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, len(words(t))) for i, t, *_ in data if i is not None)
    want = brute_targets(sizes)
    biggest = max(r.size for r in got)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest / 2 + 1
    again = mixing.mix(documents(spark, n=240).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_sample_repeats_rows_as_the_mix_says(spark):
    docs = documents(spark).withColumnRenamed("lang", "copies")
    mixed, sampled = mixing.mix(docs), mixing.sample(docs)
    assert sampled.columns == docs.columns
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in sampled.collect()) == +want


def plain_mix(data, seed=17, weights=(3, 1, 2), share=1.5, cap=2, weigh=None):
    """The mix of distinct documents, by sorting each source."""
    by = defaultdict(list)
    for i, t, _, s, *_ in data:
        t = t or ""
        w = weigh(t) if weigh else 1 / (1 + 20 * sum(c in "#*$%&|<>" for c in t) / max(len(t), 1))
        u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[s].append((math.floor(-math.log(u) / w * 2**44), -1 if i is None else i, len(words(t))))
    target = brute_targets({s: sum(x[2] for x in v) for s, v in by.items()}, weights, share, cap)
    out = Counter()
    for s, docs in by.items():
        size = sum(x[2] for x in docs)
        epochs = int(target[s] // size) if size else 0
        left, begun = target[s] - epochs * size, 0
        for _, i, n in sorted(docs):
            out[i] += n * (epochs + (begun + n / 2 <= left))
            begun += n
    return out


def test_mix_matches_a_plain_version(spark, monkeypatch):
    data = [r for k, r in enumerate(rows(n=300)) if r[0] != 5 or k == 5]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    want = plain_mix(data)
    for edge in (mixing.EDGE, 20, 0):  # ranges divided once, twice, as far as it goes
        monkeypatch.setattr(mixing, "EDGE", edge)
        got = Counter()
        for r in mixing.mix(df).collect():
            got[-1 if r.doc_id is None else r.doc_id] += r.taken
        assert +got == +want


def test_quality_of_documents_can_be_given(spark):
    data = [(i, "a b c " * 5 + ("#" * 9 if i % 2 else ""), None, "s", 1) for i in range(2000)]
    df = spark.createDataFrame(data, DOCS)
    flat = mixing.mix(df, share=0.5, quality=F.lit(1.0)).collect()
    assert +Counter({r.doc_id: r.taken for r in flat}) == +plain_mix(data, share=0.5, weigh=lambda t: 1)
    tilted = mixing.mix(df, share=0.5, quality=F.when(F.col("doc_id") < 1000, 1.0)).collect()
    assert sum(r.copies for r in tilted if r.doc_id >= 1000) < 20


def test_epochs_come_before_the_fraction(spark):
    data = [(i, " ".join(["w"] * 10), None, s, 1) for s, a, b in (("a", 0, 100), ("b", 100, 900)) for i in range(a, b)]
    got = mixing.mix(spark.createDataFrame(data, DOCS), weights=(1, 3), share=1.4).collect()
    for s in "ab":
        copies = {r.copies for r in got if r.source == s}
        assert max(copies) - min(copies) <= 1


def test_one_source_and_all_full(spark):
    data = [(i, "a b c", None, "x", 1) for i in range(5)]
    got = mixing.mix(spark.createDataFrame(data, DOCS), share=2.0).collect()
    assert {(r.target, r.taken) for r in got} == {(30.0, 6)}
    assert sum(r.taken for r in mixing.mix(spark.createDataFrame(data, DOCS), share=1.0).collect()) == 15


def check_plan(p, sizes, k):
    order = sorted(sizes)
    parts = defaultdict(int)
    for h in order:
        parts["own", h] += sizes[h] if h in p.own else 0
        if h not in p.own:
            parts[sum(h >= c for c in p.cuts)] += sizes[h]
    rest = [sizes[h] for h in order if h not in p.own]
    left = k - len(p.own)
    assert sum(1 for x in parts.items() if x[1]) <= k
    if rest:
        def fits(c):
            n, at = 1, 0
            for x in rest:
                if x > c:
                    return False
                if at + x > c:
                    n, at = n + 1, 0
                at += x
            return n <= left
        least = next(c for c in range(max(-(-sum(rest) // left), max(rest)), sum(rest) + 1) if fits(c))
        assert p.capacity == least
        assert max(v for key, v in parts.items() if not isinstance(key, tuple)) <= least


@settings(deadline=None, max_examples=120)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(2, 8), st.integers(0, 3))
def test_smallest_capacity(sizes, k, giants):
    sizes = sizes + [500 + i for i in range(giants)]
    by = {(i * 2654435761) % (1 << 62) - (1 << 61): s for i, s in enumerate(sizes)}

    class Rows:
        """Answers range sums as the table would."""

        def sums(self, shift, prefixes=None):
            groups = defaultdict(list)
            for h, s in by.items():
                groups[h >> shift].append((h, s))
            return sorted(Segment(min(h for h, _ in g), max(h for h, _ in g), sum(s for _, s in g), shift) for g in groups.values())

    saved = shards._sums, shards._refine
    try:
        shards._sums = lambda rows, shift: rows.sums(60)

        def refine(rows, segments, wanted):
            out = [s for i, s in enumerate(segments) if i not in wanted]
            for i in wanted:
                s = segments[i]
                out += [x for x in rows.sums(max(0, s.shift - 4)) if x.low >> s.shift == s.low >> s.shift]
            return sorted(out)

        shards._refine = refine
        check_plan(shards.plan(Rows(), k), by, k)
    finally:
        shards._sums, shards._refine = saved


def test_shards(spark):
    data = rows(n=200)
    got = shards.assign(documents(spark, n=200), 16).collect()
    assert len(got) == len(data)
    text = defaultdict(list)
    for i, t, *_ in data:
        text[i].append(t or "")
    places, slots, size = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        assert any(r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) for t in text[r.doc_id])
        places[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(len(p) == 1 for p in places.values()) and set(slots) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_nearly_equal(spark):
    data = [(i, f"{i:06d}" + "x" * (50 + i * 37 % 100), None, None, 1) for i in range(4000)] + [(9000 + i, "hot" * 20, None, None, 1) for i in range(3000)]
    size = Counter()
    for r in shards.assign(spark.createDataFrame(data, DOCS), 16).collect():
        size[r.shard] += r.size
    rest = sorted(size.values())[:-1]
    assert len(size) == 16 and max(size.values()) == 3000 * 61 and rest[-1] - rest[0] < 0.02 * rest[0] + 2000


@pytest.mark.parametrize("run", [quality.judge, quality.keep_good, mixing.mix, mixing.sample, shards.assign, lambda d: licenses.scan(d, d["source"])])
def test_empty_table(spark, run):
    assert run(empty(spark)).collect() == []


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    files = spark.createDataFrame(
        [
            (1, "p/LICENSE", "MIT License\n\n" + mit),
            (2, "p/src/a.py", "import os\nprint(1)"),
            (3, "p/src/deep/LICENSE.txt", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
            (4, "p/src/deep/er/b.py", "x = 1"),
            (5, "p/src/deep/c.py", "# Licensed under the Apache License, Version 2.0.\ny = 2\n" + "code here\n" * 50),
            (6, "q/d.py", "a driving licence is needed to drive a car on the road in most countries"),
            (7, None, None),
            (8, "p/src/e.py", ""),
            (9, "p/src/f.py", "many words\n" * 5000 + "SPDX-License-Identifier: Apache-2.0"),
        ],
        "doc_id long, path string, text string",
    )
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.scan(files, files["path"]).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "p/LICENSE"), 3: ("GPL-3.0", None), 4: ("GPL-3.0", "p/src/deep/LICENSE.txt"), 5: ("Apache-2.0", None), 6: (None, None), 7: (None, None), 8: ("MIT", "p/LICENSE"), 9: ("Apache-2.0", None)}


def test_without_a_licence_file_no_directory_is_searched(spark):
    rows = [(1, "p/a.py", "SPDX-License-Identifier: MIT"), (2, "p/b.py", "x = 1"), (3, None, None), (4, "p/LICENSE", "nothing stated")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = licenses.scan(files, files["path"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "p/a.py", "MIT", 1.0, None), (2, "p/b.py", None, None, None), (3, None, None, None, None), (4, "p/LICENSE", None, None, None)]
    assert found.dtypes == [("doc_id", "bigint"), ("path", "string"), ("license", "string"), ("score", "double"), ("inherited_from", "string")]


def test_many_directories_inherit_from_one(spark):
    rows = [(0, "LICENSE", "SPDX-License-Identifier: Apache-2.0"), (1, "d7/LICENSE", "SPDX-License-Identifier: MIT")]
    rows += [(10 + k, f"d{k % 100}/e{k % 3}/f{k}.py", None) for k in range(600)] + [(2, "/abs/x.py", ""), (3, "x.py", "")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.scan(files, files["path"]).collect()}
    root = ("Apache-2.0", "LICENSE")
    assert got == {0: ("Apache-2.0", None), 1: ("MIT", None), 2: root, 3: root} | {10 + k: ("MIT", "d7/LICENSE") if k % 100 == 7 else root for k in range(600)}


def test_licences_in_wrapped_headers_and_in_mid_line(spark):
    mit = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a\n * copy of this software and associated documentation files (the \"Software\"),\n * to deal in the Software without restriction, including without limitation\n */\n"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n"
    isc = "// Permission to use, copy, modify, and/or distribute this software for any\n// purpose with or without fee is hereby\n// granted, provided that the above\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"
    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n"
    agpl, gpl3 = gpl.replace("General", "Affero General").replace("version 2", "version 3"), gpl.replace("version 2", "version 3")
    code = "value = other + 1\n" * 60
    prose = "the river ran slowly past the old mill and then turned east "
    texts = {"MIT": mit, "BSD-3-Clause": bsd, "ISC": isc, "MPL-2.0": mpl, "GPL-2.0": gpl, "GPL-3.0": gpl3, "AGPL-3.0": agpl}
    data = [(n, t + code) for n, t in texts.items()]
    data += [("MIT", prose * 3 + "Released under the MIT License. " + prose * 3), ("Apache-2.0", prose + "Licensed under the Apache License, Version 2.0. " + prose * 9)]
    data += [(None, prose + "it was released under the license that " + prose), (None, prose + "a GNU General Public License, version " + prose), (None, prose * 400), (None, "the licence")]
    files = spark.createDataFrame([(i, f"d{i}/x", t) for i, (_, t) in enumerate(data)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in licenses.scan(files, files["path"]).collect()}
    assert got == {i: n for i, (n, _) in enumerate(data)}
