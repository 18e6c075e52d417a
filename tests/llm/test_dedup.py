import hashlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import minhash, neardup, repeats

from .helpers import documents, empty, rows, words


def brute_components(data, n, percent):
    sets = defaultdict(list)
    for i, t, *_ in data:
        w = [x.encode().lower() for x in words(t)]
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        sets[i].append(s)
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i in sets for s in sets[i]), key=str)


def test_near_duplicates_match_brute_force(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark), 4, 80).collect()]
    want = brute_components(rows(), 4, 80)
    assert sorted(got, key=str) == want
    assert len({c for _, _, c in want}) < len(want) - 10


def test_links_beyond_the_hub_are_found(spark):
    """Sets in a row, each close to the next only: the first of a bucket does not see the last."""
    base = [f"t{i}" for i in range(200)]
    data = [(k, " ".join(base[k * 8 : k * 8 + 120])) for k in range(8)] + [(50 + k, " ".join(base[k * 30 : k * 30 + 60])) for k in range(4)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: c for i, _, c in brute_components(data, 2, 80)}


def test_blocks_of_like_sizes_lose_no_link(spark, monkeypatch):
    """Buckets of many components, in small blocks: sets of all sizes, of which only some are alike."""
    monkeypatch.setattr(neardup, "BLOCK", 300)
    rng = np.random.default_rng(7)
    base = [f"t{i}" for i in range(400)]
    data = [(int(i), " ".join(base[: int(n)])) for i, n in enumerate(rng.permutation(np.arange(60, 400, 4)))]
    data += [(200 + i, " ".join(np.array(base)[np.sort(rng.permutation(400)[:330])])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 1, 80).collect()}
    assert got == {i: c for i, _, c in brute_components(data, 1, 80)}


def block(sets, components=None):
    import pyarrow as pa

    return pa.table({"component": components or list(range(len(sets))), "n": [len(s) for s in sets], "elements": [s.tobytes() for s in sets], "side": [0] * len(sets)})


def test_block_links_join_what_all_pairs_join():
    """A forest: what all links join is joined, with fewer links than components."""
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < keep], rng.integers(0, 2**63, 10).astype(np.uint64)])) for b in base for keep in rng.uniform(0.85, 1, 40)]
    got = {(int(u), int(v)) for u, v in zip(*(neardup._block_links(block(sets), 80)[k].to_pylist() for k in ("u", "v")), strict=True)}
    pairs = [(i, j) for i in range(120) for j in range(i + 1, 120) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def groups(edges):
        of = {i: {i} for i in range(120)}
        for u, v in edges:
            of[u] |= of[v]
            for x in of[u]:
                of[x] = of[u]
        return {frozenset(x) for x in of.values()}

    assert groups(got) == groups(pairs)
    assert len(got) == 120 - len(groups(pairs)) < len(pairs) / 10


def test_a_block_of_600_equal_sets_gives_599_links():
    sets = [np.arange(50, dtype=np.uint64)] * 600
    assert neardup._block_links(block(sets), 80).num_rows == 599
    assert neardup._block_links(block(sets, [7] * 600), 80).num_rows == 0


def test_blocks_are_bounded_in_sets_too(spark, monkeypatch):
    """Many small sets in one bucket: blocks of few sets find the same groups."""
    monkeypatch.setattr(neardup, "SETS", 5)
    rng = np.random.default_rng(11)
    data = [(int(i), " ".join(["a b c d e f g h i j k l m n o p"] + [f"x{rng.integers(4)}" for _ in range(int(rng.integers(0, 6)))])) for i in range(120)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 1, 80).collect()}
    assert got == {i: c for i, _, c in brute_components(data, 1, 80)}


def test_sets_of_the_largest_component_meet_the_rest_only(spark, monkeypatch):
    """A bucket of 400 sets of one component and three others: rows follow its sets, not their square."""
    monkeypatch.setattr(neardup, "SETS", 5)
    members = spark.createDataFrame([(1, i, 100) for i in range(403)], "key long, doc_id long, n long")
    comps = spark.createDataFrame([(i, 0) for i in range(400)], "node long, component long")
    met = neardup._meetings(members, comps, 80).collect()
    assert len(met) == 400 + 3 * 81
    groups = {}
    for r in met:
        groups.setdefault((r.key, r["size"], r.lower, r.larger, r.higher), []).append(r.doc_id)
    pairs = {(a, b) for g in groups.values() for a in g for b in g if a < b and b >= 400}
    assert pairs == {(a, b) for b in range(400, 403) for a in range(b)}


def test_signatures_estimate_similarity_without_bias():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        u = rng.integers(0, 2**63, 500).astype(np.uint64)
        errors.append((minhash.signature(u[:450], 130) == minhash.signature(u[50:], 130)).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_signature_of_parts_and_of_few_elements(monkeypatch):
    e = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    whole = minhash.signature(e, 130)
    monkeypatch.setattr(minhash, "_PART", 64)
    assert (minhash.signature(e, 130) == whole).all()
    one = minhash.signature(e[:1], 130)
    assert sorted(int(x) >> 32 for x in one) == list(range(130))


def test_keep_first_has_the_columns_of_docs(spark):
    docs = documents(spark).withColumnRenamed("lang", "component")
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute_components(rows(), 5, 80) if i == c}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("run", [lambda d: neardup.near_duplicates(d), lambda d: repeats.digest(d), lambda d: repeats.remove(d)])
def test_empty_table(spark, run):
    assert run(empty(spark)).collect() == []


def brute_repeats(data, length):
    least = {}
    for i, t, *_ in data:
        w = words(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t, *_ in data:
        w = words(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and least[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 20])
def test_repeats_match_brute_force(spark, length):
    got = [tuple(r) for r in repeats.digest(documents(spark), length).collect()]
    want = brute_repeats(rows(), length)
    assert sorted(got, key=str) == want
    assert sum(r[2] > 0 for r in want) > 10


def test_remove_keeps_unchanged_texts_and_gives_maximal_spans(spark):
    shared = " ".join(f"p{i}" for i in range(80))
    docs = spark.createDataFrame([(1, "a\n" + shared + " b", 1), (2, "c  " + shared + "\nd", 2), (3, "x\n\ny", 3)], "doc_id long, text string, anchor int")
    got = {r.doc_id: r for r in repeats.remove(docs).collect()}
    assert got[1]._kept == "a\n" + shared + " b" and got[3]._kept == "x\n\ny"
    assert got[2]._kept == "c d" and got[2]._spans == [[1, 81]] and got[2].anchor == 2


def test_windows_shared_with_different_documents(spark):
    """One document's passages come from two smaller ones that share an anchor but not their surroundings."""
    t = [f"q{i}" for i in range(200)]
    data = [(1, " ".join(t[:80])), (2, " ".join(["n"] * 3 + t[20:120])), (3, " ".join(t[10:115])), (4, " ".join(t[60:110]))]
    got = sorted(tuple(r) for r in repeats.digest(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == brute_repeats(data, 50)


def test_many_kinds_of_one_anchor(spark, monkeypatch):
    """A passage in many surroundings, dealt to several groups; some of them share more than the passage."""
    monkeypatch.setattr(repeats, "GROUP", 4)
    t = [f"q{i}" for i in range(90)]
    tails = [[f"tail{k}x{i}" for i in range(40)] for k in range(3)]
    data = [(i, " ".join([f"a{i}x{k}" for k in range(i % 40)] + t[i % 30 :] + (tails[i % 3][: 5 + i % 35] if i % 4 else []) + [f"z{i}"])) for i in range(60)]
    data += [(100 + i, " ".join(t[20:60] + ["cut"] + t[61:])) for i in range(5)] + [(7, data[8][1]), (0, data[0][1] + " " + data[0][1])]
    got = sorted((tuple(r) for r in repeats.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str)
    assert got == brute_repeats(data, 50)


def test_clashing_names_are_refused_or_avoided(spark):
    docs = documents(spark).withColumnRenamed("lang", "_kept").withColumnRenamed("n_chars", "_quarry_gone")
    with pytest.raises(ValueError):
        repeats.remove(docs)
    assert repeats.remove(docs, prefix="r_").columns == [*docs.columns, "r_n_words", "r_n_removed", "r_spans", "r_kept"]
    assert neardup.keep_first(docs).columns == docs.columns
    assert sorted(map(str, repeats.digest(docs).collect())) == sorted(map(str, repeats.digest(documents(spark)).collect()))
