import hashlib
import importlib.util
from collections import Counter

import numpy as np
import pytest

from quarry.llm import queries

from .helpers import documents, empty, rows, words
from .test_dedup import brute_components, brute_repeats
from .test_rules_mix_shards import brute_measures, plain_mix
from .test_search_text_models import library

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)
import corpus_pipeline


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_match_plain_versions(spark, tmp_path):
    docs = documents(spark, n=150)
    columns = docs.columns
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before = as_rows(state)
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, state, "").write.parquet(path)
        state = spark.read.parquet(path)
        after = as_rows(state)
        if name != "sentencepiece":
            assert state.columns == columns
        if name == "quality rules":
            def good(t):
                m = brute_measures(t)
                return m[0] >= 50 and 100 * m[4] <= 50 * m[0]
            assert Counter(after) == Counter(r for r in before if good(r[1]))
        elif name == "near-duplicates":
            kept = {i for i, _, c in brute_components(before, 5, 80) if i == c}
            assert Counter(after) == Counter(r for r in before if r[0] is None or r[0] in kept)
        elif name == "substring duplicates":
            want = {(i, sha) for i, _, _, sha in brute_repeats(before, 50)}
            assert {(r[0], hashlib.sha256(" ".join(words(r[1])).encode()).hexdigest()) for r in after} == want
            assert sum(len(words(r[1])) for r in after) < sum(len(words(r[1])) for r in before)
        elif name == "mixing":
            taken = Counter()
            for r in after:
                taken[-1 if r[0] is None else r[0]] += len(words(r[1]))
            once = {r[0]: r for r in before if r[0] != 5}
            if len(once) == len(before):  # the plain version knows no repeated ids
                assert taken == +plain_mix(before)
            assert set(after) <= set(before)
        else:
            want = []
            for r in before:
                ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
                want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
            assert Counter(after) == Counter(want)
        assert after


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 13)}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def plain_run(data):
    """The pipeline without Spark, for documents with distinct ids."""
    data = [r for r in data if (m := brute_measures(r[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    kept = {i for i, _, c in brute_components(data, 5, 80) if i == c}
    data = [r for r in data if r[0] in kept]
    least, cut = {}, []
    for i, t, *_ in data:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            least[key] = min(least.get(key, i), i)
    for i, t, *rest in data:
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < i for j in range(50)}
        cut.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t, *rest))
    taken, out = plain_mix(cut), Counter()
    for i, t, *_ in cut:
        if n := len(words(t)):
            ids = library.encode(t, add_bos=True, add_eos=True)
            out[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += taken[i] // n
    return +out


def test_run_matches_a_plain_version(spark, tmp_path):
    data = [r for r in rows(n=150) if r[0] is not None and r[0] != 5]
    docs = spark.createDataFrame(data, documents(spark).schema)
    docs.selectExpr("*", "1 AS kept", "2 AS _kept", "3 AS _quarry_copies").write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(as_rows(corpus_pipeline.run(spark, str(tmp_path)))) == plain_run(data)


def test_run_of_an_empty_table(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
