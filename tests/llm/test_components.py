import random

import numpy as np
import pytest

from quarry.llm import components as module
from quarry.llm.components import components, least


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_least_joins_long_chains():
    order = np.random.default_rng(2).permutation(5000)
    nodes, root = least(order[:-1], order[1:])
    assert len(nodes) == 5000 and (root == 0).all()


@pytest.mark.parametrize("task", [1 << 20, 20])
def test_components(spark, monkeypatch, task):
    """In one task, and by star steps where a task may hold few edges."""
    monkeypatch.setattr(module, "TASK", task)
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(100, 164)]
    rng.shuffle(chain)
    star = [(500, 500 + i) for i in range(1, 40)]
    edges = chain + star + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (3, 2), (2, 3), (3, 2)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == brute(edges)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
