import random

import pytest

from stratalode.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b:
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for e in edges for v in e if e[0] != e[1]}


@pytest.mark.parametrize("seed", [0, 1])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(200, 201)] * 3 + [(300, 300 + i) for i in range(1, 20)]
    got = components(spark, spark.createDataFrame(edges, "a long, b long"))
    assert {r["v"]: r["r"] for r in got.collect()} == brute(edges)


def test_no_edges(spark):
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
