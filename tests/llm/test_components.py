import random

import pytest

from spanwright.llm.components import connected


def brute(edges):
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none", "loops"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(0, i) for i in range(1, 500)] + [(499, 1000)],
        "random": [(rng.randint(-50, 400), rng.randint(-50, 400)) for _ in range(220)],
        "none": [],
        "loops": [(5, 5), (5, 6), (6, 5), (5, 6)],
    }[kind]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.node: r.component for r in connected(frame).collect()}
    want = brute(edges)
    assert {k: v for k, v in want.items() if k in got or v != k} == got
