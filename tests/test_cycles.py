"""Nodes on cycles against a plain search, and routes that only few rounds can walk."""

from __future__ import annotations

import random

import pytest

from millrace.operators import graph


def brute(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    found = set()
    for n in {x for e in edges for x in e}:
        seen, todo = set(), list(to.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to.get(x, ())
        if n in seen:
            found.add(str(n))
    return found


def found(spark, edges):
    return {r["node"] for r in graph.on_cycles(spark.createDataFrame(edges, "a long, b long")).collect()}


SHAPES = [
    [(1, 2), (2, 3), (3, 4)],
    [(1, 1), (1, 2)],
    [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6)],
    # two loops of one node, a ring of chains between busy nodes, ways out of it and into it
    [(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0), (0, 10), (10, 11), (11, 12), (12, 20), (20, 21), (21, 30), (30, 31), (31, 12), (20, 40), (40, 41), (50, 51), (51, 20), (30, 20)],
]


@pytest.mark.parametrize("edges", SHAPES)
def test_cycles_by_hand(spark, edges):
    assert found(spark, edges) == brute(edges)


def test_cycles_of_random_graphs(spark):
    rng = random.Random(4)
    edges, base = [], 0
    for n, m in ((12, 10), (12, 14), (15, 17), (8, 16), (20, 22), (25, 30)):
        for _ in range(3):
            edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(m)]
            base += n
    assert found(spark, edges) == brute(edges)


def test_long_routes(spark):
    n = 10_000
    line = [(i, i + 1) for i in range(n)]
    ring = [(20_000 + i, 20_000 + (i + 1) % n) for i in range(n)]
    tail = [(40_000 + i, 40_001 + i) for i in range(500)] + [(40_500, 20_007)]
    assert found(spark, line + ring + tail) == {str(20_000 + i) for i in range(n)}
