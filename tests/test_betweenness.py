"""Betweenness in batches with folded leaves against plain counting."""

import random
from collections import deque

import pytest

from citeweave.operators import graph


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = dict.fromkeys(near, 0.0)
    for s in near:
        order, paths, far, before = [], {s: 1}, {s: 0}, {s: []}
        line = deque([s])
        while line:
            v = line.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w], paths[w], before[w] = far[v] + 1, 0, []
                    line.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    return {v: x / 2 for v, x in score.items()}


@pytest.mark.parametrize("batch", [3, 4096])
def test_betweenness_equals_plain_counting(spark, batch):
    rng = random.Random(batch)
    edges = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(15)}  # a knot with trees at it
    edges |= {(0, 20 + k) for k in range(6)} | {(20, 30), (30, 31), (40, 41), (50, 51), (51, 52), (50, 52)}
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    got = {r["node"]: round(r["betweenness"], 6) for r in graph.betweenness(df, normalised=False, batch=batch).collect()}
    assert got == {v: round(x, 6) for v, x in plain(edges).items()}


def test_no_edges(spark):
    assert graph.betweenness(spark.createDataFrame([], "u long, v long")).collect() == []
