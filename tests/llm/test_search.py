"""Exact top-k search and connected components against brute force."""

import random

import numpy as np
import pytest

from placetime.llm import topk
from placetime.llm.components import components
from placetime.llm.tables import Tables

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def brute(rows, queries, k):
    usable = []
    for i, x, *_ in rows:
        if i is not None and x and all(c is not None and np.isfinite(np.float32(c)) for c in x):
            usable.append((i, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    out = set()
    for q, v in usable:
        if q in queries:
            best = {}
            for i, w in usable:
                if i != q:
                    score = sum(a * b for a, b in zip(v, w))
                    best[i] = max(score, best.get(i, score))
            for rank, (i, score) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out.add((q, rank, i, score))
    return out


def rows_of(rng, n, width):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, list(rows[3][1])) for i in range(40)]  # many copies: ties go by id
    rows += [(900, None), (901, []), (902, [None] * width), (903, [float("nan")] * width), (904, [float("inf")] * width), (None, rows[0][1])]
    rows += [(905, [0.5, 0.5]), (906, [0.0] * width), (907, [-3.0] * width)]
    return [(*row, 1, 2, "x") for row in rows]


@pytest.mark.parametrize("block, queries", [(4096, 512), (16, 7)])
def test_top_k_against_brute_force(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rows = rows_of(random.Random(block), 120, 8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in topk.top_k(df, df.filter("vec_id % 10 = 0 or vec_id > 900"), 5).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, {i for i, *_ in rows if i is not None and (i % 10 == 0 or i > 900)}, 5)


def test_few_or_no_vectors(spark):
    rows = [(0, [1.0, 2.0], 0, 0, ""), (50, [1.0, -2.0], 0, 0, ""), (51, [1.0, 2.0], 0, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()}
    assert got == brute(rows, {0, 50}, 5) and len(got) == 4
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    edges += [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
            parent.setdefault(low, low)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, Tables(spark, "t")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(df.limit(0), Tables(spark, "t")).count() == 0
