import math
import random

import numpy as np
from nichegrid.llm import topk


def brute(rows, k):
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in fine:
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(500)]
    rows += [(i, [0.5] * 8) for i in range(500, 520)]  # ties
    rows += [(600, None), (601, [1.0, None] + [0.0] * 6), (602, [float("nan")] * 8), (700, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for blocks in ({}, {"block_rows": 64, "query_block": 2}):
        got = {tuple(r) for r in topk.search(df, **blocks).select("query_id", "rank", "vec_id", "score").collect()}
        assert got == brute(rows, 10)


def test_bounds_keep_every_candidate():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 12))
    x = np.floor(1024 * (centers[rng.integers(0, 5, 800)] + 0.05 * rng.normal(size=(800, 12))))
    q = x[:20]
    lists = topk.Lists.of(x.astype(np.int64))
    lists.prepare()
    for scores, (some, share) in zip(q @ x.T, (topk.nra(v, lists, 10) for v in q)):
        assert len(some) <= 200 and share < 1  # rows of other centers are told by their bounds
        assert set(np.flatnonzero(scores >= np.sort(scores)[-10])) <= set(some.tolist())


def test_edge_cases(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0]), (2, [])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.search(df).orderBy("rank").collect()]
    assert got == [(1, 1, 1024 * 1024), (2, 2, 0)]
    assert topk.search(df.limit(0)).collect() == []
    clash = df.selectExpr("*", "1 as id", "2 as v", "3 as cb", "4 as qb", "5 as score")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in topk.search(clash).orderBy("rank").collect()] == got
    huge = spark.createDataFrame([(0, [2e9, 1.0]), (1, [2e9, 3.0]), (2, [2e9, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"]) for r in topk.search(huge, scale=1).orderBy("rank").collect()] == [1, 2]
    big = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 3.0]), (2, [1e9, 2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.search(big.selectExpr("vec_id", "transform(embedding, x -> x / 1e6) as embedding")).orderBy("rank").collect()] == [1, 2]
