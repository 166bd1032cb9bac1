import numpy as np
import pytest

from nichegrid.operators import eigen, vectors


def path_graph(spark, parts):
    """A weighted path with chords for each part, as (a, b, weight)."""
    rng = np.random.default_rng(1)
    edges, at = {}, 0
    for n in parts:
        for i in range(n):
            for j in (i + 1, (7 * i + 3) % n):
                if j < n and i != j:
                    edges[at + min(i, j), at + max(i, j)] = float(rng.random() + 0.2)
        at += n
    rows = [(a, b, w) for (a, b), w in edges.items()]
    return spark.createDataFrame(rows, "a long, b long, weight double"), rows


def dense(edges, n):
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    d = w.sum(1)
    return w / np.sqrt(d[:, None] * d[None])


@pytest.mark.parametrize("k", [1, 3])
def test_leading_equals_numpy(spark, k):
    graph, edges = path_graph(spark, [40])
    cells = eigen.normalised(graph)
    start = spark.createDataFrame([(i, [1.0, float(i), float((i * 7919) % 31), float((i * 104729) % 17)]) for i in range(40)], "node long, q array<double>")
    values, q = eigen.leading(cells, start, k, 1e-8)
    a = dense(edges, 40)
    own, basis = np.linalg.eigh(a)
    assert np.allclose(values, own[::-1][:k], atol=1e-9)
    got = np.array([r["q"] for r in q.orderBy("node").collect()])
    want = basis[:, ::-1][:, :k]
    want = want * np.sign(want[np.abs(want).argmax(0), np.arange(k)])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6) and np.allclose(a @ got, got * np.array(values), atol=1e-7)


def test_eigenmap_dense_and_iterative(spark):
    graph, _ = path_graph(spark, [60, 25])
    rows = spark.createDataFrame([(i, [float(i), float(i % 5)]) for i in range(86)], "id long, vector array<double>")
    one = {r["node"]: r for r in eigen.eigenmap(graph, rows).collect()}
    two = {r["node"]: r for r in eigen.eigenmap(graph, rows, dense=30, tolerance=1e-8, rounds=100).collect()}
    assert set(one) == set(two) == set(range(86)) and one[85]["component"] == 85 and one[85]["q"] == [0.0, 0.0]
    for i in range(86):
        assert one[i]["component"] == two[i]["component"]
        assert np.allclose(np.abs(one[i]["q"]), np.abs(two[i]["q"]), atol=1e-6)


def test_components_are_placed_apart(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0.0, 0.0, 0.0], [50.0, 0.0, 5.0], [0.0, 60.0, -5.0]])
    x = np.concatenate([c + rng.normal(size=(70, 3)) for c in centres])
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    graph = vectors.fuzzy_graph(vectors.nearest(rows, 6))
    for options in ({}, {"dense": 40}):
        got = {r["node"]: r["p"] for r in eigen.spectral_start(graph, rows, **options).collect()}
        p = np.array([got[i] for i in range(210)])
        assert p.min() >= -1e-3 and p.max() <= 10 + 1e-3 and np.ptp(p, axis=0).min() > 9.9
        d = np.linalg.norm(p[:, None] - p[None], axis=2)
        part = np.arange(210) // 70
        apart = min(d[part == a][:, part == b].min() for a in range(3) for b in range(a))
        assert apart > 0 and all(np.ptp(p[part == a], axis=0).max() > 1 for a in range(3))
        nearest_other = [np.linalg.norm(p[part == a].mean(0) - p[part == b].mean(0)) for a in range(3) for b in range(a)]
        assert min(nearest_other) > 3
