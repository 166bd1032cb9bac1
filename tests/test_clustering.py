import collections

import numpy as np
import pytest

from nichegrid.operators import agreement, clustering, layout, vectors
from nichegrid.plans import queries


def blobs(spark, k=3, n=25, far=12.0, d=2):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(0, 1, d) + far * np.eye(k, d)[i % k] * (1 + i % k)).tolist(), i % k) for i in range(k * n)]
    return spark.createDataFrame(rows, "id long, vector array<double>, truth long")


def ari(rows, labels):
    return agreement.rand_index(rows.select("id", "truth").join(labels, "id").selectExpr("truth as a", "niche as b")).first()["ari"]


@pytest.fixture(scope="module")
def rows(spark):
    return blobs(spark, d=3).cache()


def test_kmeans_and_mixture_find_blobs(rows):
    assert ari(rows, clustering.kmeans(rows, 3, seed=1)) == 1.0
    labels, history = clustering.gaussian_mixture(rows, 3)
    assert ari(rows, labels) == 1.0 and all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    assert sorted(r["niche"] for r in labels.select("niche").distinct().collect()) == [0, 1, 2]


def test_full_covariances(spark):
    rng = np.random.default_rng(4)
    bent = np.linalg.cholesky(np.array([[1.0, 0.97], [0.97, 1.0]]))
    x = np.concatenate([rng.normal(size=(150, 2)) @ bent.T + [0, 0], rng.normal(size=(150, 2)) @ bent.T + [2.0, -2.0]])
    df = spark.createDataFrame([(i, v.tolist(), i // 150) for i, v in enumerate(x)], "id long, vector array<double>, truth long")
    labels, history = clustering.gaussian_mixture(df, 2, covariance="full", tolerance=1e-6)
    assert ari(df, labels) > 0.95 and all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    assert ari(df, clustering.gaussian_mixture(df, 2)[0]) <= ari(df, labels)
    flat = df.selectExpr("id", "array(vector[0], 2 * vector[0]) as vector", "truth")  # singular
    assert clustering.gaussian_mixture(flat, 2, covariance="full")[0].count() == 300
    with pytest.raises(ValueError):
        clustering.factorised(np.diag([-1e30, 1.0]), 1e-6)


def test_mixture_far_from_zero(rows, spark):
    """Sums of squares far from zero keep no digit of a variance; centred ones do."""
    far = spark.createDataFrame([(r["id"], [x + 1e8 for x in r["vector"]], r["truth"]) for r in rows.collect()], rows.schema)
    near, there = (clustering.gaussian_mixture(df, 3)[1][-1] for df in (rows, far))
    assert there == pytest.approx(near, abs=1e-4) and ari(far, clustering.gaussian_mixture(far, 3)[0]) == 1.0


def test_spectral_finds_blobs(rows, spark):
    close = spark.createDataFrame([(r["id"], [x / 4 for x in r["vector"]], r["truth"]) for r in rows.collect()], rows.schema)
    assert ari(close, clustering.spectral(close, 3, rounds=15)) > 0.9
    with pytest.raises(ValueError):
        clustering.spectral(rows, 3, most=10)


@pytest.mark.parametrize("block", [4, 100])
def test_communities_of_cliques(spark, block):
    edges = [(a + 5 * c, b + 5 * c, 1.0) for c in range(3) for a in range(5) for b in range(a)] + [(0, 5, 1.0), (5, 10, 1.0)]
    graph = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "a long, b long, weight double")
    nodes = spark.range(16).withColumnRenamed("id", "node")
    got = {r["node"]: r["niche"] for r in clustering.communities(graph, nodes, block=block).collect()}
    assert len({got[i] for i in range(15)}) == 3 and all(len({got[5 * c + i] for i in range(5)}) == 1 for c in range(3))
    assert got[15] not in {got[i] for i in range(15)}
    m = clustering.modularity(graph, spark.createDataFrame(list(got.items()), "node long, niche long")).first()["modularity"]
    assert m == pytest.approx(30 / 32 - (22**2 + 21**2 + 21**2) / (4 * 32**2), abs=0.01)


@pytest.mark.parametrize("block", [16, 1000])
def test_communities_move_and_merge_to_the_end(spark, block):
    n = 256
    ring = [(i, (i + 1) % n) for i in range(n)]
    graph = spark.createDataFrame([(min(e), max(e), 1.0) for e in ring], "a long, b long, weight double")
    got = {r["node"]: r["niche"] for r in clustering.communities(graph, spark.range(n).withColumnRenamed("id", "node"), resolution=0.05, block=block).collect()}
    size, links = collections.Counter(got.values()), collections.Counter(frozenset((got[a], got[b])) for a, b in ring)
    # no two communities are left whose union has a higher modularity
    assert all(c <= 0.05 * 4 * size[min(p)] * size[max(p)] / (2 * n) + 1e-9 for p, c in links.items() if len(p) == 2)
    with pytest.raises(RuntimeError):
        clustering.communities(graph, spark.range(n).withColumnRenamed("id", "node"), resolution=0.05, sweeps=0)


def test_small_graphs_have_the_best_partition(spark):
    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for i in range(len(rest)):
                yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]

    rng = np.random.default_rng(8)
    n = 9
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.35), 1)
    w[np.arange(n - 1), np.arange(1, n)] += 0.2
    m, k = w.sum(), (w + w.T).sum(1)
    score = lambda p: sum(w[np.ix_(c, c)].sum() / m - k[c].sum() ** 2 / (4 * m * m) for c in p)
    best = max(score([np.array(c) for c in p]) for p in partitions(list(range(n))))
    graph = spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w))], "a long, b long, weight double")
    for block in (3, 100):
        labels = clustering.communities(graph, spark.range(n).withColumnRenamed("id", "node"), block=block)
        assert clustering.modularity(graph, labels).first()["modularity"] == pytest.approx(best, rel=1e-9 if block == 100 else 0.05)


def test_coarsened_graphs_lose_little(spark):
    rng = np.random.default_rng(9)
    x = rng.random((700, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    graph = clustering.neighbour_graph(vectors.nearest(rows, 6)).cache()
    nodes = rows.selectExpr("id as node")
    whole, coarse = (clustering.modularity(graph, clustering.communities(graph, nodes, block=b)).first()["modularity"] for b in (1000, 200))
    assert coarse >= 0.99 * whole


def test_principal_components(rows):
    x = np.array([r["vector"] for r in rows.orderBy("id").collect()])
    got = np.array([r["projection"] for r in clustering.principal_components(rows, 2).orderBy("id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = vt[:2].T * np.sign(vt[:2].T[np.abs(vt[:2].T).argmax(0), [0, 1]])
    assert np.allclose(got, (x - x.mean(0)) @ axes, atol=1e-8)


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_repeated_rows_search_as_one(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (120, 2)).astype(float)
    x[:7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    d = vectors.distances(x, x, metric)
    d = np.round(d, 12)
    np.fill_diagonal(d, np.inf)
    got = {(r["source"], r["rank"]): r["distance"] for r in vectors.nearest(rows, 4, metric).collect()}
    assert got.keys() == {(i, r) for i in range(120) for r in range(1, 5)}
    assert all(got[i, r + 1] == pytest.approx(v, abs=1e-9) for i, row in enumerate(np.sort(d, 1)) for r, v in enumerate(row[:4]))
    if metric != "cosine":
        want = {(i, int(j), r + 1) for i, row in enumerate(d) for r, j in enumerate(np.argsort(row, kind="stable")[:4])}
        assert {(r["source"], r["target"], r["rank"]) for r in vectors.nearest(rows, 4, metric).collect()} == want


def test_fuzzy_graph_and_layout(rows):
    near = vectors.nearest(rows.select("id", "vector"), 6).cache()
    graph = vectors.fuzzy_graph(near).collect()
    assert all(0 < r["weight"] <= 1 + 1e-12 and r["a"] < r["b"] for r in graph)
    sums = {r["source"]: r["s"] for r in vectors.smoothed(near).groupBy("source").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect()}
    assert all(s == pytest.approx(np.log2(7), abs=1e-3) for s in sums.values())
    a, b = layout.curve(1.0, 0.1)
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)
    places = layout.umap(rows.select("id", "vector"), neighbours=6, epochs=4)
    assert places.count() == 75
    again = {r["node"]: r["p"] for r in layout.umap(rows.select("id", "vector").repartition(5), neighbours=6, epochs=4).collect()}
    assert all(np.allclose(again[r["node"]], r["p"], atol=1e-6) for r in places.collect())


def test_layout_in_blocks(rows):
    """With an exchange after each round and without pushes, blocks take the same rounds as one task."""
    near = vectors.fuzzy_graph(vectors.nearest(rows.select("id", "vector"), 6))
    place = layout.start(rows.select("id", "vector"))
    one, many = ({r["node"]: r["p"] for r in layout.optimize(near, place, 3, 1.6, 0.9, negatives=0, block=b).collect()} for b in (1000, 20))
    assert all(np.allclose(one[i], many[i]) for i in one) and len(one) == 75
    assert layout.borders(3, 12) == [0, 1, 2, 3] and layout.borders(500, 12)[-1] == 500
    blocks = layout.dealt(place, 75, 20).groupBy("block").count().collect()
    assert sum(r["count"] for r in blocks) == 75 and max(r["count"] for r in blocks) <= 20 and {r["block"] for r in blocks} == set(range(len(blocks)))


def test_layout_keeps_blobs_apart(rows):
    for options in ({}, {"block": 20}):
        graph = vectors.fuzzy_graph(vectors.nearest(rows.select("id", "vector"), 8))
        place = layout.spectral_start(graph, rows.select("id", "vector"))
        p = layout.optimize(graph, place, 60, 1.6, 0.9, **options)
        assert ari(rows, clustering.kmeans(p.selectExpr("node as id", "p as vector"), 3, seed=1)) > 0.9
        assert np.isfinite([x for r in p.collect() for x in r["p"]]).all()


def test_layout_query_takes_all_rounds(spark, tmp_path, monkeypatch):
    taken = []
    monkeypatch.setattr(layout, "optimize", lambda graph, place, epochs, *rest, **more: taken.append(epochs) or place)
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.umap_layout(spark, str(tmp_path)).count() == 20
    near = spark.createDataFrame([(0, 1, 1.0)], "source long, target long, distance double")
    monkeypatch.setattr(layout, "nearest", lambda *a: near)
    monkeypatch.setattr(layout, "fuzzy_graph", lambda df: df)
    monkeypatch.setattr(layout, "spectral_start", lambda graph, rows, *a: layout.start(rows))
    layout.umap(spark.range(10_001).selectExpr("id", "array(cast(id as double), cast(id % 7 as double)) as vector"))
    assert taken == [500, 200]


def test_merge_smallest(spark):
    at = {0: (0.0, 0), 1: (1.0, 0), 2: (4.0, 1), 3: (5.5, 2), 4: (6.0, 2)}
    labels = spark.createDataFrame([(i, n) for i, (_, n) in at.items()], "id long, niche long")
    places = spark.createDataFrame([(i, [x]) for i, (x, _) in at.items()], "id long, vector array<double>")
    merged, done = clustering.merge_smallest(labels, places, force=True)
    assert done and {r["id"]: r["niche"] for r in merged.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}
    assert clustering.merge_smallest(labels, places)[1] is False
    assert {r["niche"] for r in clustering.merge_until(labels, places, niches=1, force=True).collect()} == {0}
    assert {r["id"]: r["niche"] for r in clustering.merge_until(labels, places, threshold=2.0).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
