from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nichegrid.operators import delaunay, graph, plane

NODES = "patient string, sample string, node_id long, x double, y double, phenotype string"


def nodes_of(spark, points, patient="p"):
    return spark.createDataFrame([(patient, None, i, float(x), float(y), "ab"[i % 2]) for i, (x, y) in enumerate(points)], NODES)


def edges_of(df):
    return {(r["source"], r["target"]) for r in df.collect()}


def empty_circles(points):
    """Edges of all triangles whose circumcircle holds no other point, by brute force."""
    n, out = len(points), set()
    p = np.array(points, float)
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                b, c = p[j] - p[i], p[k] - p[i]
                det = 2 * (b[0] * c[1] - b[1] * c[0])
                if abs(det) < 1e-12:
                    continue
                u = np.array([c[1] * (b @ b) - b[1] * (c @ c), b[0] * (c @ c) - c[0] * (b @ b)]) / det
                d = ((p - p[i] - u) ** 2).sum(1)
                d[[i, j, k]] = np.inf
                if (d > u @ u * (1 - 1e-9)).all():
                    out |= {(i, j), (i, k), (j, k)}
    return out


def positive_borders(points):
    """Pairs whose bisector has a stretch of positive length that is nearest to them, in exact arithmetic."""
    out = set()
    for i, a in enumerate(points):
        for j, b in enumerate(points[:i]):
            (ax, ay), (bx, by) = (map(Fraction, p) for p in (a, b))
            mx, my, dx, dy = (ax + bx) / 2, (ay + by) / 2, ay - by, bx - ax
            low, high, free = None, None, True
            for k, c in enumerate(points):
                if k in (i, j):
                    continue
                cx, cy = map(Fraction, c)
                slope = 2 * (dx * (cx - ax) + dy * (cy - ay))
                room = cx * cx + cy * cy - ax * ax - ay * ay - 2 * (mx * (cx - ax) + my * (cy - ay))
                if slope == 0:
                    free = free and room >= 0
                elif slope > 0:
                    high = room / slope if high is None else min(high, room / slope)
                else:
                    low = room / slope if low is None else max(low, room / slope)
            if free and (low is None or high is None or low < high):
                out.add((j, i))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=14, unique=True))
def test_lattice_points_exactly(points):
    """Many of these lie on common circles and lines."""
    p = np.array(points, float)
    assert {tuple(e) for e in plane.delaunay(p[:, 0], p[:, 1]).tolist()} == positive_borders(points)


def test_delaunay_against_empty_circles(spark):
    rng = np.random.default_rng(1)
    points = rng.uniform(0, 100, (60, 2))
    assert edges_of(delaunay.delaunay(nodes_of(spark, points))) == empty_circles(points)


def test_degenerate_samples(spark):
    d = lambda points: edges_of(delaunay.delaunay(nodes_of(spark, points)))
    assert d([(0, 0)]) == set()
    assert d([(0, 0), (3, 4)]) == {(0, 1)}
    assert d([(0, 0), (2, 2), (1, 1), (5, 5)]) == {(0, 2), (1, 2), (1, 3)}
    assert d([(0, 0), (0, 1), (1, 0), (1, 1)]) == {(0, 1), (0, 2), (1, 3), (2, 3)}  # no diagonals
    assert d([(0, 0), (1, 1e-5), (2, 0)]) == {(0, 1), (0, 2), (1, 2)}  # a nearly straight border
    with pytest.raises(ValueError):
        d([(0, 0), (float("nan"), 1)])


def far_apart():
    rng = np.random.default_rng(2)
    return np.concatenate([rng.normal(0, 1, (500, 2)), rng.normal(200, 30, (600, 2)), [[1e7, -1e7], [5, 5], [5, 5], [5, 5]]])


def test_tiles_agree_with_pairs(spark):
    """Points with outliers and equal ones: by tiles, by leaves of one task, and pair by pair."""
    points = far_apart()
    nodes = nodes_of(spark, points)
    pick = lambda df: {(r["source"], r["target"], r["rank"]) for r in df.collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i, row in enumerate(d) for r, j in enumerate(np.argsort(row, kind="stable")[:4])}
    assert pick(graph.nearest(nodes, 4)) == want
    assert pick(graph.nearest(nodes, 4, tile=150)) == want


def test_delaunay_by_tiles(spark):
    nodes = nodes_of(spark, far_apart()[400:700])
    assert edges_of(delaunay.delaunay(nodes, tile=60)) == edges_of(delaunay.delaunay(nodes))


def test_adaptive_trim_and_relink(spark):
    points = [(0, 0), (1, 0), (0, 1), (1, 1.1), (0.5, 0.4), (100, 100)]
    nodes = nodes_of(spark, points)
    whole = delaunay.delaunay(nodes)
    trimmed = delaunay.trim_adaptively(whole, nodes)
    kept = edges_of(trimmed)
    assert kept <= edges_of(whole) and (3, 5) not in kept
    back = edges_of(graph.relink(nodes, trimmed, whole, 1, shortest_only=True))
    assert kept < back and any(5 in e for e in back)
    again = graph.relink(nodes, graph.relink(nodes, trimmed, whole, 1, shortest_only=True), whole, 1, shortest_only=True)
    assert edges_of(again) == back


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    nodes = nodes_of(spark, rng.uniform(0, 10, (80, 2)))
    want = edges_of(delaunay.network(nodes))
    assert edges_of(delaunay.network(nodes.repartition(7))) == want


def test_trimming_in_strips_equals_one_pass(spark):
    rng = np.random.default_rng(12)
    rows = [(f"p{s}", None if s else "a", int(i), float(x), float(y)) for s in range(2) for i, (x, y) in enumerate(rng.random((300, 2)) ** 2)]
    nodes = spark.createDataFrame(rows, "patient string, sample string, node_id long, x double, y double").cache()
    edges = delaunay.delaunay(nodes).cache()
    place = {(p, i): (x, y) for p, _, i, x, y in rows}
    want = set()
    for p in ("p0", "p1"):
        own = {(r["source"], r["target"]): float(np.hypot(*np.subtract(place[p, r["source"]], place[p, r["target"]]))) for r in edges.where(f"patient = '{p}'").collect()}
        for node in range(300):
            mine = [e for e in own if node in e]
            if len(mine) > 3:
                limit = 1.3 * sorted(own[e] for e in mine)[2]
                for e in mine:
                    if own[e] > limit:
                        del own[e]
        want |= {(p, *e) for e in own}
    assert len(want) < edges.count()
    for tile in (1 << 17, 40):
        got = [(r["patient"], r["source"], r["target"]) for r in delaunay.trim_adaptively(edges, nodes, ratio=1.3, tile=tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_parts_of_a_sample_find_the_same_edges(spark, monkeypatch):
    rng = np.random.default_rng(13)
    points = [*rng.random((150, 2)), *((i / 5, j / 5) for i in range(5) for j in range(5)), *([0.5, 0.5],) * 3]
    nodes = nodes_of(spark, points).union(nodes_of(spark, points[:9], "q"))
    key = lambda df: sorted((r["patient"], r["source"], r["target"]) for r in df.collect())
    want = key(delaunay.delaunay(nodes))
    monkeypatch.setattr(delaunay, "PART", 20)
    assert key(delaunay.delaunay(nodes)) == want
    monkeypatch.setattr(delaunay, "PARTS", 3)
    assert key(delaunay.delaunay(nodes)) == want


def test_only_the_cells_of_a_part_are_built(monkeypatch):
    """Cells that nearest points close, and outer ones that all points must be asked for."""
    sizes = []
    points = far_apart()[:700]
    x, y = points[:, 0], points[:, 1]
    own = np.zeros(len(x), bool)
    own[np.argsort(x)[:90]] = True
    want = {tuple(e) for e in plane.delaunay(x, y).tolist() if own[e].any()}
    monkeypatch.setattr(plane, "Cells", lambda n, kind=plane.Cells: (sizes.append(n), kind(n))[1])
    assert {tuple(e) for e in plane.delaunay(x, y, own=own).tolist()} == want
    assert sizes == [90]
