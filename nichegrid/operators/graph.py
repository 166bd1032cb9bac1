"""Spatial graphs as relations: edges(patient, sample, source, target) with source < target."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichegrid.functions.clock import timed_group
from nichegrid.functions.lineage import written
from nichegrid.operators import plane

SAMPLE = ("patient", "sample")
#: Nodes of a sample, or of a tile of one, that one task holds.
TILE = 1 << 17


def same_sample(a: DataFrame, b: DataFrame) -> Column:
    return a["patient"].eqNullSafe(b["patient"]) & a["sample"].eqNullSafe(b["sample"])


def canonical(pairs: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops."""
    return pairs.select(*SAMPLE, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).where("source <> target").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, as (source, target)."""
    return edges.select(*SAMPLE, "source", "target").union(edges.select(*SAMPLE, F.col("target").alias("source"), F.col("source").alias("target")))


def _placed(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.col("node_id").alias(f"_{side}"), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))


def lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends both exist, with their Euclidean length."""
    out = edges
    for side in ("source", "target"):
        n = _placed(nodes, side)
        out = out.join(n, out["patient"].eqNullSafe(n["_patient"]) & out["sample"].eqNullSafe(n["_sample"]) & (out[side] == n[f"_{side}"])).drop("_patient", "_sample", f"_{side}")
    dx, dy = F.col("source_x") - F.col("target_x"), F.col("source_y") - F.col("target_y")
    return out.select(*edges.columns, F.sqrt(dx * dx + dy * dy).alias("length"))


_NEAR = "patient string, sample string, source long, target long, distance double, rank long, tx double, ty double"


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _rows(t: pa.Table, of: np.ndarray, other: pa.Table, to: np.ndarray, distance: np.ndarray, rank: np.ndarray) -> pa.Table:
    """Rows of _NEAR from places in two tables of nodes."""
    at, to = pa.array(of), pa.array(to)
    columns = [t.column(c).take(at) for c in (*SAMPLE, "node_id")], [other.column(c).take(to) for c in ("node_id", "x", "y")]
    return pa.table([*columns[0], columns[1][0], pa.array(distance), pa.array(rank + 1), *columns[1][1:]], names=[c.split()[0] for c in _NEAR.split(", ")])


def largest_sample(nodes: DataFrame) -> int:
    return nodes.groupBy(*SAMPLE).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def tiled(nodes: DataFrame, tile: int, largest: int) -> DataFrame:
    """nodes with strip and row: parts of each sample of about `tile` nodes, by quantiles of x and then of y."""
    parts = max(1, math.ceil((largest / tile) ** 0.5))
    steps = F.array(*(F.lit((i + 1) / parts) for i in range(parts - 1)))
    above = lambda c, bounds: F.size(F.filter(bounds, lambda b: b < F.col(c)))
    cuts = nodes.groupBy(*(F.col(c).alias(f"_{c}") for c in SAMPLE)).agg(F.percentile_approx("x", steps).alias("bounds"))
    own = F.col("patient").eqNullSafe(F.col("_patient")) & F.col("sample").eqNullSafe(F.col("_sample"))
    out = nodes.join(cuts, own).select(*nodes.columns, above("x", F.col("bounds")).alias("strip"))
    cuts = out.groupBy(*(F.col(c).alias(f"_{c}") for c in (*SAMPLE, "strip"))).agg(F.percentile_approx("y", steps).alias("bounds"))
    return out.join(cuts, own & (F.col("strip") == F.col("_strip"))).select(*out.columns, above("y", F.col("bounds")).alias("row"))


def near_rows(nodes: DataFrame, k: int, tile: int, largest: int) -> DataFrame:
    """Rows of _NEAR for the nodes whose column `asked` is true, or for all if there is none."""
    asked = "asked" in nodes.columns
    places = [*SAMPLE, "node_id", "x", "y", *["asked"] * asked]
    nodes = nodes.select(*(F.col(c).cast("double").alias(c) if c in ("x", "y") else c for c in places))

    def own(t: pa.Table) -> pa.Table:
        x, y, ids = _columns(t, "x", "y", "node_id")
        return _rows(t, *_swapped(plane.nearest(x, y, ids, k, t.column("asked").to_numpy() if asked else None), t))

    kernel = timed_group(own)
    if largest <= tile:
        return nodes.groupBy(*SAMPLE).applyInArrow(kernel, _NEAR)
    place = [*SAMPLE, "strip", "row"]
    placed = written(tiled(nodes, tile, largest))
    first = written(placed.groupBy(*place).applyInArrow(kernel, _NEAR))
    reach = first.groupBy(*(F.col(c).alias(f"_{c}") for c in (*SAMPLE, "source"))).agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    own_sample = F.col("patient").eqNullSafe(F.col("_patient")) & F.col("sample").eqNullSafe(F.col("_sample"))
    rows = placed.where("asked") if asked else placed
    rows = rows.join(reach, own_sample & (F.col("node_id") == F.col("_source")), "left").select(*placed.columns, F.when(F.coalesce("n", F.lit(0)) >= k, F.col("far")).otherwise(float("inf")).alias("far"))
    boxes = placed.groupBy(*(F.col(c).alias(f"_{c}") for c in place)).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    dx, dy = (F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1")) for c in "xy")
    further = ((F.col("strip") != F.col("_strip")) | (F.col("row") != F.col("_row"))) & (dx * dx + dy * dy <= F.col("far") * F.col("far") * (1 + 1e-12))
    queries = rows.join(boxes, own_sample & further).select(*SAMPLE, F.col("_strip").alias("strip"), F.col("_row").alias("row"), "node_id", "x", "y")

    def across(a: pa.Table, b: pa.Table) -> pa.Table:
        return _rows(a, *_swapped(plane.nearest(*_columns(a, "x", "y", "node_id"), k, others=tuple(_columns(b, "x", "y", "node_id"))), b))

    searched = placed.select(*(F.col(c).alias(c) for c in (*place, "node_id", "x", "y")))
    second = queries.groupBy(*place).cogroup(searched.groupBy(*place)).applyInArrow(across, _NEAR)
    order = W.partitionBy(*SAMPLE, "source").orderBy("distance", "target")
    return first.unionByName(second).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _swapped(found: tuple[np.ndarray, ...], other: pa.Table) -> tuple:
    of, to, distance, rank = found
    return of, other, to, distance, rank


def nearest(nodes: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """(patient, sample, source, target, distance, rank): each node's k nearest others in its sample, ties to the lower id.

    A sample of at most `tile` nodes is one task's; only k rows a node leave it. Larger ones are cut into tiles of about
    that size: every node searches its own tile and then those that its k-th neighbour's distance reaches into.
    """
    return near_rows(nodes, k, tile, largest_sample(nodes)).select(*SAMPLE, "source", "target", "distance", F.col("rank").cast("int").alias("rank"))


def knn_edges(nodes: DataFrame, k: int) -> DataFrame:
    """Distinct undirected edges to the k nearest nodes."""
    return canonical(nearest(nodes, k))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(patient, sample, node_id, degree) of every node, 0 where it has no edge."""
    d = both_ways(edges).groupBy(*SAMPLE, "source").agg(F.count("*").alias("degree")).select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), "source", "degree")
    n = nodes.select(*SAMPLE, "node_id")
    out = n.join(d, n["patient"].eqNullSafe(d["_patient"]) & n["sample"].eqNullSafe(d["_sample"]) & (n["node_id"] == d["source"]), "left")
    return out.select(*SAMPLE, "node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy(*SAMPLE).agg(F.avg("degree").alias("mean_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def under_connected(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Nodes with fewer than max(least, 1) edges."""
    return degrees(nodes, edges).where(F.col("degree") < max(least, 1))


def shorter(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The edges below a length."""
    return lengths(edges, nodes).where(F.col("length") < threshold).drop("length")


def adaptive_percent(n: Column) -> Column:
    """The percentile that leaves more edges out of small graphs: 100 (1 - 2 / sqrt(n))."""
    return F.lit(100.0) * (F.lit(1.0) - F.lit(2.0) / F.sqrt(n))


def length_percentile(edges: DataFrame, nodes: DataFrame, q: float) -> DataFrame:
    """The q-th percentile of edge length by sample, linearly interpolated."""
    return lengths(edges, nodes).where(~F.isnan("length")).groupBy(*SAMPLE).agg(F.percentile("length", F.lit(q / 100)).alias("length"))


def trim_by_percentile(edges: DataFrame, nodes: DataFrame, q: float | None = None) -> DataFrame:
    """The edges shorter than the q-th percentile of their sample's lengths; without q, than the percentile that its number
    of nodes gives."""
    sized = lengths(edges, nodes)
    counts = nodes.groupBy(*(F.col(c).alias(f"_{c}") for c in SAMPLE)).agg(F.count("*").alias("_n"))
    sized = sized.join(counts, sized["patient"].eqNullSafe(counts["_patient"]) & sized["sample"].eqNullSafe(counts["_sample"]))
    share = F.lit(q) if q is not None else F.greatest(F.lit(0.0), adaptive_percent(F.col("_n")))
    # percentiles need a constant share, so that the two lengths around it are taken by rank
    own = W.partitionBy(*SAMPLE)
    ranked = sized.select(*SAMPLE, "source", "target", "length", (F.row_number().over(own.orderBy("length")) - 1).alias("_r"), (share / 100 * (F.count("*").over(own) - 1)).alias("_at"))
    low = F.max(F.when(F.col("_r") == F.floor("_at"), F.col("length"))).over(own)
    high = F.max(F.when(F.col("_r") == F.ceil("_at"), F.col("length"))).over(own)
    cut = low + (high - low) * (F.col("_at") - F.floor("_at"))
    return ranked.select(*SAMPLE, "source", "target", "length", cut.alias("_cut")).where(F.col("length") < F.col("_cut")).select(*SAMPLE, "source", "target")


def relink(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, least: int, shortest_only: bool) -> DataFrame:
    """edges with under-connected nodes linked anew.

    shortest_only: a node gets its `least` shortest candidate edges, if it has as many; else all candidates that touch
    it.
    """
    poor = under_connected(nodes, edges, least).select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), "node_id")
    by_node = both_ways(candidates)
    touching = by_node.join(poor, by_node["patient"].eqNullSafe(F.col("_patient")) & by_node["sample"].eqNullSafe(F.col("_sample")) & (by_node["source"] == F.col("node_id")), "left_semi")
    if shortest_only:
        own = W.partitionBy(*SAMPLE, "source")
        order = own.orderBy("length", F.least("source", "target"), F.greatest("source", "target"))
        sized = lengths(touching, nodes)
        n = max(least, 1)
        touching = sized.select("*", F.count("*").over(own).alias("n"), F.row_number().over(order).alias("r")).where((F.col("n") >= n) & (F.col("r") <= n))
    return edges.select(*SAMPLE, "source", "target").union(canonical(touching.select(*SAMPLE, "source", "target"))).distinct()


def neighbourhoods(nodes: DataFrame, edges: DataFrame, order: int) -> DataFrame:
    """(patient, sample, node_id, member): all nodes within `order` hops of each node, itself included."""
    steps = both_ways(edges).select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.col("source").alias("_from"), F.col("target").alias("_to"))
    reached = nodes.select(*SAMPLE, "node_id", F.col("node_id").alias("member"))
    frontier = reached
    for _ in range(order):
        step = frontier.join(steps, frontier["patient"].eqNullSafe(F.col("_patient")) & frontier["sample"].eqNullSafe(F.col("_sample")) & (F.col("member") == F.col("_from")))
        frontier = step.select(*SAMPLE, "node_id", F.col("_to").alias("member")).distinct()
        reached = reached.union(frontier).distinct()
    return reached


def duplicates_removed(edges: DataFrame) -> DataFrame:
    return canonical(edges)


def within_box(nodes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Nodes in a rectangle, borders included."""
    return nodes.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def nearest_within(nodes: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """For each of the points (point, px, py), the nearest node of any sample within a radius, ties to the lower key.

    Both sides are put on a grid of cells as wide as the radius and meet cell by cell.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    p = points.select("*", around.alias("c")).select("point", "px", "py", (cell("px") + F.col("c.i")).alias("cx"), (cell("py") + F.col("c.j")).alias("cy"))
    n = nodes.select("key", "x", "y", cell("x").alias("nx"), cell("y").alias("ny"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    near = p.join(n, (F.col("cx") == F.col("nx")) & (F.col("cy") == F.col("ny"))).select("point", "key", F.sqrt(dx * dx + dy * dy).alias("distance")).where(F.col("distance") <= radius)
    return near.groupBy("point").agg(F.min_by("key", F.struct("distance", "key")).alias("key"), F.min("distance").alias("distance"))
