"""Delaunay graphs from Voronoi cells.

Two nodes are linked if their Voronoi cells share a border of positive length; so where four nodes or more lie on an
empty circle, the diagonals aren't edges. A cell is complete once every further node is twice as far as its farthest
corner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.functions.clock import timed_batches, timed_frame, timed_group
from nichegrid.functions.lineage import written
from nichegrid.operators import plane
from nichegrid.operators.graph import SAMPLE, TILE, largest_sample, lengths, near_rows, nearest, relink, shorter

#: Nodes of a sample whose cells are one task's; tasks of a sample at most; nodes of a sample that a task may hold, whose
#: coordinates are 16 bytes each.
PART, PARTS, WHOLE = 8192, 32, 1 << 20
_EDGES = "patient string, sample string, source long, target long"
_CELLS = "patient string, sample string, node_id long, x double, y double, complete boolean, corners array<struct<x: double, y: double, w: double>>, near array<struct<distance: double, target: long, tx: double, ty: double>>, edges array<long>"


def _cells(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Rows of _CELLS from (patient, sample, node_id, x, y, near): the cells that near's nodes leave, with those of near
    that have a border. whole: near is all that could cut the cell."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = b.column("near")
            n = len(own)
            at = np.array(own.offsets) - own.offsets[0].as_py() if n else np.zeros(1, np.int64)
            owner, each = np.repeat(np.arange(n), np.diff(at)), own.flatten()
            distance, target, tx, ty = (each.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            order = np.lexsort((target, distance, owner))
            cells, reach, far = plane.Cells(n), np.full(n, np.inf), np.zeros(n)
            for r in range(int(np.diff(at).max(initial=0))):
                live = np.flatnonzero(np.diff(at) > r)
                place = order[at[live] + r]
                far[live] = distance[place]
                near = distance[place] < 2 * reach[live]
                live, place = live[near], place[near]
                changed = cells.cut(live, tx[place] - x[live], ty[place] - y[live], place)
                reach[changed] = cells.reach(changed)
            of, to = plane.neighbours(cells, lambda i, j: (float(tx[j]), float(ty[j])) if j >= 0 else (float(x[i]), float(y[i])))
            edges = [target[to[a:z]].tolist() for a, z in zip(*(np.searchsorted(of, np.arange(n), side) for side in ("left", "right")), strict=True)]
            done = (far >= 2 * reach) | whole
            corners = [[{"x": v[0], "y": v[1], "w": v[2]} for v in cells.corners[i, : cells.sizes[i]].tolist()] if not done[i] else [] for i in range(n)]
            kept = [[{"distance": distance[j], "target": target[j], "tx": tx[j], "ty": ty[j]} for j in cells.owners[i, : cells.sizes[i]].tolist() if j >= 0] if not done[i] else [] for i in range(n)]
            schema = b.schema
            struct = schema.field("near").type
            corner = pa.list_(pa.struct([(c, pa.float64()) for c in "xyw"]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*SAMPLE, "node_id", "x", "y")), pa.array(done, pa.bool_()), pa.array(corners, corner), pa.array(kept, struct), pa.array(edges, pa.list_(pa.int64()))], [*SAMPLE, "node_id", "x", "y", "complete", "corners", "near", "edges"])

    return rows.mapInArrow(timed_batches(batches), _CELLS)


def _in_tiles(nodes: DataFrame, tile: int, largest: int) -> DataFrame:
    """Edges of samples that don't fit a task: cells of 16 and of 128 nearest nodes, then, for the outer nodes, of the
    nearest node that still cuts them, again and again. Each round is a join for all samples, over open nodes only."""
    prefixed = lambda *names: [F.col(c).alias(f"_{c}") for c in names]
    own = F.col("patient").eqNullSafe(F.col("_patient")) & F.col("sample").eqNullSafe(F.col("_sample"))
    open_, edges = nodes.select(*SAMPLE, "node_id", "x", "y"), []
    for k in (16, 128):
        mark = open_.select(*prefixed(*SAMPLE, "node_id"), F.lit(True).alias("asked"))
        asked = nodes.join(mark, own & (F.col("node_id") == F.col("_node_id")), "left").select(*SAMPLE, "node_id", "x", "y", F.coalesce("asked", F.lit(False)).alias("asked"))
        near = near_rows(asked, k, tile, largest).groupBy(*prefixed(*SAMPLE, "source")).agg(F.collect_list(F.struct("distance", "target", "tx", "ty")).alias("near"))  # k entries
        rows = open_.join(near, own & (F.col("node_id") == F.col("_source"))).select(*open_.columns, "near")
        cells = written(_cells(rows))
        edges.append(cells.where("complete").select(*SAMPLE, "node_id", "edges"))
        open_ = written(cells.where("not complete").select(*SAMPLE, "node_id", "x", "y"))
    cells = cells.where("not complete")
    place = nodes.select(*prefixed(*SAMPLE), F.col("node_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    square = dx * dx + dy * dy
    while not cells.isEmpty():
        size = lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]) * F.sqrt(square) + v["w"] * square
        cuts = F.exists("corners", lambda v: v["x"] * dx + v["y"] * dy - v["w"] * square / 2 > 4e-11 * size(v)) & (square > 0)
        known = F.exists("near", lambda p: p["target"] == F.col("target"))
        pairs = cells.join(place, own).where(cuts & ~known)
        next_ = pairs.groupBy(*prefixed(*SAMPLE, "node_id")).agg(F.min(F.struct(F.sqrt(square).alias("distance"), "target", "tx", "ty")).alias("more"))
        state = written(cells.join(next_, own & (F.col("node_id") == F.col("_node_id")), "left").select(*cells.columns, "more"))
        edges.append(state.where("more is null").select(*SAMPLE, "node_id", "edges"))
        rows = state.where("more is not null").select(*SAMPLE, "node_id", "x", "y", F.concat("near", F.array("more")).alias("near"))
        cells = written(_cells(rows).withColumn("complete", F.lit(False)))
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    ends = out.select(*SAMPLE, "node_id", F.explode("edges").alias("other"))
    return ends.select(*SAMPLE, F.least("node_id", "other").alias("source"), F.greatest("node_id", "other").alias("target")).distinct()


def delaunay(nodes: DataFrame, tile: int = WHOLE) -> DataFrame:
    """The untrimmed Delaunay edges of every sample; nodes of one place have none between each other.

    A sample of two nodes has their edge, nodes on a line are a path. A coordinate that isn't finite is an error. A
    sample of at most `tile` nodes goes to a task for each PART of its nodes, or to PARTS tasks, each of which looks at the
    cells of its share; larger ones go tile by tile.
    """
    bad = nodes.where(F.isnan("x") | F.isnan("y") | F.isnull("x") | F.isnull("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))).limit(1).collect()
    if bad:
        raise ValueError(f"coordinates must be finite: node {bad[0]['node_id']} of {bad[0]['patient']}")
    largest = largest_sample(nodes)
    nodes = nodes.select(*SAMPLE, "node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if largest > tile:
        return _in_tiles(nodes, tile, largest)

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("node_id")
        x, n = t.column("x").to_numpy(), t.num_rows
        own = None
        if "part" in t.column_names:
            part, parts = t["part"][0].as_py(), min(PARTS, -(-n // PART))
            own = np.zeros(n, bool)
            own[np.argsort(x, kind="stable")[part * n // parts : (part + 1) * n // parts]] = True
        pairs = plane.delaunay(x, t.column("y").to_numpy(), own=own)
        first, second = pa.array(pairs[:, 0]), pa.array(pairs[:, 1])
        return pa.table([*(t.column(c).take(first) for c in (*SAMPLE, "node_id")), t.column("node_id").take(second)], names=["patient", "sample", "source", "target"])

    kernel = timed_group(whole)
    if largest <= PART:
        return nodes.groupBy(*SAMPLE).applyInArrow(kernel, _EDGES)
    sizes = nodes.groupBy(*(F.col(c).alias(f"_{c}") for c in SAMPLE)).agg(F.least(F.ceil(F.count("*") / PART), F.lit(PARTS)).cast("int").alias("parts"))
    sized = nodes.join(sizes, nodes["patient"].eqNullSafe(sizes["_patient"]) & nodes["sample"].eqNullSafe(sizes["_sample"])).drop("_patient", "_sample")
    each = sized.select(*SAMPLE, "node_id", "x", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tasks = 2 * sizes.agg(F.sum("parts")).first()[0]  # parts are few rows and much work, and mustn't be put together
    return each.repartition(tasks, *SAMPLE, "part").groupBy(*SAMPLE, "part").applyInArrow(lambda t: kernel(t), _EDGES).distinct()  # an edge is found from both ends


#: Parts that a sample is cut into for trimming, at most.
STRIPS = 1024
_STATE = "patient string, sample string, source long, target long, length double, sb int, tb int, fs boolean, ft boolean, removed boolean"


def _strips(nodes: DataFrame, tile: int) -> DataFrame:
    """(patient, sample, node_id, block): each sample cut by quantiles of x into strips of about `tile` nodes."""
    cuts = [i / STRIPS for i in range(1, STRIPS)]
    q = nodes.groupBy(*(F.col(c).alias(f"_{c}") for c in SAMPLE)).agg(F.count("*").alias("n"), F.percentile_approx("x", cuts, 10 * STRIPS).alias("q"))
    placed = nodes.join(q, nodes["patient"].eqNullSafe(q["_patient"]) & nodes["sample"].eqNullSafe(q["_sample"]))
    below = F.size(F.filter("q", lambda v: v < F.col("x")))
    strips = F.least(F.ceil(F.col("n") / tile), F.lit(STRIPS))
    return placed.select(*SAMPLE, "node_id", F.floor(below * strips / STRIPS).cast("int").alias("block"))


def _acted(key: tuple, pdf: pd.DataFrame, n_edges: int, ratio: float, least: float) -> pd.DataFrame:
    """The edges of one strip's nodes after all of these have acted whose earlier neighbours have."""
    pdf = pdf.sort_values(["source", "target"], kind="stable").reset_index(drop=True)
    block = key[2]
    ends, lengths_ = np.stack([pdf["source"], pdf["target"]], 1), pdf["length"].to_numpy()
    own = np.stack([pdf["sb"] == block, pdf["tb"] == block], 1)
    flags = np.stack([pdf["fs"], pdf["ft"]], 1).astype(bool)
    alive, at = np.ones(len(pdf), bool), {}
    for i, side in zip(*np.nonzero(own), strict=True):
        at.setdefault(int(ends[i, side]), []).append((int(i), int(side)))
    for node in sorted(at):
        mine = [(i, side) for i, side in at[node] if alive[i]]
        if any(flags[i, side] for i, side in at[node]) or any(ends[i, 1 - side] < node and not flags[i, 1 - side] for i, side in mine):
            continue  # it has acted, or waits for an earlier neighbour
        edges = np.array([i for i, _ in mine], np.int64)
        if len(edges) > n_edges:
            limit = max(ratio * np.sort(lengths_[edges])[n_edges - 1], least)
            alive[edges[lengths_[edges] > limit]] = False
        for i, side in at[node]:
            flags[i, side] = True
    return pdf.assign(fs=flags[:, 0], ft=flags[:, 1], removed=~alive)[[c.split(" ")[0] for c in _STATE.split(", ")]]


def trim_adaptively(edges: DataFrame, nodes: DataFrame, n_edges: int = 3, ratio: float = 2.0, least: float = 0.0, tile: int = TILE) -> DataFrame:
    """The edges that a pass over the nodes of each sample, in order of node_id, leaves.

    A node with more than n_edges edges left loses those that are longer than `ratio` times its n_edges-th shortest and
    longer than `least`. What a node loses its later neighbours don't see, so a node acts once all its earlier neighbours
    have. Samples are cut into strips of about `tile` nodes; in a round each strip's nodes act as far as those of other
    strips, as of the last round, allow. There is one round for each time that a chain of earlier and earlier neighbours
    changes its strip, so a single one for samples that are one strip.
    """
    rows = lengths(edges, nodes)
    single = largest_sample(nodes) <= tile
    if single:
        rows = rows.select("*", F.lit(0).alias("sb"), F.lit(0).alias("tb"))
    else:
        strips = written(_strips(nodes, tile))
        for end, name in (("source", "sb"), ("target", "tb")):
            of = strips.select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.col("node_id").alias("_id"), F.col("block").alias(name))
            rows = rows.join(of, rows["patient"].eqNullSafe(of["_patient"]) & rows["sample"].eqNullSafe(of["_sample"]) & (rows[end] == of["_id"])).drop("_patient", "_sample", "_id")
    state = rows.select(*SAMPLE, "source", "target", "length", "sb", "tb", F.lit(False).alias("fs"), F.lit(False).alias("ft"))
    done: DataFrame | None = None
    act = timed_frame(lambda key, pdf: _acted(key, pdf, n_edges, ratio, least))
    while True:
        out = state.withColumn("block", F.explode(F.array_distinct(F.array("sb", "tb")))).groupBy(*SAMPLE, "block").applyInPandas(act, _STATE)
        if single:
            return out.where(~F.col("removed")).select(*SAMPLE, "source", "target")
        each = out.groupBy(*SAMPLE, "source", "target").agg(*(F.first(c).alias(c) for c in ("length", "sb", "tb")), *(F.max(c).alias(c) for c in ("fs", "ft", "removed")))
        state = written(each.where(~F.col("removed")).drop("removed"))
        ended = state.where("fs and ft").select(*SAMPLE, "source", "target")
        done = ended if done is None else done.union(ended)
        state = state.where("not (fs and ft)")
        if state.isEmpty():
            return done


def network(nodes: DataFrame, adaptive: bool = True, n_edges: int = 3, ratio: float = 2.0, least: float = 0.0, longest: float | None = None, relink_to: int = 3, by: str = "delaunay") -> DataFrame:
    """The spatial network of every sample: Delaunay, adaptive trimming, a cut by length, relinking of nodes with fewer
    than relink_to edges.

    by: what relinks, "delaunay" (the shortest untrimmed edges) or "knn" (the nearest nodes); the graph itself is
    Delaunay's either way.
    """
    whole = written(delaunay(nodes))
    edges = trim_adaptively(whole, nodes, n_edges, ratio, least) if adaptive else whole
    if longest is not None:
        edges = shorter(edges, nodes, longest)
    if by == "knn":
        candidates = nearest(nodes, max(relink_to, 1)).select(*SAMPLE, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
        return relink(nodes, written(edges), candidates, relink_to, shortest_only=False)
    return relink(nodes, written(edges), whole, relink_to, shortest_only=True)
