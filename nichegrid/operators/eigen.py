"""Leading eigenvectors of symmetric relations, and layouts of graphs by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.functions.lineage import written
from nichegrid.operators.clustering import components, principal_components
from nichegrid.operators.descent import matrix

#: Nodes of a component whose eigenvectors one task finds by a dense matrix.
DENSE = 2048


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _products(t: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The products of all columns of b with each other, and with those of ab: each task sends 2 size**2 numbers."""

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size * size)
        for x in it:
            if x.num_rows:
                b, ab = matrix(x["b"]), matrix(x["ab"])
                total += np.concatenate([(b.T @ b).ravel(), (b.T @ ab).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "x"])

    out = np.zeros(2 * size * size)
    for row in t.select("b", "ab").mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[row["at"]] = row["x"]
    return out[: size * size].reshape(size, size), out[size * size :].reshape(size, size)


def leading(cells: DataFrame, start: DataFrame, k: int, tolerance: float = 1e-6, rounds: int = 200) -> tuple[list[float], DataFrame]:
    """(values, (node, q)): the k largest eigenvalues of a symmetric relation (i, j, w), falling, and their unit eigenvectors;
    q has a number for each of the k.

    start: (node, q) with a first guess for every node, of k columns or more; further ones speed up the search. Block
    Rayleigh-Ritz (LOBPCG): a round looks for the best vectors in the span of the current ones, their residuals, and the last
    steps. It is one join of cells with the residuals, a sum by row, and the products of the columns, which alone come to the
    driver. Rounds end once every residual is `tolerance` at most, or after `rounds`. Values may be found in any order of
    nodes; each vector's largest entry in size is positive.
    """
    m = start.select(F.size("q")).first()[0]

    def times(rows: DataFrame, column: str, width: int) -> DataFrame:
        """(node, product): cells times the vectors of a column."""
        sent = rows.select(F.col("node").alias("j"), F.col(column).alias("v"))
        sums = cells.join(sent, "j").groupBy("i").agg(*(F.sum(F.col("w") * F.get("v", c)).alias(f"s{c}") for c in range(width)))
        return sums.select(F.col("i").alias("node"), F.array(*(F.col(f"s{c}") for c in range(width))).alias("product"))

    def joined(rows: DataFrame, column: str, width: int) -> DataFrame:
        zero = F.array(*(F.lit(0.0) for _ in range(width)))
        return rows.join(times(rows, column, width), "node", "left").withColumn("product", F.coalesce("product", zero))

    first = start.select("node", F.col("q").cast("array<double>").alias("b"))
    t = written(joined(first, "b", m).select("node", "b", F.col("product").alias("ab")))
    size, steps, values = m, 0, np.zeros(0)
    for turn in range(rounds + 1):
        gram, energy = _products(t, size)
        if turn and (np.sqrt(np.abs(np.diag(gram)[m : m + k])) <= tolerance).all():
            break
        scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
        own, basis = np.linalg.eigh(gram * scale[:, None] * scale[None])
        keep = own > 1e-12 * own.max()
        basis = scale[:, None] * basis[:, keep] / np.sqrt(own[keep])
        values, rotation = np.linalg.eigh(basis.T @ ((energy + energy.T) / 2) @ basis)
        order = np.argsort(-values)[:m]
        values, change = values[order], basis @ rotation[:, order]
        step = change.copy()
        step[:m] = 0  # the part that isn't of the current vectors
        if turn == rounds:
            step = None

        def moved(it: Iterator[pa.RecordBatch], change: np.ndarray = change, step: np.ndarray | None = step, values: np.ndarray = values, more: bool = turn > 0) -> Iterator[pa.RecordBatch]:
            for batch in it:
                if not batch.num_rows:
                    continue
                b, ab = matrix(batch["b"]), matrix(batch["ab"])
                x, ax = b @ change, ab @ change
                p, ap = (b @ step, ab @ step) if more and step is not None else (np.zeros((len(b), 0)),) * 2
                parts = (x, ax, ax - x * values, p, ap)
                yield pa.RecordBatch.from_arrays([batch["node"], *(_rows(c) for c in parts)], ["node", "x", "ax", "r", "p", "ap"])

        names = "x array<double>, ax array<double>, r array<double>, p array<double>, ap array<double>"
        now = t.mapInArrow(moved, f"node {t.schema['node'].dataType.simpleString()}, {names}")
        t = written(joined(now, "r", len(values)).select("node", F.concat("x", "r", "p").alias("b"), F.concat("ax", "product", "ap").alias("ab")))
        m = len(values)
        size = m * (3 if turn else 2)
    # the first k columns of b are the vectors
    vectors = t.select("node", F.slice("b", 1, k).alias("q"))
    width = min(k, len(values))
    top = vectors.agg(*(F.max_by(F.get("q", c), F.struct(F.round(F.abs(F.get("q", c)), 9), "node")).alias(str(c)) for c in range(width))).first()
    return values[:k].tolist(), vectors.select("node", F.array(*(F.get("q", c) * (-1.0 if (top[str(c)] or 0) < 0 else 1.0) for c in range(width))).alias("q"))


def normalised(graph: DataFrame) -> DataFrame:
    """(i, j, w / sqrt(di dj)) in both directions of a graph (a, b, weight), d being sums of weights."""
    both = graph.where("a <> b").select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("weight").cast("double").alias("w"))
    both = both.union(both.select("j", "i", "w"))
    degree = both.groupBy("i").agg(F.sum("w").alias("d"))
    return both.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def _eigenmap(t: pa.Table, dimensions: int) -> pa.Table:
    """(node, q) of one component's cells by a dense matrix."""
    ids = np.unique(t["i"].to_numpy())
    a = np.zeros((len(ids), len(ids)))
    a[np.searchsorted(ids, t["i"].to_numpy()), np.searchsorted(ids, t["j"].to_numpy())] = t["w"].to_numpy()
    _, vectors = np.linalg.eigh(a)
    q = np.zeros((len(ids), dimensions))
    found = vectors[:, ::-1][:, 1 : dimensions + 1]
    q[:, : found.shape[1]] = found * np.sign(found[np.abs(np.round(found, 9)).argmax(0), np.arange(found.shape[1])])
    return pa.table([pa.array(ids), _rows(q)], names=["node", "q"])


def eigenmap(graph: DataFrame, vectors: DataFrame, dimensions: int = 2, dense: int = DENSE, tolerance: float = 1e-3, rounds: int = 8) -> DataFrame:
    """(node, component, q): for each component of a graph (a, b, weight) the eigenvectors of its normalised Laplacian that
    follow the constant one, by rising eigenvalue; rows (id, vector) without edges are components of their own, at 0.

    Components of up to `dense` nodes are solved in one task each, larger ones by `leading`, from the principal components of
    their rows as a first guess, to the given tolerance.
    """
    nodes = vectors.select(F.col("id").alias("node"))
    of = written(components(graph.select("a", "b"), nodes))
    sizes = written(of.groupBy("component").agg(F.count("*").alias("n")))
    cells = written(normalised(graph).join(of.select(F.col("node").alias("i"), "component"), "i"))
    small = cells.join(sizes.where(F.col("n") <= dense).select("component"), "component")
    found = small.groupBy("component").applyInArrow(lambda t: _eigenmap(t, dimensions), "node long, q array<double>")
    for r in sizes.where(F.col("n") > dense).select("component").collect():  # a few, of over `dense` nodes each
        own = of.where(F.col("component") == r["component"])
        k = dimensions + 1
        flat = cells.where(F.col("component") == r["component"]).groupBy("i").agg(F.sqrt(F.sum("w")).alias("root"))
        guess = principal_components(vectors.join(own.select(F.col("node").alias("id")), "id"), dimensions)
        noise = F.array(*(F.pmod(F.xxhash64(F.lit(c), "node"), F.lit(1 << 20)).cast("double") / (1 << 20) - 0.5 for c in range(2)))
        start = guess.select(F.col("id").alias("node"), F.col("projection").alias("p")).join(flat.withColumnRenamed("i", "node"), "node").select("node", F.concat(F.array(F.lit(1.0)), "p", noise).alias("q"))
        _, q = leading(cells.where(F.col("component") == r["component"]).select("i", "j", "w"), start, k, tolerance, rounds)
        found = found.union(q.select("node", F.slice("q", 2, dimensions).alias("q")))
    zero = F.array(*(F.lit(0.0) for _ in range(dimensions)))
    return of.join(found, "node", "left").select("node", "component", F.coalesce("q", zero).alias("q"))


def spectral_start(graph: DataFrame, vectors: DataFrame, dimensions: int = 2, seed: int = 42, **options) -> DataFrame:
    """(node, p): the components' eigenmaps, each spread to its room and placed by its rows' centroid, with a little noise, and
    every dimension stretched to 0..10.

    Centroids of several components are placed by their principal components; a component's room is half the way to the
    nearest other one.
    """
    q = written(eigenmap(graph, vectors, dimensions, **options))
    spread = q.groupBy("component").agg(F.max(F.array_max(F.transform("q", F.abs))).alias("spread"))
    each = range(dimensions)
    if spread.count() == 1:
        placed = q.crossJoin(spread.select("spread")).select("node", F.transform("q", lambda x: F.coalesce(F.try_divide(x, F.col("spread")), F.lit(0.0))).alias("p"))
    else:
        width = vectors.select(F.max(F.size("vector"))).first()[0]
        rows = vectors.join(q.select(F.col("node").alias("id"), "component"), "id")
        centroid = rows.groupBy("component").agg(*(F.avg(F.get("vector", d)).alias(str(d)) for d in range(width)))
        centroid = centroid.select(F.col("component").alias("id"), F.array(*(F.col(str(d)) for d in range(width))).alias("vector"))
        from nichegrid.operators.vectors import nearest

        if width > dimensions:
            centroid = principal_components(centroid, dimensions).withColumnRenamed("projection", "vector")
        centroid = written(centroid.select("id", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.get("vector", i), F.lit(0.0))).alias("vector")))
        room = nearest(centroid, 1).select(F.col("source").alias("component"), (F.col("distance") / 2).alias("room"))
        where = centroid.select(F.col("id").alias("component"), F.col("vector").alias("m")).join(room, "component").join(spread, "component")
        local = lambda i: F.coalesce(F.try_divide(F.get("q", i) * F.col("room"), F.col("spread")), F.lit(0.0))
        placed = q.join(where, "component").select("node", F.array(*(F.get("m", i) + local(i) for i in each)).alias("p"))
    placed = written(placed)
    ends = placed.agg(*(f(F.get("p", i)).alias(f"{name}{i}") for i in each for f, name in ((F.min, "lo"), (F.max, "hi")))).first()
    noise = [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "node"), F.lit(1 << 20)).cast("double") / (1 << 20) - 0.5 for i in each]
    stretched = [((F.get("p", i) - F.lit(ends[f"lo{i}"])) * (10 / (ends[f"hi{i}"] - ends[f"lo{i}"]) if ends[f"hi{i}"] > ends[f"lo{i}"] else 0.0) + 1e-4 * noise[i]) for i in each]
    return placed.select("node", F.array(*stretched).alias("p"))
