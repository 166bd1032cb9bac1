"""A low-dimensional layout of a fuzzy neighbour graph: rounds of forces on blocks of nodes that exchange their places."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichegrid.functions.lineage import written
from nichegrid.operators.clustering import principal_components
from nichegrid.operators.descent import matrix
from nichegrid.operators.eigen import spectral_start
from nichegrid.operators.vectors import fuzzy_graph, nearest


def curve(spread: float = 1.0, min_dist: float = 0.1) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d**(2 b)), fitted to a curve that is 1 up to min_dist and falls off with spread: least squares
    over 300 distances up to 3 spreads, by damped Gauss-Newton steps on (ln a, b)."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    la, b, damping = 0.0, 1.0, 1e-3
    value = lambda la, b: 1 / (1 + np.exp(la) * x ** (2 * b))
    error = lambda la, b: float(((value(la, b) - y) ** 2).sum())
    for _ in range(200):
        f = value(la, b)
        slope = -f * (1 - f)
        j = np.stack([slope, slope * 2 * np.log(x)], 1)
        step = np.linalg.solve(j.T @ j + damping * np.eye(2), -j.T @ (f - y))
        if error(la + step[0], b + step[1]) < error(la, b):
            la, b, damping = la + step[0], b + step[1], damping / 3
            if np.abs(step).max() < 1e-10:
                break
        else:
            damping *= 4
    return float(np.exp(la)), float(b)


def start(vectors: DataFrame, dimensions: int = 2) -> DataFrame:
    """(node, p): principal components, each stretched to 0..10."""
    p = written(principal_components(vectors, dimensions))
    low, high = ([F.col("s")[f"{what}{i}"] for i in range(dimensions)] for what in ("lo", "hi"))
    ends = p.agg(F.struct(*(f(F.get("projection", i)).alias(f"{name}{i}") for i in range(dimensions) for f, name in ((F.min, "lo"), (F.max, "hi")))).alias("s"))
    return p.crossJoin(ends).select(F.col("id").alias("node"), F.array(*(F.coalesce(F.try_divide((F.get("projection", i) - low[i]) * 10, high[i] - low[i]), F.lit(0.0)) for i in range(dimensions))).alias("p"))


#: Nodes of a block, whose places one task moves; blocks of a range of places.
BLOCK, BLOCKS_OF_RANGE = 4096, 8
#: Blocks that a node's place is sent to, to push off their nodes.
CALLS = 4


def draws(seed: int, epoch: int, i: np.ndarray, j: np.ndarray, count: int, n: int) -> np.ndarray:
    """`count` numbers below n for each edge between nodes i and j, drawn by hashing (seed, epoch, edge, number)."""
    at = (np.uint64(((seed << 40) ^ (epoch << 8)) & ((1 << 64) - 1)) ^ np.arange(count, dtype=np.uint64))[:, None]
    h = ((i.astype(np.uint64) << np.uint64(32)) ^ j.astype(np.uint64))[None] ^ at
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values of a public 64-bit mixer
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return (h % np.uint64(n)).astype(np.int64)


@dataclass(frozen=True)
class Forces:
    """The curve's numbers, pushes for each pull, the first step's length, and all rounds."""

    a: float
    b: float
    negatives: int
    rate: float
    epochs: int
    seed: int

    def rounds(self, p: np.ndarray, n: int, i: np.ndarray, j: np.ndarray, share: np.ndarray, pool: np.ndarray, ids: np.ndarray, first: int, end: int) -> np.ndarray:
        """Places of the first n rows of p after the rounds from `first` up to `end`; the others stay.

        i, j: places in p of the ends of each edge, sorted by i, which are below n; pool: places in p to push off; ids: the
        nodes of p, which the draws depend on. All forces of a round are taken at its start.
        """
        p = p.copy()
        for epoch in range(first, end):
            due = np.flatnonzero(np.floor(share * (epoch + 1)) > np.floor(share * epoch))
            if not len(due):
                continue
            own, other = i[due], j[due]
            apart = p[own] - p[other]
            d2 = (apart * apart).sum(1)
            safe = np.where(d2 > 0, d2, 1.0)
            power = safe**self.b
            force = np.clip(np.where(d2 > 0, -2 * self.a * self.b * power / (safe * (1 + self.a * power)), 0.0)[:, None] * apart, -4, 4)
            if self.negatives and len(pool):
                pick = pool[draws(self.seed, epoch, ids[own], ids[other], self.negatives, len(pool))]
                apart = p[own][None] - p[pick]
                d2 = (apart * apart).sum(2)
                size = np.where(pick == own, 0.0, 2 * self.b / ((0.001 + d2) * (1 + self.a * d2**self.b)))
                force += np.clip(size[..., None] * apart, -4, 4).sum(0)
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            p[own[begins]] += self.rate * (1 - epoch / self.epochs) * np.add.reduceat(force, begins, axis=0)
        return p[:n]


def _interleaved(p: str, low: list[float], high: list[float], bits: int = 16) -> Column:
    """A place's number along a curve that keeps near ones together: the bits of its first two coordinates in turn, as parts of
    their ranges."""
    scale = [((1 << bits) - 1) / (b - a) if b > a else 0.0 for a, b in zip(low, high, strict=True)]
    out = F.lit(0).cast("long")
    for d in range(2):
        x = F.floor((F.coalesce(F.get(p, d), F.lit(0.0)) - low[d]) * scale[d]).cast("long")
        for step in (8, 4, 2, 1):
            mask = sum(((1 << step) - 1) << (2 * step * k) for k in range(bits // step))
            x = x.bitwiseOR(F.shiftleft(x, step)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(x, d))
    return out


def dealt(place: DataFrame, n: int, block: int) -> DataFrame:
    """(node, block, p): nodes dealt into blocks of at most `block` that lie near each other, numbered without gaps."""
    ranges = max(1, -(-n // (block * BLOCKS_OF_RANGE)))

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0  # type: ignore[union-attr]
        for b in it:
            at = np.arange(seen, seen + b.num_rows) // block + (part << 32)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(at), b["p"]], ["node", "name", "p"])

    ends = place.agg(*(f(F.coalesce(F.get("p", d), F.lit(0.0))) for f in (F.min, F.max) for d in (0, 1))).first()
    ordered = place.select("node", "p", _interleaved("p", list(ends[:2]), list(ends[2:])).alias("z")).repartitionByRange(ranges, "z", "node").sortWithinPartitions("z", "node")
    named = written(ordered.drop("z").mapInArrow(number, "node long, name long, p array<double>"))
    numbers = named.select("name").distinct().select("name", (F.row_number().over(W.orderBy("name")) - 1).alias("block"))  # one row a block
    return written(named.join(numbers, "name").select("node", "block", "p"))


_PACK = "block int, nodes array<long>, i array<int>, j array<int>, share array<double>, foreign array<long>"


def packed(graph: DataFrame, places: DataFrame) -> DataFrame:
    """For each block one row: its nodes, its edges as places among its nodes and `foreign`, the nodes of other blocks that they
    lead to, and each edge's weight over the largest."""
    top = graph.agg(F.max("weight")).first()[0] or 1.0
    ends = graph.select(F.col("a").alias("i"), F.col("b").alias("j"), "weight").union(graph.select(F.col("b").alias("i"), F.col("a").alias("j"), "weight"))
    rows = ends.join(places.select(F.col("node").alias("i"), "block"), "i").select("block", "i", "j", (F.col("weight") / F.lit(top)).alias("share"))
    rows = rows.union(places.select("block", F.col("node").alias("i"), F.lit(None).cast("long"), F.lit(None).cast("double")))

    def pack(t: pa.Table) -> pa.Table:
        nodes = np.sort(t.filter(pc.is_null(t["j"]))["i"].to_numpy())
        e = t.filter(pc.is_valid(t["j"])).sort_by([("i", "ascending"), ("j", "ascending")])
        i, j = e["i"].to_numpy(), e["j"].to_numpy()
        foreign = np.setdiff1d(j, nodes)
        inside = np.minimum(np.searchsorted(nodes, j), len(nodes) - 1)
        at = np.where(nodes[inside] == j, inside, len(nodes) + np.searchsorted(foreign, j))
        whole = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table([t["block"][:1].combine_chunks(), whole(nodes, pa.int64()), whole(np.searchsorted(nodes, i).astype(np.int32), pa.int32()), whole(at.astype(np.int32), pa.int32()), whole(e["share"].to_numpy(), pa.float64()), whole(foreign, pa.int64())], names=["block", "nodes", "i", "j", "share", "foreign"])

    return written(rows.groupBy("block").applyInArrow(pack, _PACK))


def borders(epochs: int, exchanges: int) -> list[int]:
    """Rounds after which blocks exchange places: more often at first, while nodes move far."""
    return sorted({round(epochs * (t / exchanges) ** 1.5) for t in range(exchanges)} | {0, epochs})


def optimize(graph: DataFrame, place: DataFrame, epochs: int, a: float, b: float, dimensions: int = 2, negatives: int = 5, rate: float = 1.0, seed: int = 42, block: int = BLOCK, exchanges: int = 9) -> DataFrame:
    """(node, p) after `epochs` rounds over (a, b, weight) edges from places (node, p).

    An edge pulls its ends in a share of rounds that is its weight over the largest; each end is then pushed off `negatives`
    other nodes, which a hash of (seed, round, edge, number) picks from a pool. Nodes are dealt into blocks of at most
    `block` that start near each other. A task moves the nodes of a block through some rounds, while the ends of its edges in
    other blocks, and its pool, stay where they were at the last exchange; the pool holds every node once for each of CALLS
    blocks that a hash picks. An exchange is one job, whose shuffle has a row for each node, each call and each pair of a
    block and a node that its edges lead to. Work is the same however many blocks there are; a single one needs no exchange.
    """
    n = place.count()
    if n < 2 or not epochs:
        return place
    places = dealt(place.select("node", F.col("p").cast("array<double>").alias("p")), n, block)
    packs = packed(graph, places)
    wanted = written(packs.select("block", F.explode("foreign").alias("node")))
    blocks = packs.count()
    forces = Forces(a, b, negatives, rate, epochs, seed)
    stops = borders(epochs, exchanges) if blocks > 1 else [0, epochs]
    for first, end in zip(stops, stops[1:], strict=False):
        calls = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(CALLS)), lambda r: F.pmod(F.xxhash64(F.lit(seed), F.lit(first), "node", r), F.lit(blocks)).cast("int")))  # noqa: B023
        own = places.select("block", "node", "p", F.lit(0).alias("kind"))
        foreign = wanted.join(places.select("node", "p"), "node").select("block", "node", "p", F.lit(1).alias("kind"))
        pool = places.select(F.explode(calls).alias("block"), "node", "p", F.lit(2).alias("kind"))

        def move(pack: pa.Table, rows: pa.Table) -> pa.Table:
            nodes, i, j, share, foreign = (pack[c][0].values.to_numpy() for c in ("nodes", "i", "j", "share", "foreign"))
            rows = rows.sort_by([("kind", "ascending"), ("node", "ascending")])
            kind, ids = rows["kind"].to_numpy(), rows["node"].to_numpy()
            p = matrix(rows["p"].combine_chunks())
            at = np.flatnonzero(kind == 2)  # the pool's rows; those of own nodes move with them
            inside = np.minimum(np.searchsorted(nodes, ids[at]), len(nodes) - 1)
            pool = np.where(nodes[inside] == ids[at], inside, at)
            out = forces.rounds(p, len(nodes), i, j, share, pool, ids, first, end)  # noqa: B023
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            return pa.table([pa.array(nodes), pa.array(np.full(len(nodes), pack["block"][0].as_py(), np.int32)), lists], names=["node", "block", "p"])

        everything = own.union(foreign).union(pool)
        places = written(packs.groupBy("block").cogroup(everything.groupBy("block")).applyInArrow(move, "node long, block int, p array<double>"))
    return places.select("node", "p")


def umap(vectors: DataFrame, neighbours: int = 15, dimensions: int = 2, metric: str = "euclidean", min_dist: float = 0.1, epochs: int | None = None, seed: int = 42, search: str = "exact", begin: str = "spectral") -> DataFrame:
    """(node, p) of rows (id, vector): neighbours, fuzzy graph, a start, rounds of forces.

    begin: "spectral" starts from eigenvectors of the graph, "pca" from principal components of the rows. `neighbours` counts
    the row itself. Fewer than three rows keep their principal components. By default there are 500 rounds for up to 10,000
    rows and 200 for more.
    """
    n = vectors.count()
    if n < 3:
        return start(vectors, dimensions)
    if epochs is None:
        epochs = 500 if n <= 10_000 else 200
    graph = written(fuzzy_graph(written(nearest(vectors, neighbours - 1, metric, search, seed))))
    place = written(spectral_start(graph, vectors, dimensions, seed)) if begin == "spectral" else start(vectors, dimensions)
    a, b = curve(1.0, min_dist)
    return optimize(graph, place, epochs, a, b, dimensions, seed=seed)
