"""Clustering as iterative Spark jobs: k-means, diagonal Gaussian mixtures, communities, components."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichegrid.functions.lineage import written
from nichegrid.operators.features import relabelled


def kmeans(vectors: DataFrame, k: int, seed: int = 0, iterations: int = 100) -> DataFrame:
    """(id, niche) of rows (id, vector); a single niche needs no means."""
    if k < 2:
        return vectors.select("id", F.lit(0).cast("long").alias("niche"))
    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").cast("long").alias("niche"))


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """(id, projection): centred rows on the first k principal axes, each axis' largest entry being positive."""
    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="out").fit(rows)
    axes = model.pc.toArray()
    flip = np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    d = axes.shape[0]
    each = vectors.select("id", F.col("vector").cast("array<double>").alias("v"))
    mean = each.agg(*(F.avg(F.get("v", i)).alias(str(i)) for i in range(d))).first()
    shift = np.array([mean[str(i)] for i in range(d)]) @ axes * flip
    out = model.transform(rows).select("id", vector_to_array("out").alias("p"))
    return out.select("id", F.array(*((F.get("p", i) * float(flip[i]) - float(shift[i])) for i in range(k))).alias("projection"))


class Mixture:
    """A Gaussian mixture: weights (k), means (k by d), and covariances, as variances (k by d) or in full (k by d by d)."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray, floor: float = 1e-6):
        self.weights, self.means, self.full = weights, means, covariances.ndim == 3
        if self.full:
            self.factors = [factorised(c, floor) for c in covariances]
            self.logs = np.array([2 * np.log(np.diag(f)).sum() for f in self.factors])
        else:
            self.variances = covariances + floor
            self.logs = np.log(self.variances).sum(1)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for j, mean in enumerate(self.means):
            y = x - mean
            quad = (np.linalg.solve(self.factors[j], y.T) ** 2).sum(0) if self.full else (y * y / self.variances[j]).sum(1)
            out[:, j] = np.log(self.weights[j]) - 0.5 * (quad + x.shape[1] * np.log(2 * np.pi) + self.logs[j])
        return out


def factorised(covariance: np.ndarray, floor: float, tries: int = 12) -> np.ndarray:
    """The lower Cholesky factor of a covariance with `floor` on its diagonal, ten times as much after each failure."""
    for i in range(tries):
        try:
            return np.linalg.cholesky(covariance + floor * 10.0**i * np.eye(len(covariance)))
        except np.linalg.LinAlgError:
            continue
    raise ValueError("a covariance can't be made positive definite")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.array(b.column("vector").flatten(), dtype=float).reshape(b.num_rows, -1)


def _moments(vectors: DataFrame, weigh, shift: np.ndarray, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums over all rows of responsibilities r, of r y and of r y squared (or r y y', in full), with y = x - shift, and of the
    log-likelihood. With shifts near the means nothing cancels. Each task sends k (1 + 2 d) + 1 numbers, or k (1 + d + d d) + 1."""
    k, d = shift.shape
    size = k * (1 + d + (d * d if full else d)) + 1

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in it:
            if not b.num_rows:
                continue
            x = _matrix(b)
            r, likelihood = weigh(b, x)
            first, second = [], []
            for j in range(k):
                y = x - shift[j]
                first.append(r[:, j] @ y)
                second.append(((y * r[:, j, None]).T @ y).ravel() if full else r[:, j] @ (y * y))
            total += np.concatenate([r.sum(0), *first, *second, [likelihood]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "x"])

    out = np.zeros(size)
    for row in vectors.mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[row["at"]] = row["x"]
    return out[:k], out[k : k + k * d].reshape(k, d), out[k + k * d : -1].reshape((k, d, d) if full else (k, d)), float(out[-1])


def gaussian_mixture(vectors: DataFrame, k: int, seed: int = 42, tolerance: float = 1e-3, iterations: int = 100, floor: float = 1e-6, covariance: str = "diag") -> tuple[DataFrame, list[float]]:
    """((id, niche), mean log-likelihoods): EM from a k-means start; niches are numbered without gaps.

    covariance: "diag" or "full". What a covariance lacks to be positive definite is added to its diagonal, from `floor` on.
    """
    if covariance not in ("diag", "full"):
        raise ValueError(f"covariance must be diag or full, not {covariance!r}")
    full = covariance == "full"
    rows = written(vectors.select("id", F.col("vector").cast("array<double>").alias("vector")))
    d = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    n = rows.count()
    if not n:
        return rows.select("id", F.lit(None).cast("long").alias("niche")), []
    start = written(rows.join(kmeans(rows, k, seed), "id").select("id", "vector", "niche"))
    centre = np.array(rows.agg(*(F.avg(F.get("vector", i)) for i in range(d))).first(), float)

    def estimate(shift: np.ndarray, r: np.ndarray, first: np.ndarray, second: np.ndarray) -> Mixture:
        r = r + 1e-12
        off = first / r[:, None]
        if full:
            spread = second / r[:, None, None] - off[:, :, None] * off[:, None, :]
            return Mixture(r / r.sum(), shift + off, (spread + spread.transpose(0, 2, 1)) / 2, floor)
        return Mixture(r / r.sum(), shift + off, np.maximum(second / r[:, None] - off**2, 0), floor)

    hard = lambda b, x: (np.eye(k)[b.column("niche").to_numpy()], 0.0)
    shift = np.tile(centre, (k, 1))
    shift = estimate(shift, *_moments(start, hard, shift, False)[:2], np.ones((k, d, d) if full else (k, d))).means  # the means alone
    model = estimate(shift, *_moments(start, hard, shift, full)[:3])
    history: list[float] = []
    for _ in range(iterations):
        now = model

        def soft(b: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, float]:
            joint = now.log_joint(x)  # noqa: B023
            top = joint.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(joint - top).sum(1))
            return np.exp(joint - total[:, None]), float(total.sum())

        *moments, likelihood = _moments(rows, soft, now.means, full)
        history.append(likelihood / n)
        model = estimate(now.means, *moments)
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
            break
    last = model

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                joint = last.log_joint(_matrix(b))
                niche = k - 1 - joint[:, ::-1].argmax(1)  # the last of equal maxima
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(niche.astype(np.int64))], ["id", "niche"])

    return relabelled(written(rows.mapInArrow(assign, f"id {rows.schema['id'].dataType.simpleString()}, niche long"))), history


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that each node is linked with, by alternating large-star and small-star steps.

    nodes (node): adds those without edges, each a component of its own.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        ways = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = ways.join(ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    if nodes is not None:
        found = found.union(nodes.select("node", F.col("node").alias("component")))
    return found.groupBy("node").agg(F.min("component").alias("component"))


#: Nodes of a coarse graph, whose communities one task finds; satellites that an anchor takes in a round of coarsening.
BLOCK, SATELLITES = 1024, 4


def moved(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, seed: int, iterations: int = 2) -> np.ndarray:
    """The community of each of n nodes of a weighted graph, each edge (a, b) given once.

    Nodes, in an order shuffled by the seed, move to the neighbouring community with the largest gain in modularity, and
    neighbours of those that moved are looked at again, until the queue is empty. Communities are then refined: their
    nodes start alone and join a part of their community that they are linked with, so that parts are connected; parts
    become nodes, which begin in their communities, until nothing shrinks.
    """
    total = float(w.sum())
    label = np.arange(n)
    rng = np.random.default_rng(seed)
    if not total:
        return label

    def level(size: int, x: np.ndarray, y: np.ndarray, v: np.ndarray) -> tuple[list[list[tuple[int, float]]], np.ndarray]:
        near: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        degree = np.zeros(size)
        for i, j, u in zip(x.tolist(), y.tolist(), v.tolist(), strict=True):
            degree[i] += u
            degree[j] += u
            if i != j:
                near[i].append((j, u))
                near[j].append((i, u))
        return near, degree

    def move(near: list, degree: list[float], own: list[int], within: list[int] | None) -> bool:
        """within: a node may only join a part of its own community, and only while it is alone."""
        weight: dict[int, float] = {}
        count: dict[int, int] = {}
        for i, c in enumerate(own):
            weight[c] = weight.get(c, 0.0) + degree[i]
            count[c] = count.get(c, 0) + 1
        queue = deque(rng.permutation(len(own)).tolist())
        waiting, changed = [True] * len(own), False
        while queue:
            i = queue.popleft()
            waiting[i] = False
            c, k = own[i], degree[i]
            if within is not None and count[c] > 1:
                continue
            links: dict[int, float] = {}
            for j, u in near[i]:
                if within is None or within[j] == within[i]:
                    links[own[j]] = links.get(own[j], 0.0) + u
            price = resolution * k / (2 * total)
            best, gain = c, links.get(c, 0.0) - price * (weight[c] - k)
            for to, u in links.items():
                new = u - price * (weight[to] - (k if to == c else 0.0))
                if new > gain + 1e-12:
                    best, gain = to, new
            if best != c:
                changed = True
                weight[c] -= k
                weight[best] += k
                count[c] -= 1
                count[best] += 1
                own[i] = best
                if within is None:
                    for j, _ in near[i]:
                        if own[j] != best and not waiting[j]:
                            waiting[j] = True
                            queue.append(j)
        return changed

    for _ in range(iterations):
        x, y, v, of = a, b, w, np.arange(n)
        own = label.tolist()
        while True:
            size = len(own)
            near, degree = level(size, x, y, v)
            move(near, degree.tolist(), own, None)
            part = list(range(size))
            move(near, degree.tolist(), part, own)
            names, new = np.unique(part, return_inverse=True)
            label = np.array(own)[of]
            if len(names) == size:
                break
            of = new[of]
            pairs, back = np.unique(np.stack([np.minimum(new[x], new[y]), np.maximum(new[x], new[y])], 1), axis=0, return_inverse=True)
            v = np.bincount(back.ravel(), weights=v, minlength=len(pairs))
            x, y = pairs[:, 0], pairs[:, 1]
            community = np.zeros(len(names), np.int64)
            community[new] = own
            own = np.unique(community, return_inverse=True)[1].tolist()
        label = np.unique(label, return_inverse=True)[1]
    return label


def _ways(links: DataFrame) -> DataFrame:
    """(a, b, w) in both directions, loops once."""
    return links.select("a", "b", "w").union(links.where("a <> b").select("b", "a", "w"))


def _degrees(links: DataFrame) -> DataFrame:
    """(node, k): sums of weights, loops twice."""
    ends = links.select(F.col("a").alias("node"), "w").union(links.select(F.col("b").alias("node"), "w"))
    return ends.groupBy("node").agg(F.sum("w").alias("k"))


def _merged(links: DataFrame, to: DataFrame) -> DataFrame:
    """The links between what the nodes of (node, to) have become, loops included."""
    up = links.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
    return written(up.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))


def _before(part: str, order: tuple) -> Column:
    """Sum of k over the rows of a part that come before in some order."""
    return F.coalesce(F.sum("k").over(W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))


def coarsened(links: DataFrame, price: float, salt: int) -> DataFrame | None:
    """(node, to): nodes joined with an anchor whose link raises modularity; None if no link would.

    A hash makes every third node an anchor. Any other asks the best of its anchors, if that gains half as much as its best
    neighbour; an anchor takes SATELLITES at most, the best first, each of which must still gain with those before it.
    """
    degree = _degrees(links)
    k = lambda end: degree.select(F.col("node").alias(end), F.col("k").alias(f"k{end}"))
    gains = written(_ways(links.where("a <> b")).join(k("a"), "a").join(k("b"), "b").select("a", "b", F.col("ka").alias("k"), "kb", (F.col("w") - price * F.col("ka") * F.col("kb")).alias("gain")).where("gain > 1e-12"))
    if gains.isEmpty():
        return None
    anchor = lambda end: F.pmod(F.xxhash64(F.lit(salt), end), F.lit(3)) == 0
    best = gains.withColumn("most", F.max("gain").over(W.partitionBy("a"))).where(~anchor("a") & anchor("b") & (F.col("gain") >= F.col("most") / 2))
    asked = best.groupBy("a").agg(F.max_by(F.struct("b", "k", "gain"), F.struct(F.round("gain", 12), F.xxhash64("b"))).alias("m")).select("a", "m.*")
    order = (F.desc(F.round("gain", 12)), F.xxhash64("a"))
    taken = asked.withColumn("place", F.row_number().over(W.partitionBy("b").orderBy(*order))).where(F.col("place") <= SATELLITES)
    taken = taken.withColumn("before", _before("b", order)).where(F.col("gain") - price * F.col("k") * F.col("before") > 0)
    moves = taken.select(F.col("a").alias("node"), F.col("b").alias("to"))
    return written(degree.select("node").join(moves, "node", "left").select("node", F.coalesce("to", "node").alias("to")))


def refined(ways: DataFrame, degree: DataFrame, place: DataFrame, price: float, sweeps: int, salt: int) -> tuple[DataFrame, bool]:
    """((node, to), whether any moved): nodes moved to the neighbouring community with the largest gain until none gains.

    In a sweep only nodes move that gain more than each neighbour which would move too (ties by hash), and only while they
    gain with all those counted that come before them into their new community or out of their old one, so that every sweep
    raises modularity, and the node that gains most always moves.
    """
    own = written(degree.join(place, "node").select("node", "k", F.col("to").alias("c")))
    any_moved = False
    for sweep in range(sweeps):
        weight = own.groupBy("c").agg(F.sum("k").alias("kc"))
        to = ways.where("a <> b").join(own.select(F.col("node").alias("b"), F.col("c").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("w"))
        options = to.union(own.select("node", "c", F.lit(0.0))).groupBy("a", "to").agg(F.sum("w").alias("w"))
        options = options.join(own.select(F.col("node").alias("a"), "k", F.col("c").alias("now")), "a").join(weight.withColumnRenamed("c", "to"), "to")
        here = F.col("to") == F.col("now")
        gain = F.col("w") - price * F.col("k") * (F.col("kc") - F.when(here, F.col("k")).otherwise(0.0))
        best = options.select("a", "k", "now", "to", here.alias("here"), gain.alias("gain")).groupBy("a", "k", "now").agg(F.max_by("to", F.struct("gain", "here", F.xxhash64("to"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("here"), F.col("gain"))).alias("stay"))
        rank = F.struct(F.round(F.col("gain") - F.col("stay"), 12).alias("gain"), F.xxhash64(F.lit(salt + sweep), "a").alias("h"))
        movers = written(best.where("to <> now AND gain - stay > 1e-9").select(F.col("a").alias("node"), "k", "now", "to", rank.alias("rank")))
        if movers.isEmpty():
            return own.select("node", F.col("c").alias("to")), any_moved
        end = lambda name: movers.select(F.col("node").alias(name), F.col("rank").alias(f"r{name}"))  # noqa: B023, E731
        beaten = ways.where("a <> b").join(end("a"), "a").join(end("b"), "b").where("rb > ra").select(F.col("a").alias("node")).distinct()
        free = movers.join(beaten, "node", "left_anti")
        order = (F.desc("rank"),)
        kept = free.withColumn("before", _before("to", order) + _before("now", order)).where(F.col("rank.gain") - price * F.col("k") * F.col("before") > 0)
        own = written(own.join(kept.select("node", F.col("to").alias("new")), "node", "left").select("node", "k", F.coalesce("new", "c").alias("c")))
        any_moved = True
    raise RuntimeError(f"nodes still move after {sweeps} sweeps")


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = 0, sweeps: int = 1000, levels: int = 64, block: int = BLOCK) -> DataFrame:
    """(node, niche): communities of a weighted graph (a, b, weight) that raise modularity with a resolution.

    Linked nodes are joined until a coarse graph has `block` nodes at most, or no join would raise modularity; one task finds
    the coarse graph's communities node by node (`moved`); then nodes of the whole graph move between them until none gains.
    This is repeated with the communities as nodes until nothing changes; communities that aren't connected are split at
    last. Every step is a few joins and aggregates over the links; only counts come to the driver. `sweeps` and `levels` are
    guards, and reaching one is an error. Nodes without links are communities of their own.
    """
    links = written(edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w")))
    total = links.agg(F.sum("w")).first()[0]
    alone = nodes.select("node", F.col("node").alias("c"))
    if not total:
        return relabelled(alone.select("node", F.col("c").alias("niche")))
    price = resolution / (2 * total)
    ways, degree = written(_ways(links)), written(_degrees(links))
    place = written(degree.select("node", F.col("node").alias("to")))

    def onward(place: DataFrame, to: DataFrame) -> DataFrame:
        return written(place.join(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))

    def solve(t: pa.Table) -> pa.Table:
        ids = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]))
        t = t.sort_by([("a", "ascending"), ("b", "ascending")])
        a, b = (np.searchsorted(ids, t[c].to_numpy()) for c in ("a", "b"))
        label = moved(len(ids), a, b, t["w"].to_numpy(), resolution, seed)
        first = np.zeros(int(label.max(initial=0)) + 1, np.int64)
        first[label[::-1]] = ids[::-1]  # a community has the name of its first node
        return pa.table([pa.array(ids), pa.array(first[label])], names=["node", "to"])

    size = place.count()
    for level in range(levels):
        coarse, to = _merged(links, place), place
        n = size
        for turn in range(levels):
            if n <= block or (step := coarsened(coarse, price, seed * 1_000_003 + level * 1009 + turn)) is None:
                break
            to, coarse = onward(to, step), _merged(coarse, step)
            n = step.select("to").distinct().count()
        else:
            raise RuntimeError(f"the number of nodes still shrinks after {levels} levels")
        if n <= block:
            to = onward(to, written(coarse.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(lambda t: solve(t.select(["a", "b", "w"])), "node long, to long")))
        place, moving = refined(ways, degree, to, price, sweeps, seed + level)
        before, size = size, place.select("to").distinct().count()
        if size == before and not moving:
            break
    else:
        raise RuntimeError(f"communities still change after {levels} levels")
    inside = ways.where("a < b").join(place.select(F.col("node").alias("a"), F.col("to").alias("ca")), "a").join(place.select(F.col("node").alias("b"), F.col("to").alias("cb")), "b")
    parts = components(inside.where("ca = cb").select("a", "b"), nodes.select("node"))
    return relabelled(written(parts.select("node", F.col("component").alias("niche"))))


def communities_apart(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = 0, **options) -> DataFrame:
    """(by, node, niche): the communities of many graphs (by, a, b, weight), found together; nodes (by, node) must differ
    between graphs. Niches are numbered from 0 in each graph, in order of their smallest nodes.

    A move gains w - resolution k k' / 2m in a graph of total weight m. Graphs that are scaled to one total M, S of them,
    have in their union a price of resolution / 2 S M, so S times the resolution gives each graph its own price back, and
    gains are those of the graph on its own but for its scale.
    """
    total = written(edges.groupBy("by").agg(F.sum("weight").alias("total")).where("total > 0"))
    graphs, mean = total.agg(F.count("*"), F.avg("total")).first()
    links = edges.join(total, "by").select("a", "b", (F.col("weight") * mean / F.col("total")).alias("weight")) if graphs else edges.select("a", "b", "weight")
    found = communities(links, nodes.select("node"), resolution * graphs, seed, **options)
    labels = written(nodes.select("by", "node").join(found, "node"))
    own = labels.groupBy("by", "niche").agg(F.min("node").alias("least"))
    names = own.select("by", "niche", (F.row_number().over(W.partitionBy("by").orderBy("least")) - 1).cast("long").alias("own"))
    return labels.join(names, ["by", "niche"]).select("by", "node", F.col("own").alias("niche"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of labels (node, niche) on a weighted graph (a, b, weight)."""
    ends = edges.join(labels.select(F.col("node").alias("a"), F.col("niche").alias("na")), "a").join(labels.select(F.col("node").alias("b"), F.col("niche").alias("nb")), "b")
    inside = ends.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("na") == F.col("nb"), F.col("weight")).otherwise(0.0)).alias("within"))
    degree = ends.select(F.col("na").alias("n"), "weight").union(ends.select(F.col("nb").alias("n"), "weight")).groupBy("n").agg(F.sum("weight").alias("k"))
    squares = degree.agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return inside.crossJoin(squares).select((F.col("within") / F.col("m") - resolution * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def _nearest_outside(inside: DataFrame, outside: DataFrame, block: int = 4096) -> DataFrame:
    """(id, d, to): for each row (id, v) the least squared distance to the rows (to, w) of each block, ties to the lower `to`.

    Both sides are dealt into blocks, and every pair of blocks meets in one task, which sends one row an id on.
    """
    nr, nl = (max(1, -(-df.count() // block)) for df in (outside, inside))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = inside.select("id", "v", deal("id", nl).alias("i"), every(nr).alias("j"))
    right = outside.select("to", "w", every(nl).alias("i"), deal("w", nr).alias("j"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int64())], names=["id", "d", "to"])
        b = b.sort_by("to")
        x, y = (np.array(t[c].combine_chunks().flatten(), float).reshape(t.num_rows, -1) for t, c in ((a, "v"), (b, "w")))
        d = [((y - v) ** 2).sum(1) for v in x]
        at = [int(row.argmin()) for row in d]
        return pa.table([a["id"].cast(pa.int64()), pa.array([float(row[i]) for row, i in zip(d, at, strict=True)]), b["to"].take(pa.array(at)).cast(pa.int64())], names=["id", "d", "to"])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "id long, d double, to long")


def merge_smallest(labels: DataFrame, vectors: DataFrame, voters: int = 20, percent: float = 25.0, ratio: float = 0.1, threshold: float | None = None, force: bool = False) -> tuple[DataFrame, bool]:
    """(labels (id, niche), whether anything merged): the smallest niche (of equals the lowest) dissolved into a neighbour.

    It is dissolved if it has fewer rows than `threshold`, by default `ratio` times the `percent`-th percentile of the
    niches' sizes, or if forced. Each of its rows finds the nearest row outside (of equals the lower niche); the
    `voters` rows that are nearest to the outside vote with that row's niche, and of equal votes the lower niche wins.
    Only the smallest niche's rows are compared with all others.
    """
    sizes = labels.groupBy("niche").agg(F.count("*").alias("n"))
    s = sizes.agg(F.min_by("niche", F.struct("n", "niche")).alias("gone"), F.min("n").alias("least"), F.count("*").alias("k"), F.percentile("n", F.lit(percent / 100)).alias("p")).first()
    if s["k"] < 2 or not force and s["least"] >= (s["p"] * ratio if threshold is None else threshold):
        return labels, False
    rows = labels.join(vectors.select("id", F.col("vector").cast("array<double>").alias("v")), "id")
    inside = rows.where(F.col("niche") == s["gone"]).select("id", "v")
    outside = rows.where(F.col("niche") != s["gone"]).select(F.col("niche").alias("to"), F.col("v").alias("w"))
    nearest_ = _nearest_outside(inside, outside).groupBy("id").agg(F.min(F.struct("d", "to")).alias("m"))
    votes = nearest_.select("m.*").orderBy("d", "to").limit(max(1, min(voters, s["least"]))).groupBy("to").agg(F.count("*").alias("n"))
    into = votes.agg(F.max_by("to", F.struct("n", -F.col("to"))).alias("into")).first()["into"]
    return labels.select("id", F.when(F.col("niche") == s["gone"], F.lit(into)).otherwise(F.col("niche")).alias("niche")), True


def merge_until(labels: DataFrame, vectors: DataFrame, niches: int | None = None, force: bool = False, **options) -> DataFrame:
    """Merges the smallest niche again and again, until none is small enough or `niches` are left; numbered without gaps.
    With force, merging goes on past the size threshold until `niches` are left."""
    now, going = labels.select("id", "niche"), True
    while going:
        if niches is not None and now.select("niche").distinct().count() <= niches:
            break
        if force and niches is None:
            raise ValueError("forced merging needs a number of niches")
        now, going = merge_smallest(now, vectors, force=force, **options)
        now = written(now)
    return relabelled(now)


def neighbour_graph(near: DataFrame) -> DataFrame:
    """(a, b, weight 1): undirected edges to the nearest neighbours."""
    return near.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct().withColumn("weight", F.lit(1.0))


def ranked_labels(labels: DataFrame) -> DataFrame:
    """(niche, n) by falling size."""
    return labels.groupBy("niche").agg(F.count("*").alias("n")).select("niche", "n", F.row_number().over(W.orderBy(F.col("n").desc(), "niche")).alias("place"))


def spectral(vectors: DataFrame, k: int, seed: int = 0, gamma: float = 1.0, most: int = 4096, rounds: int = 100) -> DataFrame:
    """(id, niche): k-means on the leading eigenvectors of the normalised affinity exp(-gamma d**2) of all pairs of rows.

    More than `most` rows are an error, as the affinity has a cell for each pair. The cells stay distributed
    (eigen.leading); only products of columns come to the driver.
    """
    from nichegrid.operators.eigen import leading

    rows = written(vectors.select("id", F.col("vector").cast("array<double>").alias("v")))
    n = rows.count()
    if n > most:
        raise ValueError(f"spectral clustering takes {most} rows at most, not {n}")
    k = min(k, n)
    d2 = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    cells = written(rows.join(rows.select(F.col("id").alias("j"), F.col("v").alias("w"))).select(F.col("id").alias("i"), "j", F.exp(-gamma * d2).alias("w")))
    degree = written(cells.groupBy("i").agg(F.sum("w").alias("d")))
    cells = cells.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    cells = written(cells.select("i", "j", (F.col("w") / F.sqrt(F.col("d") * F.col("dj"))).alias("w")))
    noise = (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), "i"), F.lit(1 << 20)).cast("double") / (1 << 20) - 0.5 for c in range(k + 1))
    start = degree.select(F.col("i").alias("node"), F.array(F.sqrt("d"), *noise).alias("q"))
    _, q = leading(cells, start, k, 1e-5, rounds)
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    unit = q.select(F.col("node").alias("id"), F.transform("q", lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0))).alias("vector"))
    return relabelled(written(kmeans(unit, k, seed)))
