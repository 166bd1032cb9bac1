"""Which labels mix with which: mixing matrices, assortativity and its permutation null, in long form."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichegrid.functions.lineage import written
from nichegrid.operators.graph import SAMPLE, TILE, both_ways, largest_sample

NAN = float("nan")


def vocabulary(nodes: DataFrame) -> DataFrame:
    """(phenotype, idx): the distinct labels of the cohort in code-point order, nulls left out."""
    labels = nodes.select("phenotype").where(F.col("phenotype").isNotNull()).distinct()
    return labels.select("phenotype", (F.row_number().over(W.orderBy("phenotype")) - 1).cast("long").alias("idx"))


def abundance(nodes: DataFrame) -> DataFrame:
    """(patient, sample, phenotype, n, share): share of all nodes of the sample, unlabelled ones included."""
    n = nodes.groupBy(*SAMPLE, "phenotype").agg(F.count("*").alias("n"))
    return n.select(*SAMPLE, "phenotype", "n", (F.col("n") / F.sum("n").over(W.partitionBy(*SAMPLE))).alias("share")).where(F.col("phenotype").isNotNull())


def labelled_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(patient, sample, a, b) for both directions of every edge whose ends both carry a label."""
    out = both_ways(edges)
    for side, name in (("source", "a"), ("target", "b")):
        n = nodes.where(F.col("phenotype").isNotNull()).select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.col("node_id").alias("_id"), F.col("phenotype").alias(name))
        out = out.join(n, out["patient"].eqNullSafe(n["_patient"]) & out["sample"].eqNullSafe(n["_sample"]) & (out[side] == n["_id"])).drop("_patient", "_sample", "_id")
    return out.select(*SAMPLE, "a", "b")


def mixing_matrix(edges: DataFrame, nodes: DataFrame, normalized: bool = False, double_diagonal: bool = True) -> DataFrame:
    """(patient, sample, a, b, value) of the cells that aren't 0.

    Every edge counts for (a, b) and (b, a), so that the diagonal counts each edge twice, unless double_diagonal is
    off. normalized divides by the matrix's sum.
    """
    counts = labelled_pairs(edges, nodes).groupBy(*SAMPLE, "a", "b").agg(F.count("*").cast("double").alias("value"))
    if not double_diagonal:
        counts = counts.withColumn("value", F.when(F.col("a") == F.col("b"), F.col("value") / 2).otherwise(F.col("value")))
    if normalized:
        counts = counts.withColumn("value", F.col("value") / F.sum("value").over(W.partitionBy(*SAMPLE)))
    return counts


def coefficient(matrix: DataFrame) -> DataFrame:
    """(patient, sample, assortativity) of normalised matrices: (trace - sum_k a_k b_k) / (1 - sum_k a_k b_k).

    With a single label that is 0 / 0, which gives NaN.
    """
    rows = matrix.groupBy(*SAMPLE, F.col("a").alias("k")).agg(F.sum("value").alias("r"), F.sum(F.when(F.col("a") == F.col("b"), F.col("value")).otherwise(0.0)).alias("d"))
    cols = matrix.groupBy(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.col("b").alias("_k")).agg(F.sum("value").alias("c"))
    both = rows.join(cols, rows["patient"].eqNullSafe(cols["_patient"]) & rows["sample"].eqNullSafe(cols["_sample"]) & (rows["k"] == cols["_k"]))
    sums = both.groupBy(*SAMPLE).agg(F.sum("d").alias("trace"), F.sum(F.col("r") * F.col("c")).alias("ab"))
    return sums.select(*SAMPLE, ratio(F.col("trace") - F.col("ab"), F.lit(1.0) - F.col("ab")).alias("assortativity"))


def ratio(a: Column, b: Column) -> Column:
    """Division where 0 / 0 is NaN and x / 0 infinite, instead of an error."""
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), NAN).otherwise(F.when(a > 0, float("inf")).otherwise(float("-inf")))


def assortativity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return coefficient(mixing_matrix(edges, nodes, normalized=True))


_RANDOM = "patient string, sample string, rep int, a string, b string, value double"


def _in_samples(edges: DataFrame, nodes: DataFrame, n_shuffle: int, seed: int) -> DataFrame:
    """Rows of _RANDOM, a task a sample; only label-by-label shares leave it."""

    def shuffled(n: pa.Table, e: pa.Table) -> pa.Table:
        n = n.sort_by("node_id")
        if not n.num_rows:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())], names=["patient", "sample", "rep", "a", "b", "value"])
        ids, label = n["node_id"].to_numpy(), n["phenotype"].combine_chunks().dictionary_encode()
        if isinstance(label, pa.ChunkedArray):
            label = label.combine_chunks()
        code, names = label.indices.fill_null(-1).to_numpy(), label.dictionary
        ends = np.stack([e[c].to_numpy() for c in ("source", "target")])
        ends = ends[:, np.isin(ends, ids).all(0)]
        i, j = np.searchsorted(ids, ends)
        own = [n[c][0].as_py() for c in SAMPLE]
        rng = np.random.default_rng([seed, *(zlib.crc32(f"{x is None}{x}".encode()) for x in own)])
        k, out = len(names), []
        for rep in range(n_shuffle):
            given = code[rng.permutation(len(code))]
            a, b = given[i], given[j]
            known = (a >= 0) & (b >= 0)
            count = np.bincount(a[known] * k + b[known], minlength=k * k).reshape(k, k) if k else np.zeros((0, 0))
            count = count + count.T
            x, y = np.nonzero(count)
            out.append((np.full(len(x), rep, np.int32), x, y, count[x, y] / max(1, count.sum())))
        rep, x, y, value = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([pa.array([own[0]] * len(rep), pa.string()), pa.array([own[1]] * len(rep), pa.string()), rep, names.take(pa.array(x)), names.take(pa.array(y)), value], names=["patient", "sample", "rep", "a", "b", "value"])

    right = edges.select(*(F.col(c).alias(c) for c in (*SAMPLE, "source", "target")))
    return nodes.select(*SAMPLE, "node_id", "phenotype").groupBy(*SAMPLE).cogroup(right.groupBy(*SAMPLE)).applyInArrow(shuffled, _RANDOM)


def permutations(edges: DataFrame, nodes: DataFrame, n_shuffle: int, seed: int = 0, tile: int = TILE) -> DataFrame:
    """(patient, sample, rep, a, b, value): the normalised matrices of n_shuffle random labellings.

    Labels, missing ones included, are permuted over the nodes of their sample. If all samples have at most `tile` nodes,
    each is one task's. Else each repetition orders nodes by a hash
    of (seed, repetition, node), and gives the i-th node in that order the label of the i-th node: no task holds a
    sample's graph, it is a window and two joins for all samples and repetitions at once.
    """
    if largest_sample(nodes) <= tile:
        return _in_samples(edges, nodes, n_shuffle, seed)
    labels = nodes.select(*SAMPLE, "node_id", "phenotype")
    place = W.partitionBy(*SAMPLE).orderBy("node_id")
    ranked = labels.select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.row_number().over(place).alias("_place"), "phenotype")
    shuffled = labels.select(*SAMPLE, "node_id", F.explode(F.sequence(F.lit(0), F.lit(n_shuffle - 1))).alias("rep"))
    order = W.partitionBy(*SAMPLE, "rep").orderBy(F.xxhash64(F.lit(seed), "rep", "node_id"), "node_id")
    shuffled = shuffled.select("*", F.row_number().over(order).alias("place"))
    given = shuffled.join(ranked, shuffled["patient"].eqNullSafe(ranked["_patient"]) & shuffled["sample"].eqNullSafe(ranked["_sample"]) & (shuffled["place"] == ranked["_place"])).where(F.col("phenotype").isNotNull()).select(*SAMPLE, "rep", "node_id", "phenotype")
    out = both_ways(edges)
    first = given.select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), "rep", F.col("node_id").alias("_id"), F.col("phenotype").alias("a"))
    out = out.join(first, out["patient"].eqNullSafe(first["_patient"]) & out["sample"].eqNullSafe(first["_sample"]) & (out["source"] == first["_id"])).drop("_patient", "_sample", "_id")
    second = given.select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.col("rep").alias("_rep"), F.col("node_id").alias("_id"), F.col("phenotype").alias("b"))
    out = out.join(second, out["patient"].eqNullSafe(second["_patient"]) & out["sample"].eqNullSafe(second["_sample"]) & (out["target"] == second["_id"]) & (out["rep"] == second["_rep"])).select(*SAMPLE, "rep", "a", "b")
    counts = out.groupBy(*SAMPLE, "rep", "a", "b").agg(F.count("*").cast("double").alias("value"))
    return counts.withColumn("value", F.col("value") / F.sum("value").over(W.partitionBy(*SAMPLE, "rep")))


def _moments(value: Column, n: int) -> list[Column]:
    """Mean and population deviation over n repetitions of which those without a row are 0."""
    # centred sums of the rows there are, and what the absent zeros add: Chan's rule for two parts in closed form
    seen, mean = F.count(value), F.avg(value)
    square = F.var_pop(value) * seen + mean * mean * seen * (n - seen) / n
    return [(mean * seen / n).alias("mean"), F.sqrt(square / n).alias("std")]


def zscores(edges: DataFrame, nodes: DataFrame, n_shuffle: int, seed: int = 0) -> DataFrame:
    """(patient, sample, a, b, observed, mean, std, z) of every cell that is seen in the observed or a random matrix.

    The assortativity coefficient has a row with a and b null. z is infinite or NaN where the deviation is 0, as a
    division gives it. Without shuffles, means and deviations of cells are 0 and those of the coefficient NaN.
    """
    observed = mixing_matrix(edges, nodes, normalized=True)
    value = observed.select(*SAMPLE, "a", "b", F.col("value").alias("observed"))
    total = coefficient(observed).select(*SAMPLE, F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.col("assortativity").alias("observed"))
    if n_shuffle:
        random = written(permutations(edges, nodes, n_shuffle, seed))
        cells = random.groupBy(*SAMPLE, "a", "b").agg(*_moments(F.col("value"), n_shuffle))
        by_rep = coefficient(random.select(F.struct(*SAMPLE, "rep").alias("patient"), F.lit(None).alias("sample"), "a", "b", "value")).select("patient.*", "assortativity")
        coefs = by_rep.groupBy(*SAMPLE).agg(F.avg("assortativity").alias("mean"), F.stddev_pop("assortativity").alias("std"))
        null = cells.unionByName(coefs.select(*SAMPLE, F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "mean", "std"))
    else:
        null = value.select(*SAMPLE, "a", "b", F.lit(0.0).alias("mean"), F.lit(0.0).alias("std")).unionByName(total.select(*SAMPLE, "a", "b", F.lit(NAN).alias("mean"), F.lit(NAN).alias("std")))
    seen = value.unionByName(total)
    other = null.select(*(F.col(c).alias(f"_{c}") for c in (*SAMPLE, "a", "b")), "mean", "std")
    same = F.lit(True)
    for c in (*SAMPLE, "a", "b"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = seen.join(other, same, "full").select(*(F.coalesce(c, f"_{c}").alias(c) for c in (*SAMPLE, "a", "b")), F.coalesce("observed", F.lit(0.0)).alias("observed"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"))
    return both.select("*", ratio(F.col("observed") - F.col("mean"), F.col("std")).alias("z"))


def pair_name(a: Column, b: Column) -> Column:
    """The name of a pair of labels: the later one first."""
    return F.concat(F.greatest(a, b), F.lit(" - "), F.least(a, b))


def network_statistics(edges: DataFrame, nodes: DataFrame, labels: list[str], n_shuffle: int = 0, seed: int = 0) -> DataFrame:
    """One wide row a sample: id, # total, % of each label, assort with its MEAN, STD and Z, and the same four for each
    pair of labels, named "later - earlier RAW" and so on, pairs along the lower triangle."""
    total = nodes.groupBy(*SAMPLE).agg(F.count("*").alias("# total"), *((F.count_if(F.col("phenotype") == p) / F.count("*")).alias(f"% {p}") for p in labels))
    z = zscores(edges, nodes, n_shuffle, seed)
    pairs = [(hi, lo) for i, hi in enumerate(labels) for lo in labels[: i + 1]]
    pick = lambda a, b, what, default: F.coalesce(F.max(F.when(F.col("a").eqNullSafe(F.lit(a)) & F.col("b").eqNullSafe(F.lit(b)), F.col(what))), F.lit(default))
    kinds = (("observed", ""), ("mean", "MEAN"), ("std", "STD"), ("z", "Z"))
    columns = [pick(None, None, what, NAN).alias(f"assort {name}".strip()) for what, name in kinds]
    for what, name in kinds:
        columns += [pick(hi, lo, what, NAN if what == "z" else 0.0).alias(f"{hi} - {lo} {name or 'RAW'}") for hi, lo in pairs]
    wide = z.groupBy(*(F.col(c).alias(f"_{c}") for c in SAMPLE)).agg(*columns)
    out = total.join(wide, total["patient"].eqNullSafe(wide["_patient"]) & total["sample"].eqNullSafe(wide["_sample"]), "left").drop("_patient", "_sample")
    return out.select(F.concat_ws("_", *SAMPLE).alias("id"), *(f"`{c}`" for c in out.columns if c not in SAMPLE))


def matrix_from_columns(wide: DataFrame, kind: str = "RAW") -> DataFrame:
    """(id, a, b, value): both cells of each pair, from columns named "a - b KIND" of a wide row."""
    names = [c for c in wide.columns if c.endswith(f" {kind}") and " - " in c]
    long = wide.select("id", F.explode(F.array(*(F.struct(F.lit(c[: -len(kind) - 1].split(" - ", 1)[0]).alias("a"), F.lit(c[: -len(kind) - 1].split(" - ", 1)[1]).alias("b"), F.col(f"`{c}`").alias("value")) for c in names))).alias("x")).select("id", "x.*")
    return long.union(long.where("a <> b").select("id", F.col("b").alias("a"), F.col("a").alias("b"), "value"))

