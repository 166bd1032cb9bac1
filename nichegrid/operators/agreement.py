"""Agreement between two labellings of the same rows, from rows of (a, b)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contingency(rows: DataFrame) -> DataFrame:
    """(a, b, n, na, nb): joint counts with both margins."""
    joint = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    return joint.select("a", "b", "n", F.sum("n").over(W.partitionBy("a")).alias("na"), F.sum("n").over(W.partitionBy("b")).alias("nb"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def _margins(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table.groupBy("a").agg(F.sum("n").alias("n")), table.groupBy("b").agg(F.sum("n").alias("n"))


def rand_index(rows: DataFrame) -> DataFrame:
    """(ari): the adjusted Rand index; 1 for fewer than two rows or a zero denominator."""
    joint = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    a, b = _margins(joint)
    sums = joint.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("index"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    sums = sums.crossJoin(a.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("sa"))).crossJoin(b.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("sb")))
    expected = F.try_divide(F.col("sa") * F.col("sb"), _pairs(F.col("total")))
    most = (F.col("sa") + F.col("sb")) / 2
    return sums.select(F.when((F.col("total") < 2) | (most == expected), 1.0).otherwise(F.try_divide(F.col("index") - expected, most - expected)).alias("ari"))


def information(rows: DataFrame) -> DataFrame:
    """(total, ha, hb, mi): entropies of both labellings and their mutual information, in nats."""
    joint = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    a, b = _margins(joint)
    total = joint.agg(F.sum("n").cast("double").alias("total"))
    entropy = lambda m, name: m.crossJoin(total).agg((-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total")))).alias(name))
    own = joint.join(a.select("a", F.col("n").alias("na")), "a").join(b.select("b", F.col("n").alias("nb")), "b").crossJoin(total)
    mi = own.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))).alias("mi"))
    return total.crossJoin(entropy(a, "ha")).crossJoin(entropy(b, "hb")).crossJoin(mi)


def normalized_information(rows: DataFrame) -> DataFrame:
    """(nmi): mutual information over the mean entropy, from 0 to 1; 0 if an entropy is 0."""
    mean = (F.col("ha") + F.col("hb")) / 2
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("mi"), mean)))
    return information(rows).select(F.when((F.col("ha") <= 0) | (F.col("hb") <= 0), 0.0).otherwise(value).alias("nmi"))


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers from 0: a table for small ones, Stirling's series beyond, which is exact to a double there."""
    small = F.array(*(F.lit(math.lgamma(i + 1.0)) for i in range(128)))
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 128, F.get(small, F.least(n, F.lit(127)).cast("int"))).otherwise(series)


def expected_information(rows: DataFrame) -> DataFrame:
    """(emi): the mutual information that random labellings with the same margins have on average.

    Sums over pairs of distinct margin sizes, each counted as often as it occurs, and over the overlaps n about their
    mean m whose share of the sum a double can hold: one farther off than d has a probability below
    2 exp(-d² / (2m + 2d/3)), which is under 1e-19 for d = 15 + sqrt(225 + 90m). So terms grow with the root of the rows.
    """
    joint = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    a, b = _margins(joint)
    total = joint.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    sizes = lambda m, c: m.groupBy(F.col("n").alias(c)).agg(F.count("*").alias(f"k{c}"))
    pairs = sizes(a, "x").crossJoin(sizes(b, "y")).crossJoin(total)
    mean = F.col("x").cast("double") * F.col("y") / F.col("total")
    away = 15 + F.sqrt(225 + 90 * mean)
    low = F.greatest(F.lit(1).cast("long"), F.col("x") + F.col("y") - F.col("total"), F.floor(mean - away))
    high = F.least("x", "y", F.ceil(mean + away))
    cells = pairs.select("*", F.explode(F.sequence(low, high)).alias("n"))
    x, y, n, total = (F.col(c) for c in ("x", "y", "n", "total"))
    exponent = sum((log_factorial(c) for c in (x, y, total - x, total - y)), F.lit(0.0)) - sum((log_factorial(c) for c in (total, n, x - n, y - n, total - x - y + n)), F.lit(0.0))
    n, t = F.col("n").cast("double"), F.col("total").cast("double")
    term = F.col("kx") * F.col("ky") * (n / t) * F.log(n * t / (F.col("x").cast("double") * F.col("y"))) * F.exp(exponent)
    return cells.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("emi"))


def adjusted_information(rows: DataFrame) -> DataFrame:
    """(ami): mutual information above chance over the mean entropy above chance; 1 where the denominator is tiny."""
    both = information(rows).crossJoin(expected_information(rows))
    below = (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    return both.select(F.when(F.coalesce(F.abs(below) < 1e-15, F.lit(True)), 1.0).otherwise(F.try_divide(F.col("mi") - F.col("emi"), below)).alias("ami"))


def jaccard_stability(rows: DataFrame) -> DataFrame:
    """(niche, stability): for each label of a, the best Jaccard index with any label of b."""
    table = contingency(rows)
    return table.groupBy(F.col("a").alias("niche")).agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("stability"))


def paired_rand(labels: DataFrame) -> DataFrame:
    """(run_a, run_b, ari) for all pairs of runs from rows of (row_id, run, niche), run_a before run_b.

    One join on row_id: each row meets itself once for each pair of runs.
    """
    left = labels.select("row_id", F.col("run").alias("run_a"), F.col("niche").alias("a"))
    right = labels.select("row_id", F.col("run").alias("run_b"), F.col("niche").alias("b"))
    runs = ["run_a", "run_b"]
    joint = left.join(right, "row_id").where("run_a < run_b").groupBy(*runs, "a", "b").agg(F.count("*").alias("n"))
    index = joint.groupBy(*runs).agg(F.sum(_pairs(F.col("n"))).alias("index"), F.sum("n").alias("total"))
    side = lambda c: joint.groupBy(*runs, c).agg(F.sum("n").alias("n")).groupBy(*runs).agg(F.sum(_pairs(F.col("n"))).alias(f"s{c}"))
    sums = index.join(side("a"), runs).join(side("b"), runs)
    expected = F.try_divide(F.col("sa") * F.col("sb"), _pairs(F.col("total")))
    most = (F.col("sa") + F.col("sb")) / 2
    return sums.select(*runs, F.when((F.col("total") < 2) | (most == expected), 1.0).otherwise(F.try_divide(F.col("index") - expected, most - expected)).alias("ari"))


def overlap(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """(share): the share of k nearest neighbours (source, target) in one space that are so in the other too."""
    kept = high.select("source", "target").join(low.select("source", "target"), ["source", "target"], "left_semi").agg(F.count("*").alias("kept"))
    return kept.crossJoin(high.agg(F.countDistinct("source").alias("n"))).select(F.try_divide(F.col("kept"), F.col("n") * k).alias("share"))
