"""What niches are made of, and how niches spread over samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NORMALIZATIONS = ("total", "obs", "niche", "niche&obs", "clr")


def expand(normalize: str) -> tuple[str, ...]:
    """"all" stands for every normalisation, in a fixed order."""
    return NORMALIZATIONS if normalize == "all" else (normalize,)


def counts(rows: DataFrame) -> DataFrame:
    """(phenotype, niche, value) from rows of (phenotype, niche), every combination of a phenotype and a niche; a missing
    phenotype is the empty string."""
    own = rows.select(F.coalesce("phenotype", F.lit("")).alias("phenotype"), "niche")
    seen = own.groupBy("phenotype", "niche").agg(F.count("*").cast("double").alias("value"))
    grid = seen.select("phenotype").distinct().crossJoin(seen.select("niche").distinct())  # labels by labels
    return grid.join(seen, ["phenotype", "niche"], "left").na.fill(0.0, ["value"])


def normalized(table: DataFrame, how: str) -> DataFrame:
    """The counts as shares of all (total), of each phenotype (obs), of each niche (niche), of the first within the second
    (niche&obs), or centred log-ratios by phenotype (clr; zeros count as the largest count / 100,000)."""
    over = {"total": W.partitionBy(), "obs": W.partitionBy("phenotype"), "niche": W.partitionBy("niche")}
    if how == "none":
        return table
    if how == "niche&obs":
        return normalized(normalized(table, "obs"), "niche")
    if how == "clr":
        filled = table.withColumn("value", F.when(F.col("value") == 0, F.max("value").over(over["total"]) / 100_000).otherwise(F.col("value")))
        closed = filled.withColumn("value", F.col("value") / F.sum("value").over(over["obs"]))
        return closed.withColumn("value", F.log("value") - F.avg(F.log("value")).over(over["obs"]))
    return table.withColumn("value", F.try_divide(F.col("value"), F.sum("value").over(over[how])))


def composition(rows: DataFrame, how: str = "total") -> DataFrame:
    return normalized(counts(rows), how)


def histogram(rows: DataFrame) -> DataFrame:
    """(niche, n)."""
    return rows.groupBy("niche").agg(F.count("*").alias("n"))


def spread(rows: DataFrame, by: str) -> DataFrame:
    """(label, n_groups, mean, error): the label's mean share over the groups, with the standard error (0 for one group);
    groups without the label count as 0, shares that aren't finite are left out."""
    seen = rows.groupBy(by, "label").agg(F.count("*").alias("n"))
    share = seen.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(by)))
    grid = seen.select(by).distinct().crossJoin(seen.select("label").distinct())
    all_ = grid.join(share, [by, "label"], "left").select(by, "label", F.coalesce("share", F.lit(0.0)).alias("share")).where(~F.isnan("share"))
    error = F.when(F.count("*") > 1, F.stddev_samp("share") / F.sqrt(F.count("*"))).otherwise(0.0)
    return all_.groupBy("label").agg(F.count("*").alias("n_groups"), F.avg("share").alias("mean"), error.alias("error"))


def centroids(points: DataFrame, columns: list[str]) -> DataFrame:
    """(niche, columns...): mean position of each niche."""
    return points.groupBy("niche").agg(*(F.avg(c).alias(c) for c in columns))


def min_max(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The column stretched to 0..1 in each group; a group of equal values has 0."""
    w = W.partitionBy(*by)
    span = F.max(column).over(w) - F.min(column).over(w)
    return df.withColumn(column, F.when(span == 0, 0.0).otherwise(F.try_divide(F.col(column) - F.min(column).over(w), span)))
