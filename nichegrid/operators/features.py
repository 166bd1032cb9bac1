"""Neighbourhood features: statistics of attributes over the nodes within some hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.operators.graph import SAMPLE, neighbourhoods


def one_hot(label: Column, categories: list[str]) -> list[Column]:
    """A 0/1 column for each category; an unknown or missing label has zeros only."""
    return [F.coalesce((label == c).cast("double"), F.lit(0.0)).alias(c) for c in categories]


def attributes(nodes: DataFrame, columns: list[str], categories: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(patient, sample, node_id, attributes...): one-hot if a single column is chosen and categories are given, else the
    columns as doubles; a missing column is 0 throughout."""
    if len(columns) == 1 and categories is not None:
        return nodes.select(*SAMPLE, "node_id", *one_hot(F.col(columns[0]), categories)), categories
    own = [(F.col(f"`{c}`").cast("double") if c in nodes.columns else F.lit(0.0)).alias(c) for c in columns]
    return nodes.select(*SAMPLE, "node_id", *own), columns


def neighbourhood_statistics(values: DataFrame, names: list[str], nodes: DataFrame, edges: DataFrame, order: int = 1, statistics: tuple[str, ...] = ("mean", "std"), separator: str = " ") -> DataFrame:
    """Mean and population deviation of each attribute over each node's closed neighbourhood.

    Columns are all attributes of the first statistic, then those of the second, "{attribute} {statistic}". A node
    without edges has its own values and a deviation of 0.
    """
    kinds = {"mean": F.avg, "std": F.stddev_pop}
    around = neighbourhoods(nodes, edges, order)
    own = values.select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.col("node_id").alias("_id"), *(f"`{c}`" for c in names))
    rows = around.join(own, around["patient"].eqNullSafe(own["_patient"]) & around["sample"].eqNullSafe(own["_sample"]) & (around["member"] == own["_id"]))
    return rows.groupBy(*SAMPLE, "node_id").agg(*(kinds[s](F.col(f"`{c}`")).alias(f"{c}{separator}{s}") for s in statistics for c in names))


def finite_or_error(df: DataFrame, columns: list[str]) -> None:
    """An error that names the first row and column with a value that isn't finite."""
    bad = lambda c: F.isnull(c) | F.isnan(c) | (F.abs(F.col(f"`{c}`")) == float("inf"))
    found = df.select("*", F.coalesce(*(F.when(bad(c), F.lit(c)) for c in columns)).alias("_column")).where("_column is not null").limit(1).collect()
    if found:
        raise ValueError(f"{found[0]['_column']} isn't finite in {found[0].asDict()}")


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean) of numeric columns, over the values that aren't NaN or null."""
    means = df.agg(*(F.avg(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(columns)))
    return means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("mean")) for i, c in enumerate(columns)))).alias("x")).select("x.*")


def relabelled(labels: DataFrame, column: str = "niche") -> DataFrame:
    """labels with the column replaced by ranks among its sorted distinct values, from 0."""
    from pyspark.sql import Window as W

    ranks = labels.select(F.col(column).alias("_old")).distinct().select("_old", (F.row_number().over(W.orderBy("_old")) - 1).cast("long").alias("_new"))
    return labels.join(ranks, labels[column].eqNullSafe(ranks["_old"])).withColumn(column, F.col("_new")).drop("_old", "_new")


def kinds_of_attributes(df: DataFrame, columns: list[str], most: int = 32) -> DataFrame:
    """(column, levels, categorical): text, or at most `most` whole-numbered levels, is categorical."""
    from nichegrid.sources.cohorts import numeric

    counts = df.agg(*(F.countDistinct(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)), *((F.coalesce(F.bool_and(F.col(f"`{c}`") % 1 == 0), F.lit(True)) if numeric(df, c) else F.lit(None).cast("boolean")).alias(f"w{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("levels"), (F.col(f"w{i}").isNull() | ((F.col(f"n{i}") <= most) & F.col(f"w{i}"))).alias("categorical")) for i, c in enumerate(columns)))
    return counts.select(F.explode(rows).alias("x")).select("x.*")
