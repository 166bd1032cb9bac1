"""Writing cohorts and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = (), about: dict[str, str] | None = None) -> None:
    """Parquet, one folder for each value of `by`; `about` goes into the metadata of the first column."""
    df = described(df, about) if about else df
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)


def described(df: DataFrame, about: dict[str, str]) -> DataFrame:
    """df with `about` in the metadata of its first column."""
    first = df.columns[0]
    return df.withMetadata(first, {**df.schema[first].metadata, **about})


def read_about(df: DataFrame) -> dict[str, str]:
    """The metadata that write_parquet added."""
    return dict(df.schema[df.columns[0]].metadata)


def plain(c: Column) -> Column:
    """A double for a delimited file: NaN is empty, infinities are inf and -inf."""
    text = F.when(F.isnan(c), None).when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return text.otherwise(c.cast("string"))


def write_csv(df: DataFrame, path: str) -> None:
    """One delimited file; meant for statistics, which have a row a sample."""
    floats = [isinstance(f.dataType, T.FractionalType) for f in df.schema.fields]
    out = df.select(*(plain(F.col(f"`{c}`")).alias(c) if is_float else F.col(f"`{c}`") for c, is_float in zip(df.columns, floats, strict=True)))
    out.coalesce(1).write.csv(path, header=True, nullValue="", emptyValue="")


def with_labels(nodes: DataFrame, labels: DataFrame, run: str) -> DataFrame:
    """nodes with a column niches_<run>; labels must hold (patient, sample, node_id, niche) of every node once."""
    keys = ["patient", "sample", "node_id"]
    own = labels.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("niche").alias(f"niches_{run}"))
    same = F.lit(True)
    for k in keys:
        same = same & nodes[k].eqNullSafe(F.col(f"_{k}"))
    return nodes.join(own, same, "left").drop(*(f"_{k}" for k in keys))


def check_labels(nodes: DataFrame, labels: DataFrame) -> None:
    """An error unless every sample has as many labels as nodes."""
    count = lambda df, name: df.groupBy("patient", "sample").agg(F.count("*").alias(name))
    a, b = count(nodes, "n_nodes"), count(labels, "n_labels").withColumnsRenamed({"patient": "p", "sample": "s"})
    odd = a.join(b, a["patient"].eqNullSafe(b["p"]) & a["sample"].eqNullSafe(b["s"]), "full").where("not (n_nodes <=> n_labels)").limit(1).collect()
    if odd:
        raise ValueError(f"sample {odd[0]['patient'] or odd[0]['p']}: {odd[0]['n_nodes'] or 0} nodes and {odd[0]['n_labels'] or 0} labels")
