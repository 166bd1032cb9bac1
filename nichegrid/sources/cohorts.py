"""Cohorts as DataFrames: nodes(patient, sample, node_id, x, y, phenotype), from files or from relational tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as null in delimited files, after trimming.
NULL_TOKENS = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "#N/A")
EXTENSIONS = {"csv": ",", "tsv": "\t", "parquet": None}


def extension(text: str) -> str:
    """csv, tsv or parquet; a leading dot and spaces are tolerated, anything else is an error."""
    found = text.strip().lstrip(".").strip().lower()
    if found not in EXTENSIONS:
        raise ValueError(f"unknown extension {text!r}: csv, tsv or parquet is expected")
    return found


def infer(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each string column as long, double or string: the first that all its values which aren't null fit, over all rows; the
    columns `keep` stay as they are."""
    cleaned = df.select(*(F.col(f"`{c}`") if c in keep else F.when(F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), None).otherwise(F.trim(F.col(f"`{c}`"))).alias(c) for c in df.columns))
    fits = lambda c, kind: F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(kind).isNotNull()), F.lit(True))
    tests = [fits(c, kind).alias(f"{kind}{i}") for i, c in enumerate(df.columns) for kind in ("long", "double")]
    if not tests:
        return cleaned
    seen = cleaned.agg(*tests).first()
    kinds = ["string" if c in keep else "long" if seen[f"long{i}"] else "double" if seen[f"double{i}"] else "string" for i, c in enumerate(df.columns)]
    return cleaned.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(df.columns, kinds, strict=True)))


def read_table(spark: SparkSession, path: str | list[str], kind: str, columns: list[str] | None = None) -> DataFrame:
    """A table of any of the three formats; `columns` are all that is read of a Parquet file, a missing one is an error."""
    kind = extension(kind)
    if kind == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        df = infer(spark.read.csv(path, sep=EXTENSIONS[kind], header=True, mode="FAILFAST", enforceSchema=False))
    require(df, columns or [])
    return df.select(*(f"`{c}`" for c in columns)) if columns else df


def require(df: DataFrame, columns: list[str]) -> None:
    """An error that names the columns that df lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")


def numeric(df: DataFrame, column: str) -> bool:
    """Whether a column is stored as numbers."""
    return isinstance(df.schema[column].dataType, T.NumericType)


def file_pattern(patient: str, sample: str | None, kind: str, what: str = "nodes") -> str:
    """A regular expression for file names such as nodes_patient-7_sample-2.parquet; ids hold no underscore."""
    tail = f"_{re.escape(sample)}-[^_]+" if sample else ""
    return rf"^{what}_{re.escape(patient)}-[^_]+{tail}\.{extension(kind)}$"


def with_ids(df: DataFrame, patient: str, sample: str | None) -> DataFrame:
    """Adds patient and sample, decoded from the name of the file that each row comes from."""
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\.[^.]+$", "")
    stem = F.regexp_replace(name, "^(nodes|edges)_", "")
    if sample:
        split = rf"^{re.escape(patient)}-(.*)_{re.escape(sample)}-(.*)$"  # the last separator counts
        return df.select("*", F.regexp_extract(stem, split, 1).alias("patient"), F.regexp_extract(stem, split, 2).alias("sample"))
    return df.select("*", F.regexp_extract(stem, rf"^{re.escape(patient)}-(.*)$", 1).alias("patient"), F.lit(None).cast("string").alias("sample"))


def read_cohort(spark: SparkSession, folder: str, patient: str, sample: str | None, kind: str, x: str, y: str, phenotype: str | None = None, id_col: str | None = None) -> DataFrame:
    """All nodes files of a folder as one nodes table.

    node_id is the rank of id_col in its sample where one is named; otherwise the row's place in its file, by block and by
    the order in which a block's task reads it.
    """
    kind = extension(kind)
    reader = spark.read.option("pathGlobFilter", f"nodes_*.{kind}")
    raw = reader.parquet(folder) if kind == "parquet" else reader.csv(folder, sep=EXTENSIONS[kind], header=True, mode="FAILFAST")
    require(raw, [c for c in (x, y, phenotype, id_col) if c])
    rows = with_ids(raw, patient, sample).where(F.col("_metadata.file_name").rlike(file_pattern(patient, sample, kind)))
    # a file's blocks, and the rows of a block, which one task reads in order
    order = [F.col(f"`{id_col}`")] if id_col else [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    node = (F.row_number().over(W.partitionBy("patient", "sample").orderBy(*order)) - 1).cast("long")
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double") if kind != "parquet" else F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
    label = F.lit(None).cast("string") if phenotype is None else F.col(f"`{phenotype}`").cast("string")
    if phenotype is not None and kind != "parquet":
        label = F.when(F.trim(label).isin(*NULL_TOKENS), None).otherwise(F.trim(label))
    return rows.select("patient", "sample", node.alias("node_id"), number(x).alias("x"), number(y).alias("y"), label.alias("phenotype"))


def sample_index(nodes: DataFrame) -> DataFrame:
    """(patient, sample, n_nodes) of each sample."""
    return nodes.groupBy("patient", "sample").agg(F.count("*").alias("n_nodes"))


def cohort(rows: DataFrame, patient: str, key: str, x: str, y: str, phenotype: str) -> DataFrame:
    """A nodes table from columns of any table; node_id ranks the key in its patient, from 0."""
    rank = (F.row_number().over(W.partitionBy("patient").orderBy("key")) - 1).cast("long")
    own = rows.select(F.expr(patient).cast("string").alias("patient"), F.lit(None).cast("string").alias("sample"), F.expr(key).alias("key"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"), F.expr(phenotype).cast("string").alias("phenotype"))
    return own.select("patient", "sample", rank.alias("node_id"), "x", "y", "phenotype", F.col("key").cast("long").alias("key"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a cohort: a nation is a patient, the account balance over the key a map, the segment a phenotype."""
    return cohort(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_nationkey", "c_custkey", "c_custkey", "c_acctbal", "c_mktsegment")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a cohort with many equal coordinates: a brand is a patient."""
    return cohort(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", "p_partkey", "p_size", "p_retailprice", "p_type")
