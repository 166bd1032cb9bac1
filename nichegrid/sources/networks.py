"""Spatial networks as files: edges beside nodes, columns of niches, conversion, embeddings."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nichegrid.sources.cohorts import EXTENSIONS, extension, file_pattern, infer, require, with_ids
from nichegrid.sources.sinks import check_labels, described, with_labels

KEYS = ("patient", "sample")


def file_name(what: str, patient_column: str, patient: str, sample_column: str | None = None, sample: str | None = None, kind: str = "parquet") -> str:
    """The name of a nodes or edges file, such as edges_patient-7_sample-2.parquet; ids must not hold an underscore."""
    parts = [(patient_column, patient), *([(sample_column, sample)] if sample_column else [])]
    if any("_" in str(x) for p in parts for x in p):
        raise ValueError("ids must not hold an underscore, as file names use it as separator")
    return "_".join([what, *(f"{c}-{i}" for c, i in parts)]) + f".{extension(kind)}"


def read_files(spark: SparkSession, folder: str, what: str, patient: str, sample: str | None, kind: str) -> DataFrame:
    """All columns of the nodes or edges files of a folder, with patient and sample from the files' names."""
    kind = extension(kind)
    reader = spark.read.option("pathGlobFilter", f"{what}_*.{kind}")
    raw = reader.parquet(folder) if kind == "parquet" else reader.csv(folder, sep=EXTENSIONS[kind], header=True, mode="FAILFAST")
    return with_ids(raw, patient, sample).where(F.col("_metadata.file_name").rlike(file_pattern(patient, sample, kind, what)))


def checked_edges(df: DataFrame) -> DataFrame:
    """A table of edges: exactly source and target, as whole numbers."""
    found = [c for c in df.columns if c not in KEYS]
    if sorted(found) != ["source", "target"]:
        raise ValueError(f"edges have the columns source and target, not {', '.join(found)}")
    return df.select(*(c for c in KEYS if c in df.columns), *(F.col(c).cast("long").alias(c) for c in ("source", "target")))


def read_edges(spark: SparkSession, folder: str, patient: str, sample: str | None, kind: str) -> DataFrame:
    """edges(patient, sample, source, target) of all edges files of a folder."""
    return checked_edges(read_files(spark, folder, "edges", patient, sample, kind))


def write_network(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """nodes and edges as Parquet, one folder for each patient and sample, which read_network reads."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        write_whole(df, f"{folder}/{name}", KEYS)


def read_network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that write_network wrote; ids are text whatever they look like."""
    out = []
    for name in ("nodes", "edges"):
        settle(spark, f"{folder}/{name}")
        found = spark.read.parquet(f"{folder}/{name}").schema
        text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in KEYS else f for f in found])
        df = spark.read.schema(text).parquet(f"{folder}/{name}")  # else an id such as 01 becomes a number
        out.append(df.select(*KEYS, *(F.col(f"`{c}`") for c in df.columns if c not in KEYS)))
    return out[0], out[1]


def _files(spark: SparkSession, path: str):  # noqa: ANN202  a Hadoop file system and path
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settle(spark: SparkSession, path: str) -> None:
    """Ends what a writer left that stopped between its renames: the table is the new one if that is in place, else the old."""
    fs, at = _files(spark, path)
    _, old = _files(spark, f"{path}.old")
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            fs.rename(old, at)


def write_whole(df: DataFrame, path: str, by: tuple[str, ...] = (), about: dict[str, str] | None = None) -> None:
    """df as Parquet that appears at once: it is written beside `path` and then takes its place, even of what df reads.

    The old table is set aside, not deleted, until the new one is in place; `settle` brings it back where a writer stopped in
    between. `about` goes into the metadata of the first column.
    """
    spark, fresh = df.sparkSession, f"{path}.new"
    writer = (described(df, about) if about else df).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(fresh)
    settle(spark, path)
    fs, at = _files(spark, path)
    for source, target in ((at, _files(spark, f"{path}.old")[1]), (_files(spark, fresh)[1], at)):
        if fs.exists(source) and not fs.rename(source, target):
            settle(spark, path)
            raise OSError(f"{source} can't be renamed to {target}")
    settle(spark, path)
    spark.catalog.refreshByPath(path)


def clear_temporary(spark: SparkSession, folder: str) -> bool:
    """Removes the folder temp/ of a network folder, if there is one."""
    fs, at = _files(spark, f"{folder}/temp")
    return bool(fs.delete(at, True))


def convert(spark: SparkSession, folder: str, out: str, patient: str, sample: str | None, kind: str) -> int:
    """Delimited nodes and edges files as Parquet, types inferred over all rows; the number of files read."""
    count = 0
    for what in ("nodes", "edges"):
        try:
            rows = read_files(spark, folder, what, patient, sample, kind)
            count += rows.select("_metadata.file_path").distinct().count()
        except AnalysisException as e:
            if what == "edges" and "UNABLE_TO_INFER_SCHEMA" in str(e):
                continue  # a cohort without networks
            raise
        typed = rows if extension(kind) == "parquet" else infer(rows, KEYS)
        write_whole(typed.select(*(F.col(c).cast("string").alias(c) if c in KEYS else F.col(f"`{c}`") for c in typed.columns)), f"{out}/{what}", KEYS)
    return count


def label_runs(nodes: DataFrame) -> list[str]:
    """The runs of which nodes have a column niches_<run>, in the order of their numbers."""
    found = [c.removeprefix("niches_") for c in nodes.columns if c.startswith("niches_")]
    return sorted(found, key=lambda r: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", r) if x])


def merge_labels(spark: SparkSession, folder: str, labels: DataFrame, run: str, kind: str = "parquet") -> None:
    """Adds (or replaces) the column niches_<run> in a network's nodes, after a check that every node has one label."""
    if extension(kind) != "parquet":
        raise ValueError("only Parquet networks take labels: convert the network first")
    nodes, _ = read_network(spark, folder)
    check_labels(nodes, labels)
    write_whole(with_labels(nodes.drop(f"niches_{run}"), labels, run), f"{folder}/nodes", KEYS)


def read_labels(nodes: DataFrame, runs: list[str] | None = None) -> dict[str, DataFrame]:
    """(patient, sample, node_id, niche) of each run; a run that some node has no label of is left out."""
    runs = label_runs(nodes) if runs is None else [r for r in runs if f"niches_{r}" in nodes.columns]
    if not runs:
        return {}
    whole = nodes.agg(*(F.bool_and(F.col(f"`niches_{r}`").isNotNull()).alias(str(i)) for i, r in enumerate(runs))).first()
    return {r: nodes.select(*KEYS, "node_id", F.col(f"`niches_{r}`").alias("niche")) for i, r in enumerate(runs) if whole[str(i)]}


def save_embedding(vectors: DataFrame, keys: DataFrame, path: str) -> None:
    """Rows (id, vector) as columns dim_1, dim_2 and so on, beside (row_id, patient, sample, node_id)."""
    require(keys, ["row_id", *KEYS, "node_id"])
    d = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    wide = vectors.select(F.col("id").alias("row_id"), *(F.get("vector", i).alias(f"dim_{i + 1}") for i in range(d)))
    write_whole(keys.select("row_id", *KEYS, "node_id").join(wide, "row_id").drop("row_id"), path)
