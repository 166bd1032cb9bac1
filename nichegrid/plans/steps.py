"""The three steps over a whole cohort: networks, assortativity statistics, niches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichegrid.functions.lineage import written
from nichegrid.operators import clustering, composition, delaunay, features, layout, mixing, vectors
from nichegrid.operators.graph import SAMPLE
from nichegrid.plans.config import AssortativityConfig, Config, NetworkConfig, NicheConfig
from nichegrid.sources.cohorts import read_cohort


def nodes_of(spark: SparkSession, config: Config) -> DataFrame:
    c = config.cohort
    return read_cohort(spark, c.folder, c.patient, c.sample, c.kind, c.x, c.y, c.phenotype, c.id_col)


def networks(nodes: DataFrame, config: NetworkConfig) -> DataFrame:
    """Step 1: the edges of every sample."""
    return delaunay.network(nodes, config.adaptive, config.n_edges, config.ratio, config.least, config.longest, config.relink_to, config.by)


def statistics(nodes: DataFrame, edges: DataFrame, config: AssortativityConfig) -> DataFrame:
    """Step 2: one wide row of mixing statistics for each sample."""
    labels = [r["phenotype"] for r in mixing.vocabulary(nodes).orderBy("idx").collect()]  # the names of columns
    return mixing.network_statistics(edges, nodes, labels, config.n_shuffle, config.seed)


@dataclass
class Niches:
    """Step 3's results: features and labels of nodes, the reduced vectors, and the composition by normalisation."""

    features: DataFrame
    vectors: DataFrame
    labels: DataFrame
    composition: dict[str, DataFrame]


def feature_rows(nodes: DataFrame, edges: DataFrame, config: NicheConfig) -> tuple[DataFrame, list[str]]:
    """(patient, sample, node_id, row_id, features...) with row_id in order of sample and node, and the features' names."""
    single = len(config.columns) == 1
    labels = [r["phenotype"] for r in mixing.vocabulary(nodes.withColumn("phenotype", F.col(config.columns[0]).cast("string"))).orderBy("idx").collect()] if single else None
    values, names = features.attributes(nodes, list(config.columns), labels)
    table = features.neighbourhood_statistics(values, names, nodes, edges, config.order, config.statistics)
    own = [c for c in table.columns if c not in (*SAMPLE, "node_id")]
    return numbered(table), own


def numbered(table: DataFrame) -> DataFrame:
    """Adds row_id, 0.. in order of (patient, sample, node_id): ranks within samples after the samples' running sizes."""
    sizes = table.groupBy(*SAMPLE).agg(F.count("*").alias("n"))
    before = sizes.select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), (F.sum("n").over(W.orderBy(*SAMPLE).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    place = F.row_number().over(W.partitionBy(*SAMPLE).orderBy("node_id")) - 1
    out = table.select("*", place.alias("_place"))
    out = out.join(before, out["patient"].eqNullSafe(before["_patient"]) & out["sample"].eqNullSafe(before["_sample"]))
    return out.withColumn("row_id", (F.col("_before") + F.col("_place")).cast("long")).drop("_patient", "_sample", "_before", "_place")


def cluster(rows: DataFrame, config: NicheConfig) -> DataFrame:
    """(id, niche) of rows (id, vector) by the configured method; the graph of communities is always Euclidean."""
    if config.clusterer == "gmm":
        return clustering.gaussian_mixture(rows, config.n_clusters, config.seed, covariance=config.covariance)[0]
    if config.clusterer == "spectral":
        return clustering.spectral(rows, config.n_clusters, config.seed)
    near = clustering.neighbour_graph(vectors.nearest(rows, config.k_cluster, search=config.search, seed=config.seed))
    return clustering.communities(written(near), rows.select(F.col("id").alias("node")), config.resolution, 0).withColumnRenamed("node", "id")


def feature_stage(nodes: DataFrame, edges: DataFrame, config: NicheConfig) -> DataFrame:
    """The features of all nodes, written, and checked to be finite."""
    table, names = feature_rows(nodes, edges, config)
    table = written(table)
    features.finite_or_error(table, names)
    return table


def reduction_stage(table: DataFrame, config: NicheConfig) -> DataFrame:
    """(id, vector) from a table of features: the features themselves, or their layout."""
    names = [c for c in table.columns if c not in (*SAMPLE, "node_id", "row_id")]
    rows = table.select(F.col("row_id").alias("id"), F.array(*(F.col(f"`{x}`") for x in names)).alias("vector"))
    c = config.within(table.count())
    if not c.reduce:
        return rows
    return layout.umap(written(rows), c.n_neighbors, c.dimensions, c.metric, c.min_dist, c.epochs, c.seed, c.search).select(F.col("node").alias("id"), F.col("p").alias("vector"))


def cluster_stage(table: DataFrame, rows: DataFrame, config: NicheConfig) -> DataFrame:
    """(patient, sample, node_id, row_id, niche) of all nodes."""
    found = cluster(rows, config.within(table.count()))
    return table.select(*SAMPLE, "node_id", "row_id").join(found.withColumnRenamed("id", "row_id"), "row_id")


def compositions(nodes: DataFrame, labels: DataFrame, config: NicheConfig) -> dict[str, DataFrame]:
    keyed = nodes.select(*(F.col(x).alias(f"_{x}") for x in SAMPLE), F.col("node_id").alias("_id"), "phenotype")
    typed = labels.join(keyed, labels["patient"].eqNullSafe(keyed["_patient"]) & labels["sample"].eqNullSafe(keyed["_sample"]) & (labels["node_id"] == keyed["_id"])).select("phenotype", "niche")
    return {how: composition.composition(typed, how) for how in config.normalize}


def niches(nodes: DataFrame, edges: DataFrame, config: NicheConfig) -> Niches:
    """Step 3 over the pooled cohort: features, reduction, clustering, and what the niches are made of."""
    table = feature_stage(nodes, edges, config)
    rows = written(reduction_stage(table, config))
    labels = written(cluster_stage(table, rows, config))
    return Niches(table, rows, labels, compositions(nodes, labels, config))


def starts(table: DataFrame) -> DataFrame:
    """(patient, sample, start, n): where each sample's row_ids start in a table of features, and how many it has."""
    return table.groupBy(*SAMPLE).agg(F.min("row_id").alias("start"), F.count("*").alias("n"))


def in_one_pass(config: NicheConfig) -> bool:
    """Whether labels_of_samples can follow this configuration."""
    return not config.reduce and config.clusterer == "leiden" and config.search == "exact"


def labels_of_samples(table: DataFrame, config: NicheConfig) -> DataFrame:
    """(patient, sample, node_id, row_id, niche): communities that each sample has on its own, found for all samples in the
    same jobs. A sample's start is its key; its niches are numbered from 0."""
    names = [c for c in table.columns if c not in (*SAMPLE, "node_id", "row_id")]
    first = starts(table).select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.col("start").alias("by"))
    own = F.col("patient").eqNullSafe(F.col("_patient")) & F.col("sample").eqNullSafe(F.col("_sample"))
    rows = written(table.join(first, own).select("by", F.col("row_id").alias("id"), F.array(*(F.col(f"`{x}`") for x in names)).alias("vector")))
    near = written(clustering.neighbour_graph(vectors.nearest(rows, config.k_cluster, by="by")))
    edges = near.join(rows.select("by", F.col("id").alias("a")), "a")
    found = clustering.communities_apart(written(edges), rows.select("by", F.col("id").alias("node")), config.resolution)
    return table.select(*SAMPLE, "node_id", "row_id").join(found.select(F.col("node").alias("row_id"), "niche"), "row_id").select(*SAMPLE, "node_id", "row_id", "niche")


def labels_of_sample(table: DataFrame, start: int, n: int, config: NicheConfig) -> DataFrame:
    """The same for the sample whose row_ids start there, by any configuration."""
    own = written(table.where(F.col("row_id").between(start, start + n - 1)).withColumn("row_id", F.col("row_id") - start))
    labels = cluster_stage(own, written(reduction_stage(own, config)), config)
    return labels.select(*SAMPLE, "node_id", (F.col("row_id") + start).alias("row_id"), "niche")


def niches_per_sample(nodes: DataFrame, edges: DataFrame, config: NicheConfig) -> dict[tuple[str, str | None], Niches]:
    """Step 3 for each sample on its own, one after the other."""
    out = {}
    for r in nodes.select(*SAMPLE).distinct().orderBy(*SAMPLE).collect():  # the names of samples
        own = lambda df: df.where(F.col("patient").eqNullSafe(F.lit(r["patient"])) & F.col("sample").eqNullSafe(F.lit(r["sample"])))  # noqa: B023, E731
        out[r["patient"], r["sample"]] = niches(own(nodes), own(edges), config)
    return out
