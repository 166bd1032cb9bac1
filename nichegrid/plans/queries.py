"""Registered queries of the cohort operators, on cohorts made of the given tables, and the SQL that checks them.

Customers are the cohort unless a query says otherwise: a nation is a patient, a market segment a phenotype. Floating
results are rounded, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.functions import scalars
from nichegrid.functions.lineage import written
from nichegrid.operators import agreement, clustering, composition, delaunay, descent, eigen, features, graph, layout, mixing, vectors
from nichegrid.sources.cohorts import cohort, customers, infer, parts, sample_index

K = 3
THRESHOLD = 500.0
PERCENTILE = 90.0


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes if c != "sample"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = customers(spark, sf_dir)
    return nodes, written(graph.knn_edges(nodes, K))  # queries use the edges in both directions


def _on_graph(f: Callable[[DataFrame, DataFrame], DataFrame], digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    """A query from a function of (nodes, edges)."""
    return lambda spark, sf_dir: _rounded(f(*_graph(spark, sf_dir)), digits)


def _khop(order: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, edges = _graph(spark, sf_dir)
        labels = [r["phenotype"] for r in mixing.vocabulary(nodes).orderBy("idx").collect()]  # one row a phenotype
        values, names = features.attributes(nodes, ["phenotype"], labels)
        out = features.neighbourhood_statistics(values, names, nodes, edges, order)
        long = F.explode(F.array(*(F.struct(F.lit(c).alias("phenotype"), F.col(f"`{c} mean`").alias("mean"), F.col(f"`{c} std`").alias("std")) for c in names)))
        return _rounded(out.select("patient", "node_id", long.alias("x")).select("patient", "node_id", "x.*"))

    return query


def _niches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("patient", "phenotype", (F.col("key") % 5).alias("niche"))


def _composition(how: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(composition.composition(_niches(spark, sf_dir), how))


def _labellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("a"), (F.floor(F.col("vec_id") / 3) % 6).alias("b"))


def _agreement(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(f(_labellings(spark, sf_dir)))


def relink_knn(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.relink(nodes, graph.shorter(edges, nodes, THRESHOLD), edges, K, shortest_only=False)


def relink_shortest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.relink(nodes, graph.shorter(edges, nodes, THRESHOLD), edges, 2, shortest_only=True)


def relabel_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = customers(spark, sf_dir).select("key", (F.pmod(F.col("key") * 7, F.lit(5)) * 10 + 3).alias("niche"))
    return features.relabelled(labels)


def sweep_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    runs = {"1-1-1": F.col("label").cast("long"), "1-1-2": F.col("vec_id") % 4, "1-2-1": F.floor(F.col("vec_id") / 3) % 6}
    long = rows.select(F.col("vec_id").alias("row_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("run"), v.alias("niche")) for k, v in runs.items()))).alias("x")).select("row_id", "x.*")
    return _rounded(agreement.paired_rand(long))


def mean_sem_across_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(composition.spread(customers(spark, sf_dir).select("patient", F.col("phenotype").alias("label")), "patient"))


def embedding_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("niche"), F.get("embedding", 0).cast("double").alias("dim_1"), F.get("embedding", 1).cast("double").alias("dim_2"))
    return _rounded(composition.centroids(rows, ["dim_1", "dim_2"]))


def min_max_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(composition.min_max(customers(spark, sf_dir).select("key", "patient", "y"), "y", ["patient"]))


def grid_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.within_box(customers(spark, sf_dir), 50.0, 0.0, 900.0, 5000.0).select("patient", "node_id", "x", "y"))


def nearest_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("point"), (F.col("s_suppkey") * 10).cast("double").alias("px"), F.col("s_acctbal").cast("double").alias("py"))
    return _rounded(graph.nearest_within(customers(spark, sf_dir), orders, 200.0))


def attribute_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return features.kinds_of_attributes(rows, ["p_brand", "p_size", "p_retailprice"])


def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types inferred from all values of columns that were read as text."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    found = infer(rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns)))
    return rows.agg(F.count("*").alias("n_rows"), *(F.lit(k).alias(c) for c, k in found.dtypes))


def feature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share all features, as the neighbour search treats them once: the parts of equal size and price."""
    rows = parts(spark, sf_dir)
    return _rounded(rows.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("key").alias("first")))


def knn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours where many coordinates are equal: the parts."""
    return _rounded(graph.nearest(parts(spark, sf_dir), 2).select("patient", "source", "target", "distance", F.col("rank").cast("long").alias("rank")))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def embedding_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the given labels fit the neighbour graph of the vectors."""
    near = clustering.neighbour_graph(vectors.nearest(_vectors(spark, sf_dir), 5))
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("node"), F.col("label").alias("niche"))
    return _rounded(clustering.modularity(near, labels))


def _knn_vectors(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(vectors.nearest(_vectors(spark, sf_dir), 5, metric).select("source", "target", "distance", F.col("rank").cast("long").alias("rank")))


def _vectors_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("by"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def knn_vectors_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the rows with the same label, each label being searched on its own."""
    return _rounded(vectors.nearest(_vectors_by_label(spark, sf_dir), 5, by="by").select("source", "target", "distance", F.col("rank").cast("long").alias("rank")))


def communities_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities that each label's rows have on their own, found for all labels at once."""
    rows = _vectors_by_label(spark, sf_dir)
    near = written(clustering.neighbour_graph(vectors.nearest(rows, 8, by="by")))
    edges = near.join(rows.select("by", F.col("id").alias("a")), "a")
    return clustering.communities_apart(edges, rows.select("by", F.col("id").alias("node"))).select(F.col("by").alias("label"), "node", "niche")


def knn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 10 nearest neighbours the first 16 dimensions keep."""
    rows = _vectors(spark, sf_dir)
    low = rows.select("id", F.slice("vector", 1, 16).alias("vector"))
    return _rounded(agreement.overlap(vectors.nearest(rows, 10), vectors.nearest(low, 10), 10))


def trade_eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading eigenvector of the graph of customers' nations and suppliers' nations, by items between them."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    items = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    links = written(items.groupBy(F.col("c_nationkey").cast("long").alias("a"), (25 + F.col("s_nationkey")).cast("long").alias("b")).agg(F.count("*").cast("double").alias("weight")))
    cells = written(eigen.normalised(links))
    start = cells.select(F.col("i").alias("node")).distinct().select("node", F.array(F.lit(1.0), F.pmod(F.col("node") * 7919, F.lit(31)).cast("double"), F.pmod(F.col("node") * 104729, F.lit(17)).cast("double")).alias("q"))
    return _rounded(eigen.leading(cells, start, 1, 1e-9)[1].select("node", F.get("q", 0).alias("value")))


def knn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of neighbour descent, and whether 95 % of their entries are among the nearest."""
    near = written(vectors.nearest(_vectors(spark, sf_dir), 10, search="descent"))
    exact = vectors.nearest(_vectors(spark, sf_dir), 10).select("source", "target", F.lit(True).alias("hit"))
    return near.join(exact, ["source", "target"], "left").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("entries"), (F.count("hit") >= 0.95 * F.count("*")).alias("reached"))


def forest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the leaves of four trees of random planes, and whether none holds over 64."""
    leaves = descent.forest(_vectors(spark, sf_dir), 4, 64).groupBy("tree", "node").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    return leaves.groupBy("tree").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), (F.max("n") <= 64).alias("bounded"))


def fuzzy_simplicial_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.fuzzy_graph(written(vectors.nearest(_vectors(spark, sf_dir), 14))))


def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.principal_components(_vectors(spark, sf_dir), 2)
    return _rounded(out.select("id", F.get("projection", 0).alias("dim_1"), F.get("projection", 1).alias("dim_2")))


def gmm_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.gaussian_mixture(_vectors(spark, sf_dir), 10)[0]


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans(_vectors(spark, sf_dir), 10, seed=42)


def _neighbour_graph(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    rows = _vectors(spark, sf_dir)
    return written(clustering.neighbour_graph(vectors.nearest(rows, k))), rows.select(F.col("id").alias("node"))


def community_niches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.communities(*_neighbour_graph(spark, sf_dir, 8))


def knn_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.components(*_neighbour_graph(spark, sf_dir, 1))


def umap_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.umap(_vectors(spark, sf_dir))
    return _rounded(out.select("node", F.get("p", 0).alias("dim_1"), F.get("p", 1).alias("dim_2")))


def merged_niches(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("niche"))
    return clustering.merge_smallest(labels, _vectors(spark, sf_dir), force=True)[0]


def delaunay_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(delaunay.delaunay(customers(spark, sf_dir)))


def spatial_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(delaunay.network(customers(spark, sf_dir)))


def permutation_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return _rounded(mixing.zscores(edges, nodes, 20))


def network_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide statistics of every sample, without random labellings."""
    nodes, edges = _graph(spark, sf_dir)
    labels = [r["phenotype"] for r in mixing.vocabulary(nodes).orderBy("idx").collect()]  # one row a phenotype
    return _rounded(mixing.network_statistics(edges, nodes, labels))


def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's label as its place in the vocabulary."""
    nodes = customers(spark, sf_dir)
    return nodes.join(mixing.vocabulary(nodes), "phenotype", "left").select("key", F.col("idx").alias("code"))


def balance_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values brought to colour scales."""
    rows = customers(spark, sf_dir)
    return _rounded(rows.select("key", scalars.two_slope(F.col("y"), -1000.0, 0.0, 9700.0).alias("two_slope"), scalars.symmetric_log(F.col("y"), 100.0, 10000.0).alias("symmetric_log")))


def mixing_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean mixing matrix over patients without its diagonal; a cell that a patient lacks counts as 0."""
    nodes, edges = _graph(spark, sf_dir)
    n = nodes.select(F.countDistinct("patient").alias("n_patients"))
    cells = mixing.mixing_matrix(edges, nodes, normalized=True).where("a <> b").groupBy("a", "b").agg(F.sum("value").alias("value")).crossJoin(n)
    return _rounded(cells.select("a", "b", (F.col("value") / F.col("n_patients")).alias("value")))


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.degrees(nodes, edges).groupBy("degree").agg(F.count("*").alias("n"))


def event_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abundance by event type: the user's remainder is the phenotype."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    nodes = cohort(rows, "event_type", "event_id", "cast(cast(ts as timestamp) as double) / 1e6", "value", "user_id % 8")
    return _rounded(mixing.abundance(nodes))


def entry_query(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return mixing.assortativity(edges, nodes)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sample_index": lambda s, d: sample_index(customers(s, d)).drop("sample"),
    "abundance_by_sample": lambda s, d: _rounded(mixing.abundance(customers(s, d))),
    "vocabulary": lambda s, d: mixing.vocabulary(customers(s, d)),
    "knn_edges_2d": _on_graph(lambda n, e: e),
    "knn_ties": knn_ties,
    "edge_lengths": _on_graph(lambda n, e: graph.lengths(e, n)),
    "edge_length_percentile": _on_graph(lambda n, e: graph.length_percentile(e, n, PERCENTILE)),
    "global_trim": _on_graph(lambda n, e: graph.shorter(e, n, THRESHOLD)),
    "size_adaptive_trim": _on_graph(lambda n, e: graph.trim_by_percentile(e, n)),
    "degree_summary": _on_graph(graph.degree_summary),
    "under_connected": _on_graph(lambda n, e: graph.under_connected(n, graph.shorter(e, n, THRESHOLD), K)),
    "relink_knn": _on_graph(relink_knn),
    "relink_shortest": _on_graph(relink_shortest),
    "mixing_matrix_raw": _on_graph(lambda n, e: mixing.mixing_matrix(e, n)),
    "mixing_matrix_normalized": _on_graph(lambda n, e: mixing.mixing_matrix(e, n, normalized=True), 9),
    "mixing_half_diag": _on_graph(lambda n, e: mixing.mixing_matrix(e, n, double_diagonal=False)),
    "assortativity_coefficient": _on_graph(entry_query, 9),
    "khop1_features": _khop(1),
    "khop2_features": _khop(2),
    "composition_none": _composition("none"),
    "composition_total": _composition("total"),
    "composition_obs": _composition("obs"),
    "composition_niche": _composition("niche"),
    "composition_niche_obs": _composition("niche&obs"),
    "composition_clr": _composition("clr"),
    "niche_histogram": lambda s, d: composition.histogram(_niches(s, d)),
    "relabel_contiguous": relabel_contiguous,
    "contingency": lambda s, d: agreement.contingency(_labellings(s, d)),
    "ari": _agreement(agreement.rand_index),
    "ami": _agreement(agreement.adjusted_information),
    "nmi": _agreement(agreement.normalized_information),
    "jaccard_stability": _agreement(agreement.jaccard_stability),
    "sweep_matrix": sweep_matrix,
    "mean_sem_across_samples": mean_sem_across_samples,
    "embedding_centroids": embedding_centroids,
    "min_max_columns": min_max_columns,
    "grid_range_query": grid_range_query,
    "nearest_in_radius": nearest_in_radius,
    "attribute_kinds": attribute_kinds,
    "inferred_types": inferred_types,
    "feature_classes": feature_classes,
    **{f"knn_vectors_{m}": _knn_vectors(m) for m in vectors.METRICS},
    "knn_overlap": knn_overlap,
    "trade_eigenvector": trade_eigenvector,
    "knn_descent": knn_descent,
    "forest_leaves": forest_leaves,
    "knn_vectors_by_label": knn_vectors_by_label,
    "communities_by_label": communities_by_label,
    "fuzzy_simplicial_set": fuzzy_simplicial_set,
    "pca_projection": pca_projection,
    "gmm_diag": gmm_diag,
    "kmeans": kmeans,
    "community_niches": community_niches,
    "knn_components": knn_components,
    "umap_layout": umap_layout,
    "merged_niches": merged_niches,
    "delaunay_edges": delaunay_edges,
    "spatial_network": spatial_network,
    "permutation_zscores": permutation_zscores,
    "network_statistics": network_statistics,
    "label_codes": label_codes,
    "balance_colours": balance_colours,
    "mixing_heatmap": mixing_heatmap,
    "degree_histogram": _on_graph(degree_histogram),
    "event_cohort": event_cohort,
    "embedding_modularity": embedding_modularity,
}

_NODES = """nodes AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS patient, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS node_id,
         CAST(c_custkey AS DOUBLE) AS x, CAST(c_acctbal AS DOUBLE) AS y, c_mktsegment AS phenotype, c_custkey AS key
  FROM customer)"""
_EDGES = f"""{_NODES}, pairs AS (
  SELECT a.patient, a.node_id AS source, b.node_id AS target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM nodes a JOIN nodes b ON a.patient = b.patient AND a.node_id <> b.node_id),
near AS (SELECT *, row_number() OVER (PARTITION BY patient, source ORDER BY d, target) AS r FROM pairs),
edges AS (SELECT DISTINCT patient, least(source, target) AS source, greatest(source, target) AS target FROM near WHERE r <= {K}),
lengths AS (
  SELECT e.*, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS length
  FROM edges e JOIN nodes a ON a.patient = e.patient AND a.node_id = e.source JOIN nodes b ON b.patient = e.patient AND b.node_id = e.target),
trimmed AS (SELECT patient, source, target FROM lengths WHERE length < {THRESHOLD}),
both_ways AS (SELECT * FROM edges UNION ALL SELECT patient, target, source FROM edges),
trimmed_ways AS (SELECT * FROM trimmed UNION ALL SELECT patient, target, source FROM trimmed),
labelled AS (
  SELECT e.patient, a.phenotype AS a, b.phenotype AS b
  FROM both_ways e JOIN nodes a ON a.patient = e.patient AND a.node_id = e.source JOIN nodes b ON b.patient = e.patient AND b.node_id = e.target),
mixed AS (SELECT patient, a, b, CAST(count(*) AS DOUBLE) AS value FROM labelled GROUP BY ALL),
shares AS (SELECT patient, a, b, value / sum(value) OVER (PARTITION BY patient) AS value FROM mixed)"""
_COUNTS = f"""{_NODES}, rows AS (SELECT phenotype, key % 5 AS niche FROM nodes),
seen AS (SELECT phenotype, niche, CAST(count(*) AS DOUBLE) AS value FROM rows GROUP BY ALL),
cells AS (
  SELECT p.phenotype, n.niche, coalesce(s.value, 0.0) AS value
  FROM (SELECT DISTINCT phenotype FROM rows) p CROSS JOIN (SELECT DISTINCT niche FROM rows) n
  LEFT JOIN seen s ON s.phenotype = p.phenotype AND s.niche = n.niche)"""
_LABELS = """labelled AS (SELECT CAST(label AS BIGINT) AS a, (vec_id // 3) % 6 AS b FROM embeddings),
joint AS (SELECT a, b, count(*) AS n FROM labelled GROUP BY ALL),
ma AS (SELECT a, CAST(sum(n) AS BIGINT) AS n FROM joint GROUP BY a), mb AS (SELECT b, CAST(sum(n) AS BIGINT) AS n FROM joint GROUP BY b),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM joint)"""
_INFORMATION = f"""{_LABELS},
info AS (SELECT (SELECT t FROM total) AS t,
  (SELECT -sum(n / t * ln(n / t)) FROM ma, total) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM mb, total) AS hb,
  (SELECT sum(j.n / t * ln(j.n * t / (CAST(ma.n AS DOUBLE) * mb.n))) FROM joint j JOIN ma ON j.a = ma.a JOIN mb ON j.b = mb.b, total) AS mi)"""


def _khop_sql(order: int) -> str:
    hops = ["h0 AS (SELECT patient, node_id, node_id AS member FROM nodes)"]
    for i in range(1, order + 1):
        hops.append(f"h{i} AS (SELECT * FROM h{i - 1} UNION SELECT h.patient, h.node_id, e.target FROM h{i - 1} h JOIN both_ways e ON e.patient = h.patient AND e.source = h.member)")
    return f"""WITH {_EDGES}, {", ".join(hops)}, vocab AS (SELECT DISTINCT phenotype FROM nodes)
SELECT h.patient, h.node_id, v.phenotype, round(avg(CASE WHEN n.phenotype = v.phenotype THEN 1.0 ELSE 0.0 END), 6) AS mean,
       round(stddev_pop(CASE WHEN n.phenotype = v.phenotype THEN 1.0 ELSE 0.0 END), 6) AS std
FROM h{order} h JOIN nodes n ON n.patient = h.patient AND n.node_id = h.member CROSS JOIN vocab v GROUP BY ALL"""


_DISTANCE = {
    "euclidean": "list_distance(a.v, b.v)",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])))",
    "cosine": "1 - list_cosine_similarity(a.v, b.v)",
}


def _knn_sql(metric: str, k: int, vector: str = "CAST(embedding AS DOUBLE[])") -> str:
    return f"""v AS (SELECT vec_id AS id, {vector} AS v FROM embeddings),
d AS (SELECT a.id AS source, b.id AS target, {_DISTANCE[metric]} AS distance FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, target) AS rank FROM d QUALIFY rank <= {k})"""


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")  # fixed values: the customers' phenotypes


def _statistics_sql() -> str:
    """Without random labellings: means and deviations of cells are 0, z is infinite where something was seen."""
    columns = [f"round(avg(CASE WHEN phenotype = '{p}' THEN 1.0 ELSE 0.0 END), 6) AS \"% {p}\"" for p in _SEGMENTS]
    pairs = [(hi, lo) for i, hi in enumerate(_SEGMENTS) for lo in _SEGMENTS[: i + 1]]
    cell = lambda hi, lo: f"coalesce(max(value) FILTER (a = '{hi}' AND b = '{lo}'), 0.0)"
    cells = [f"round({cell(hi, lo)}, 6) AS \"{hi} - {lo} RAW\", CAST(0 AS DOUBLE) AS \"{hi} - {lo} MEAN\", CAST(0 AS DOUBLE) AS \"{hi} - {lo} STD\", CAST(CASE WHEN {cell(hi, lo)} > 0 THEN 'inf' ELSE 'nan' END AS DOUBLE) AS \"{hi} - {lo} Z\"" for hi, lo in pairs]
    nan = ", ".join(f"CAST('nan' AS DOUBLE) AS \"assort {x}\"" for x in ("MEAN", "STD", "Z"))
    return f"""WITH {_EDGES}, rows AS (SELECT patient, a AS k, sum(value) AS r, sum(CASE WHEN a = b THEN value ELSE 0 END) AS d FROM shares GROUP BY ALL),
cols AS (SELECT patient, b AS k, sum(value) AS c FROM shares GROUP BY ALL),
sums AS (SELECT r.patient, sum(d) AS t, sum(r.r * c.c) AS ab FROM rows r JOIN cols c ON c.patient = r.patient AND c.k = r.k GROUP BY r.patient),
totals AS (SELECT patient, count(*) AS "# total", {", ".join(columns)} FROM nodes GROUP BY patient),
wide AS (SELECT patient, {", ".join(cells)} FROM shares GROUP BY patient)
SELECT patient AS id, round((t - ab) / (1 - ab), 6) AS assort, {nan}, totals.* EXCLUDE (patient), wide.* EXCLUDE (patient)
FROM totals JOIN wide USING (patient) JOIN sums USING (patient)"""


_C2 = "CAST(n AS DOUBLE) * (n - 1) / 2"
ORACLE_SQL: dict[str, str] = {
    "sample_index": f"WITH {_NODES} SELECT patient, count(*) AS n_nodes FROM nodes GROUP BY patient",
    "abundance_by_sample": f"WITH {_NODES}, c AS (SELECT patient, phenotype, count(*) AS n FROM nodes GROUP BY ALL) SELECT patient, phenotype, n, round(n / sum(n) OVER (PARTITION BY patient), 6) AS share FROM c",
    "vocabulary": f"WITH {_NODES} SELECT phenotype, row_number() OVER (ORDER BY phenotype) - 1 AS idx FROM (SELECT DISTINCT phenotype FROM nodes)",
    "knn_edges_2d": f"WITH {_EDGES} SELECT * FROM edges",
    "knn_ties": """WITH nodes AS (
  SELECT p_brand AS patient, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS node_id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part),
near AS (
  SELECT a.patient, a.node_id AS source, b.node_id AS target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance,
         row_number() OVER (PARTITION BY a.patient, a.node_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.node_id) AS rank
  FROM nodes a JOIN nodes b ON a.patient = b.patient AND a.node_id <> b.node_id)
SELECT patient, source, target, round(distance, 6) AS distance, rank FROM near WHERE rank <= 2""",
    "edge_lengths": f"WITH {_EDGES} SELECT patient, source, target, round(length, 6) AS length FROM lengths",
    "edge_length_percentile": f"WITH {_EDGES} SELECT patient, round(quantile_cont(length, {PERCENTILE / 100}), 6) AS length FROM lengths GROUP BY patient",
    "global_trim": f"WITH {_EDGES} SELECT * FROM trimmed",
    "size_adaptive_trim": f"""WITH {_EDGES}, n AS (SELECT patient, count(*) AS n FROM nodes GROUP BY patient),
r AS (SELECT l.*, row_number() OVER (PARTITION BY l.patient ORDER BY length) - 1 AS r, greatest(0.0, 1 - 2 / sqrt(n)) * (count(*) OVER (PARTITION BY l.patient) - 1) AS place FROM lengths l JOIN n ON n.patient = l.patient),
c AS (SELECT patient, max(CASE WHEN r = floor(place) THEN length END) AS lo, max(CASE WHEN r = ceil(place) THEN length END) AS hi, any_value(place - floor(place)) AS f FROM r GROUP BY patient)
SELECT r.patient, source, target FROM r JOIN c ON c.patient = r.patient WHERE length < lo + (hi - lo) * f""",
    "degree_summary": f"""WITH {_EDGES}, d AS (SELECT n.patient, n.node_id, count(e.source) AS degree FROM nodes n LEFT JOIN both_ways e ON e.patient = n.patient AND e.source = n.node_id GROUP BY ALL)
SELECT patient, round(avg(degree), 6) AS mean_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM d GROUP BY patient""",
    "under_connected": f"""WITH {_EDGES} SELECT n.patient, n.node_id, count(e.source) AS degree FROM nodes n LEFT JOIN trimmed_ways e ON e.patient = n.patient AND e.source = n.node_id GROUP BY ALL HAVING count(e.source) < {K}""",
    "relink_knn": f"""WITH {_EDGES}, poor AS (SELECT n.patient, n.node_id FROM nodes n LEFT JOIN trimmed_ways e ON e.patient = n.patient AND e.source = n.node_id GROUP BY ALL HAVING count(e.source) < {K})
SELECT * FROM trimmed UNION SELECT e.* FROM edges e WHERE EXISTS (SELECT 1 FROM poor p WHERE p.patient = e.patient AND p.node_id IN (e.source, e.target))""",
    "relink_shortest": f"""WITH {_EDGES}, poor AS (SELECT n.patient, n.node_id FROM nodes n LEFT JOIN trimmed_ways e ON e.patient = n.patient AND e.source = n.node_id GROUP BY ALL HAVING count(e.source) < 2),
touching AS (
  SELECT l.*, count(*) OVER (PARTITION BY p.patient, p.node_id) AS k, row_number() OVER (PARTITION BY p.patient, p.node_id ORDER BY l.length, l.source, l.target) AS r
  FROM poor p JOIN lengths l ON l.patient = p.patient AND p.node_id IN (l.source, l.target))
SELECT * FROM trimmed UNION SELECT patient, source, target FROM touching WHERE k >= 2 AND r <= 2""",
    "mixing_matrix_raw": f"WITH {_EDGES} SELECT patient, a, b, round(value, 6) AS value FROM mixed",
    "mixing_matrix_normalized": f"WITH {_EDGES} SELECT patient, a, b, round(value, 9) AS value FROM shares",
    "mixing_half_diag": f"WITH {_EDGES} SELECT patient, a, b, round(CASE WHEN a = b THEN value / 2 ELSE value END, 6) AS value FROM mixed",
    "assortativity_coefficient": f"""WITH {_EDGES}, rows AS (SELECT patient, a AS k, sum(value) AS r, sum(CASE WHEN a = b THEN value ELSE 0 END) AS d FROM shares GROUP BY ALL),
cols AS (SELECT patient, b AS k, sum(value) AS c FROM shares GROUP BY ALL),
sums AS (SELECT r.patient, sum(d) AS t, sum(r.r * c.c) AS ab FROM rows r JOIN cols c ON c.patient = r.patient AND c.k = r.k GROUP BY r.patient)
SELECT patient, round((t - ab) / (1 - ab), 9) AS assortativity FROM sums""",
    "khop1_features": _khop_sql(1),
    "khop2_features": _khop_sql(2),
    "composition_none": f"WITH {_COUNTS} SELECT phenotype, niche, round(value, 6) AS value FROM cells",
    "composition_total": f"WITH {_COUNTS} SELECT phenotype, niche, round(value / sum(value) OVER (), 6) AS value FROM cells",
    "composition_obs": f"WITH {_COUNTS} SELECT phenotype, niche, round(value / sum(value) OVER (PARTITION BY phenotype), 6) AS value FROM cells",
    "composition_niche": f"WITH {_COUNTS} SELECT phenotype, niche, round(value / sum(value) OVER (PARTITION BY niche), 6) AS value FROM cells",
    "composition_niche_obs": f"WITH {_COUNTS}, o AS (SELECT phenotype, niche, value / sum(value) OVER (PARTITION BY phenotype) AS value FROM cells) SELECT phenotype, niche, round(value / sum(value) OVER (PARTITION BY niche), 6) AS value FROM o",
    "composition_clr": f"""WITH {_COUNTS}, f AS (SELECT phenotype, niche, CASE WHEN value = 0 THEN max(value) OVER () / 100000 ELSE value END AS value FROM cells),
c AS (SELECT phenotype, niche, ln(value / sum(value) OVER (PARTITION BY phenotype)) AS value FROM f)
SELECT phenotype, niche, round(value - avg(value) OVER (PARTITION BY phenotype), 6) AS value FROM c""",
    "niche_histogram": f"WITH {_NODES} SELECT key % 5 AS niche, count(*) AS n FROM nodes GROUP BY 1",
    "relabel_contiguous": "SELECT CAST(c_custkey AS BIGINT) AS key, dense_rank() OVER (ORDER BY (c_custkey * 7) % 5) - 1 AS niche FROM customer",
    "contingency": f"WITH {_LABELS} SELECT j.a, j.b, j.n, ma.n AS na, mb.n AS nb FROM joint j JOIN ma ON ma.a = j.a JOIN mb ON mb.b = j.b",
    "ari": f"""WITH {_LABELS}, s AS (SELECT (SELECT sum({_C2}) FROM joint) AS i, (SELECT sum({_C2}) FROM ma) AS x, (SELECT sum({_C2}) FROM mb) AS y, (SELECT t * (t - 1) / 2 FROM total) AS p)
SELECT round((i - x * y / p) / ((x + y) / 2 - x * y / p), 6) AS ari FROM s""",
    "ami": f"""WITH {_INFORMATION},
cells AS (SELECT ma.n AS x, mb.n AS y, t, unnest(generate_series(greatest(1, CAST(ma.n + mb.n - t AS BIGINT)), least(ma.n, mb.n))) AS n FROM ma, mb, total),
emi AS (SELECT sum(n / t * ln(n * t / (CAST(x AS DOUBLE) * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1)
  - lgamma(t + 1) - lgamma(n + 1) - lgamma(x - n + 1) - lgamma(y - n + 1) - lgamma(t - x - y + n + 1))) AS e FROM cells)
SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM info, emi""",
    "nmi": f"WITH {_INFORMATION} SELECT round(greatest(0.0, least(1.0, mi / ((ha + hb) / 2))), 6) AS nmi FROM info",
    "jaccard_stability": f"WITH {_LABELS} SELECT j.a AS niche, round(max(j.n / CAST(ma.n + mb.n - j.n AS DOUBLE)), 6) AS stability FROM joint j JOIN ma ON ma.a = j.a JOIN mb ON mb.b = j.b GROUP BY 1",
    "sweep_matrix": f"""WITH long AS (
  SELECT vec_id, '1-1-1' AS run, CAST(label AS BIGINT) AS niche FROM embeddings UNION ALL SELECT vec_id, '1-1-2', vec_id % 4 FROM embeddings UNION ALL SELECT vec_id, '1-2-1', (vec_id // 3) % 6 FROM embeddings),
joint AS (SELECT l.run AS run_a, r.run AS run_b, l.niche AS a, r.niche AS b, count(*) AS n FROM long l JOIN long r ON l.vec_id = r.vec_id AND l.run < r.run GROUP BY ALL),
i AS (SELECT run_a, run_b, sum({_C2}) AS i, sum(n) AS t FROM joint GROUP BY ALL),
x AS (SELECT run_a, run_b, sum({_C2}) AS x FROM (SELECT run_a, run_b, a, sum(n) AS n FROM joint GROUP BY ALL) GROUP BY ALL),
y AS (SELECT run_a, run_b, sum({_C2}) AS y FROM (SELECT run_a, run_b, b, sum(n) AS n FROM joint GROUP BY ALL) GROUP BY ALL),
s AS (SELECT *, x * y / (CAST(t AS DOUBLE) * (t - 1) / 2) AS e FROM i JOIN x USING (run_a, run_b) JOIN y USING (run_a, run_b))
SELECT run_a, run_b, round((i - e) / ((x + y) / 2 - e), 6) AS ari FROM s""",
    "mean_sem_across_samples": f"""WITH {_NODES}, c AS (SELECT patient, phenotype AS label, count(*) AS n FROM nodes GROUP BY ALL),
s AS (SELECT patient, label, n / sum(n) OVER (PARTITION BY patient) AS share FROM c),
g AS (SELECT p.patient, l.label, coalesce(s.share, 0.0) AS share FROM (SELECT DISTINCT patient FROM c) p CROSS JOIN (SELECT DISTINCT label FROM c) l LEFT JOIN s ON s.patient = p.patient AND s.label = l.label)
SELECT label, count(*) AS n_groups, round(avg(share), 6) AS mean, round(stddev_samp(share) / sqrt(count(*)), 6) AS error FROM g GROUP BY label""",
    "embedding_centroids": "SELECT label AS niche, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS dim_1, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS dim_2 FROM embeddings GROUP BY label",
    "min_max_columns": f"WITH {_NODES} SELECT key, patient, round((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w), 6) AS y FROM nodes WINDOW w AS (PARTITION BY patient)",
    "grid_range_query": f"WITH {_NODES} SELECT patient, node_id, x, y FROM nodes WHERE x BETWEEN 50 AND 900 AND y BETWEEN 0 AND 5000",
    "nearest_in_radius": f"""WITH {_NODES}, d AS (
  SELECT CAST(s_suppkey AS BIGINT) AS point, key, sqrt((x - s_suppkey * 10) * (x - s_suppkey * 10) + (y - s_acctbal) * (y - s_acctbal)) AS distance FROM supplier, nodes)
SELECT point, CAST(arg_min(key, (distance, key)) AS BIGINT) AS key, round(min(distance), 6) AS distance FROM d WHERE distance <= 200 GROUP BY point""",
    "attribute_kinds": """SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS levels, true AS categorical FROM part
UNION ALL SELECT 'p_size', count(DISTINCT p_size), count(DISTINCT p_size) <= 32 AND bool_and(p_size % 1 = 0) FROM part
UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice), count(DISTINCT p_retailprice) <= 32 AND bool_and(p_retailprice % 1 = 0) FROM part""",
    "inferred_types": "SELECT count(*) AS n_rows, 'bigint' AS c_custkey, 'string' AS c_name, 'bigint' AS c_nationkey, 'double' AS c_acctbal, 'string' AS c_mktsegment FROM customer",
    **{f"knn_vectors_{m}": f"WITH {_knn_sql(m, 5)} SELECT source, target, round(distance, 6) AS distance, rank FROM near" for m in vectors.METRICS},
    "trade_eigenvector": """WITH e AS (SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(25 + s_nationkey AS BIGINT) AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
d AS (SELECT node, sum(w) AS d FROM (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY node)
SELECT node, round(sqrt(d / sum(d) OVER ()), 6) AS value FROM d""",
    "knn_descent": f"WITH {_knn_sql('euclidean', 10)} SELECT count(DISTINCT source) AS sources, count(*) AS entries, true AS reached FROM near",
    "forest_leaves": "SELECT CAST(t AS INTEGER) AS tree, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, true AS bounded FROM embeddings, range(4) r(t) GROUP BY t",
    "knn_overlap": f"""WITH high AS (WITH {_knn_sql("euclidean", 10)} SELECT source, target FROM near), low AS (WITH {_knn_sql("euclidean", 10, "CAST(embedding AS DOUBLE[])[1:16]")} SELECT source, target FROM near)
SELECT round(count(l.source) / (10.0 * count(DISTINCT h.source)), 6) AS share FROM high h LEFT JOIN low l ON h.source = l.source AND h.target = l.target""",
    "knn_components": f"""WITH RECURSIVE {_knn_sql("euclidean", 1)}, ways AS (SELECT source AS a, target AS b FROM near UNION SELECT target, source FROM near),
reach(node, other) AS (SELECT id, id FROM v UNION SELECT r.node, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY node""",
    "merged_niches": """WITH s AS (SELECT CAST(label AS BIGINT) AS niche, count(*) AS n FROM embeddings GROUP BY 1), gone AS (SELECT arg_min(niche, (n, niche)) AS g, min(n) AS least FROM s),
d AS (SELECT a.vec_id AS id, b.label AS to_, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN gone ON a.label = g JOIN embeddings b ON b.label <> g),
m AS (SELECT id, arg_min(to_, (d, to_)) AS to_, min(d) AS d FROM d GROUP BY id), first AS (SELECT to_ FROM m ORDER BY d, to_ LIMIT 20),
votes AS (SELECT to_, count(*) AS n FROM first GROUP BY 1), into_ AS (SELECT arg_max(to_, (n, -to_)) AS i FROM votes)
SELECT vec_id AS id, CAST(CASE WHEN label = g THEN i ELSE label END AS BIGINT) AS niche FROM embeddings, gone, into_""",
    "delaunay_edges": f"""WITH {_NODES}, t AS (
  SELECT a.patient, a.node_id AS i, b.node_id AS j, c.node_id AS k, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS by_, c.x - a.x AS cx, c.y - a.y AS cy
  FROM nodes a JOIN nodes b ON a.patient = b.patient AND a.node_id < b.node_id JOIN nodes c ON c.patient = a.patient AND b.node_id < c.node_id),
o AS (SELECT *, 2 * (bx * cy - by_ * cx) AS det, bx * bx + by_ * by_ AS b2, cx * cx + cy * cy AS c2 FROM t),
circles AS (SELECT patient, i, j, k, ax + (cy * b2 - by_ * c2) / det AS ux, ay + (bx * c2 - cx * b2) / det AS uy, ((cy * b2 - by_ * c2) / det) ** 2 + ((bx * c2 - cx * b2) / det) ** 2 AS r2 FROM o WHERE det <> 0),
empty AS (SELECT * FROM circles c WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.patient = c.patient AND n.node_id NOT IN (c.i, c.j, c.k) AND (n.x - c.ux) ** 2 + (n.y - c.uy) ** 2 < c.r2 * (1 - 1e-9)))
SELECT DISTINCT patient, unnest([i, i, j]) AS source, unnest([j, k, k]) AS target FROM empty""",
    "network_statistics": _statistics_sql(),
    # the bisection of sigma as 64 steps over lists of distances
    "knn_vectors_by_label": f"""WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id AS source, b.id AS target, {_DISTANCE["euclidean"]} AS distance FROM v a JOIN v b ON a.id <> b.id AND a.label = b.label),
near AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, target) AS rank FROM d QUALIFY rank <= 5)
SELECT source, target, round(distance, 6) AS distance, rank FROM near""",
    "fuzzy_simplicial_set": f"""WITH RECURSIVE {_knn_sql("euclidean", 14)},
lists AS (SELECT source, list(distance ORDER BY distance, target) AS d, list(target ORDER BY distance, target) AS t, min(distance) FILTER (distance > 0) AS rho FROM near GROUP BY source),
begin_ AS (SELECT source, d, t, coalesce(rho, 0.0) AS rho, log2(len(d) + 1) AS goal FROM lists),
steps(source, i, lo, hi, s, open) AS (
  SELECT source, 0, CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE), CAST(1 AS DOUBLE), true FROM begin_
  UNION ALL
  SELECT source, i + 1, CASE WHEN open AND total <= goal THEN s ELSE lo END, CASE WHEN open AND total > goal THEN s ELSE hi END,
    CASE WHEN NOT open THEN s WHEN total > goal THEN (lo + s) / 2 WHEN hi = CAST('inf' AS DOUBLE) THEN s * 2 ELSE (s + hi) / 2 END, open
  FROM (SELECT x.source, i, lo, hi, s, total, goal, open AND abs(total - goal) >= 1e-5 AS open
    FROM (SELECT p.*, b.goal, list_sum(list_transform(b.d, lambda y: exp(-greatest(y - b.rho, 0.0) / p.s))) AS total FROM steps p JOIN begin_ b ON b.source = p.source WHERE p.i < 64) x)),
mean AS (SELECT sum(distance) / (count(*) + count(DISTINCT source)) AS m FROM near),
sigma AS (SELECT b.*, greatest(s, 1e-3 * CASE WHEN rho > 0 THEN list_sum(d) / (len(d) + 1) ELSE m END) AS s FROM steps JOIN begin_ b ON b.source = steps.source, mean WHERE i = 64),
w AS (SELECT source, unnest(t) AS target, exp(-greatest(unnest(d) - rho, 0.0) / s) AS w FROM sigma)
SELECT a, b, round(sum(w) - CASE WHEN count(*) = 2 THEN product(w) ELSE 0.0 END, 6) AS weight FROM (SELECT least(source, target) AS a, greatest(source, target) AS b, w FROM w) GROUP BY a, b""",
    "label_codes": f"WITH {_NODES}, v AS (SELECT phenotype, row_number() OVER (ORDER BY phenotype) - 1 AS idx FROM (SELECT DISTINCT phenotype FROM nodes)) SELECT CAST(key AS BIGINT) AS key, idx AS code FROM nodes LEFT JOIN v ON v.phenotype = nodes.phenotype",
    "balance_colours": f"""WITH {_NODES} SELECT CAST(key AS BIGINT) AS key, round(CASE WHEN y <= 0 THEN (y + 1000) / 2000 ELSE 0.5 + y / 19400 END, 6) AS two_slope,
round(CASE WHEN abs(y) <= 100 THEN y / 100 ELSE sign(y) * (1 + ln(abs(y) / 100)) END / (1 + ln(100.0)), 6) AS symmetric_log FROM nodes""",
    "mixing_heatmap": f"WITH {_EDGES} SELECT a, b, round(sum(value) / (SELECT count(DISTINCT patient) FROM nodes), 6) AS value FROM shares WHERE a <> b GROUP BY ALL",
    "degree_histogram": f"WITH {_EDGES}, d AS (SELECT n.patient, n.node_id, count(e.source) AS degree FROM nodes n LEFT JOIN both_ways e ON e.patient = n.patient AND e.source = n.node_id GROUP BY ALL) SELECT degree, count(*) AS n FROM d GROUP BY degree",
    "event_cohort": "WITH c AS (SELECT event_type AS patient, CAST(user_id % 8 AS VARCHAR) AS phenotype, count(*) AS n FROM events GROUP BY ALL) SELECT patient, phenotype, n, round(n / sum(n) OVER (PARTITION BY patient), 6) AS share FROM c",
    "embedding_modularity": f"""WITH {_knn_sql("euclidean", 5)}, e AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM near),
l AS (SELECT x.label AS na, y.label AS nb FROM e JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b),
m AS (SELECT CAST(count(*) AS DOUBLE) AS m, CAST(count(*) FILTER (na = nb) AS DOUBLE) AS w FROM l),
k AS (SELECT n, CAST(count(*) AS DOUBLE) AS k FROM (SELECT na AS n FROM l UNION ALL SELECT nb FROM l) GROUP BY n)
SELECT round(any_value(w / m) - sum(k * k) / any_value(4 * m * m), 6) AS modularity FROM k, m""",
    "feature_classes": "SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, count(*) AS n, CAST(min(p_partkey) AS BIGINT) AS first FROM part GROUP BY 1, 2",
}
