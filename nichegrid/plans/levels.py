"""Records of a cohort's results, their comparison, and three levels of checks on synthetic tissue."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.functions.lineage import written
from nichegrid.operators import agreement, delaunay, features, graph, mixing, vectors
from nichegrid.plans import config, steps
from nichegrid.sources.tissue import tissue

Record = dict[str, dict[str, Any]]


def exact(df: DataFrame) -> dict[str, Any]:
    """The number of rows and a digest that doesn't depend on their order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))).cast("decimal(38,0)")).alias("h")).first()
    return {"kind": "exact", "count": row["n"], "digest": str(row["h"] or 0)}


def floats(values: list[float | None]) -> dict[str, Any]:
    """Numbers that are compared with a tolerance; NaN is written as null."""
    return {"kind": "floats", "values": [None if v is None or math.isnan(v) else float(v) for v in values]}


def differences(a: Record, b: Record, tolerance: float = 1e-9) -> list[str]:
    """What differs: entries only one has, other counts or digests, numbers apart by more than a relative tolerance."""
    out = [f"{k} is only in the {'first' if k in a else 'second'}" for k in sorted(a.keys() ^ b.keys())]
    for k in sorted(a.keys() & b.keys()):
        x, y = a[k], b[k]
        if x["kind"] != y["kind"] or x["kind"] == "exact":
            if x != y:
                out.append(f"{k}: {x} and {y}")
        elif len(x["values"]) != len(y["values"]):
            out.append(f"{k}: {len(x['values'])} and {len(y['values'])} numbers")
        else:
            apart = [i for i, (u, v) in enumerate(zip(x["values"], y["values"], strict=True)) if (u is None) != (v is None) or u is not None and abs(u - v) > tolerance * max(1.0, abs(u), abs(v))]
            out += [f"{k}[{i}]: {x['values'][i]} and {y['values'][i]}" for i in apart]
    return out


def save(record: Record, path: str) -> None:
    with open(path, "w") as f:
        json.dump({"entries": record}, f, indent=1)


def load(path: str) -> Record:
    with open(path) as f:
        return json.load(f)["entries"]


def golden(nodes: DataFrame, labels: list[str]) -> Record:
    """Level 1: networks, degrees, features, mixing and assortativity of a cohort."""
    nodes = written(nodes)
    whole = written(delaunay.delaunay(nodes))
    edges = written(delaunay.network(nodes))
    degree = graph.degree_summary(nodes, edges).orderBy("patient").collect()  # a row a sample
    values, names = features.attributes(nodes, ["phenotype"], labels)
    table = features.neighbourhood_statistics(values, names, nodes, edges, 1)
    own = [c for c in table.columns if c not in ("patient", "sample", "node_id")]
    matrix = written(mixing.mixing_matrix(edges, nodes, normalized=True))
    return {
        "delaunay": exact(whole),
        "edges": exact(edges),
        "degree_summary": floats([float(x) for r in degree for x in (r["mean_degree"], r["min_degree"], r["max_degree"])]),
        "feature_means": floats([r["mean"] for r in features.column_means(table, own).orderBy("column").collect()]),
        "mixing_matrix": floats([r["value"] for r in matrix.orderBy("patient", "a", "b").collect()]),  # labels squared, a sample
        "assortativity": floats([r["assortativity"] for r in mixing.coefficient(matrix).orderBy("patient").collect()]),
    }


def reproducible(nodes: DataFrame, labels: list[str]) -> list[str]:
    """Level 2: what differs between two runs, the second on rows dealt out otherwise."""
    return differences(golden(nodes, labels), golden(nodes.repartition(7), labels))


def recovery(spark: SparkSession, cells: int = 3000, niches: int = 5, settings: dict[str, Any] | None = None, k: int = 15) -> dict[str, float]:
    """Level 3: how well one sample's planted niches are found again (ari, nmi), and the share of nearest neighbours among
    the features that the layout keeps."""
    nodes = tissue(spark, 1, cells, niches=niches)
    c = config.NicheConfig.of({"clusterer": "gmm", "n_clusters": niches} | (settings or {}))
    found = steps.niches(nodes, steps.networks(nodes, config.NetworkConfig()), c)
    rows = written(found.labels.join(nodes.select("node_id", "true_niche"), "node_id").selectExpr("true_niche as a", "niche as b"))
    names = [x for x in found.features.columns if x not in ("patient", "sample", "node_id", "row_id")]
    high = found.features.select(F.col("row_id").alias("id"), F.array(*(F.col(f"`{x}`") for x in names)).alias("vector"))
    kept = agreement.overlap(written(vectors.nearest(high, k)), written(vectors.nearest(found.vectors, k)), k)
    return {"ari": agreement.rand_index(rows).first()["ari"], "nmi": agreement.normalized_information(rows).first()["nmi"], "overlap": kept.first()["share"]}
