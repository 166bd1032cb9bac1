"""A table of what each network cost, and summaries of repeated measurements."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nichegrid.functions.clock import clock
from nichegrid.functions.lineage import written
from nichegrid.operators.graph import SAMPLE
from nichegrid.plans import runs, steps
from nichegrid.plans.config import NetworkConfig

_COSTS = T.StructType([T.StructField("patient", T.StringType()), T.StructField("sample", T.StringType()), T.StructField("seconds", T.DoubleType())])


@dataclass
class Samples:
    """Seconds of repeated measurements."""

    seconds: list[float]

    def median(self) -> float:
        return statistics.median(self.seconds)

    def mad(self) -> float:
        """The median distance from the median."""
        middle = self.median()
        return statistics.median(abs(s - middle) for s in self.seconds)

    def best(self) -> float:
        return min(self.seconds)


def measure(repeats: int, work: Callable[[], Any]) -> Samples:
    """Wall-clock seconds of each of `repeats` turns of work, of one at least, after a turn that warms up."""
    out = []
    for _ in range(max(1, repeats) + 1):
        start = time.perf_counter()
        work()
        out.append(time.perf_counter() - start)
    return Samples(out[1:])


def networks(nodes: DataFrame, config: NetworkConfig, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, costs): step 1's edges, written, and (patient, sample, nodes, edges, seconds), a row for each sample.

    seconds is what tasks spent on the sample's geometry: cells, nearest nodes and trimming, summed over its parts. With a
    path, edges are stored there and taken from there if they come from the same nodes and settings; what wasn't computed
    now has null, and so has a sample whose nodes no kernel met. Rows come in order of patient and sample.
    """
    spark = nodes.sparkSession
    with clock(spark) as spent:
        make = lambda: steps.networks(nodes, config)
        if path is None:
            edges = written(make())
        else:
            edges = runs.stored(spark, path, f"{runs.digest(nodes)}/{asdict(config)}", None, make)
    seconds = spark.createDataFrame([(*sample, s) for sample, s in spent.by_sample().items()], _COSTS)
    count = lambda df, name: df.groupBy(*SAMPLE).agg(F.count("*").alias(name))
    out = count(nodes, "nodes")
    for other in (count(edges, "edges"), seconds):
        renamed = other.select(*(F.col(c).alias(f"_{c}") for c in SAMPLE), F.col(other.columns[-1]))
        out = out.join(renamed, F.col("patient").eqNullSafe(F.col("_patient")) & F.col("sample").eqNullSafe(F.col("_sample")), "left").drop("_patient", "_sample")
    return edges, out.select(*SAMPLE, "nodes", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"), "seconds").orderBy(*SAMPLE)
