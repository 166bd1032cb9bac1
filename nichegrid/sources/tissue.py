"""Synthetic tissue with planted niches, made by Spark from hashes: a cohort of known truth for tests and timing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(*keys: Column | int) -> Column:
    """A number above 0 and below 1 that depends on the keys alone."""
    h = F.xxhash64(*(F.lit(k) if isinstance(k, int) else k for k in keys))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def tissue(spark: SparkSession, samples: int = 4, cells: int = 10_000, phenotypes: int = 12, niches: int = 5, seed: int = 20260804, side: float = 1000.0, spread: float = 0.09) -> DataFrame:
    """nodes(patient, sample, node_id, x, y, phenotype, true_niche) of `samples` samples with `cells` cells each.

    A niche is a place in the field, other in each sample, and a mix of phenotypes, the same in all: weights u**3 + 0.01.
    Cells lie around their niche's place (Gaussian, by the Box-Muller transform) and are clamped to the field.
    """
    rng = np.random.default_rng(seed)
    mix = rng.uniform(size=(niches, phenotypes)) ** 3 + 0.01
    shares = np.cumsum(mix / mix.sum(1, keepdims=True), 1)[:, :-1]  # a few numbers, whatever the number of cells
    rows = spark.range(samples * cells).select(F.floor(F.col("id") / cells).cast("long").alias("s"), (F.col("id") % cells).alias("node_id"))
    u = lambda i: _uniform(seed, F.col("s"), F.col("node_id"), i)
    rows = rows.select("s", "node_id", F.floor(u(0) * niches).cast("int").alias("niche"))
    centre = lambda i: _uniform(seed, F.col("s"), F.col("niche"), 100 + i) * (side * 0.8) + side * 0.1
    far = F.sqrt(-2 * F.log(u(1))) * (spread * side)
    place = lambda i, turn: F.least(F.lit(side), F.greatest(F.lit(0.0), centre(i) + far * turn(u(2) * (2 * float(np.pi)))))
    bounds = F.element_at(F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in shares)), F.col("niche") + 1)
    kind = F.size(F.filter(bounds, lambda b: b < u(3)))
    return rows.select((F.col("s") + 1).cast("string").alias("patient"), F.lit(None).cast("string").alias("sample"), "node_id", place(0, F.cos).alias("x"), place(1, F.sin).alias("y"), F.concat(F.lit("pheno_"), kind).alias("phenotype"), F.col("niche").cast("long").alias("true_niche"))
