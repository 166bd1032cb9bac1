"""Seconds that tasks spend computing, by sample, apart from reading, shuffling and writing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import SparkSession

#: (patient, sample)
Sample = tuple[str, str | None]


class _Sums(AccumulatorParam):
    def zero(self, value: dict[Sample, float]) -> dict[Sample, float]:
        return {}

    def addInPlace(self, value1: dict[Sample, float], value2: dict[Sample, float]) -> dict[Sample, float]:
        for sample, seconds in value2.items():
            value1[sample] = value1.get(sample, 0.0) + seconds
        return value1


class Clock:
    """Sums over all tasks. It is the work that was done, so what is computed twice, as after a lost executor, counts twice.
    The driver holds one number for each sample."""

    def __init__(self, spark: SparkSession):
        self.sums = spark.sparkContext.accumulator({}, _Sums())

    def by_sample(self) -> dict[Sample, float]:
        return dict(self.sums.value)

    def seconds(self) -> float:
        return sum(self.sums.value.values())


_active: ContextVar[Clock | None] = ContextVar("clock", default=None)


@contextmanager
def clock(spark: SparkSession) -> Iterator[Clock]:
    """Kernels of plans that are built inside this context are timed, whenever these run."""
    made = Clock(spark)
    token = _active.set(made)
    try:
        yield made
    finally:
        _active.reset(token)


def timed_group(kernel: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A kernel of one sample's rows, for applyInArrow; as it is if no clock runs."""
    running = _active.get()
    if running is None:
        return kernel
    sums = running.sums

    def measured(t: pa.Table) -> pa.Table:
        start = time.perf_counter()
        out = kernel(t)
        if t.num_rows:
            sums.add({(t["patient"][0].as_py(), t["sample"][0].as_py()): time.perf_counter() - start})
        return out

    return measured


def timed_frame(kernel: Callable[[tuple, pd.DataFrame], pd.DataFrame]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A kernel of a key, which starts with patient and sample, and its rows, for applyInPandas."""
    running = _active.get()
    if running is None:
        return kernel
    sums = running.sums

    def measured(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = time.perf_counter()
        out = kernel(key, pdf)
        sums.add({(key[0], key[1]): time.perf_counter() - start})
        return out

    return measured


def timed_batches(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel that makes a batch of each batch, for mapInArrow; a batch's samples share its time by their rows."""
    running = _active.get()
    if running is None:
        return kernel
    sums = running.sums

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            start = time.perf_counter()
            out = list(kernel(iter([b])))
            spent = time.perf_counter() - start
            if b.num_rows:
                shares = pa.Table.from_batches([b]).group_by(["patient", "sample"]).aggregate([([], "count_all")]).to_pylist()
                sums.add({(r["patient"], r["sample"]): spent * r["count_all"] / b.num_rows for r in shares})
            yield from out

    return measured
