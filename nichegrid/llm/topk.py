"""Exact top-k search by inner product: sorted lists per dimension, read without random access."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichegrid.llm.common import cut

#: Reading goes on down to these shares of the largest contribution that an entry can make, and then to its end.
LEVELS = (0.3, 0.1, 0.05, 0.035, 0.025, 0.017, 0.01, 0.005)


@dataclass
class Lists:
    """Rows of whole numbers, and for each dimension the rows in ascending order of its values."""

    values: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Lists:
        return Lists(values, np.argsort(values, 0, kind="stable").astype(np.uint32))

    def prepare(self) -> None:
        self.real = self.values.astype(np.float64)
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.real, self.order.astype(np.int64), 0).T)
        self.by = np.ascontiguousarray(self.order.T)
        self.norms = (self.real * self.real).sum(1)


def nra(query: np.ndarray, lists: Lists, k: int) -> tuple[np.ndarray, float]:
    """(rows that may be among the k highest inner products, ties included; the share of all entries that was read).

    A list is read from both ends, in every list down to the same size of contribution |query * value|. What was read of a
    row is its partial sum; what was not is at most the product of what is left of the norms of row and query. Reading
    stops once at most an eighth of the rows have upper bounds that reach the k-th lower bound: the others can't qualify,
    and the scores of these are left to be resolved.
    """
    n, d = lists.real.shape
    k = min(k, n)
    q = query.astype(np.float64)
    dims = np.flatnonzero(q)
    top = float((np.abs(q) * np.maximum(-lists.sorted[:, 0], lists.sorted[:, -1])).max(initial=0.0))
    partial, row_rest, query_rest = np.zeros(n), lists.norms.copy(), np.full(n, float(q @ q))
    noise = 1e-9 * (1 + np.sqrt(lists.norms * float(q @ q)))
    low, high = [0] * d, [n] * d  # what is unread of each list lies between
    read = 0
    bounds = {j: top * np.array(LEVELS) / abs(q[j]) for j in dims.tolist()}
    ends = {j: (np.searchsorted(lists.sorted[j], -b, "right").tolist(), np.searchsorted(lists.sorted[j], b, "left").tolist()) for j, b in bounds.items()}
    for level in range(len(LEVELS)):
        parts, values, own = [], [], []
        for j in dims.tolist():
            a = max(low[j], ends[j][0][level])
            z = max(a, min(high[j], ends[j][1][level]))
            for first, last in ((low[j], a), (z, high[j])):
                if last > first:
                    parts.append(lists.by[j, first:last])
                    values.append(lists.sorted[j, first:last])
                    own.append((q[j], last - first))
            low[j], high[j] = a, z
        if parts:
            at, x = np.concatenate(parts), np.concatenate(values)
            own = np.repeat([o for o, _ in own], [m for _, m in own])
            partial += np.bincount(at, own * x, n)
            row_rest -= np.bincount(at, x * x, n)
            query_rest -= np.bincount(at, own * own, n)
            read += len(at)
        slack = np.sqrt(np.maximum(row_rest, 0) * np.maximum(query_rest, 0)) + noise
        least = np.partition(partial - slack, n - k)[n - k]
        some = np.flatnonzero(partial + slack >= least)
        if len(some) <= max(4 * k, n // 8):
            return some, read / (n * d)
    return np.arange(n), 1.0  # to the lists' ends: every score is resolved


def best(queries: np.ndarray, query_ids: np.ndarray, lists: Lists, row_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the k best rows for each query, its own id left out; ties to the smaller id."""
    out = []
    lists.prepare()
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(lists.values).max(initial=0)) * max(1, lists.values.shape[1])
    whole = lists.values if limit < 2**62 else lists.values.astype(object)  # where sums leave 64 bits, Python's integers
    ask = k + int(np.unique(row_ids, return_counts=True)[1].max(initial=0))  # the query's own rows don't count
    for vector, own in zip(queries, query_ids.tolist(), strict=True):
        some, _ = nra(vector, lists, ask)
        some = some[row_ids[some] != own]
        scores = (whole[some] @ vector.astype(whole.dtype)).tolist()
        ids = row_ids[some].tolist()
        out += [(own, i, -s) for s, i in sorted((-s, i) for s, i in zip(scores, ids, strict=True))[:k]]
    return out


def search(vectors: DataFrame, k: int = 10, scale: int = 1024, query_every: int = 100, block_rows: int = 8192, query_block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner product for each query.

    Components become floor(scale * x). Queries are the ids divisible by `query_every`, candidates all rows but those
    of the query's id; ties go to the smaller id. Rows whose vector or id is null, or whose vector holds a null or a
    non-finite component, take no part; a shorter vector counts as followed by zeros; rows that repeat an id with the
    same vector are candidates each. Other columns of vectors, whatever their names, are not read. Empty tables give no
    rows.

    Candidates are dealt into blocks of about `block_rows` by id hash; each block's lists are sorted once and written.
    Every pair of a block and a block of queries meets in one task and sends k rows a query to the final ranking.
    """
    number = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), number.cast("array<long>").alias("v"))
    asked = rows.where(F.col("id") % query_every == 0).distinct()
    count = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % query_every == 0).alias("q"), F.max(F.size("v")).alias("d")).first()
    nc, nq, d = max(1, -(-count["n"] // block_rows)), max(1, -(-count["q"] // query_block)), count["d"] or 0
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dense(vs: pa.ChunkedArray) -> np.ndarray:
        out = np.zeros((len(vs), d), np.int64)
        for i, v in enumerate(vs.to_pylist()):
            out[i, : len(v)] = v
        return out

    def sort(t: pa.Table) -> pa.Table:
        x = Lists.of(dense(t["v"]))
        return pa.table({"cb": t["cb"][:1], "ids": pa.array([t["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "values": pa.array([x.values.astype("<i8").tobytes()], pa.binary()), "orders": pa.array([x.order.astype("<u4").tobytes()], pa.binary())})

    lists = cut(rows.select("id", "v", deal(nc).alias("cb")).groupBy("cb").applyInArrow(sort, "cb int, ids binary, values binary, orders binary"))
    left = asked.select("id", "v", deal(nq).alias("qb"), every(nc).alias("cb"))
    right = lists.select("ids", "values", "orders", F.col("cb").alias("cb"), every(nq).alias("qb"))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if a.num_rows and b.num_rows and d:
            ids, values, order = (np.frombuffer(b[c][0].as_py(), kind) for c, kind in (("ids", "<i8"), ("values", "<i8"), ("orders", "<u4")))
            found = best(dense(a["v"]), a["id"].to_numpy(), Lists(values.reshape(-1, d), order.reshape(-1, d)), ids, k)
        elif a.num_rows and b.num_rows:  # vectors without components: all scores are 0
            ids = sorted(np.frombuffer(b["ids"][0].as_py(), "<i8").tolist())
            found = [(own, i, 0) for own in a["id"].to_pylist() for i in [x for x in ids if x != own][:k]]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
