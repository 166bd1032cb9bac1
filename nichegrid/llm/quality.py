"""A quality classifier: quadratic discriminant analysis with shrunken class covariances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.common import arrow, cut, held_out
from nichegrid.llm.textkit import Words, pieces, stretches

FEATURES = ("log_words", "log_word_length", "letters", "capitals", "digits", "marks", "distinct_words", "top_word", "repeated_pairs", "pipes_and_symbols", "sentence_ends", "lines")


def _kinds() -> np.ndarray:
    """Per byte: 0 other, 1 letter, 2 capital, 3 digit, 4 mark, 5 symbol, 6 sentence end, 7 line end."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(97, 123), *range(128, 256)]] = 1
    kind[65:91] = 2
    kind[48:58] = 3
    kind[[*b",;:'\"()-!"]] = 4
    kind[[*b"|*$%&#@^~<>=+_{}[]\\/"]] = 5
    kind[[*b".?"]] = 6
    kind[[*b"\n"]] = 7
    return kind


_KIND = _kinds()
#: Pseudo-counts towards typical prose, so that short texts aren't judged by a few characters.
PRIOR_BYTES, PRIOR_WORDS = 60.0, 12.0
_logit = lambda count, n, typical, prior: np.log((count + prior * typical) / (n - count + prior * (1 - typical)))


def statistics(texts: pa.Array) -> np.ndarray:
    """FEATURES of each text, whole; shares are logits with pseudo-counts, so that empty texts have values too."""
    w = Words(texts)
    n = len(texts)
    size = np.diff(w.at)
    counts = np.zeros((n, 8))
    for a, z in stretches(w.raw, w.at):  # a long text lies in many
        own = np.searchsorted(w.at, [a, z - 1], "right") - 1
        owner = np.repeat(np.arange(own[1] - own[0] + 1), np.diff(np.clip(w.at[own[0] : own[1] + 2], a, z)))
        counts[own[0] : own[1] + 1] += np.bincount(owner * 8 + _KIND[w.raw[a:z]], minlength=8 * (own[1] - own[0] + 1)).reshape(-1, 8)
    words = np.diff(w.firsts)
    chars = np.bincount(np.repeat(np.arange(n), words), weights=w.ends - w.starts, minlength=n)
    distinct, top, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(words):
        own = w.hashes[w.firsts[i] : w.firsts[i + 1]]
        each = np.unique(own, return_counts=True)[1]
        distinct[i], top[i] = len(each), each.max()
        pairs[i] = len(own) - 1 - len(np.unique(own[:-1] * np.uint64(3) + own[1:])) if len(own) > 1 else 0
        byte = lambda k, typical: _logit(counts[:, k].sum(1), size, typical, PRIOR_BYTES)
    word = lambda count, typical: _logit(np.minimum(count, words), words, typical, PRIOR_WORDS)
    out = [np.log1p(words), np.log((chars + 5 * PRIOR_WORDS) / (words + PRIOR_WORDS)), byte([1, 2], 0.8), byte([2], 0.02), byte([3], 0.02), byte([4], 0.01)]
    out += [word(distinct, 0.8), word(np.maximum(top - 1, 0), 0.03), word(pairs, 0.02)]
    out += [word(counts[:, 5], 0.005), word(counts[:, 6], 0.08), word(counts[:, 7], 0.02)]
    return np.stack(out, 1).astype(float)


def features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `stats`, an array of FEATURES, for every row; nulls count as empty texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, "the_text"):
                x = statistics(b.column("the_text"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(f"k{i}") for i in range(len(keep))), flat], [*keep, "stats"])

    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("the_text"))
    return arrow(rows, batches, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes with cached Cholesky factors. Without rows of both classes, every score is 0.5."""

    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    offset: float = 0.0

    @staticmethod
    def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1) -> Discriminant:
        """moments: by class, the count, the sum and the sum of outer products.

        Each class covariance is shrunk by `shrink` towards the pooled one's diagonal, which also holds for a class of
        one row.
        """
        if any(not moments.get(c) or moments[c][0] < 1 for c in (0, 1)):
            return Discriminant(None, None)
        d = len(moments[0][1])
        means, covs = [], []
        for c in (0, 1):
            n, s, o = moments[c]
            means.append(s / n)
            covs.append((o - np.outer(s, s) / n) / max(n - 1, 1))
        ns = [moments[c][0] for c in (0, 1)]
        pooled = np.diag(sum(n * np.diag(v) for n, v in zip(ns, covs, strict=True)) / sum(ns)) + 1e-6 * np.eye(d)
        factors = [np.linalg.cholesky((1 - shrink) * v + shrink * pooled) for v in covs]
        logdet = [2 * np.log(np.diag(f)).sum() for f in factors]
        return Discriminant(tuple(means), tuple(factors), float(np.log(ns[1] / ns[0]) - 0.5 * (logdet[1] - logdet[0])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the squared Mahalanobis distances."""
        if self.means is None:
            return np.full(len(x), 0.5)
        far = [(np.linalg.solve(f, (x - m).T) ** 2).sum(0) for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.offset - 0.5 * (far[1] - far[0]), -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.1, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Learns from every labelled row whose id isn't held out: each task sends two rows of sums, no sample is taken.

    Null ids and labels other than 0 and 1 teach nothing; a label given twice counts twice.
    """
    d = len(FEATURES)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in it:
            x = np.array(b.column("stats").flatten()).reshape(-1, d)
            y = np.array(b.column("label"))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for c in (0, 1):
            k = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, c)), pa.array(np.arange(k)), pa.array(total[c])], ["label", "at", "x"])

    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    rows = stats.select(F.col(id_col).alias("id"), "stats").join(known, "id").select("stats", "label")
    found = arrow(rows, sums, "label long, at long, x double").groupBy("label", "at").agg(F.sum("x").alias("x")).collect()  # 2 * (1 + d + d*d) numbers
    total = np.zeros((2, 1 + d + d * d))
    for r in found:
        total[r["label"], r["at"]] = r["x"]
    return Discriminant.fit({c: (t[0], t[1 : 1 + d], t[1 + d :].reshape(d, d)) for c, t in enumerate(total)}, shrink)


def score(stats: DataFrame, model: Discriminant, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and score, from 0 to 1."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.array(b.column("stats").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(model.scores(x))], [*keep, "score"])

    return arrow(stats, batches, ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep) + ", score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrink: float = 0.1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    The texts are read once: their statistics are written to the shared folder, the model is fitted on all labelled
    rows that aren't held out, and all rows are scored. A null doc_id is never held out, a null text is empty, equal
    texts have equal scores, and repeated rows stay. A very long text is worked off in stretches, some bytes a word.
    Only doc_id and text of docs are read, whatever other columns are called. Empty tables give no rows.
    """
    stats = cut(features(docs))
    rows = score(stats, fit(stats, labels, shrink))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrink: float = 0.1) -> DataFrame:
    """The rows of docs whose text scores at least `threshold`, all columns as they are.

    The texts are read twice, for the fit and for the decision, and never shuffled.
    """
    model = fit(features(docs), labels, shrink)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, "text"):
                yield b.filter(pa.array(model.scores(statistics(b.column("text"))) >= threshold))

    return arrow(docs, batches, docs.schema)
