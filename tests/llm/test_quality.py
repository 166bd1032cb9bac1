import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from nichegrid.llm import quality

from .conftest import prose


def _corpus(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        text = prose(rng, rng.randint(20, 120)) + "."
        rows.append((i, text if good else " | ".join(text.split(" ")[:30]) + " $$$", "en", "s", 0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _corpus(spark)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert all(got[i]["predicted"] == int(got[i]["score"] >= 0.3) and 0 <= got[i]["score"] <= 1 for i in got)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97


def test_held_out_labels_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs, labels = _corpus(spark)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {r["doc_id"]: round(r["score"], 9) for r in quality.classify(docs, x).collect()}
    assert score(labels) == score(turned)


def test_mahalanobis_scores():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (50, 3)), 1: rng.normal(1, 2, (70, 3))}
    model = quality.Discriminant.fit({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()}, 0.2)
    covs = {c: np.cov(v.T) for c, v in x.items()}
    pooled = np.diag((50 * np.diag(covs[0]) + 70 * np.diag(covs[1])) / 120) + 1e-6 * np.eye(3)
    at = rng.normal(0, 2, (10, 3))
    logs = []
    for c in (0, 1):
        s = 0.8 * covs[c] + 0.2 * pooled
        d = at - x[c].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.log(np.linalg.det(s)) + np.log(len(x[c])))
    assert np.allclose(model.scores(at), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}  # labels of one class teach nothing
    assert quality.classify(empty, labels).collect() == []
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == 5


def _plain_statistics(text):
    """The twelve statistics of one text, byte by byte and word by word."""
    raw = (text or "").encode()
    letters = sum(97 <= b <= 122 or b >= 128 or 65 <= b <= 90 for b in raw)
    capitals, digits = sum(65 <= b <= 90 for b in raw), sum(48 <= b <= 57 for b in raw)
    marks, symbols = sum(b in b",;:'\"()-!" for b in raw), sum(b in b"|*$%&#@^~<>=+_{}[]\\/" for b in raw)
    ends, lines = sum(b in b".?" for b in raw), raw.count(b"\n")
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]  # bytes: only A-Z
    n, size = len(words), len(raw)
    pairs = list(zip(words, words[1:]))
    logit = lambda count, of, typical, prior: math.log((count + prior * typical) / (of - count + prior * (1 - typical)))
    byte, word = lambda c, t: logit(c, size, t, 60), lambda c, t: logit(min(c, n), n, t, 12)
    top = max(collections.Counter(words).values(), default=0)
    out = [math.log(1 + n), math.log((sum(map(len, words)) + 60) / (n + 12)), byte(letters, 0.8), byte(capitals, 0.02), byte(digits, 0.02), byte(marks, 0.01)]
    return [*out, word(len(set(words)), 0.8), word(max(top - 1, 0), 0.03), word(len(pairs) - len(set(pairs)), 0.02), word(symbols, 0.005), word(ends, 0.08), word(lines, 0.02)]


def test_statistics_against_plain_counts(texts):
    long = prose(random.Random(3), 120_000)  # in several stretches
    own = [*texts.values(), None, long, "A b, (c) 42% {x}|y\\z. Why?\nA b a B\n\n", "a" * 600_000, "\n" * 10]
    got = quality.statistics(pa.array(own, pa.string()))
    assert got.shape == (len(own), len(quality.FEATURES))
    assert np.allclose(got, [_plain_statistics(t) for t in own], rtol=1e-12, atol=1e-12)
