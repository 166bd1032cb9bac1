"""The corpus pipeline: quality, near-duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads it from Parquet. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.llm import chaining, minhash, mixing, quality, sentencepiece_scan
from nichegrid.llm.common import shared_folder, table, unused
from nichegrid.llm.queries import SENTENCEPIECE_MODEL


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 on five-word shingles."""
    return minhash.keep_first(docs, words=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has too."""
    return chaining.without_passages(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; one that is taken in part comes whole.

    A document of which the mix takes no word leaves. Rows that share an id, null ones too, come as often as the one
    that is taken most often.
    """
    own, times, copy = (unused(docs, name) for name in ("own", "times", "copy"))
    taken = mixing.mix(docs).select(F.col("doc_id").alias(own), F.ceil(F.try_divide(F.col("taken"), F.col("size"))).cast("int").alias(times)).where(F.col(times) > 0)
    taken = taken.groupBy(own).agg(F.max(times).alias(times))
    copies = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(own)))
    return copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(own, times, copy)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every document."""
    return sentencepiece_scan.encode(docs, SENTENCEPIECE_MODEL)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding", token_ids),
]

#: The classifier and the tokenizer can't be put in SQL; tests/llm/test_pipeline.py holds the stages
#: against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
