"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichegrid.llm.common import WORD, cut


#: Weights are told apart to so many levels where keys are cut into ranges.
LEVELS = 20


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A document's weight in its source, above 0 and at most 1: the share of its bytes that aren't symbols or marks."""
    junk = F.length(F.translate(text, "|*$%&#@^~<>=+_{}[]!0123456789", ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.try_divide(junk, F.length(text))), F.lit(1.0)).cast("double")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number above 0 and below 1 that depends on the id and the seed alone: 48 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, shares: Sequence[float], total: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh `shares` in turn and divide total * all sizes. No target is above
    most * source_size; what is above goes to the others by weight until none is. That is: each source gets
    min(cap, level * weight), and the sources that reach their cap are those with the least cap per weight.
    """
    place = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    share = F.element_at(F.array(*(F.lit(float(x)) for x in shares)), ((F.row_number().over(place) - 1) % len(shares) + 1).cast("int"))
    by_need = W.orderBy(F.col("cap") / F.col("share"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = W.partitionBy()
    rows = sizes.select("source", "source_size", share.alias("share"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(total))
    rows = rows.select("*", ((budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("share").over(everything) - F.coalesce(F.sum("share").over(before), F.lit(0.0)))).alias("level"))
    full = F.col("cap") <= F.col("level") * F.col("share")
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    return rows.select("source", "source_size", F.when(full, F.col("cap")).otherwise(level * F.col("share")).alias("target"))


def mix(docs: DataFrame, shares: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs.

    Size is the number of words. A source whose target is a epochs and a rest gets each document a times in full;
    the rest goes to the documents with the least exponential keys -ln(u) / weight until the next one would pass it.
    That document gets as many of its words as are left, so taken sums to the target, rounded down, of each source.

    Ids and texts of null, empty texts and repeated rows are rows like others: size 0 takes nothing, a null id has a
    key of its own, equal rows share a key and take in any order, as they are the same. An empty table gives no rows.

    A source may hold most rows: its keys are cut into ranges of about `bucket_rows` documents, ranges are summed
    first, and only the one range where the rest ends is sorted row by row. Very long texts only cost their reading;
    columns of docs with other names than doc_id, source and text are not read.
    """
    text = F.col("text")
    weight = quality_weight(text)
    key = -F.log(uniform(F.col("doc_id"), seed)) / weight
    rows = cut(docs.select("doc_id", "source", words_in(text).alias("size"), key.alias("key"), F.ceil(weight * LEVELS).alias("level")))  # each text is read once
    # a key of weight w lies below k with probability 1 - exp(-k w): summed over a source's weights, that is about the
    # share of its documents before k, so that ranges are about equally large whatever the weights
    levels = [F.count_if(F.col("level") == i).alias(f"_n{i}") for i in range(1, LEVELS + 1)]
    weights = rows.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n"), *levels)
    before = sum((F.col(f"_n{i}") * (F.lit(1.0) - F.exp(F.col("key") * (-i / LEVELS))) for i in range(1, LEVELS + 1)), F.lit(0.0))
    rows = rows.join(weights, F.col("source").eqNullSafe(F.col("_s")))
    rows = cut(rows.select("doc_id", "source", "size", "key", F.floor(before / bucket_rows).alias("at")))
    fine = rows.groupBy("source", F.col("at").alias("fine")).agg(F.sum("size").alias("words"))
    sizes = fine.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, shares, total, most)
    goal = goal.select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
    goal = goal.select("*", F.floor(F.col("target")).cast("long").alias("whole"))
    goal = goal.select("source", "source_size", "target", "epochs", (F.col("whole") - F.col("epochs") * F.col("source_size")).alias("rest"))
    ahead = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = fine.select("source", "fine", "words", ahead.alias("ahead")).withColumnRenamed("source", "_s")
    # the range in which the rest ends: its index and what the ranges before it take
    ends = goal.join(ends, F.col("source").eqNullSafe(F.col("_s"))).where((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("words"))).select("_s", "fine", "ahead")
    # written, so that the next join shuffles both sides and Spark can split a large source's rows
    goal = cut(goal.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s"))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    last = F.coalesce(F.col("at") == F.col("fine"), F.lit(False))
    within = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    near = rows.where(last).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    far = rows.where(~last).withColumn("part", F.when(F.col("fine").isNull() | (F.col("at") < F.col("fine")), F.col("size")).otherwise(0))
    out = far.unionByName(near.withColumn("part", part))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.when(F.col("rest") > 0, F.col("part")).otherwise(0)).cast("long").alias("taken"))
