"""Retrieval evaluation and quality audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import scores

#: Prices of a million tokens in and out, and songs for a projection.
PRICE_IN, PRICE_OUT, CATALOG = 0.15, 0.60, 114_336


def summary(cases: DataFrame) -> DataFrame:
    """One row over cases (position of the first hit or null, confidence, failed).

    Failed cases count as misses in the rates, but not in the confidence.
    """
    ok = ~F.col("failed")
    rate = lambda test: F.round(F.avg(F.when(ok & test, 100.0).otherwise(0.0)), 4)
    return cases.agg(
        F.count("*").alias("n"),
        rate(F.col("position") == 1).alias("top1"),
        rate(F.col("position") <= 3).alias("top3"),
        F.round(F.avg(F.when(ok, scores.reciprocal_rank(F.col("position"))).otherwise(0.0)), 6).alias("mrr"),
        F.round(F.avg(F.when(ok, F.col("confidence"))), 6).alias("confidence"),
        F.round(F.avg(F.col("failed").cast("int")), 4).alias("errors"),
    )


def by_tag(cases: DataFrame) -> DataFrame:
    """Hit rate by tag; cases without tags are 'untagged'."""
    tagged = cases.select(F.explode(F.coalesce("tags", F.array(F.lit("untagged")))).alias("tag"), "top1")
    return tagged.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("top1"), 100.0).otherwise(0.0)), 4).alias("top1"))


def audit(lengths: DataFrame, low: int = 50, high: int = 500) -> DataFrame:
    """One row over text lengths (column n): mean, length buckets, cost, gate and projection."""
    n = F.col("n")
    one = lengths.agg(
        F.count("*").alias("n"),
        F.round(F.avg("n"), 4).alias("mean_length"),
        F.count_if(n < 20).alias("under_20"),
        F.count_if(n.between(20, 49)).alias("to_49"),
        F.count_if(n.between(50, 90)).alias("to_90"),
        F.count_if(n.between(91, 100)).alias("to_100"),
        F.count_if(n > 100).alias("over_100"),
        F.round(F.sum("n") / 4 * F.lit(PRICE_IN) / 1_000_000 + F.sum("n") / 8 * F.lit(PRICE_OUT) / 1_000_000, 8).alias("cost"),
    )
    gate = F.when(F.col("mean_length").between(low, high), "PASS").otherwise("FAIL")
    return one.withColumn("gate", gate).withColumn("projected", F.round(F.col("cost") / F.col("n") * CATALOG, 4))
