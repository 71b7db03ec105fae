"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root: the smallest node reachable, for nodes that some link (columns a, b: long) touches.

    Large-star and small-star steps in turn until nothing changes; each step is
    a minimum per node (combined before the shuffle) and a join, and its result
    is written to the shared folder. Links of a node to itself and repeated
    links change nothing; null ends are ignored. ``rows``: about how many nodes.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = stored(now, "links", rows)
    before, is_now = None, _digest(now)
    while is_now != before and is_now[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        now = stored(small, "links", is_now[0])
        before, is_now = is_now, _digest(now)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
