"""Presence, sessions, reactions, deduplication and history over event tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import chat

PRESENCE_GAP = "10 minutes"


def routed(frames: DataFrame, kinds: list[str]) -> dict[str, DataFrame]:
    """JSON frames (column frame) by their type; unknown types and bad frames under 'other'."""
    parsed = frames.withColumn("type", F.get_json_object("frame", "$.type"))
    out = {k: parsed.where(F.col("type") == k) for k in kinds}
    return out | {"other": parsed.where(F.coalesce(~F.col("type").isin(*kinds), F.lit(True)))}


def from_others(events: DataFrame, me: str) -> DataFrame:
    """Without the echo of what this instance sent."""
    return events.where(~F.col("instance_id").eqNullSafe(me))


def present(events: DataFrame) -> DataFrame:
    """room_id, user_id whose last event (action, ts, event_id) is no leave."""
    last = events.groupBy("room_id", "user_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"))
    return last.where("action <> 'leave'").select("room_id", "user_id")


def sessions(events: DataFrame, gap: str = PRESENCE_GAP, by: str = "user_id") -> DataFrame:
    """Runs of a user's events no further apart than ``gap``: start, end of activity, count. Batch or stream (with a watermark)."""
    w = F.session_window("ts", gap)
    return events.groupBy(by, w.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n")


def deduplicated(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The first event of each id; in a stream, ids are remembered for the lateness."""
    if events.isStreaming:
        return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def reaction_counts(events: DataFrame) -> DataFrame:
    """Counts after the adds and removes so far; as a stream in complete mode."""
    return chat.folded_reactions(events)


def room_presence(events: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """Members of rooms whose key has not expired: every add renews the room's whole key."""
    rooms = events.groupBy("room_id").agg(F.max("ts").alias("renewed")).where(F.col("renewed") >= now - F.expr(f"INTERVAL {int(ttl_hours)} HOURS"))
    return present(events).join(rooms.select("room_id"), "room_id")


def replay(messages: DataFrame, reactions: DataFrame, viewer: int, n: int = 20) -> DataFrame:
    """For each room its last n messages with the number of reactions, oldest first by rank descending."""
    last = chat.latest(messages, ["room_id"], n)
    counts = chat.grouped_reactions(reactions, viewer).groupBy("message_id").agg(F.sum("n").alias("n_reactions"))
    return last.join(counts, "message_id", "left").select("room_id", "message_id", "rank", F.coalesce("n_reactions", F.lit(0)).alias("n_reactions"))


def evicted(buckets: DataFrame, now: float, capacity: float = 30.0, idle_s: int = 3600) -> DataFrame:
    """Buckets to drop: idle for over an hour and nearly full."""
    return buckets.where((F.lit(now) - F.col("last") > idle_s) & (F.col("tokens") >= capacity * 0.9))


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """JSON-line files of a folder as a stream; a broker's topic would give the same columns."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def chronological(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    return events.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
