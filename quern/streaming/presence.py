"""Presence with timers: connections that go stale, and room sets that expire as a whole.

Two kinds of state, each as a streaming operator (``transformWithState``, state in
RocksDB, timers by event time) and as a batch twin of plain aggregates and windows
that gives the same change log:

* Connections: each event of a user in a room is activity; a sweep every SWEEP_S
  seconds removes users that have been idle for more than IDLE_S. State is a time for
  each user and room, so that no room is one key; a timer stands at the sweep that
  would remove the user.
* Room sets: a set of users for each room whose whole key lives TTL_S seconds from the
  last add. State is a map for each room, with one timer.

Events: room_id, user_id, ts (timestamp), event_id, action ("leave", or anything else).
Times are compared to the microsecond; in one place at one time, events go by id. A
stream's changes are those up to its watermark, a batch's up to ``now``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

SWEEP_S, IDLE_S, TTL_S = 30, 600, 86_400
CHANGES = "room_id string, user_id long, at_us long, change string"
_US = 1_000_000
_TIME = StructType([StructField("us", LongType()), StructField("due", LongType())])


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and map state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sweep_after(us: int, idle_s: int = IDLE_S, sweep_s: int = SWEEP_S) -> int:
    """The first sweep that finds a user who was last active at ``us`` idle for more than ``idle_s``."""
    step = sweep_s * _US
    return ((us + idle_s * _US) // step + 1) * step


class Connections(StatefulProcessor):
    """A user in a room: the time of the last activity, and the sweep that will remove the user."""

    def __init__(self, idle_s: int, sweep_s: int):
        self.idle_s, self.sweep_s = idle_s, sweep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", _TIME)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])  # of one user, room and micro-batch
        due, out = self.last.get()[1] if self.last.exists() else None, []
        before = due
        for us, action in zip(batch["us"].tolist(), batch["action"]):
            if due is not None and us >= due:
                out.append((due, "stale"))
                due = None
            if action == "leave":
                if due is not None:
                    out.append((us, "left"))
                due = None
            else:
                if due is None:
                    out.append((us, "joined"))
                due = sweep_after(us, self.idle_s, self.sweep_s)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            if due is None:
                self.last.clear()
            else:
                self.last.update((int(batch["us"].iloc[-1]), due))
                self.handle.registerTimer(due // 1000)
        yield _changes(key[0], [(int(key[1]), us, change) for us, change in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.last.exists() and self.last.get()[1] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((int(key[1]), self.last.get()[1], "stale"))
            self.last.clear()
        yield _changes(key[0], out)

    def close(self) -> None:
        pass


class RoomSets(StatefulProcessor):
    """A room: its users, and when the whole set expires."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.users = handle.getMapState("users", StructType([StructField("user_id", LongType())]), StructType([StructField("us", LongType())]))
        self.due = handle.getValueState("due", StructType([StructField("us", LongType())]))

    def _expired(self, due: int) -> list[tuple[int, int, str]]:
        out = sorted((int(k[0]), due, "expired") for k in self.users.keys()) if self.users.exists() else []
        self.users.clear()
        self.due.clear()
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = due = self.due.get()[0] if self.due.exists() else None
        for batch in [pd.concat(list(rows)).sort_values(["us", "event_id"])]:  # of one room and micro-batch
            out = []
            for us, user, action in zip(batch["us"].tolist(), batch["user_id"].tolist(), batch["action"]):
                if due is not None and us >= due:
                    out += self._expired(due)
                    due = None
                held = due is not None and self.users.containsKey((user,))
                if action == "leave":
                    if held:
                        self.users.removeKey((user,))
                        out.append((user, us, "left"))
                else:
                    if not held:
                        out.append((user, us, "joined"))
                    self.users.updateValue((user,), (us,))
                    due = us + self.ttl_s * _US
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            if due is not None:
                self.due.update((due,))
                self.handle.registerTimer(due // 1000)
        yield _changes(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else None
        yield _changes(key[0], self._expired(due) if due is not None and due // 1000 <= expiredTimerInfo.getExpiryTimeInMs() else [])

    def close(self) -> None:
        pass


def _changes(room: str, rows: list[tuple[int, int, str]]) -> pd.DataFrame:
    out = pd.DataFrame({"user_id": [r[0] for r in rows], "at_us": [r[1] for r in rows], "change": [r[2] for r in rows]}).astype({"user_id": "int64", "at_us": "int64", "change": "object"})
    out.insert(0, "room_id", room)
    return out.astype({"room_id": "object"})


def _timed(events: DataFrame) -> DataFrame:
    return events.select("room_id", "user_id", "ts", "event_id", "action", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def connection_changes_stream(events: DataFrame, idle_s: int = IDLE_S, sweep_s: int = SWEEP_S, lateness: str = "0 seconds") -> DataFrame:
    """The change log of a stream of events: joined, left, stale."""
    keyed = _timed(events).withWatermark("ts", lateness).groupBy("room_id", "user_id")
    return keyed.transformWithStateInPandas(Connections(idle_s, sweep_s), CHANGES, "append", "eventTime")


def room_changes_stream(events: DataFrame, ttl_s: int = TTL_S, lateness: str = "0 seconds") -> DataFrame:
    """The change log of room sets: joined, left, expired."""
    keyed = _timed(events).withWatermark("ts", lateness).groupBy("room_id")
    return keyed.transformWithStateInPandas(RoomSets(ttl_s), CHANGES, "append", "eventTime")


def connection_changes(events: DataFrame, now_us: Column, idle_s: int = IDLE_S, sweep_s: int = SWEEP_S) -> DataFrame:
    """The same change log of a table: each event looks at the one before it of the same user and room, and at the one after."""
    step = sweep_s * _US
    own = Window.partitionBy("room_id", "user_id").orderBy("us", "event_id")
    due = (F.floor((F.col("us") + idle_s * _US) / step) + 1) * step
    e = _timed(events).withColumn("due", F.when(F.col("action") != "leave", due))
    e = e.withColumn("was_due", F.lag("due").over(own)).withColumn("next", F.lead("us").over(own))
    was = F.coalesce(F.col("us") < F.col("was_due"), F.lit(False))
    change = F.when((F.col("action") == "leave") & was, "left").when((F.col("action") != "leave") & ~was, "joined")
    at_event = e.withColumn("change", change).where("change IS NOT NULL").select("room_id", "user_id", F.col("us").alias("at_us"), "change")
    stale = e.where(F.col("due").isNotNull() & (F.col("next").isNull() | (F.col("next") >= F.col("due"))) & (F.col("due") <= now_us))
    return at_event.unionByName(stale.select("room_id", "user_id", F.col("due").alias("at_us"), F.lit("stale").alias("change")))


def room_changes(events: DataFrame, now_us: Column, ttl_s: int = TTL_S) -> DataFrame:
    """The same change log of a table.

    A room's lives, from an add to the expiry that no further add put off, are
    session windows over its adds, merged in each task before they are shuffled;
    an event belongs to the life that began last before it. What is looked at row
    by row is one user in one life.
    """
    e = _timed(events)
    w = F.session_window(F.timestamp_micros("us"), f"{ttl_s * _US - 1} microseconds")  # Spark joins windows that touch; an add at the expiry begins a new life
    lives = e.where("action <> 'leave'").groupBy("room_id", w.alias("w")).agg(F.count("*").alias("n")).select("room_id", F.unix_micros("w.start").alias("begun"), (F.unix_micros("w.end") + 1).alias("due"))
    own_life = (F.col("us") >= F.col("begun")) & (F.col("us") < F.col("due"))
    held = e.join(lives, "room_id").where(own_life)  # leaves outside of a life change nothing
    own = Window.partitionBy("room_id", "begun", "user_id").orderBy("us", "event_id")
    held = held.withColumn("had", F.coalesce(F.lag("action").over(own) != "leave", F.lit(False))).withColumn("last", F.lead("us").over(own).isNull())
    change = F.when((F.col("action") == "leave") & F.col("had"), "left").when((F.col("action") != "leave") & ~F.col("had"), "joined")
    at_event = held.withColumn("change", change).where("change IS NOT NULL").select("room_id", "user_id", F.col("us").alias("at_us"), "change")
    expired = held.where(F.col("last") & (F.col("action") != "leave") & (F.col("due") <= now_us))
    return at_event.unionByName(expired.select("room_id", "user_id", F.col("due").alias("at_us"), F.lit("expired").alias("change")))
