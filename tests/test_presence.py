"""Presence by timers: streams against batch twins, and both against a loop with a clock of its own."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import events as X
from quern.streaming import presence as P

from .test_streaming import folder, run

SCHEMA = "event_id long, room_id string, user_id long, ts timestamp, action string"


def made(rng, n, step_s, users=6):
    at, rows = 0.0, []
    for i in range(n):
        at += rng.choice((0, 1, step_s, step_s, 3 * step_s, 40 * step_s if rng.random() < 0.1 else 1))
        rows.append({"event_id": i, "room_id": rng.choice("ab"), "user_id": rng.randrange(users), "ts": (datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at)).isoformat(), "action": rng.choice(("add", "add", "say", "leave"))})
    return rows


def micros(row):
    return round((datetime.datetime.fromisoformat(row["ts"]) - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def looped(rows, idle_s=None, sweep_s=None, ttl_s=None):
    """Every second of the clock in turn: what is due happens before what comes in."""
    now, end = micros(rows[0]), micros(rows[-1])
    state, due, out, left = {}, {}, set(), sorted(rows, key=lambda r: (micros(r), r["event_id"]))
    while now <= end:
        if idle_s and now % (sweep_s * 1_000_000) == 0:
            for key in [k for k, last in state.items() if now - last > idle_s * 1_000_000]:
                out.add((*key, now, "stale"))
                del state[key]
        if ttl_s:
            for room in [r for r, d in due.items() if d == now]:
                for key in [k for k in state if k[0] == room]:
                    out.add((*key, now, "expired"))
                    del state[key]
                del due[room]
        while left and micros(left[0]) == now:
            r = left.pop(0)
            key = r["room_id"], r["user_id"]
            if r["action"] == "leave":
                if state.pop(key, None) is not None:
                    out.add((*key, now, "left"))
            else:
                if key not in state:
                    out.add((*key, now, "joined"))
                state[key] = now
                if ttl_s:
                    due[key[0]] = now + ttl_s * 1_000_000
        now += 1_000_000
    return out


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    P.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def taken(df):
    rows = [tuple(r) for r in df.select("room_id", "user_id", "at_us", "change").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("kind", ["connections", "rooms"])
def test_batch_equals_the_loop(spark, kind):
    rng = random.Random(kind)
    for step in (20, 200):
        rows = made(rng, 300, step)
        df = spark.createDataFrame([(r["event_id"], r["room_id"], r["user_id"], datetime.datetime.fromisoformat(r["ts"]), r["action"]) for r in rows], SCHEMA)
        now = F.lit(micros(rows[-1]))
        if kind == "connections":
            got, want = taken(P.connection_changes(df, now, 600, 30)), looped(rows, 600, 30)
        else:
            got, want = taken(P.room_changes(df, now, 6 * step)), looped(rows, ttl_s=6 * step)
        assert got == want and {c for *_, c in want} >= {"joined", "left", "stale" if kind == "connections" else "expired"}
    assert taken(P.connection_changes(df.limit(0), now)) == taken(P.room_changes(df.limit(0), now)) == set()


@pytest.mark.parametrize("kind", ["connections", "rooms"])
def test_stream_equals_batch(spark, rocksdb, tmp_path, kind):
    """Files in order of time; timers fire as the watermark passes them, the last in a batch without data."""
    rows = made(random.Random(kind + "s"), 160, 150)
    end = (datetime.datetime.fromisoformat(rows[-1]["ts"]) + datetime.timedelta(days=2)).isoformat()
    rows.append({"event_id": 999, "room_id": "z", "user_id": 1, "ts": end, "action": "leave"})  # moves the clock on
    path = folder(spark, rows, tmp_path, 4)
    stream = X.event_stream(spark, path, SCHEMA)
    batch, now = spark.read.schema(SCHEMA).json(path), F.lit(micros(rows[-1]))
    if kind == "connections":
        got, want = run(P.connection_changes_stream(stream, 600, 30)), P.connection_changes(batch, now, 600, 30)
    else:
        got, want = run(P.room_changes_stream(stream, 1500)), P.room_changes(batch, now, 1500)
    assert taken(got) == taken(want) and got.count() > 20
