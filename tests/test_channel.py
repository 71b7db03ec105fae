"""Publishing: each batch once, aborted batches leave nothing, failing targets go."""

import json
import os

import pytest

from quern.sources import channel
from quern.streaming import events as X

from .test_streaming import folder

SCHEMA = "message_id long, room_id string, sender long, payload string"


def frames(n):
    return [{"message_id": i, "room_id": "ab"[i % 2], "sender": i % 5, "payload": f"p{i}"} for i in range(n)]


def publish(spark, source, target, checkpoint, limit=1):
    spark.dataSource.register(channel.Channel)
    q = X.event_stream(spark, source, SCHEMA, limit).writeStream.format("channel").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)


def got(spark, path):
    return sorted((r.batch_id, r.message_id, r.payload) for r in channel.published(spark, path, SCHEMA).collect())


def test_batches_are_published_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source, target, checkpoint = folder(spark, frames(90), tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    assert got(spark, target) == []
    publish(spark, source, target, checkpoint)
    want = [(i // 30, i, f"p{i}") for i in range(90)]
    assert got(spark, target) == want
    # the driver died after batch 2 was published and before Spark noted it: the batch is run again
    for name in ("2", ".2.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    files = set(os.listdir(f"{target}/frames"))
    publish(spark, source, target, checkpoint)
    assert got(spark, target) == want and set(os.listdir(f"{target}/frames")) == files
    # a task's files without a manifest are not published
    channel.ChannelWriter(spark.createDataFrame([], SCHEMA).schema, target).write(iter([(7, "a", 1, "lost")]))
    assert got(spark, target) == want


def test_commit_and_abort(spark, tmp_path):
    w = channel.ChannelWriter(spark.createDataFrame([], SCHEMA).schema, str(tmp_path))
    rows = [(i, "a", None, None if i == 3 else f"x{i}") for i in range(25_000)]
    w.abort([w.write(iter(rows)), None], 0)
    assert os.listdir(tmp_path / "frames") == []
    first, empty = w.write(iter(rows)), w.write(iter([]))
    w.commit([first, empty, None], 4)
    w.commit([w.write(iter(rows[:5]))], 4)
    assert json.loads((tmp_path / "manifests" / "4.json").read_text()) == [{"file": first.file, "frames": 25_000}]
    got_rows = channel.published(spark, str(tmp_path), SCHEMA).collect()
    assert sorted(r.message_id for r in got_rows) == list(range(25_000)) and {r.batch_id for r in got_rows} == {4}
    assert sum(r.payload is None for r in got_rows) == 1


@pytest.mark.parametrize("broken", [set(), {2, 11}])
def test_failing_targets_are_pruned(spark, tmp_path, broken):
    """Members get all frames of their room but their own; a connection that fails is not tried again and goes."""
    members = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 10 + i) for i in range(3)], "room_id string, conn_id long")
    log = str(tmp_path)

    def send(conn, text):
        with open(f"{log}/{conn}", "a") as f:
            f.write(text + "\n")
        return conn not in broken

    sent = frames(20)
    rows = spark.createDataFrame([tuple(r.values()) for r in sent], SCHEMA)
    told = channel.deliver(channel.audience(rows, members), send).cache()
    got = {r.conn_id: (r.sent, r.failed) for r in told.collect()}
    for room, conn in [("a", i) for i in range(4)] + [("b", 10 + i) for i in range(3)]:
        own = [r["payload"] for r in sent if r["room_id"] == room and r["sender"] != conn]
        assert got[conn] == ((0, len(own)) if conn in broken else (len(own), 0))
        lines = (tmp_path / str(conn)).read_text().split()
        assert lines == (own[:1] if conn in broken else own)
    assert {r.conn_id for r in channel.pruned(members, told).collect()} == {0, 1, 2, 3, 10, 11, 12} - broken
    told.unpersist()
