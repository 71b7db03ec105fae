"""Streaming queries give what their batch twins give."""

import json
import uuid

from pyspark.sql import functions as F

from quern.sources import files
from quern.streaming import events as X
from quern.streaming import rate_limit


def run(df, name=None, mode="append"):
    name = name or f"t{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def folder(spark, rows, tmp_path, parts=3):
    """JSON-line files in time order, one a micro-batch."""
    import os

    size = -(-len(rows) // parts)
    for i in range(parts):
        path = tmp_path / f"part{i}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows[i * size : (i + 1) * size]))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path)


def test_rate_limit(spark, tmp_path):
    rows = [{"key": f"u{i % 4}", "event_id": i, "seconds": i * 0.2} for i in range(240)]
    schema = "key string, event_id long, seconds double"
    got = run(rate_limit.limited_stream(X.event_stream(spark, folder(spark, rows, tmp_path), schema), 5.0, 1.0))
    want = rate_limit.limited(spark.createDataFrame(rows, schema), 5.0, 1.0)
    take = lambda df: sorted((r.key, r.event_id, round(r.tokens, 6), r.allowed) for r in df.collect())
    assert take(got) == take(want) and not all(r[3] for r in take(want))


def test_burst_of_thirty(spark):
    rows = [("a", i, 0.0) for i in range(31)] + [("b", 99, 0.0)]
    out = {r.event_id: r.allowed for r in rate_limit.limited(spark.createDataFrame(rows, "key string, event_id long, seconds double")).collect()}
    assert all(out[i] for i in range(30)) and not out[30] and out[99]


def test_reactions_and_dedupe(spark, tmp_path):
    rows = [{"event_id": i % 50, "ts": f"2024-01-01T00:00:{i % 50:02d}", "message_id": i % 5, "emoji": "x", "user_id": i % 7, "action": "remove" if i % 3 == 0 else "add"} for i in range(60)]
    schema = "event_id long, ts timestamp, message_id long, emoji string, user_id long, action string"
    path = folder(spark, rows, tmp_path)
    batch = spark.createDataFrame([], schema).unionByName(spark.read.schema(schema).json(path))
    ids = run(X.deduplicated(X.event_stream(spark, path, schema)))
    assert sorted(r.event_id for r in ids.collect()) == sorted(r.event_id for r in X.deduplicated(batch).select("event_id").collect())
    last = X.event_stream(spark, path, schema).groupBy("message_id", "emoji", "user_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"))
    counts = run(last, mode="complete").where("action = 'add'").groupBy("message_id", "emoji").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, X.reaction_counts(batch).collect()))


def test_sessions(spark, tmp_path):
    rows = [{"user_id": i % 3, "ts": f"2024-01-01T{h:02d}:00:00"} for i, h in enumerate([0, 1, 2, 3, 4, 5, 12, 13, 14, 23])]
    schema = "user_id long, ts timestamp"
    path = folder(spark, rows, tmp_path)
    stream = run(X.sessions(X.event_stream(spark, path, schema).withWatermark("ts", "1 hour"), "4 hours"))
    batch = X.sessions(spark.read.schema(schema).json(path), "4 hours")
    done = {tuple(r) for r in stream.collect()}
    assert done and done <= {tuple(r) for r in batch.collect()}


def test_checkpoints(spark):
    c = files.Checkpoints(spark, files.scratch(spark, "t"))
    c.save("a", "1", 1)
    c.save("a", "2", 2)
    c.save("b", "9", 1)
    assert {(r.source, r.cursor) for r in c.load().collect()} == {("a", "2"), ("b", "9")}


def test_csv_drops_incomplete_rows(spark):
    path = files.scratch(spark, "t")
    files.write_csv(spark.createDataFrame([("a, \"b\"\nc", "x"), (None, "y"), (" ", "z")], "title string, artist string"), path)
    assert [tuple(r) for r in files.read_csv(spark, path, "title string, artist string", ["title", "artist"]).collect()] == [("a, \"b\"\nc", "x")]
