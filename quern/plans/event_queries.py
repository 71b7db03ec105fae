"""Stateful event processing (batch twins), sources and sinks by round trip, and whole requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import embedders
from quern.functions import text as T
from quern.operators import backfill, catalog, chat, first_come, mapping, retrieval
from quern.sources import channel, files, keyed_table, paged_stream
from quern.streaming import events as X
from quern.streaming import presence as P
from quern.streaming import rate_limit

from . import standins as S
from .registry import query
from .search_queries import HEAD
from .text_queries import MOOD_CASE, TITLES, _titles

MESSAGES, REACTIONS, SONGS, PLAYS, USERS = S.MESSAGES, S.REACTIONS, S.SONGS, S.PLAYS, S.USERS
#: A join or leave for each event, with the same ids.
ACTIONS = "actions AS (SELECT event_id, ts, user_id, event_type AS room_id, event_id // 10 AS message_id, CASE event_type WHEN 'error' THEN 'leave' WHEN 'view' THEN 'remove' ELSE 'add' END AS action, CASE WHEN event_id % 5 = 0 THEN 'me' ELSE 'other' END AS instance_id FROM events)"


def _actions(spark, sf_dir):
    return S.table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type AS room_id", "event_id div 10 AS message_id", "CASE event_type WHEN 'error' THEN 'leave' WHEN 'view' THEN 'remove' ELSE 'add' END AS action", "CASE WHEN event_id % 5 = 0 THEN 'me' ELSE 'other' END AS instance_id")


ORACLE_BUCKETS = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) / 1000000.0 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    b(key, event_id, s, r, t) AS (SELECT key, event_id, s, r, CAST(3.0 AS DOUBLE) FROM e WHERE r = 1 UNION ALL SELECT e.key, e.event_id, e.s, e.r, least(CAST(3.0 AS DOUBLE), (CASE WHEN b.t >= 1 THEN b.t - 1 ELSE b.t END) + (e.s - b.s) * 0.00005) FROM b JOIN e ON e.key = b.key AND e.r = b.r + 1)"""


def _buckets(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).alias("seconds"))
    return rate_limit.limited(e, 3.0, 0.00005)


@query("x01_token_bucket", ORACLE_BUCKETS + " SELECT key, event_id, round(CASE WHEN t >= 1 THEN t - 1 ELSE t END, 4) AS tokens, t >= 1 AS allowed FROM b")
def token_bucket(spark, sf_dir):
    return _buckets(spark, sf_dir).select("key", "event_id", F.round("tokens", 4).alias("tokens"), "allowed")


@query("x02_evicted_buckets", ORACLE_BUCKETS + ", l AS (SELECT key, max(s) AS last, arg_max(CASE WHEN t >= 1 THEN t - 1 ELSE t END, r) AS left_ FROM b GROUP BY 1) SELECT CAST(key AS BIGINT) AS user_id, last FROM l WHERE 1706659200.0 - last > 3600 AND least(3.0, left_ + (1706659200.0 - last) * 0.00005) >= 2.7")
def evicted_buckets(spark, sf_dir):
    """The buckets of x01 that have been idle for an hour and have filled up again."""
    now = 1706659200.0
    state = _buckets(spark, sf_dir).groupBy("key").agg(F.max("seconds").alias("last"), F.max_by("tokens", F.struct("seconds", "event_id")).alias("left"))
    filled = state.withColumn("tokens", F.least(F.lit(3.0), F.col("left") + (F.lit(now) - F.col("last")) * 0.00005))
    return X.evicted(filled, now, 3.0).select(F.col("key").cast("long").alias("user_id"), "last")


@query("x03_presence", f"WITH {ACTIONS} SELECT room_id, user_id FROM actions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND action <> 'leave'")
def presence(spark, sf_dir):
    last = _actions(spark, sf_dir).groupBy("user_id").agg(F.max_by(F.struct("room_id", "action"), F.struct("ts", "event_id")).alias("l"))
    return last.where("l.action <> 'leave'").select("l.room_id", "user_id")


@query("x04_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS expires, count(*) AS n FROM s GROUP BY user_id, id")
def sessions(spark, sf_dir):
    return X.sessions(S.table(spark, sf_dir, "events"), "6 hours")


@query("x05_room_presence", f"WITH {ACTIONS}, l AS (SELECT room_id, user_id FROM actions QUALIFY row_number() OVER (PARTITION BY room_id, user_id ORDER BY ts DESC, event_id DESC) = 1 AND action <> 'leave'), r AS (SELECT room_id FROM actions GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-31 23:30:00' - INTERVAL 24 HOUR) SELECT room_id, user_id FROM l JOIN r USING (room_id)")
def room_presence(spark, sf_dir):
    return X.room_presence(_actions(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-31 23:30:00'"))


NOW_US = 1706743800000000  # 2024-01-31 23:30
#: Forty users who come, stay active and leave in all rooms.
COMINGS = "comings AS (SELECT event_id, ts, user_id % 40 AS user_id, event_type AS room_id, CASE WHEN event_id % 4 = 3 THEN 'leave' ELSE 'add' END AS action FROM events)"


def _comings(spark, sf_dir):
    return S.table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id % 40 AS user_id", "event_type AS room_id", "CASE WHEN event_id % 4 = 3 THEN 'leave' ELSE 'add' END AS action")


@query("x03_x04_connection_changes", f"WITH {COMINGS}, e AS (SELECT room_id, user_id, event_id, action, epoch_us(ts) AS us, CASE WHEN action <> 'leave' THEN ((epoch_us(ts) + 21600000000) // 600000000 + 1) * 600000000 END AS due FROM comings), w AS (SELECT *, lag(due) OVER o AS was_due, lead(us) OVER o AS following FROM e WINDOW o AS (PARTITION BY room_id, user_id ORDER BY us, event_id)) SELECT room_id, user_id, us AS at_us, CASE action WHEN 'leave' THEN 'left' ELSE 'joined' END AS change FROM w WHERE (action = 'leave') = coalesce(us < was_due, false) UNION ALL SELECT room_id, user_id, due, 'stale' FROM w WHERE due <= {NOW_US} AND coalesce(following >= due, true)")
def connection_changes(spark, sf_dir):
    """Who joined, left, or was swept after six idle hours, every ten minutes: the batch twin of the stream with timers."""
    return P.connection_changes(_comings(spark, sf_dir), F.lit(NOW_US), 21_600, 600)


@query("x05_room_changes", f"WITH {COMINGS}, e AS (SELECT room_id, user_id, event_id, action, epoch_us(ts) AS us FROM comings), g AS (SELECT *, CASE WHEN us < lag(us) OVER o + 1800000000 THEN 0 ELSE 1 END AS new FROM e WHERE action <> 'leave' WINDOW o AS (PARTITION BY room_id ORDER BY us, event_id)), l AS (SELECT room_id, min(us) AS begun, max(us) + 1800000000 AS due FROM (SELECT *, sum(new) OVER (PARTITION BY room_id ORDER BY us, event_id) AS life FROM g) GROUP BY room_id, life), h AS (SELECT e.*, begun, due, lag(action) OVER o AS before, lead(us) OVER o AS following FROM e JOIN l ON l.room_id = e.room_id AND us >= begun AND us < due WINDOW o AS (PARTITION BY e.room_id, begun, user_id ORDER BY us, event_id)) SELECT room_id, user_id, us AS at_us, CASE action WHEN 'leave' THEN 'left' ELSE 'joined' END AS change FROM h WHERE (action = 'leave') = coalesce(before <> 'leave', false) UNION ALL SELECT room_id, user_id, due, 'expired' FROM h WHERE following IS NULL AND action <> 'leave' AND due <= {NOW_US}")
def room_changes(spark, sf_dir):
    """Who joined or left a room's set, and whole sets that expired half an hour after their last add."""
    return P.room_changes(_comings(spark, sf_dir), F.lit(NOW_US), 1800)


@query("k17_delivered", f"WITH {MESSAGES}, members AS (SELECT DISTINCT room_id, CAST(user_id % 12 AS BIGINT) AS conn_id FROM messages), a AS (SELECT m.room_id, c.conn_id FROM messages m JOIN members c USING (room_id) WHERE c.conn_id <> m.user_id % 12) SELECT room_id, conn_id, count(*) FILTER (WHERE conn_id % 7 <> 3) AS sent, count(*) FILTER (WHERE conn_id % 7 = 3) AS failed, conn_id % 7 <> 3 AS stays FROM a GROUP BY 1, 2")
def delivered(spark, sf_dir):
    """Every message to the connections of its room but the sender's; some cannot be reached and are pruned."""
    frames = S.messages(spark, sf_dir).select("message_id", "room_id", F.expr("CAST(user_id % 12 AS BIGINT)").alias("sender"), F.col("text").alias("payload"))
    members = frames.select("room_id", F.col("sender").alias("conn_id")).distinct()
    told = files.stored(channel.deliver(channel.audience(frames, members), lambda conn, _: conn % 7 != 3), "delivered")
    left = channel.pruned(members, told).select("room_id", "conn_id", F.lit(True).alias("stays"))
    return told.join(left, ["room_id", "conn_id"], "left").withColumn("stays", F.coalesce("stays", F.lit(False)))


@query("x06_reaction_fold", f"WITH {ACTIONS}, l AS (SELECT message_id, action FROM (SELECT message_id, room_id, user_id, action, event_id, ts FROM actions) QUALIFY row_number() OVER (PARTITION BY message_id, user_id ORDER BY ts DESC, event_id DESC) = 1 AND action = 'add') SELECT message_id, '+1' AS emoji, count(*) AS n FROM l GROUP BY 1")
def reaction_fold(spark, sf_dir):
    return X.reaction_counts(_actions(spark, sf_dir).withColumn("emoji", F.lit("+1")))


@query("x07_x08_echo_dedupe", f"WITH {ACTIONS} SELECT event_id FROM actions WHERE instance_id <> 'me'")
def echo_dedupe(spark, sf_dir):
    a = _actions(spark, sf_dir)
    return X.deduplicated(X.from_others(a.unionByName(a.where("event_id % 3 = 0")), "me")).select("event_id")


@query("x10_incremental_ingest", f"WITH {PLAYS} SELECT play_id FROM plays WHERE airdate > TIMESTAMP '2024-01-20' AND play_type = 'view'")
def incremental_ingest(spark, sf_dir):
    checkpoints = files.Checkpoints(spark, files.scratch(spark, "checkpoints"))
    checkpoints.save("radio", "2024-01-10 00:00:00", 1)
    checkpoints.save("radio", "2024-01-20 00:00:00", 2)
    cursor = checkpoints.load().where("source = 'radio'").select(F.col("cursor").cast("timestamp_ntz").alias("cursor"))
    plays = S.plays(spark, sf_dir).where("play_type = 'view'")
    return plays.join(F.broadcast(cursor), F.col("airdate") > F.col("cursor")).select("play_id")  # one row


@query("x12_history_replay", f"WITH {MESSAGES}, {REACTIONS}, l AS (SELECT room_id, message_id, CAST(row_number() OVER (PARTITION BY room_id ORDER BY created_at DESC, message_id DESC) AS INT) AS rank FROM messages QUALIFY rank <= 20) SELECT room_id, l.message_id, rank, coalesce(n, 0) AS n_reactions FROM l LEFT JOIN (SELECT message_id, count(*) AS n FROM reactions GROUP BY 1) USING (message_id)")
def history_replay(spark, sf_dir):
    return X.replay(S.messages(spark, sf_dir), S.reactions(spark, sf_dir), 1)


@query("s10_s11_routed_frames", "SELECT event_type AS type, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS event_type FROM events) GROUP BY 1")
def routed_frames(spark, sf_dir):
    frames = S.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("type"), "user_id"))).otherwise(F.concat(F.lit('{"type": "'), "event_type", F.lit('", "x": null}'))).alias("frame"))
    legs = [df.select(F.lit(kind).alias("type")) for kind, df in X.routed(frames, ["click", "view"]).items()]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).groupBy("type").agg(F.count("*").alias("n"))


# Sources and sinks, written and read back


@query("s02_s03_k12_csv", f"WITH {SONGS}, {TITLES} SELECT song_id, trim(title) AS title, artist, concat('a, \"', artist, '\"') AS quoted FROM titles WHERE song_id % 7 <> 0")
def csv_round_trip(spark, sf_dir):
    path = files.scratch(spark, "csv")
    rows = _titles(spark, sf_dir).select("song_id", F.when(F.col("song_id") % 7 != 0, F.concat(F.lit(" "), "title", F.lit(" "))).alias("title"), "artist", F.concat(F.lit('a, "'), "artist", F.lit('"')).alias("quoted"))
    files.write_csv(rows, path)
    return files.read_csv(spark, path, "song_id long, title string, artist string, quoted string", ["title", "artist"])


@query("s05_k14_json_lines", "SELECT event_id, user_id, 0 AS bad FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT NULL, NULL, CAST(count(*) AS INT) FROM events WHERE event_id % 10 = 3")
def json_lines(spark, sf_dir):
    path = files.scratch(spark, "jsonl")
    e = S.table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 10 == 3, F.lit("{not json")).otherwise(F.to_json(F.struct("event_id", "user_id")))
    e.where("event_id % 2 = 0").select(line.alias("value")).write.text(path)
    e.where("event_id % 2 = 1").select(line.alias("value")).write.mode("append").text(path)
    rows, bad = files.read_jsonl(spark, path, "event_id long, user_id long")
    return rows.withColumn("bad", F.lit(0)).unionByName(bad.agg(F.count("*").cast("int").alias("bad")), allowMissingColumns=True)


@query("s06_k15_snapshot", f"WITH {SONGS} SELECT song_id, title FROM songs")
def snapshot(spark, sf_dir):
    path = files.scratch(spark, "snapshot")
    files.write_snapshot(S.songs(spark, sf_dir).select("song_id", "title"), path, "2024-01-31T00:00:00Z")
    back = files.read_json_array(spark, path, "timestamp string, count long, songs array<struct<song_id: long, title: string>>")
    return back.select(F.explode("songs").alias("s")).select("s.song_id", "s.title")


@query("k16_quarantine_text", f"WITH {SONGS} SELECT concat(CAST(song_id AS VARCHAR), chr(9), title) AS value FROM songs WHERE is_placeholder")
def quarantine_text(spark, sf_dir):
    path = files.scratch(spark, "quarantine")
    files.write_quarantine(S.songs(spark, sf_dir).where("is_placeholder"), path, ["song_id", "title"])
    return spark.read.text(path)


@query("s07_s09_paged_source", f"WITH {SONGS}, r AS (SELECT *, row_number() OVER (ORDER BY song_id DESC) - 1 AS i FROM songs) SELECT song_id, title, i // 40 AS page FROM r WHERE i // 40 >= 1 AND song_id > 17")
def paged_source(spark, sf_dir):
    """A recorded service, newest songs first, 40 a page: from the second page on, until the cursor of the last run."""
    import json

    from quern.sources.paged import paged_source

    total = S.songs(spark, sf_dir).agg(F.max("song_id")).first()[0] or 0

    def fetch(n: int) -> str:
        rows = [{"song_id": i, "at": f"{i:012d}"} for i in range(total - 40 * n, max(0, total - 40 * n - 40), -1)]
        return json.dumps({"results": rows, "next": "more" if total > 40 * n + 40 else None})

    spark.dataSource.register(paged_source("recorded_pages", fetch))
    options = {"pages": -(-total // 40), "pagesPerTask": 25, "offset": 1, "stopField": "at", "stopAt": f"{17:012d}"}
    rows = spark.read.format("recorded_pages").options(**options).load()
    ids = rows.select(F.get_json_object("row", "$.song_id").cast("long").alias("song_id"), F.col("page").cast("long").alias("page"))
    return ids.join(S.songs(spark, sf_dir).select("song_id", "title"), "song_id").select("song_id", "title", "page")


@query(
    "s08_s09_planned_stream",
    f"WITH {SONGS} SELECT artist, song_id, title, CAST((row_number() OVER (PARTITION BY artist ORDER BY song_id) - 1) // 20 AS INT) AS page FROM songs QUALIFY row_number() OVER (PARTITION BY artist ORDER BY song_id) <= 250",
)
def planned_stream(spark, sf_dir):
    """Songs of each artist by pages of 20, 250 an artist at most, from a recorded service: a stream read to its end."""
    import json

    import pyarrow.parquet

    recorded, size = files.scratch(spark, "recorded"), 20
    songs = S.songs(spark, sf_dir).select("song_id", "title", "artist")
    n = F.row_number().over(Window.partitionBy("artist").orderBy("song_id")) - 1
    pages = songs.withColumn("offset", F.floor(n / size) * size).groupBy("artist", "offset").agg(F.array_sort(F.collect_list(F.struct("song_id", "title"))).alias("results"))  # ``size`` rows each
    pages.select("artist", "offset", F.to_json(F.struct("results")).alias("body")).write.parquet(recorded)
    artists = [r[0] for r in spark.read.parquet(recorded).select("artist").distinct().orderBy("artist").limit(paged_stream.MAX_SUBJECTS + 1).collect()]

    def fetch(artist: str, offset: int, limit: int) -> str:
        fs, path = paged_stream.located(recorded)
        found = pyarrow.parquet.read_table(path, filesystem=fs, columns=["body"], filters=[("artist", "=", artist), ("offset", "=", offset)])["body"].to_pylist()
        return json.dumps({"results": json.loads(found[0])["results"][:limit] if found else []})

    spark.dataSource.register(paged_stream.planned_pages("recorded_artists", fetch, artists))
    options = {"state": files.scratch(spark, "state"), "pageSize": size, "perSubject": 250, "pagesPerBatch": 100_000, "tasks": 8, "intervalMs": 0}
    out = files.scratch(spark, "pages")
    rows = spark.readStream.format("recorded_artists").options(**options).load()
    stream = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", files.scratch(spark, "stream")).trigger(availableNow=True).start()
    stream.awaitTermination()
    back = spark.read.schema("subject string, page int, row string").parquet(out)
    return back.select(F.col("subject").alias("artist"), F.get_json_object("row", "$.song_id").cast("long").alias("song_id"), F.get_json_object("row", "$.title").alias("title"), "page")


@query(
    "k01_k06_k09_versioned_table",
    f"""WITH {SONGS}, had AS (SELECT song_id, title, year, popularity FROM songs WHERE source <> 'radio'), a AS (SELECT song_id, title, year, popularity FROM had UNION ALL SELECT song_id, concat('new ', title), year, popularity FROM songs WHERE song_id % 5 = 0 AND source = 'radio'),
    b AS (SELECT a.song_id, CASE WHEN s.source = 'manual' AND s.song_id % 4 = 1 THEN upper(s.title) ELSE a.title END AS title, a.year, CASE WHEN s.song_id % 9 = 2 THEN 100 - a.popularity ELSE a.popularity END AS popularity FROM a JOIN songs s USING (song_id)) SELECT song_id, title, year, popularity, 5 AS version FROM b WHERE song_id % 50 <> 7""",
)
def versioned_table(spark, sf_dir):
    """Inserts that ignore known keys, upserts, bulk updates and deletes on a stored table that rewrites touched buckets only."""
    songs = S.songs(spark, sf_dir)
    columns = ["song_id", "title", "year", "popularity"]
    table = keyed_table.KeyedTable(spark, files.scratch(spark, "songs"))
    table.create(songs.where("source <> 'radio'").select(*columns), ["song_id"], 16)
    table.insert_ignore(songs.where("song_id % 5 = 0").select("song_id", F.concat(F.lit("new "), "title").alias("title"), "year", "popularity"))
    table.upsert(songs.where("source = 'manual' AND song_id % 4 = 1").select("song_id", F.upper("title").alias("title")))
    table.update(songs.where("song_id % 9 = 2").select("song_id", (100 - F.col("popularity")).alias("popularity")))
    last = table.delete(songs.where("song_id % 50 = 7").select("song_id"))
    return table.read().withColumn("version", F.lit(last))


SCANNED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("s12_catalog_scan", f"WITH c AS (SELECT table_name AS name, count(*) AS columns, string_agg(column_name, ',' ORDER BY ordinal_position) AS names FROM (SELECT DISTINCT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN ({', '.join(map(repr, SCANNED))})) GROUP BY 1), n AS ({' UNION ALL '.join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in SCANNED)}) SELECT name, columns, names, n > 0 AS has_rows, true AS has_bytes, CAST(row_number() OVER (ORDER BY n DESC, name) AS INT) AS by_rows FROM c JOIN n USING (name)")
def catalog_scan(spark, sf_dir):
    """What the session's catalog says of the tables, with the sizes of their files and their rows by the files' footers."""
    for name in SCANNED:
        S.table(spark, sf_dir, name).createOrReplaceTempView(f"scanned_{name}")
    try:
        names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith("scanned_"))
        columns = {name: [c.name for c in spark.catalog.listColumns(name)] for name in names}
    finally:
        for name in SCANNED:
            spark.catalog.dropTempView(f"scanned_{name}")
    known = spark.createDataFrame([(n.removeprefix("scanned_"), len(c), ",".join(c)) for n, c in columns.items()], "name string, columns long, names string")
    sized = catalog.sizes({name: S.table(spark, sf_dir, name) for name in SCANNED})
    place = F.row_number().over(Window.orderBy(F.desc("n_rows"), "name"))  # a row a table
    return known.join(sized, "name").select("name", "columns", "names", (F.col("n_rows") > 0).alias("has_rows"), (F.col("bytes") > 0).alias("has_bytes"), place.alias("by_rows"))


#: Sums of signed words by the hash of each, as HashEmbedder(16) makes them.
WORD_SUMS = "list_transform(range(16), lambda d: coalesce(list_sum(list_transform(list_filter(list_transform(regexp_split_to_array(trim(lower(title)), '\\s+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT)), lambda h: h % 16 = d), lambda h: CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)), 0))"


@query(
    "p01_p04_embedder",
    f"WITH {SONGS}, e AS (SELECT song_id, {WORD_SUMS} AS v FROM songs), n AS (SELECT song_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e) SELECT song_id, CAST(len(v) AS INT) AS dims, unnest(range(1, 17)) AS place, round(CASE WHEN l > 0 THEN unnest(v) / l ELSE 0.0 END, 5)::DOUBLE AS value FROM n",
)
def embedder(spark, sf_dir):
    """Vectors of titles by the deterministic test embedder, after one that is down and one that fails."""
    first = embedders.FirstAvailable(embedders.Down(16), embedders.Down(16, says_available=True), embedders.HashEmbedder(16))
    vectors_ = S.songs(spark, sf_dir).select("song_id", embedders.embedding(F.col("title"), first).alias("v"))
    placed = vectors_.select("song_id", F.size("v").alias("dims"), F.posexplode("v").alias("at", "x"))
    return placed.select("song_id", "dims", (F.col("at") + 1).cast("long").alias("place"), F.round(F.col("x").cast("double"), 5).alias("value"))


@query(
    "j10_t12_k05_backfill",
    f"WITH {SONGS}, e AS (SELECT song_id, {WORD_SUMS} AS v FROM songs WHERE song_id % 3 <> 0), n AS (SELECT song_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e) SELECT song_id, unnest(range(1, 17)) AS place, round(CASE WHEN l > 0 THEN unnest(v) / l ELSE 0.0 END, 5)::DOUBLE AS value FROM n UNION ALL SELECT song_id, 1, 0.5 FROM songs WHERE song_id % 3 = 0",
)
def backfill_vectors(spark, sf_dir):
    """Vectors of the songs of a stored table that lack them: a run that stops after a group of buckets, and one that goes on."""
    rows = S.songs(spark, sf_dir).select("song_id", "title", F.when(F.col("song_id") % 3 == 0, F.array(F.lit(0.5))).alias("vector"))
    table = keyed_table.KeyedTable(spark, files.scratch(spark, "vectors"))
    table.create(rows, ["song_id"], 8)

    def fill(lacking):
        return lacking.select("song_id", embedders.embedding(F.col("title"), embedders.HashEmbedder(16)).cast("array<double>").alias("vector"))

    backfill.backfilled(table, F.col("vector").isNull(), fill, 4, 1)
    backfill.backfilled(table, F.col("vector").isNull(), fill, 4)
    return table.read().select("song_id", F.posexplode("vector").alias("at", "x")).select("song_id", (F.col("at") + 1).cast("long").alias("place"), F.round("x", 5).alias("value"))


# Whole requests


KEYWORDS = ["idiot", "gnu", "the license"]
#: Requests judged and, if let through, answered: a row each.
ANSWERED = f"""{HEAD.replace("WITH ", "WITH RECURSIVE ", 1)}, {MESSAGES}, {S.REQUESTS},
    e AS (SELECT request_id, seconds AS s, concat(coalesce(CAST(user_id AS VARCHAR), 'anonymous'), ':', coalesce(ip, 'unknown')) AS key FROM requests), eo AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, request_id) AS r FROM e),
    b(key, request_id, s, r, t) AS (SELECT key, request_id, s, r, CAST(2.0 AS DOUBLE) FROM eo WHERE r = 1 UNION ALL SELECT eo.key, eo.request_id, eo.s, eo.r, least(CAST(2.0 AS DOUBLE), (CASE WHEN b.t >= 1 THEN b.t - 1 ELSE b.t END) + (eo.s - b.s) * 0.00001) FROM b JOIN eo ON eo.key = b.key AND eo.r = b.r + 1),
    judged AS (SELECT q.request_id, user_id, seconds, trim(text) AS text, allow_explicit, CASE WHEN t < 1 THEN 'rate_limited' WHEN length(trim(text)) NOT BETWEEN 1 AND 500 THEN 'validation_error' WHEN regexp_matches(text, '(?i)\\b(idiot|gnu|the license)\\b') THEN 'content_filtered' ELSE 'ok' END AS outcome FROM requests q JOIN b USING (request_id)),
    l10 AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, message_id DESC) AS nth FROM messages), recent AS (SELECT DISTINCT user_id, song_id, true AS seen FROM l10 WHERE nth <= 10 AND song_id IS NOT NULL), eras AS (SELECT user_id, count(DISTINCT floor(year / 10)) > 1 AS spans FROM l10 JOIN vsongs USING (song_id) WHERE nth <= 3 GROUP BY 1),
    k AS (SELECT j.*, coalesce(spans, false) AS spans, song_id, rank, similarity, seen, count(*) FILTER (WHERE seen IS NULL) OVER (PARTITION BY request_id) AS rest FROM judged j JOIN ranked ON query_id = request_id AND rank <= 40 AND similarity >= 0 LEFT JOIN recent USING (user_id, song_id) LEFT JOIN eras USING (user_id) WHERE outcome = 'ok'),
    r AS (SELECT k.*, title, artist, year, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS place, lower(artist) AS who, CAST(floor(year / 10) * 10 AS INT) AS decade FROM k JOIN vsongs USING (song_id) WHERE (seen IS NULL OR rest < 5) AND (allow_explicit OR NOT list_contains(tags, 'Explicit'))),
    c AS (SELECT request_id, max(CASE WHEN place = 1 THEN similarity END) AS a, max(CASE WHEN place = 2 THEN similarity END) AS b, count(*) AS n FROM r GROUP BY 1), sure AS (SELECT request_id, CASE n WHEN 1 THEN 0.95 ELSE greatest(0.1, least(0.99, 1 / (1 + exp(-5 * (a - b))))) END AS confidence, n FROM c),
    p AS (SELECT request_id, who AS pa, decade AS pd FROM r WHERE place = 1),
    a1 AS (SELECT r.*, pa, pd FROM r JOIN p USING (request_id) JOIN sure USING (request_id) WHERE confidence < 0.7 AND place > 1 AND (spans OR who <> pa) AND (spans OR decade IS NULL OR pd IS NULL OR decade <> pd) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY place) = 1),
    a2 AS (SELECT r.* FROM r JOIN a1 USING (request_id) WHERE r.place > a1.place AND (r.spans OR r.who <> pa) AND (r.spans OR r.decade IS NULL OR pd IS NULL OR r.decade <> pd) AND r.who <> a1.who AND (r.spans OR r.decade IS NULL OR a1.decade IS NULL OR r.decade <> a1.decade) QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY r.place) = 1),
    m AS (SELECT request_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM judged),
    answered AS (SELECT j.*, cleaned, r.song_id, r.title, r.artist, r.year, n, confidence, CASE WHEN n > 0 THEN {MOOD_CASE.replace("(t,", "(cleaned,")} END AS mood, a1.song_id AS s1, a1.title AS t1, a1.artist AS w1, a1.year AS y1, a2.song_id AS s2, a2.title AS t2, a2.artist AS w2, a2.year AS y2
    FROM judged j JOIN m USING (request_id) LEFT JOIN r ON r.request_id = j.request_id AND place = 1 LEFT JOIN sure ON sure.request_id = j.request_id LEFT JOIN a1 ON a1.request_id = j.request_id LEFT JOIN a2 ON a2.request_id = j.request_id)"""


def _answered(spark, sf_dir):
    asked = mapping.judged(S.requests(spark, sf_dir), KEYWORDS, 2.0, 0.00001)
    vectors_ = S.query_vectors(spark, sf_dir).withColumnRenamed("query_id", "request_id")
    return mapping.answered(asked, vectors_, S.vector_songs(spark, sf_dir), S.messages(spark, sf_dir))


@query(
    "e01_match",
    f"{ANSWERED} SELECT request_id, cleaned, outcome, CASE outcome WHEN 'ok' THEN 200 WHEN 'rate_limited' THEN 429 ELSE 400 END AS status, CASE outcome WHEN 'rate_limited' THEN 100000 END AS retry_after, song_id, title, mood, CAST(n AS INT) AS n_matches, round(confidence, 6) AS confidence, concat_ws(',', s1 || ':0.8', s2 || ':0.7') AS alternates FROM answered",
)
def match(spark, sf_dir):
    """Texts to songs: limits, checks, neighbours, recent and explicit filters, confidence, alternates with scores, mood."""
    a = _answered(spark, sf_dir)
    others = F.array_join(F.transform("alternates", lambda c: F.concat(c["song_id"].cast("string"), F.lit(":"), F.format_number(c["score"].cast("double"), 1))), ",")
    return a.select("request_id", "cleaned", "outcome", "status", "retry_after", "primary.song_id", "primary.title", "mood", "n_matches", F.round("confidence", 6).alias("confidence"), F.coalesce(others, F.lit("")).alias("alternates"))


@query(
    "e01_k01_stored_messages",
    f"""{ANSWERED}, one AS (SELECT user_id, text, CAST(to_json({{'primary': {{'title': title, 'artist': artist, 'year': year}}, 'alternates': list_filter([{{'title': t1, 'artist': w1, 'year': y1}}, {{'title': t2, 'artist': w2, 'year': y2}}], lambda x: x.title IS NOT NULL), 'reasoning': mood, 'source': 'api_map'}}) AS VARCHAR) AS scores, make_timestamp(CAST(round(seconds * 1000000) AS BIGINT)) AS created_at FROM answered WHERE outcome = 'ok' AND user_id IS NOT NULL)
    SELECT room_id, user_id, text, song_id, scores, created_at FROM (SELECT 'lobby' AS room_id, user_id, text, CAST(NULL AS BIGINT) AS song_id, scores, created_at FROM one UNION ALL SELECT room_id, user_id, text, song_id, '{{}}', created_at FROM messages WHERE room_id = 'purchase')""",
)
def stored_messages(spark, sf_dir):
    """The messages that answered requests leave, appended to a stored table, and the table read back."""
    path = files.scratch(spark, "messages")
    had = S.messages(spark, sf_dir).where("room_id = 'purchase'").select("user_id", "room_id", "text", "song_id", F.lit("{}").alias("scores"), F.col("created_at").cast("timestamp").alias("created_at"))
    had.write.parquet(path)
    mapping.stored_messages(_answered(spark, sf_dir), "lobby").write.mode("append").parquet(path)
    return spark.read.schema(mapping.MESSAGE).parquet(path).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(
    "e04_e06_room_page",
    f"WITH {MESSAGES}, {REACTIONS}, {USERS}, {SONGS}, p AS (SELECT * FROM messages WHERE room_id = 'click' ORDER BY created_at DESC, message_id DESC LIMIT 25), g AS (SELECT message_id, emoji, count(*) AS n, string_agg(CAST(user_id AS VARCHAR), ' ' ORDER BY created_at, user_id) AS whose, bool_or(user_id = 7) AS mine FROM reactions GROUP BY 1, 2), x AS (SELECT message_id, sum(n) AS n, string_agg(concat(emoji, ':', CAST(n AS VARCHAR), ':', CAST(mine AS VARCHAR), ':', whose), ',' ORDER BY emoji) AS reactions FROM g GROUP BY 1) SELECT p.message_id, ip_hash, title, CAST(coalesce(n, 0) AS BIGINT) AS n_reactions, coalesce(reactions, '') AS reactions, (SELECT count(*) > 25 FROM messages WHERE room_id = 'click') AS has_more, (SELECT arg_min(message_id, (created_at, message_id)) FROM p) AS oldest_id FROM p JOIN users USING (user_id) LEFT JOIN songs USING (song_id) LEFT JOIN x ON x.message_id = p.message_id",
)
def room_page(spark, sf_dir):
    page = chat.page_before(S.messages(spark, sf_dir).where("room_id = 'click'"), None, 25)
    of_page = S.reactions(spark, sf_dir).join(F.broadcast(page.select("message_id")), "message_id", "left_semi")  # 25 ids
    g = chat.grouped_reactions(of_page, 7)
    line = F.concat_ws(":", "emoji", F.col("n").cast("string"), F.col("has_reacted").cast("string"), F.array_join(F.transform("users", lambda u: u.cast("string")), " "))
    reactions = g.groupBy("message_id").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), ",").alias("reactions"))
    full = page.join(S.users(spark, sf_dir).select("user_id", "ip_hash"), "user_id").join(S.songs(spark, sf_dir).select("song_id", "title"), "song_id", "left").join(reactions, "message_id", "left")
    return full.select("message_id", "ip_hash", "title", F.coalesce("n", F.lit(0)).alias("n_reactions"), F.coalesce("reactions", F.lit("")).alias("reactions"), "has_more", "oldest_id")


@query(
    "e05_connection_list",
    f"""WITH {MESSAGES}, {USERS}, {ACTIONS}, m AS (SELECT room_id, user_id, min(ts) AS joined_at, max(ts) AS active_at, count(*) AS connections FROM actions WHERE action <> 'leave' GROUP BY 1, 2),
    t AS (SELECT room_id, count(*) AS users, CAST(sum(connections) AS BIGINT) AS all_connections FROM m GROUP BY 1)
    SELECT m.room_id, users, all_connections, CAST(row_number() OVER (PARTITION BY m.room_id ORDER BY (m.user_id = 7) DESC, joined_at, m.user_id) AS INT) AS place, concat(substr(CAST(m.user_id AS VARCHAR), 1, 8), '...') AS who, connections, joined_at, active_at FROM m JOIN t USING (room_id)""",
)
def connection_list(spark, sf_dir):
    """Each room's members as user 7 sees them: oneself first, then by time of joining; ids masked; with the room's totals."""
    return chat.connection_list(_actions(spark, sf_dir).where("action <> 'leave'"), 7)


@query("e07_catalog_report", f"WITH {S.VECTOR_SONGS} SELECT 'songs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM vsongs UNION ALL SELECT 'vector coverage', CAST(round(100.0 * count(embedding) / count(*), 1) AS DOUBLE) FROM vsongs UNION ALL SELECT 'artists', CAST(count(DISTINCT artist) AS DOUBLE) FROM vsongs UNION ALL SELECT 'placeholders', CAST(count(*) FILTER (WHERE is_placeholder) AS DOUBLE) FROM vsongs UNION ALL SELECT 'without year', CAST(count(*) FILTER (WHERE year IS NULL) AS DOUBLE) FROM vsongs UNION ALL SELECT 'duplicates', CAST(count(*) AS DOUBLE) FROM (SELECT title FROM vsongs GROUP BY title, artist HAVING count(*) > 1) UNION ALL SELECT concat('source ', source), CAST(count(*) AS DOUBLE) FROM vsongs GROUP BY source UNION ALL SELECT concat('share of ', source), CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS DOUBLE) FROM vsongs GROUP BY source UNION ALL SELECT CASE WHEN year IS NULL THEN 'Unknown' ELSE concat(CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR), 's') END, CAST(count(*) AS DOUBLE) FROM vsongs GROUP BY 1 UNION ALL SELECT concat('tag ', tag), CAST(count(*) AS DOUBLE) FROM (SELECT unnest(tags) AS tag FROM vsongs) GROUP BY 1")
def catalog_report(spark, sf_dir):
    songs = S.songs(spark, sf_dir)

    def each(name, groups, value="n"):
        return groups.select(name.alias("metric"), F.col(value).cast("double").alias("value"))

    def counts(by):
        return songs.groupBy(by.alias("g")).agg(F.count("*").alias("n"))

    shares = catalog.share_of_total(songs, ["source"])
    again = songs.groupBy("title", "artist").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
    tags = songs.select(F.explode("tags").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    one = S.vector_songs(spark, sf_dir).agg(
        F.count("*").cast("double").alias("songs"), F.round(F.count("embedding") * 100.0 / F.count("*"), 1).cast("double").alias("vector coverage"), F.countDistinct("artist").cast("double").alias("artists"),
        F.count_if("is_placeholder").cast("double").alias("placeholders"), F.count_if(F.col("year").isNull()).cast("double").alias("without year"),
    )
    rows = one.unpivot([], one.columns, "metric", "value")
    for more in (each(F.lit("duplicates"), again), each(F.concat(F.lit("source "), "source"), shares), each(F.concat(F.lit("share of "), "source"), shares, "percent"), each(F.col("g"), counts(T.decade_label(F.col("year")))), each(F.concat(F.lit("tag "), "g"), tags)):
        rows = rows.unionByName(more)
    return rows


@query(
    "e09_import",
    f"""WITH {SONGS}, {TITLES}, new AS (SELECT t.*, s.album, s.isrc, s.arrival FROM titles t JOIN songs s USING (song_id) WHERE s.source <> 'radio'), have AS (SELECT * FROM songs WHERE source = 'radio'),
    ok AS (SELECT * FROM new WHERE song_id % 11 NOT IN (0, 1, 2, 3, 4)), fresh AS (SELECT * FROM ok n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.isrc = n.isrc) AND NOT EXISTS (SELECT 1 FROM have h WHERE h.mbid = n.mbid) AND NOT EXISTS (SELECT 1 FROM have h WHERE lower(h.title) = lower(n.title) AND lower(h.artist) = lower(n.artist))),
    a AS (SELECT *, row_number() OVER (PARTITION BY artist, album ORDER BY arrival) AS x FROM fresh), b AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY arrival) AS y FROM a WHERE album IS NULL OR x <= 1) SELECT song_id FROM b WHERE y <= 12""",
)
def import_songs(spark, sf_dir):
    """Quality gate, duplicates against the catalog by any key, caps."""
    new = _titles(spark, sf_dir).where("source <> 'radio'").withColumn("phrases", F.lit("")).withColumn("source", F.lit("manual"))
    clean, _ = catalog.quality_split(new)
    known = catalog.known_by_any(clean, S.songs(spark, sf_dir).where("source = 'radio'"))
    return catalog.capped(clean.join(known, "song_id", "left_anti"), 12, 1).select("song_id")


BATCH = "song_id, arrival, title, artist, album, CASE WHEN song_id % 5 < 2 THEN concat('c', CAST(song_id * 7 % 900 AS {str})) END AS isrc, CASE WHEN song_id % 4 = 0 THEN concat('mb-', CAST(song_id % 800 AS {str})) END AS mbid"


@query(
    "e09_w04_first_come",
    f"""WITH RECURSIVE {SONGS}, have AS (SELECT {BATCH.format(str='VARCHAR')} FROM songs WHERE source = 'radio' AND year < 1970), new AS (SELECT {BATCH.format(str='VARCHAR')} FROM songs WHERE NOT (source = 'radio' AND coalesce(year, 0) < 1970 AND year IS NOT NULL)),
    fresh AS (SELECT row_number() OVER (ORDER BY arrival, song_id) AS n, song_id, lower(artist) AS artist, concat(lower(artist), '|', lower(album)) AS on_album, album IS NULL AS bare, list_filter([concat('i', isrc), concat('m', mbid), concat('n', lower(title), '|', lower(artist))], lambda x: length(x) > 1) AS keys FROM new n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.isrc = n.isrc) AND NOT EXISTS (SELECT 1 FROM have h WHERE h.mbid = n.mbid) AND NOT EXISTS (SELECT 1 FROM have h WHERE lower(h.title) = lower(n.title) AND lower(h.artist) = lower(n.artist))),
    s(n, song_id, ok, keys, artists, albums) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL
    SELECT n, song_id, ok, CASE WHEN ok THEN list_concat(had, keys) ELSE had END, CASE WHEN ok THEN list_append(artists, artist) ELSE artists END, CASE WHEN ok AND NOT bare THEN list_append(albums, on_album) ELSE albums END FROM (SELECT f.n, CAST(f.song_id AS BIGINT) AS song_id, f.keys, f.artist, f.on_album, f.bare, s.keys AS had, s.artists, s.albums,
    NOT list_has_any(s.keys, f.keys) AND len(list_filter(s.artists, lambda x: x = f.artist)) < 12 AND (f.bare OR len(list_filter(s.albums, lambda x: x = f.on_album)) < 2) AS ok FROM s JOIN fresh f ON f.n = s.n + 1))
    SELECT song_id FROM s WHERE ok""",
)
def first_come_import(spark, sf_dir):
    """A batch whose rows repeat each other's keys, taken in order of arrival, with at most 12 songs of an artist and 2 of an album."""
    songs = S.songs(spark, sf_dir)
    old = F.coalesce((F.col("source") == "radio") & (F.col("year") < 1970), F.lit(False))
    columns = [c.strip() for c in BATCH.format(str="STRING").split(", CASE")[0].split(",")] + ["CASE" + c for c in BATCH.format(str="STRING").split(", CASE")[1:]]
    return first_come.import_batch(songs.where(~old).selectExpr(*columns), songs.where(old).selectExpr(*columns), 12, 2).select("song_id")


@query("e10_find_or_create_user", f"WITH {USERS}, s AS (SELECT o_custkey AS user_id, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) SELECT user_id, CASE WHEN joined_at < TIMESTAMP '2023-08-01' THEN sha256(concat('sub-', CAST(user_id AS VARCHAR))) ELSE 'new' END AS token_hash, coalesce(n, 0) AS live_sessions FROM users LEFT JOIN s USING (user_id)")
def find_or_create_user(spark, sf_dir):
    """Known users stay, others are made; with the sessions of each that have not expired."""
    u = S.users(spark, sf_dir)
    have = u.where("joined_at < TIMESTAMP_NTZ '2023-08-01'").select("user_id", F.sha2(F.concat(F.lit("sub-"), F.col("user_id").cast("string")), 256).alias("token_hash"))
    all_ = catalog.upsert_new(have, u.select("user_id", F.lit("new").alias("token_hash")), ["user_id"])
    live = S.table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"))
    return all_.join(live, "user_id", "left").select("user_id", "token_hash", F.coalesce("n", F.lit(0)).alias("live_sessions"))


@query("e11_health", "SELECT CASE WHEN n >= 100000 THEN 'RED' WHEN n >= 5000 THEN 'YELLOW' ELSE 'GREEN' END AS status, n FROM (SELECT count(*) AS n FROM events)")
def health(spark, sf_dir):
    return S.table(spark, sf_dir, "events").agg(F.count("*").alias("n")).select(T.size_status(F.col("n"), 5000, 100_000).alias("status"), "n")
