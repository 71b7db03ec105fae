"""Joins, aggregates, windows, sorts, set operations and changes to tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import scores
from quern.functions import text as T
from quern.operators import catalog, chat
from quern.sources import files

from . import standins as S
from .registry import query
from .text_queries import EXPECTED, REASON, TITLES, _titles

SONGS, MESSAGES, USERS, PLAYS, REACTIONS = S.SONGS, S.MESSAGES, S.USERS, S.PLAYS, S.REACTIONS
VSONGS = S.VECTOR_SONGS


# Joins


@query("j05_known_by_any", f"WITH {SONGS}, new AS (SELECT * FROM songs WHERE source <> 'radio'), have AS (SELECT * FROM songs WHERE source = 'radio') SELECT song_id FROM new n WHERE EXISTS (SELECT 1 FROM have h WHERE h.isrc = n.isrc) OR EXISTS (SELECT 1 FROM have h WHERE h.mbid = n.mbid) OR EXISTS (SELECT 1 FROM have h WHERE lower(h.title) = lower(n.title) AND lower(h.artist) = lower(n.artist))")
def known_by_any(spark, sf_dir):
    songs = S.songs(spark, sf_dir)
    return catalog.known_by_any(songs.where("source <> 'radio'"), songs.where("source = 'radio'"))


@query(
    "j06_matched_plays",
    f"WITH {SONGS}, {PLAYS}, m AS (SELECT mbid, min(song_id) AS a FROM songs WHERE mbid IS NOT NULL GROUP BY 1), n AS (SELECT lower(trim(title)) AS t, lower(trim(artist)) AS r, min(song_id) AS b FROM songs GROUP BY 1, 2) SELECT play_id, coalesce(a, b) AS song_id FROM plays p LEFT JOIN m USING (mbid) LEFT JOIN n ON t = regexp_replace(trim(lower(p.title)), '\\s+', ' ', 'g') AND r = regexp_replace(trim(lower(p.artist)), '\\s+', ' ', 'g')",
)
def matched_plays(spark, sf_dir):
    return catalog.matched_songs(S.plays(spark, sf_dir), S.songs(spark, sf_dir)).select("play_id", "song_id")


@query("j07_hydrate", f"WITH {SONGS}, c AS (SELECT vec_id + 1900 AS song_id, vec_id AS place FROM embeddings) SELECT c.song_id, place, title, artist FROM c JOIN songs USING (song_id) WHERE NOT is_placeholder")
def hydrate(spark, sf_dir):
    c = S.table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1900).alias("song_id"), F.col("vec_id").alias("place"))
    return c.join(S.songs(spark, sf_dir).where("NOT is_placeholder"), "song_id").select("song_id", "place", "title", "artist")


@query("j08_message_context", f"WITH {MESSAGES}, {USERS}, {SONGS} SELECT message_id, user_id, ip_hash, title FROM messages JOIN users USING (user_id) LEFT JOIN songs USING (song_id)")
def message_context(spark, sf_dir):
    m = S.messages(spark, sf_dir).join(S.users(spark, sf_dir), "user_id").join(S.songs(spark, sf_dir).select("song_id", "title"), "song_id", "left")
    return m.select("message_id", "user_id", "ip_hash", "title")


@query("j09_a19_grouped_reactions", f"WITH {REACTIONS} SELECT message_id, emoji, count(*) AS n, array_to_string(list(user_id ORDER BY created_at, user_id), ',') AS users, max(CAST(user_id = 7 AS INT)) = 1 AS has_reacted FROM reactions GROUP BY 1, 2")
def grouped_reactions(spark, sf_dir):
    return chat.grouped_reactions(S.reactions(spark, sf_dir), 7).withColumn("users", F.array_join(F.transform("users", lambda u: u.cast("string")), ","))


@query("j10_lacking_embedding", f"WITH {SONGS} SELECT s.song_id FROM songs s LEFT JOIN embeddings e ON e.vec_id = s.song_id AND e.label >= 3 WHERE e.vec_id IS NULL")
def lacking_embedding(spark, sf_dir):
    done = S.table(spark, sf_dir, "embeddings").where("label >= 3").select(F.col("vec_id").alias("song_id"))
    return S.songs(spark, sf_dir).select("song_id").join(done, "song_id", "left_anti")


@query("j11_k10_idle_users", f"WITH {USERS}, {MESSAGES} SELECT user_id FROM users WHERE joined_at < TIMESTAMP '2023-08-01' AND NOT EXISTS (SELECT 1 FROM messages m WHERE m.user_id = users.user_id)")
def idle_users(spark, sf_dir):
    return S.users(spark, sf_dir).where("joined_at < TIMESTAMP_NTZ '2023-08-01'").join(S.messages(spark, sf_dir), "user_id", "left_anti").select("user_id")


@query("j12_placeholder_embeddings", f"WITH {SONGS} SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT song_id FROM songs WHERE is_placeholder)")
def placeholder_embeddings(spark, sf_dir):
    doomed = S.songs(spark, sf_dir).where("is_placeholder").select(F.col("song_id").alias("vec_id"))
    return S.table(spark, sf_dir, "embeddings").select("vec_id").join(doomed, "vec_id", "left_semi")


@query("j13_unseen_keys", f"WITH {SONGS}, {PLAYS} SELECT DISTINCT lower(trim(artist)) AS artist, mbid FROM plays p WHERE mbid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM songs s WHERE s.mbid = p.mbid)")
def unseen_keys(spark, sf_dir):
    return S.plays(spark, sf_dir).where("mbid IS NOT NULL").select(F.lower(F.trim("artist")).alias("artist"), "mbid").distinct().join(S.songs(spark, sf_dir).select("mbid"), "mbid", "left_anti").select("artist", "mbid")


@query("j14_reply_parents", f"WITH {MESSAGES} SELECT m.message_id, m.reply_to, p.user_id AS parent_author, p.room_id = m.room_id AS same_room FROM messages m LEFT JOIN messages p ON p.message_id = m.reply_to")
def reply_parents(spark, sf_dir):
    m = S.messages(spark, sf_dir)
    p = m.select(F.col("message_id").alias("reply_to"), F.col("user_id").alias("parent_author"), F.col("room_id").alias("parent_room"))
    return m.join(p, "reply_to", "left").select("message_id", "reply_to", "parent_author", (F.col("parent_room") == F.col("room_id")).alias("same_room"))


@query("j15_k11_sessions", f"WITH {USERS}, sessions AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderdate AS expires_at FROM orders) SELECT session_id, user_id, ip_hash FROM sessions JOIN users USING (user_id) WHERE expires_at >= TIMESTAMP '1998-01-01'")
def sessions(spark, sf_dir):
    s = S.table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"))
    return s.join(S.users(spark, sf_dir), "user_id").select("session_id", "user_id", "ip_hash")


@query("j17_scalar_subquery", "WITH q AS (SELECT avg(value) AS mean FROM events) SELECT event_type, count(*) AS n FROM events, q WHERE value > mean GROUP BY 1")
def scalar_subquery(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    mean = e.agg(F.avg("value").alias("mean"))
    return e.join(F.broadcast(mean), F.col("value") > F.col("mean")).groupBy("event_type").agg(F.count("*").alias("n"))  # one row is broadcast


ROOTS = f"WITH RECURSIVE {MESSAGES}, up(message_id, root_id, depth) AS (SELECT message_id, message_id, 0 FROM messages WHERE reply_to IS NULL UNION ALL SELECT m.message_id, up.root_id, depth + 1 FROM messages m JOIN up ON m.reply_to = up.message_id)"


@query("j18_thread_roots", f"{ROOTS} SELECT message_id, root_id, CAST(depth AS INT) AS depth FROM up")
def thread_roots(spark, sf_dir):
    return chat.thread_roots(S.messages(spark, sf_dir))


@query("x13_threads", f"{ROOTS}, r AS (SELECT up.root_id, m.created_at, m.message_id, CASE WHEN m.reply_to <> up.root_id THEN p.user_id END AS answers FROM up JOIN messages m USING (message_id) LEFT JOIN messages p ON p.message_id = m.reply_to WHERE up.message_id <> root_id) SELECT t.message_id AS root_id, t.created_at AS started, CAST(count(r.message_id) AS INT) AS n_replies, string_agg(concat(CAST(r.message_id AS VARCHAR), ':', coalesce(CAST(answers AS VARCHAR), '')), ' ' ORDER BY r.created_at, r.message_id) AS replies FROM messages t LEFT JOIN r ON r.root_id = t.message_id WHERE t.reply_to IS NULL GROUP BY 1, 2")
def threads(spark, sf_dir):
    line = F.array_join(F.transform("replies", lambda r: F.concat(r["message_id"].cast("string"), F.lit(":"), F.coalesce(r["answers"].cast("string"), F.lit("")))), " ")
    return chat.threads(S.messages(spark, sf_dir)).select("root_id", "started", "n_replies", line.alias("replies"))


#: Replies in chains of 120; every 997th message answers one that answers it in turn, every 501st one that is gone.
KNOTTED = "CASE WHEN event_id % 997 = 5 THEN event_id + 3 WHEN event_id % 501 = 9 THEN -event_id WHEN event_id % 120 <> 0 THEN event_id - 1 END"


@query("j18_knotted_roots", f"WITH RECURSIVE m AS (SELECT event_id AS message_id, {KNOTTED} AS reply_to FROM events), l AS (SELECT m.message_id, p.message_id AS parent FROM m LEFT JOIN m p ON m.reply_to = p.message_id), w(message_id, here, seen, again) AS (SELECT message_id, message_id, [message_id], false FROM m UNION ALL SELECT w.message_id, l.parent, list_append(seen, l.parent), list_contains(seen, l.parent) FROM w JOIN l ON l.message_id = w.here WHERE l.parent IS NOT NULL AND NOT again) SELECT w.message_id, here AS root_id, CAST(list_position(seen, here) - 1 AS INT) AS depth FROM w JOIN l ON l.message_id = w.here WHERE again OR l.parent IS NULL")
def knotted_roots(spark, sf_dir):
    """Roots in long chains with cycles and orphans: a walk ends at the message it comes to again."""
    return chat.thread_roots(S.table(spark, sf_dir, "events").selectExpr("event_id AS message_id", f"{KNOTTED} AS reply_to"))


# Aggregates


@query("a01_a03_counts", f"WITH {VSONGS} SELECT count(*) AS total, count(*) FILTER (WHERE embedding IS NOT NULL) AS with_vector, count(album) AS with_album, count(CASE WHEN year < 1990 THEN 1 END) AS old, count(*) FILTER (WHERE is_placeholder) AS placeholders FROM vsongs")
def counts(spark, sf_dir):
    return S.vector_songs(spark, sf_dir).agg(F.count("*").alias("total"), F.count("embedding").alias("with_vector"), F.count("album").alias("with_album"), F.count_if(F.col("year") < 1990).alias("old"), F.count_if("is_placeholder").alias("placeholders"))


@query("a04_a20_coverage", f"WITH {VSONGS} SELECT count(*) AS total, count(embedding) AS covered, CAST(round(100.0 * count(embedding) / count(*), 1) AS DOUBLE) AS percent, CAST(max(len(embedding)) AS INT) AS dims FROM vsongs")
def coverage(spark, sf_dir):
    return catalog.coverage(S.vector_songs(spark, sf_dir), "embedding", F.max(F.size("embedding")).alias("dims"))


@query("a05_a06_group_counts", f"WITH {VSONGS} SELECT source, is_placeholder, embedding IS NOT NULL AS has_vector, count(*) AS n FROM vsongs GROUP BY 1, 2, 3")
def group_counts(spark, sf_dir):
    return S.vector_songs(spark, sf_dir).groupBy("source", "is_placeholder", F.col("embedding").isNotNull().alias("has_vector")).agg(F.count("*").alias("n"))


@query("a07_decades", f"WITH {SONGS} SELECT CASE WHEN year IS NULL THEN 'Unknown' ELSE concat(CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR), 's') END AS decade, count(*) AS n FROM songs GROUP BY 1")
def decades(spark, sf_dir):
    return S.songs(spark, sf_dir).groupBy(T.decade_label(F.col("year")).alias("decade")).agg(F.count("*").alias("n"))


@query("a08_t09_top_tags", f"WITH {SONGS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM songs) GROUP BY 1 ORDER BY n DESC, tag LIMIT 30")
def top_tags(spark, sf_dir):
    return S.songs(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(30)


@query("a09_duplicates", f"WITH {SONGS} SELECT title, artist, count(*) AS n FROM songs GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    return S.songs(spark, sf_dir).groupBy("title", "artist").agg(F.count("*").alias("n")).where("n > 1")


@query("a10_a13_room_statistics", f"WITH {MESSAGES} SELECT room_id, count(*) AS n_messages, count(DISTINCT user_id) AS n_users, max(created_at) AS last_activity, min(created_at) AS first_activity FROM messages GROUP BY 1")
def room_statistics(spark, sf_dir):
    return chat.room_statistics(S.messages(spark, sf_dir))


@query("a14_user_statistics", f"WITH {MESSAGES}, {USERS} SELECT u.user_id, count(message_id) AS n_messages, min(created_at) AS first_message, max(created_at) AS last_message, CAST(floor(epoch_us(TIMESTAMP '2024-02-01' - any_value(joined_at)) / 86400000000.0) AS INT) AS age_days FROM users u LEFT JOIN messages USING (user_id) GROUP BY 1")
def user_statistics(spark, sf_dir):
    return chat.user_statistics(S.users(spark, sf_dir), S.messages(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-02-01'"))


@query(
    "a17_analytics",
    f"WITH {MESSAGES}, {USERS}, ten AS (SELECT coalesce(confidence, 0) AS c FROM messages WHERE scored ORDER BY created_at DESC, message_id DESC LIMIT 10) SELECT (SELECT count(*) FROM messages) AS n_messages, (SELECT count(confidence) FROM messages) AS n_scored, (SELECT count(DISTINCT ip_hash) FROM users) AS n_devices, (SELECT round(avg(c), 2) FROM ten) AS mean_confidence, (SELECT round(count(*) FILTER (WHERE scored) / count(*) * 100, 1) FROM messages) AS success_rate",
)
def analytics(spark, sf_dir):
    return chat.analytics(S.messages(spark, sf_dir), S.users(spark, sf_dir))


@query("a18_room_presence", f"WITH {MESSAGES}, c AS (SELECT room_id, user_id, message_id % 40 AS conn FROM messages) SELECT room_id, count(DISTINCT conn) AS connections, count(DISTINCT user_id) AS users FROM c GROUP BY 1")
def room_presence(spark, sf_dir):
    return S.messages(spark, sf_dir).groupBy("room_id").agg(F.countDistinct(F.col("message_id") % 40).alias("connections"), F.countDistinct("user_id").alias("users"))


@query("a21_daily_cost", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(count(*) * 0.000246, 6)::DOUBLE AS cost FROM events GROUP BY 1")
def daily_cost(spark, sf_dir):
    return S.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("cost", F.round(F.col("n") * F.lit(0.000246), 6))


CASES = f"WITH {VSONGS}, {S.QUERY_VECTORS}, near AS (SELECT query_id, song_id, label, row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(embedding, qv), song_id) AS pos, list_cosine_similarity(embedding, qv) AS sim FROM vsongs, queries WHERE embedding IS NOT NULL AND song_id <> query_id), top AS (SELECT n.query_id, song_id, pos, sim, n.label = e.label AS hit FROM near n JOIN embeddings e ON e.vec_id = n.query_id WHERE pos <= 10)"


def _cases(spark, sf_dir):
    """query_id, pos, hit, similarity of the ten nearest; a hit has the query's label."""
    from quern.operators import retrieval

    songs = S.vector_songs(spark, sf_dir).where("embedding IS NOT NULL")
    near = retrieval.knn(songs, S.query_vectors(spark, sf_dir), 11, keep=("label",)).where("song_id <> query_id")  # one more, as a query may find itself
    top = retrieval.top_k(near.drop("rank"), 10, ["query_id"], [F.col("distance"), F.col("song_id")])
    want = S.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    return top.join(want, "query_id").select("query_id", "song_id", F.col("rank").alias("pos"), (F.col("label") == F.col("want")).alias("hit"), (1 - F.col("distance")).alias("sim"))


@query("w06_reciprocal_rank", f"{CASES} SELECT query_id, coalesce(1.0 / min(pos) FILTER (WHERE hit), 0)::DOUBLE AS rr FROM top GROUP BY 1")
def reciprocal_rank(spark, sf_dir):
    return _cases(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("pos"))).alias("first")).select("query_id", scores.reciprocal_rank(F.col("first")).alias("rr"))


@query(
    "a22_evaluation",
    f"{CASES}, c AS (SELECT query_id, min(pos) FILTER (WHERE hit) AS p, max(sim) AS best, query_id % 150 = 50 AS failed FROM top GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN NOT failed AND p = 1 THEN 100.0 ELSE 0 END), 4)::DOUBLE AS top1, round(avg(CASE WHEN NOT failed AND p <= 3 THEN 100.0 ELSE 0 END), 4)::DOUBLE AS top3, round(avg(CASE WHEN failed THEN 0 ELSE coalesce(1.0 / p, 0) END), 6)::DOUBLE AS mrr, round(avg(best) FILTER (WHERE NOT failed), 6) AS confidence, round(avg(CAST(failed AS INT)), 4)::DOUBLE AS errors FROM c",
)
def evaluation(spark, sf_dir):
    from quern.operators.evaluation import summary

    c = _cases(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("pos"))).alias("position"), F.max("sim").alias("confidence"))
    return summary(c.withColumn("failed", F.col("query_id") % 150 == 50))


@query("a23_breakdown", f"WITH {SONGS} SELECT tag, count(*) AS n, round(avg(CASE WHEN popularity >= 50 THEN 100.0 ELSE 0 END), 4)::DOUBLE AS top1 FROM (SELECT popularity, unnest(CASE WHEN song_id % 9 = 0 THEN ['untagged'] ELSE tags END) AS tag FROM songs) GROUP BY 1")
def breakdown(spark, sf_dir):
    from quern.operators.evaluation import by_tag

    cases = S.songs(spark, sf_dir).select(F.when(F.col("song_id") % 9 != 0, F.col("tags")).alias("tags"), (F.col("popularity") >= 50).alias("top1"))
    return by_tag(cases)


@query("a24_t09_artist_removals", f"WITH {SONGS} SELECT artist, count(*) FILTER (WHERE is_placeholder) AS removed, count(*) FILTER (WHERE NOT is_placeholder) AS kept, round(100.0 * count(*) FILTER (WHERE is_placeholder) / count(*), 2)::DOUBLE AS rate FROM songs GROUP BY 1 HAVING count(*) FILTER (WHERE is_placeholder) > 0 ORDER BY removed DESC, artist LIMIT 10")
def artist_removals(spark, sf_dir):
    g = S.songs(spark, sf_dir).groupBy("artist").agg(F.count_if("is_placeholder").alias("removed"), F.count_if(~F.col("is_placeholder")).alias("kept"))
    return g.where("removed > 0").withColumn("rate", F.round(F.col("removed") * F.lit(100.0) / (F.col("removed") + F.col("kept")), 2)).orderBy(F.desc("removed"), "artist").limit(10)


@query("a25_violations_by_rule", "SELECT split_part(reason, ':', 1) AS rule, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'Exact match: \"x\"' ELSE concat('Numbered: ', event_type) END AS reason FROM events) GROUP BY 1")
def violations_by_rule(spark, sf_dir):
    reason = F.when(F.col("event_id") % 3 == 0, 'Exact match: "x"').otherwise(F.concat(F.lit("Numbered: "), "event_type"))
    return S.table(spark, sf_dir, "events").groupBy(F.split_part(reason, F.lit(":"), F.lit(1)).alias("rule")).agg(F.count("*").alias("n"))


@query("a26_a28_pilot_audit", "WITH t AS (SELECT length(text) AS n FROM conversations), a AS (SELECT count(*) AS n, round(avg(n), 4) AS mean_length, count(*) FILTER (WHERE n < 20) AS under_20, count(*) FILTER (WHERE n BETWEEN 20 AND 49) AS to_49, count(*) FILTER (WHERE n BETWEEN 50 AND 90) AS to_90, count(*) FILTER (WHERE n BETWEEN 91 AND 100) AS to_100, count(*) FILTER (WHERE n > 100) AS over_100, round(sum(n) / 4 * 0.15 / 1000000 + sum(n) / 8 * 0.6 / 1000000, 8)::DOUBLE AS cost FROM t) SELECT *, CASE WHEN mean_length BETWEEN 50 AND 500 THEN 'PASS' ELSE 'FAIL' END AS gate, round(cost / n * 114336, 4)::DOUBLE AS projected FROM a")
def pilot_audit(spark, sf_dir):
    from quern.operators.evaluation import audit

    return audit(S.table(spark, sf_dir, "conversations").select(F.length("text").alias("n")))


@query("a30_error_histogram", "SELECT props AS message, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def error_histogram(spark, sf_dir):
    return S.table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("props").alias("message")).agg(F.count("*").alias("n"))


@query("a31_unique_ratio", "SELECT round(count(DISTINCT text) / count(*), 6)::DOUBLE AS ratio FROM documents")
def unique_ratio(spark, sf_dir):
    hashed = S.table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return hashed.agg(F.round(F.count("*") / F.sum("n"), 6).alias("ratio"))


# Windows, sorts, limits


@query("w01_share_of_total", f"WITH {SONGS} SELECT source, count(*) AS n, CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS DOUBLE) AS percent FROM songs GROUP BY 1")
def share_of_total(spark, sf_dir):
    return catalog.share_of_total(S.songs(spark, sf_dir), ["source"])


@query("w02_latest_per_user", f"WITH {MESSAGES} SELECT user_id, message_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, message_id DESC) AS r FROM messages) WHERE r <= 3")
def latest_per_user(spark, sf_dir):
    return chat.latest(S.messages(spark, sf_dir), ["user_id"], 3).select("user_id", "message_id", "rank")


@query("w03_score_gap", f"WITH {MESSAGES} SELECT room_id, round(value - next, 6) AS gap FROM (SELECT room_id, value, lead(value) OVER w AS next, row_number() OVER w AS r FROM messages WINDOW w AS (PARTITION BY room_id ORDER BY value DESC, message_id)) WHERE r = 1")
def score_gap(spark, sf_dir):
    w = Window.partitionBy("room_id").orderBy(F.desc("value"), "message_id")
    return S.messages(spark, sf_dir).select("room_id", "value", F.lead("value").over(w).alias("next"), F.row_number().over(w).alias("r")).where("r = 1").select("room_id", F.round(F.col("value") - F.col("next"), 6).alias("gap"))


@query("w04_caps", f"WITH {SONGS}, a AS (SELECT *, row_number() OVER (PARTITION BY artist, album ORDER BY arrival) AS x FROM songs), b AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY arrival) AS y FROM a WHERE album IS NULL OR x <= 2) SELECT song_id FROM b WHERE y <= 30")
def caps(spark, sf_dir):
    return catalog.capped(S.songs(spark, sf_dir), 30, 2).select("song_id")


@query("w05_first_by_key", f"WITH {SONGS} SELECT title, artist, song_id FROM songs QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY arrival) = 1")
def first_by_key(spark, sf_dir):
    return catalog.first_by(S.songs(spark, sf_dir), ["title", "artist"]).select("title", "artist", "song_id")


@query("t10_w09_recent_rows", f"WITH {MESSAGES} SELECT message_id, created_at FROM messages ORDER BY created_at DESC, message_id DESC LIMIT 20")
def recent_rows(spark, sf_dir):
    return S.messages(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("message_id")).limit(20).orderBy("created_at", "message_id").select("message_id", "created_at")


@query("t11_page_before", f"WITH {MESSAGES}, p AS (SELECT message_id, created_at, row_number() OVER (ORDER BY created_at DESC, message_id DESC) AS r FROM messages WHERE (created_at, message_id) < (TIMESTAMP '2024-01-15', 5000) QUALIFY r <= 26) SELECT message_id, created_at, (SELECT max(r) > 25 FROM p) AS has_more, (SELECT message_id FROM p WHERE r <= 25 ORDER BY r DESC LIMIT 1) AS oldest_id FROM p WHERE r <= 25")
def page_before(spark, sf_dir):
    import datetime

    return chat.page_before(S.messages(spark, sf_dir), (datetime.datetime(2024, 1, 15), 5000), 25).select("message_id", "created_at", "has_more", "oldest_id")


@query("t12_keyset_scan", f"WITH {SONGS} SELECT song_id, title FROM songs WHERE song_id > 700 ORDER BY song_id LIMIT 64")
def keyset_scan(spark, sf_dir):
    return S.songs(spark, sf_dir).where("song_id > 700").orderBy("song_id").limit(64).select("song_id", "title")


@query("t13_limit_offset", f"WITH {SONGS} SELECT song_id FROM songs ORDER BY arrival, song_id LIMIT 50 OFFSET 100")
def limit_offset(spark, sf_dir):
    return S.songs(spark, sf_dir).orderBy("arrival", "song_id").offset(100).limit(50).select("song_id")


@query("t14_sample", "SELECT p_partkey AS song_id FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 25")
def sample(spark, sf_dir):
    """A fixed sample: the first ids by a hash."""
    return S.songs(spark, sf_dir).orderBy(F.md5(F.col("song_id").cast("string").cast("binary")), "song_id").limit(25).select("song_id")


@query("t15_failures_by_confidence", f"WITH {MESSAGES} SELECT message_id, confidence FROM messages WHERE NOT scored AND confidence IS NOT NULL ORDER BY confidence DESC, message_id LIMIT 10")
def failures_by_confidence(spark, sf_dir):
    return S.messages(spark, sf_dir).where("NOT scored AND confidence IS NOT NULL").orderBy(F.desc("confidence"), "message_id").limit(10).select("message_id", "confidence")


@query("t16_t18_user_list", f"WITH {USERS} SELECT user_id, CAST(row_number() OVER (ORDER BY user_id = 77 DESC, joined_at, user_id) AS INT) AS place FROM users QUALIFY place <= 40")
def user_list(spark, sf_dir):
    first = S.users(spark, sf_dir).orderBy(F.desc(F.col("user_id") == 77), "joined_at", "user_id").limit(40)
    return first.select("user_id", F.row_number().over(Window.orderBy(F.desc(F.col("user_id") == 77), "joined_at", "user_id")).alias("place"))  # 40 rows


@query("t17_first_tags", "WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, array_to_string((list(event_type ORDER BY n DESC, event_type))[1:2], ',') AS first_tags FROM t GROUP BY 1")
def first_tags(spark, sf_dir):
    n = S.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "event_type")))
    return n.groupBy("user_id").agg(ordered.alias("t")).select("user_id", F.array_join(F.slice(F.col("t.event_type"), 1, 2), ",").alias("first_tags"))


@query("w10_last_events", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS last_five FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY 1")
def last_events(spark, sf_dir):
    last = chat.latest(S.table(spark, sf_dir, "events"), ["user_id"], 5, "ts", "event_id")
    ids = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return last.groupBy("user_id").agg(ids.alias("l")).select("user_id", F.array_join(F.transform("l.event_id", lambda x: x.cast("string")), ",").alias("last_five"))


# Sets


@query("u01_candidate_union", f"WITH {SONGS} SELECT song_id FROM songs WHERE popularity > 90 UNION SELECT vec_id FROM embeddings WHERE label = 1")
def candidate_union(spark, sf_dir):
    return S.songs(spark, sf_dir).where("popularity > 90").select("song_id").union(S.table(spark, sf_dir, "embeddings").where("label = 1").select("vec_id")).distinct()


@query("u02_merged_pages", f"WITH {MESSAGES} SELECT message_id FROM messages WHERE value < 300 UNION SELECT message_id FROM messages WHERE value > 200")
def merged_pages(spark, sf_dir):
    m = S.messages(spark, sf_dir)
    return chat.merged_pages(m.where("value < 300"), m.where("value > 200")).select("message_id")


@query("u03_located_checks", f"WITH {SONGS} SELECT 'catalog' AS location, count(*) AS n FROM songs WHERE is_placeholder UNION ALL SELECT 'seed', count(*) FROM songs WHERE title ILIKE '%ring%' UNION ALL SELECT 'import', count(*) FROM songs WHERE isrc IS NULL")
def located_checks(spark, sf_dir):
    s = S.songs(spark, sf_dir)
    legs = {"catalog": "is_placeholder", "seed": "title ILIKE '%ring%'", "import": "isrc IS NULL"}
    one = s.agg(*(F.count_if(F.expr(test)).alias(name) for name, test in legs.items()))
    return one.unpivot([], list(legs), "location", "n")


@query("u04_spans_eras", f"WITH {MESSAGES}, {SONGS}, l AS (SELECT user_id, song_id FROM messages WHERE song_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, message_id DESC) <= 3) SELECT user_id, count(DISTINCT floor(year / 10)) > 1 AS spans FROM l JOIN songs USING (song_id) GROUP BY 1")
def spans_eras(spark, sf_dir):
    last = chat.latest(S.messages(spark, sf_dir).where("song_id IS NOT NULL"), ["user_id"], 3).drop("rank")
    return last.select("user_id", "song_id").join(S.songs(spark, sf_dir).select("song_id", "year"), "song_id").groupBy("user_id").agg((F.size(F.collect_set(T.decade(F.col("year")))) > 1).alias("spans"))


# Changes to tables: the state after the change


@query("k01_k02_insert_or_ignore", f"WITH {SONGS} SELECT song_id, CASE WHEN source = 'radio' THEN upper(title) ELSE title END AS title FROM songs")
def insert_or_ignore(spark, sf_dir):
    s = S.songs(spark, sf_dir)
    have = s.where("source <> 'radio'").select("song_id", "title")
    return catalog.upsert_new(have, s.select("song_id", F.upper("title").alias("title")), ["song_id"])


@query("k03_k04_upsert_over", f"WITH {SONGS} SELECT song_id, CASE WHEN popularity > 50 THEN upper(title) ELSE title END AS title FROM songs WHERE popularity > 50 OR source <> 'radio'")
def upsert_over(spark, sf_dir):
    s = S.songs(spark, sf_dir)
    new = s.where("popularity > 50").select("song_id", F.upper("title").alias("title"))
    return catalog.upsert_over(s.where("source <> 'radio'").select("song_id", "title"), new, ["song_id"])


@query("k05_k06_bulk_update", f"WITH {SONGS} SELECT song_id, CASE WHEN vec_id IS NOT NULL THEN label ELSE popularity END AS popularity, is_placeholder OR title ILIKE 'small%' AS is_placeholder FROM songs LEFT JOIN embeddings ON vec_id = song_id")
def bulk_update(spark, sf_dir):
    changes = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("song_id"), F.col("label").alias("popularity"))
    out = catalog.updated(S.songs(spark, sf_dir), changes, "song_id", ["popularity"])
    return out.select("song_id", "popularity", F.when(F.col("title").ilike("small%"), True).otherwise(F.col("is_placeholder")).alias("is_placeholder"))


@query("k07_cast_backfill", "SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN 64 END AS dims FROM embeddings")
def cast_backfill(spark, sf_dir):
    from quern.functions.vectors import from_json

    text = F.when(F.col("vec_id") % 3 == 0, F.lit("[1, 2]")).otherwise(F.to_json("embedding"))
    return S.table(spark, sf_dir, "embeddings").select("vec_id", from_json(text, 64).alias("v")).select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dims"))


@query("k08_guarded_delete", f"WITH {SONGS}, {MESSAGES} SELECT song_id FROM songs WHERE NOT (is_placeholder AND song_id NOT IN (SELECT song_id FROM messages WHERE song_id IS NOT NULL))")
def guarded_delete(spark, sf_dir):
    m = S.messages(spark, sf_dir).where("song_id IS NOT NULL")
    return catalog.deletable(S.songs(spark, sf_dir), [(m, "song_id")], F.col("is_placeholder"), "song_id").select("song_id")


@query("k09_delete_reaction", f"WITH {REACTIONS} SELECT message_id, emoji, user_id FROM reactions r WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 50 = 0 AND e.event_id // 10 = r.message_id AND e.event_type = r.emoji AND e.user_id = r.user_id)")
def delete_reaction(spark, sf_dir):
    gone = S.table(spark, sf_dir, "events").where("event_id % 50 = 0").selectExpr("event_id div 10 AS message_id", "event_type AS emoji", "user_id")
    return S.reactions(spark, sf_dir).select("message_id", "emoji", "user_id").join(gone, ["message_id", "emoji", "user_id"], "left_anti")


@query(
    "k12_k13_quarantine",
    f"""WITH {SONGS}, {TITLES}, {EXPECTED}, j AS (SELECT song_id, title, artist, source, {REASON} AS reason FROM e), have AS (SELECT * FROM j WHERE reason IS NULL AND source = 'radio')
    SELECT song_id, title, artist, 'file' AS part FROM have UNION ALL SELECT song_id, title, artist, 'file' FROM j WHERE reason IS NULL AND source <> 'radio' AND (lower(title), lower(artist)) NOT IN (SELECT (lower(title), lower(artist)) FROM have)
    UNION ALL SELECT song_id, title, artist, reason FROM j WHERE reason IS NOT NULL""",
)
def quarantine(spark, sf_dir):
    """All titles through the quality gate; the clean ones that the CSV lacks are appended to it, the others kept apart."""
    clean, out = catalog.quality_split(_titles(spark, sf_dir))
    path, columns = files.scratch(spark, "catalog-csv"), ["song_id", "title", "artist"]
    files.write_csv(clean.where("source = 'radio'").select(*columns), path)
    files.append_new_csv(clean.where("source <> 'radio'").select(*columns), path, "song_id long, title string, artist string", ["title", "artist"])
    back = files.read_csv(spark, path, "song_id long, title string, artist string", ["title", "artist"])
    return back.withColumn("part", F.lit("file")).unionByName(out.select(*columns, F.col("reason").alias("part")))


@query("k17_audience", f"WITH {MESSAGES} SELECT DISTINCT message_id % 40 AS conn_id FROM messages WHERE room_id = 'click' AND message_id % 40 <> 3")
def audience(spark, sf_dir):
    members = S.messages(spark, sf_dir).selectExpr("message_id % 40 AS conn_id", "room_id").distinct()
    return chat.audience(members, 3, "click").select("conn_id")


@query("k18_rollback", f"WITH {SONGS} SELECT song_id FROM songs WHERE source IS DISTINCT FROM 'radio'")
def rollback(spark, sf_dir):
    return S.songs(spark, sf_dir).where(~F.col("source").eqNullSafe("radio")).select("song_id")
