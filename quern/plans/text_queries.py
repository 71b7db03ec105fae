"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scores
from quern.functions import text as T
from quern.functions.phrases import MAX_PHRASES, PhraseDictionary, found_labels

from . import standins as S
from .registry import query

SONGS, MESSAGES = S.SONGS, S.MESSAGES
REAL = f"WITH {SONGS}"


def alternation(words) -> str:
    return "|".join(words).replace("'", "''")


@query("s01_eligible_songs", f"WITH {S.VECTOR_SONGS} SELECT song_id, title FROM vsongs WHERE embedding IS NOT NULL AND NOT is_placeholder")
def eligible_songs(spark, sf_dir):
    from quern.operators.retrieval import eligible

    return eligible(S.vector_songs(spark, sf_dir)).select("song_id", "title")


@query("f01_f02_projection_lookup", f"{REAL} SELECT song_id AS id, title AS name, artist, CAST(floor(year / 10) * 10 AS INT) AS decade FROM songs WHERE song_id = 42")
def projection_lookup(spark, sf_dir):
    return S.songs(spark, sf_dir).where("song_id = 42").select(F.col("song_id").alias("id"), F.col("title").alias("name"), "artist", T.decade(F.col("year")).alias("decade"))


@query("f03_f05_null_in_range", f"{REAL} SELECT song_id, year, album FROM songs WHERE album IS NOT NULL AND source IN ('radio', 'manual') AND song_id NOT IN (1, 2, 3) AND year BETWEEN 1960 AND 1989 AND popularity > 20")
def null_in_range(spark, sf_dir):
    return S.songs(spark, sf_dir).where(F.col("album").isNotNull() & F.col("source").isin("radio", "manual") & ~F.col("song_id").isin(1, 2, 3) & F.col("year").between(1960, 1989) & (F.col("popularity") > 20)).select("song_id", "year", "album")


@query("f07_f09_caseless_match", f"{REAL} SELECT song_id, title, artist FROM songs WHERE lower(title) = lower('Small RING') OR title ILIKE '%lue b%' OR lower(trim(artist)) = 'brand#7'")
def caseless_match(spark, sf_dir):
    c = F.col
    return S.songs(spark, sf_dir).where((F.lower(c("title")) == F.lower(F.lit("Small RING"))) | c("title").ilike("%lue b%") | (F.lower(F.trim(c("artist"))) == "brand#7")).select("song_id", "title", "artist")


@query("f10_f16_regex_keywords", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\b(idiot|gnu|the license)\\b') OR regexp_matches(text, '(?i)apache +license')")
def regex_keywords(spark, sf_dir):
    t = F.col("text")
    return S.table(spark, sf_dir, "documents").where(T.matches_keyword(t, ["idiot", "gnu", "the license"]) | t.rlike("(?i)apache +license")).select("doc_id")


@query("f12_explicit_songs", f"{REAL} SELECT song_id FROM songs WHERE len(list_filter(tags, lambda t: lower(t) IN ('explicit', 'profanity', 'adult'))) > 0")
def explicit_songs(spark, sf_dir):
    return S.songs(spark, sf_dir).where(T.is_explicit(F.col("tags"))).select("song_id")


@query("f13_excluded_ids", f"{REAL} SELECT song_id FROM songs WHERE song_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def excluded_ids(spark, sf_dir):
    out = S.table(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("song_id"))
    return S.songs(spark, sf_dir).select("song_id").join(out, "song_id", "left_anti")


@query("f15_f18_room_by_id_or_name", "WITH r AS (SELECT n_nationkey, n_name, substr(md5(n_name), 1, 8) || '-' || substr(md5(n_name), 9, 4) || '-4' || substr(md5(n_name), 14, 3) || '-a' || substr(md5(n_name), 18, 3) || '-' || substr(md5(n_name), 21, 12) AS id FROM nation), k AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN id ELSE n_name END AS asked FROM r) SELECT k.asked, r.n_name, regexp_matches(k.asked, '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') AS is_uuid FROM k JOIN r ON CASE WHEN regexp_matches(k.asked, '^[0-9a-f]{8}-') THEN r.id ELSE r.n_name END = k.asked")
def room_by_id_or_name(spark, sf_dir):
    h = F.md5("n_name")
    part = lambda a, n: F.substring(h, a, n)
    rooms = S.table(spark, sf_dir, "nation").withColumn("id", F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12)))
    asked = rooms.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("id")).otherwise(F.col("n_name")).alias("asked")).withColumn("is_uuid", F.col("asked").rlike(T.UUID4))
    by_id = asked.where("is_uuid").join(rooms, F.col("asked") == F.col("id"))
    by_name = asked.where("NOT is_uuid").join(rooms, F.col("asked") == F.col("n_name"))
    return by_id.unionByName(by_name).select("asked", "n_name", "is_uuid")


@query("f17_ip_blocklist", f"WITH {S.USERS} SELECT user_id FROM users WHERE concat('10.0.0.', CAST(ip_hash AS VARCHAR)) IN ('10.0.0.1', '10.0.0.7')")
def ip_blocklist(spark, sf_dir):
    return S.users(spark, sf_dir).where(F.concat(F.lit("10.0.0."), F.col("ip_hash").cast("string")).isin("10.0.0.1", "10.0.0.7")).select("user_id")


@query("f19_message_validation", "SELECT doc_id, CASE WHEN length(trim(substr(text, 1, 520))) = 0 THEN 'empty' WHEN length(trim(text)) > 500 THEN 'too long' END AS problem FROM documents")
def message_validation(spark, sf_dir):
    n = F.length(F.trim(F.col("text")))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.when(n == 0, "empty").when(n > 500, "too long").alias("problem"))


@query("f21_required_fields", f"WITH {S.PLAYS} SELECT play_id FROM plays WHERE play_type = 'view' AND trim(title) <> '' AND trim(artist) <> ''")
def required_fields(spark, sf_dir):
    return S.plays(spark, sf_dir).where("play_type = 'view' AND trim(title) <> '' AND trim(artist) <> ''").select("play_id")


PHRASES = [p for g in T.MODERATE_PHRASES.values() for p in g]
RANK = f"CASE WHEN list_has_any(w, {list(T.EXPLICIT_WORDS)}) THEN 3 WHEN list_has_any(w, {list(T.MODERATE_WORDS)}) OR regexp_matches(low, '{alternation(PHRASES)}') THEN 2 WHEN list_has_any(w, {list(T.MILD_WORDS)}) THEN 1 ELSE 0 END"


@query("c16_f20_severity", f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(CASE doc_id % 4 WHEN 0 THEN 'Damn ' WHEN 1 THEN 'shit ' WHEN 2 THEN 'gun ' ELSE 'Fuck ' END, text) ELSE text END AS text FROM documents), s AS (SELECT doc_id, lower(text) AS low, regexp_split_to_array(lower(text), '\\s+') AS w FROM t), r AS (SELECT doc_id, {RANK} AS r FROM s) SELECT doc_id, ['clean', 'mild', 'moderate', 'explicit'][r + 1] AS severity, CASE WHEN doc_id % 2 = 0 THEN r = 3 ELSE r >= 2 END AS blocked FROM r")
def severity(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 4 == 0, "Damn ").when(F.col("doc_id") % 4 == 1, "shit ").when(F.col("doc_id") % 4 == 2, "gun ").otherwise("Fuck ")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(lead, "text")).otherwise(F.col("text"))
    rank = S.table(spark, sf_dir, "documents").select("doc_id", T.severity_rank(text).alias("r"))
    return rank.select("doc_id", T.severity(F.col("r")).alias("severity"), T.blocked_in_room(F.col("r"), F.col("doc_id") % 2 == 0).alias("blocked"))


@query("c01_c04_normalising", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(s)), '[^a-zA-Z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned, regexp_replace(trim(lower(s)), '\\s+', ' ', 'g') AS name, regexp_replace(regexp_replace(trim(s), '\\s+', ' ', 'g'), '^[\"'']|[\"'']$', '', 'g') AS stripped, upper(regexp_replace(concat('us-', CAST(doc_id AS VARCHAR), ' - abc'), '[-\\s]', '', 'g')) AS isrc FROM (SELECT doc_id, concat('\"', text, '\"') AS s FROM documents)")
def normalising(spark, sf_dir):
    s = F.concat(F.lit('"'), "text", F.lit('"'))
    return S.table(spark, sf_dir, "documents").select("doc_id", T.clean_text(s).alias("cleaned"), T.normalize_name(s).alias("name"), T.normalize_text(s).alias("stripped"), T.normalize_isrc(F.concat(F.lit("us-"), F.col("doc_id").cast("string"), F.lit(" - abc"))).alias("isrc"))


@query("c05_c06_years", f"{REAL} SELECT song_id, TRY_CAST(nullif(regexp_extract(d, '^([0-9]{{4}})', 1), '') AS INT) AS parsed, CAST(floor(year / 10) * 10 AS INT) AS decade, CASE WHEN year IS NULL THEN 'Unknown' ELSE concat(CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR), 's') END AS label FROM (SELECT song_id, year, CASE WHEN song_id % 3 = 0 THEN 'unknown' ELSE concat(CAST(coalesce(year, 1900) AS VARCHAR), '-05-01') END AS d FROM songs)")
def years(spark, sf_dir):
    d = F.when(F.col("song_id") % 3 == 0, "unknown").otherwise(F.concat(F.coalesce("year", F.lit(1900)).cast("string"), F.lit("-05-01")))
    return S.songs(spark, sf_dir).select("song_id", T.leading_year(d).alias("parsed"), T.decade(F.col("year")).alias("decade"), T.decade_label(F.col("year")).alias("label"))


MOOD_CASE = "CASE " + " ".join(f"WHEN regexp_matches(t, '{words}') THEN '{name}'" for name, words in T.MOODS) + " ELSE 'neutral' END"


@query("c07_mood", f"SELECT doc_id, {MOOD_CASE} AS mood FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def mood(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", T.mood(F.col("text")).alias("mood"))


TITLES = "titles AS (SELECT song_id, artist, source, mbid, phrases, CASE song_id % 11 WHEN 0 THEN 'Found Song' WHEN 1 THEN 'blue TRACK 7' WHEN 2 THEN 'Crazy Song' WHEN 3 THEN 'Test Song 12' WHEN 4 THEN 'Track 9' WHEN 5 THEN 'Something Jam 10' ELSE title END AS title FROM songs)"
TYPE, ADJ, PRE = T.PLACEHOLDER_TYPES, T.PLACEHOLDER_ADJECTIVES, T.PLACEHOLDER_PREFIXES
VERIFIED = "(source = 'musicbrainz' AND coalesce(mbid, '') <> '')"
EXACT = str(T.PLACEHOLDER_TITLES)


def _titles(spark, sf_dir):
    t = F.col("title")
    for i, made in enumerate(("Found Song", "blue TRACK 7", "Crazy Song", "Test Song 12", "Track 9", "Something Jam 10")):
        t = F.when(F.col("song_id") % 11 == i, made).otherwise(t)
    return S.songs(spark, sf_dir).withColumn("title", t)


EXPECTED = "e AS (SELECT *, list_concat(regexp_split_to_array(lower(title), '\\s+'), regexp_split_to_array(lower(artist), '\\s+')) AS expected, string_split(lower(phrases), ',') AS given FROM titles)"
REASON = f"""CASE WHEN title IN {EXACT} THEN 'Exact match' WHEN regexp_matches(title, '(?i)^({ADJ})\\s+({TYPE})(\\s+[0-9]+)?$') THEN 'Adjective+Type pattern' WHEN NOT {VERIFIED} AND regexp_matches(title, '^\\S+\\s+({TYPE})$') THEN 'Simple type suffix'
    WHEN regexp_matches(title, '(?i)^({PRE})\\s+({TYPE})\\s+[0-9]+$') THEN 'Numbered placeholder' WHEN NOT {VERIFIED} AND regexp_matches(title, '(?i)^({TYPE})\\s+[0-9]+$') THEN 'Numbered placeholder'
    WHEN list_has_all(expected, given) AND len(given) = len(expected) AND len(given) <= 4 THEN 'Trivial phrases' END"""


@query(
    "c08_placeholders",
    f"""{REAL}, {TITLES}, {EXPECTED} SELECT song_id, {REASON} AS reason,
    title IN {EXACT} OR regexp_matches(title, '(?i)^({ADJ})\\s+({TYPE})(\\s+[0-9]+)?$') OR regexp_matches(title, '(?i)^[a-zA-Z0-9_]+\\s+(Song|Track)$') OR regexp_matches(title, '(?i)^[A-Za-z]+\\s+({TYPE})\\s+[0-9]+$') AS flagged FROM e""",
)
def placeholders(spark, sf_dir):
    c = F.col
    return _titles(spark, sf_dir).select("song_id", T.placeholder_reason(c("title"), c("artist"), c("phrases"), c("source"), c("mbid")).alias("reason"), T.is_placeholder_stored(c("title")).alias("flagged"))


TAGGED = "t AS (SELECT doc_id, concat(CASE WHEN doc_id % 7 = 0 THEN lang ELSE text END, CASE doc_id % 4 WHEN 0 THEN ' [confidence: HIGH]' WHEN 1 THEN ' [Confidence: low] ' WHEN 2 THEN ' [confidence: none]' ELSE '' END) AS s FROM documents)"


def _tagged(spark, sf_dir):
    d = F.col("doc_id") % 4
    tag = F.when(d == 0, " [confidence: HIGH]").when(d == 1, " [Confidence: low] ").when(d == 2, " [confidence: none]").otherwise("")
    return S.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.col("text")), tag).alias("s"))


@query(
    "c09_confidence_tags",
    f"""WITH {TAGGED}, c AS (SELECT *, nullif(lower(regexp_extract(s, '(?i)\\[confidence:\\s*(low|medium|high)\\]\\s*$', 1)), '') AS level FROM t)
    SELECT doc_id, level, trim(regexp_replace(s, '(?i)\\s*\\[confidence:\\s*(low|medium|high)\\]\\s*$', '')) AS body, CASE WHEN length(s) <= 100 THEN s ELSE concat(rtrim(substr(s, 1, 99)), '…') END AS short,
    CASE WHEN trim(s) = '' THEN 'empty response' WHEN length(s) > 100 THEN concat('too long: ', CAST(length(s) AS VARCHAR), ' chars') WHEN level IS NULL THEN 'missing or malformed confidence tag' WHEN regexp_matches(trim(s), '(?i)^confidence:') THEN 'starts with a confidence label' END AS problem FROM c""",
)
def confidence_tags(spark, sf_dir):
    s = F.col("s")
    return _tagged(spark, sf_dir).select("doc_id", T.confidence_tag(s).alias("level"), T.without_confidence_tag(s).alias("body"), T.shortened(s, 100).alias("short"), T.output_problem(s, 100).alias("problem"))


@query("c11_c15_builders", f"{REAL} SELECT song_id, concat_ws(' — ', title, artist, album) AS embedding_text, array_to_string([title, artist], ' / ') AS credit, array_to_string(list_filter(list_transform(string_split(concat(' ', title, ', ,', artist, ' '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts, coalesce(nullif(TRY_CAST(nullif(regexp_extract(source_text, '^\\s*([+-]?[0-9]+)', 1), '') AS INT), 0), 50) AS pop FROM (SELECT *, CASE song_id % 3 WHEN 0 THEN '0' WHEN 1 THEN 'n/a' ELSE concat(CAST(popularity AS VARCHAR), ' pts') END AS source_text FROM songs)")
def builders(spark, sf_dir):
    d = F.col("song_id") % 3
    given = F.when(d == 0, "0").when(d == 1, "n/a").otherwise(F.concat(F.col("popularity").cast("string"), F.lit(" pts")))
    return S.songs(spark, sf_dir).select(
        "song_id", T.embedding_text(F.col("title"), F.col("artist"), F.col("album")).alias("embedding_text"), T.credit(F.array("title", "artist")).alias("credit"),
        F.array_join(T.list_of(F.concat(F.lit(" "), "title", F.lit(", ,"), "artist", F.lit(" "))), "|").alias("parts"), T.int_or(given, 50).alias("pop"),
    )


@query("c14_derived_tags", f"{REAL} SELECT song_id, array_to_string(list_filter([lower(source), CASE WHEN year IS NOT NULL THEN concat(CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR), 's') END, lower(split_part(artist, ' ', 1))], lambda x: x IS NOT NULL), ',') AS derived FROM songs")
def derived_tags(spark, sf_dir):
    decade = F.when(F.col("year").isNotNull(), T.decade_label(F.col("year")))
    return S.songs(spark, sf_dir).select("song_id", F.array_join(F.array_compact(F.array(F.lower("source"), decade, F.lower(F.get(F.split("artist", " "), F.lit(0))))), ",").alias("derived"))


CLARITY_M = "CASE WHEN song_id % 4 = 0 THEN concat('please play ', title, ' now') WHEN song_id % 4 = 1 THEN 'Let it go' ELSE 'something else' END"
CLARITY_T = "CASE song_id % 7 WHEN 0 THEN 'Crimson Sky' WHEN 1 THEN 'a [b] {c} (d)' WHEN 2 THEN 'incomprehensibilities' ELSE title END"


@query(
    "c17_c18_clarity_radio_edit",
    f"""{REAL}, c AS (SELECT song_id, lower(trim({CLARITY_M})) AS m, lower(trim({CLARITY_T})) AS t, CASE WHEN song_id % 3 = 0 THEN concat('Holy Shit ', title, ' ASS') ELSE title END AS rt FROM songs)
    SELECT song_id, CAST(CASE WHEN contains(m, t) OR contains(t, m) OR regexp_matches(t, '{alternation(T.IDIOMS)}') OR regexp_matches(m, '{alternation(T.IDIOMS)}') THEN 0.2
    WHEN regexp_matches(t, '{alternation(T.METAPHORS)}') OR length(t) > 100 OR length(t) - length(regexp_replace(t, '[()\\[\\]{{}}<>|@#$%^&*+=]', '', 'g')) > 3 OR len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) > 15)) > 0 THEN -0.2 ELSE 0 END AS DOUBLE) AS bonus,
    CASE WHEN contains(lower(rt), 'holy shit') THEN regexp_replace(rt, '(?i)holy shit', 'holy crap', 'g') WHEN contains(lower(rt), 'ass') THEN regexp_replace(rt, '(?i)ass', 'a**', 'g') END AS edit FROM c""",
)
def clarity_radio_edit(spark, sf_dir):
    songs = S.songs(spark, sf_dir).selectExpr("song_id", f"{CLARITY_M} AS m", f"{CLARITY_T} AS t", "CASE WHEN song_id % 3 = 0 THEN concat('Holy Shit ', title, ' ASS') ELSE title END AS rt")
    return songs.select("song_id", T.clarity_bonus(F.col("m"), F.col("t")).alias("bonus"), T.radio_edit(F.col("rt")).alias("edit"))


@query("c19_c23_hashes_masks", f"WITH {S.USERS} SELECT user_id, substr(sha256(concat(ip, 'salt')), 1, 32) AS ip_hash, sha256(concat('token', CAST(user_id AS VARCHAR))) AS token_hash, concat(substr(ip, 1, 8), '...') AS masked, regexp_matches(handle, '^[a-z]+-[a-z]+$') AS valid, CASE WHEN regexp_matches(handle, '^[a-z]+-[a-z]+$') THEN split_part(handle, '-', 2) END AS noun FROM (SELECT user_id, concat('10.1.', CAST(ip_hash AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) AS ip, CASE user_id % 3 WHEN 0 THEN 'calm-river' WHEN 1 THEN 'Calm-river' ELSE 'calmriver' END AS handle FROM users)")
def hashes_masks(spark, sf_dir):
    u = S.users(spark, sf_dir).selectExpr("user_id", "concat('10.1.', CAST(ip_hash AS STRING), '.', CAST(user_id % 256 AS STRING)) AS ip", "CASE user_id % 3 WHEN 0 THEN 'calm-river' WHEN 1 THEN 'Calm-river' ELSE 'calmriver' END AS handle")
    return u.select("user_id", T.hashed_ip(F.col("ip"), "salt").alias("ip_hash"), F.sha2(F.concat(F.lit("token"), F.col("user_id").cast("string")), 256).alias("token_hash"), T.masked(F.col("ip")).alias("masked"), T.is_handle(F.col("handle")).alias("valid"), F.when(T.is_handle(F.col("handle")), F.split_part("handle", F.lit("-"), F.lit(2))).alias("noun"))


CODES = "list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT))"


def _int32(x: str) -> str:
    return f"((({x}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


XORED = f"xor({_int32('h')}, c)"


@query(
    "c20_rolling_hash",
    f"""WITH a AS (SELECT c_custkey, unnest(['10.' || c_custkey, c_name, c_mktsegment]) AS s FROM customer),
    h AS (SELECT c_custkey, s, abs({_int32(f"list_reduce({CODES}, lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT))")}) AS r,
      abs(list_reduce({CODES}, lambda h, c: {XORED} + {' + '.join(_int32(f'{XORED} * {1 << k}') for k in (1, 4, 7, 8, 24))}, 2166136261)) % 60 AS avatar FROM a)
    SELECT c_custkey, s, coalesce(nullif(ltrim(list_aggregate(list_transform([60466176, 1679616, 46656, 1296, 36, 1], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(r // p % 36 AS INT) + 1, 1)), 'string_agg', ''), '0'), ''), '0') AS bucket, avatar FROM h""",
)
def rolling_hash(spark, sf_dir):
    """Labels of addresses in base 36 and avatars of names."""
    texts = S.table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.concat(F.lit("10."), "c_custkey"), "c_name", "c_mktsegment")).alias("s"))
    return texts.select("c_custkey", "s", T.rolling_hash36(F.col("s")).alias("bucket"), T.avatar_bucket(F.col("s"), 60).alias("avatar"))


@query("c24_c25_times", f"WITH {S.USERS} SELECT user_id, CAST(floor(epoch_us(TIMESTAMP '2024-02-01' - joined_at) / 86400000000.0) AS INT) AS age_days, strftime(joined_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, joined_at >= TIMESTAMP '2024-02-01' - INTERVAL 200 DAY AS recent, CAST(ceil((user_id % 97) / 10.0) AS BIGINT) AS retry_after FROM users")
def times(spark, sf_dir):
    now = F.expr("TIMESTAMP_NTZ '2024-02-01'")
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("joined_at").cast("timestamp"))) / 86_400_000_000)
    return S.users(spark, sf_dir).select("user_id", age.cast("int").alias("age_days"), F.date_format("joined_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), (F.col("joined_at") >= F.expr("TIMESTAMP_NTZ '2024-02-01' - INTERVAL 200 DAY")).alias("recent"), F.ceil((F.col("user_id") % 97) / 10.0).alias("retry_after"))


@query("c26_c28_arrays_json", f"WITH {MESSAGES} SELECT message_id, CAST(json_extract(props, '$.k') AS INT) AS k, concat('{{\"primary\":\"', room_id, '\",\"n\":', CAST(user_id AS VARCHAR), '}}') AS scores, CAST(len([room_id, text]) AS INT) AS n, array_to_string([room_id, text], '+') AS joined FROM messages")
def arrays_json(spark, sf_dir):
    return S.messages(spark, sf_dir).select("message_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.col("room_id").alias("primary"), F.col("user_id").alias("n"))).alias("scores"), F.size(F.array("room_id", "text")).alias("n"), F.array_join(F.array("room_id", "text"), "+").alias("joined"))


@query("c29_c30_status_like", f"{REAL} SELECT song_id, CASE WHEN popularity >= 80 THEN 'RED' WHEN popularity >= 50 THEN 'YELLOW' ELSE 'GREEN' END AS status, round(song_id / 1048576.0 * 1000000, 2)::DOUBLE AS mb, nullif(regexp_extract(artist, '#([0-9]+)', 1), '') AS number, title LIKE 'b%' AS b FROM songs")
def status_like(spark, sf_dir):
    return S.songs(spark, sf_dir).select("song_id", T.size_status(F.col("popularity"), 50, 80).alias("status"), F.round(F.col("song_id") / F.lit(1048576.0) * 1000000, 2).alias("mb"), F.nullif(F.regexp_extract("artist", "#([0-9]+)", 1), F.lit("")).alias("number"), F.col("title").like("b%").alias("b"))


@query("c31_c34_one_liner_url", f"{REAL} SELECT song_id, array_to_string(list_filter([nullif(array_to_string(tags[1:2], ', '), ''), nullif(album, ''), source], lambda x: x IS NOT NULL), '. ') AS line, concat('https://x.example/search?q=', replace(url_encode(concat(title, ' ', artist)), '%20', '+')) AS url FROM songs")
def one_liner_url(spark, sf_dir):
    line = F.concat_ws(". ", F.nullif(F.array_join(F.slice("tags", 1, 2), ", "), F.lit("")), F.nullif(F.col("album"), F.lit("")), "source")
    return S.songs(spark, sf_dir).select("song_id", line.alias("line"), F.concat(F.lit("https://x.example/search?q="), F.url_encode(F.concat("title", F.lit(" "), "artist"))).alias("url"))


@query("c32_pattern_tests", f"WITH {TAGGED} SELECT doc_id, regexp_matches(s, '(?i)\\[confidence:\\s*(low|medium|high)\\]') AS leaks, contains(s, '…') OR contains(s, '...') AS cut, regexp_matches(s, '(?i)\\b(ideal for|perfect for|great for)\\b') AS ideal FROM t")
def pattern_tests(spark, sf_dir):
    s = F.col("s")
    return _tagged(spark, sf_dir).select("doc_id", s.rlike(r"(?i)\[confidence:\s*(low|medium|high)\]").alias("leaks"), (F.contains(s, F.lit("…")) | F.contains(s, F.lit("..."))).alias("cut"), s.rlike(r"(?i)\b(ideal for|perfect for|great for)\b").alias("ideal"))


@query("x11_backoff", "SELECT n_nationkey, least(30000.0, 1000 * pow(2, n_nationkey))::DOUBLE AS wait_ms FROM nation")
def backoff(spark, sf_dir):
    return S.table(spark, sf_dir, "nation").select("n_nationkey", scores.backoff_ms(F.col("n_nationkey")).alias("wait_ms"))


@query("w08_alternate_scores", f"{REAL} SELECT song_id, CAST(i AS INT) AS i, tag, round(0.8 - 0.1 * i, 6)::DOUBLE AS score FROM (SELECT song_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS i FROM songs)")
def alternate_scores(spark, sf_dir):
    return S.songs(spark, sf_dir).select("song_id", F.posexplode("tags").alias("i", "tag")).withColumn("score", F.round(scores.alternate_score(F.col("i")), 6))


FIRST_WORDS, SECOND_WORDS = ["calm", "bright", "quiet"], ["river", "stone", "cloud", "song"]


def _picked(words: list[str], salt: str) -> str:
    return f"{words}[CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR) || '{salt}'), 1, 8) AS BIGINT) % {len(words)} AS INT) + 1]"


@query("c22_handles", f"WITH {S.USERS} SELECT user_id, {_picked(FIRST_WORDS, 'a')} || '-' || {_picked(SECOND_WORDS, 'n')} AS handle, true AS valid, {_picked(SECOND_WORDS, 'n')} AS noun FROM users")
def handles(spark, sf_dir):
    made = T.handle(F.col("user_id"), FIRST_WORDS, SECOND_WORDS)
    return S.users(spark, sf_dir).select("user_id", made.alias("handle")).withColumns({"valid": T.is_handle(F.col("handle")), "noun": F.split_part("handle", F.lit("-"), F.lit(2))})


#: A phrase an item: its first words of ASCII letters, two at least.
ITEM_PHRASES = "phrases AS (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]+( [A-Za-z]+)+')) AS phrase FROM benchmark WHERE regexp_matches(text, '[A-Za-z]+( [A-Za-z]+)+'))"


@query("c32_c16_f16_phrases", f"WITH {ITEM_PHRASES}, hits AS (SELECT doc_id, item_id FROM documents, phrases WHERE contains(lower(text), phrase) AND regexp_matches(lower(text), concat('\\b', phrase, '\\b'))) SELECT doc_id, CAST(count(item_id) AS INT) AS n_items, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS items FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id")
def phrase_dictionary(spark, sf_dir):
    """Which of the phrases that benchmark items begin with stand in each document, as whole words in any case."""
    pattern = "[A-Za-z]+( [A-Za-z]+)+"
    items = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("item_id"), F.lower(F.regexp_extract("text", pattern, 0)).alias("phrase")).where("phrase <> ''")
    some = items.limit(MAX_PHRASES + 1).collect()
    dictionary = PhraseDictionary((r["phrase"], r["item_id"], "word") for r in some)
    found = S.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(found_labels(F.lower("text"), dictionary), F.array().cast("array<int>")).alias("found"))
    return found.select("doc_id", F.size("found").alias("n_items"), F.array_join(F.transform("found", lambda i: i.cast("string")), ",").alias("items"))
