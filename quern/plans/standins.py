"""Songs, messages, reactions, users and plays made of the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Requests of e01: a message for each query vector, some of them blank, too long or with a blocked word.
_REQUEST = {
    "request_id": "event_id",
    "user_id": "CASE WHEN event_id % 450 <> 400 THEN event_id % 500 % 150 / 50 + floor(event_id / 500) * 3 END",
    "ip": "CASE WHEN event_id % 350 <> 300 THEN concat('10.0.0.', CAST(event_id % 2 AS {str})) END",
    "text": "CASE WHEN event_id % 700 = 150 THEN '   ' WHEN event_id % 800 = 350 THEN repeat(props, 60) WHEN event_id % 600 = 250 THEN concat('you IDIOT, ', props) WHEN event_id % 100 = 0 THEN concat('  So happy: ', event_type, '! ', props, ' ') ELSE concat(event_type, ' ', props) END",
    "allow_explicit": "event_id % 4 = 0",
}
#: Columns both engines compute alike from part.
_SONG = {
    "song_id": "p_partkey",
    "title": "p_name",
    "artist": "p_brand",
    "album": "CASE WHEN p_partkey % 13 <> 0 THEN concat(p_type, ' ', CAST(p_partkey % 7 AS {str})) END",
    "year": "CAST(CASE WHEN p_partkey % 11 <> 0 THEN 1950 + p_partkey % 70 END AS INT)",
    "popularity": "CAST(p_partkey * 37 % 101 AS INT)",
    "source": "CASE p_partkey % 3 WHEN 0 THEN 'musicbrainz' WHEN 1 THEN 'radio' ELSE 'manual' END",
    "mbid": "CASE WHEN p_partkey % 4 = 0 THEN concat('mb-', CAST(p_partkey % 800 AS {str})) END",
    "isrc": "CASE WHEN p_partkey % 5 = 0 THEN concat('us-abc-', CAST(p_partkey AS {str})) END",
    "phrases": "replace(p_name, ' ', ',')",
    "is_placeholder": "p_partkey % 17 = 0",
    "arrival": "p_partkey * 7919 % 100003",
}
_MESSAGE = {
    "message_id": "event_id",
    "user_id": "user_id",
    "room_id": "event_type",
    "created_at": "ts",
    "text": "concat(event_type, ' ', props)",
    "confidence": "CASE WHEN event_id % 3 <> 0 THEN value / 500 END",
    "scored": "event_id % 4 <> 0",
    "song_id": "CASE WHEN event_id % 6 <> 0 THEN event_id * 31 % 2000 END",
    "reply_to": "CASE WHEN event_id % 6 <> 0 THEN event_id - 1 END",
    "props": "props",
    "value": "value",
}


def _sql(columns: dict[str, str], text: str) -> str:
    return ", ".join(f"{e.format(str=text)} AS {c}" for c, e in columns.items())


_TAGS = {"spark": "array(lower(p_type), split(p_name, ' ')[0], CASE WHEN p_size % 10 = 3 THEN 'Explicit' ELSE 'radio' END)", "duck": "[lower(p_type), split_part(p_name, ' ', 1), CASE WHEN p_size % 10 = 3 THEN 'Explicit' ELSE 'radio' END]"}

SONGS = f"songs AS (SELECT {_sql(_SONG, 'VARCHAR')}, {_TAGS['duck']} AS tags FROM part)"
VECTOR_SONGS = f"vsongs AS (SELECT {_sql(_SONG, 'VARCHAR')}, {_TAGS['duck']} AS tags, CAST(embedding AS DOUBLE[]) AS embedding, label FROM part LEFT JOIN embeddings ON p_partkey = vec_id)"
MESSAGES = f"messages AS (SELECT {_sql(_MESSAGE, 'VARCHAR')} FROM events)"
REQUESTS = f"requests AS (SELECT {_sql(_REQUEST, 'VARCHAR').replace(' END AS user_id', ' END::BIGINT AS user_id')}, epoch_us(ts) / 1000000.0 AS seconds FROM events WHERE event_id IN (SELECT query_id FROM queries))"
REACTIONS = "reactions AS (SELECT event_id // 10 AS message_id, event_type AS emoji, user_id, min(ts) AS created_at FROM events GROUP BY 1, 2, 3)"
USERS = "users AS (SELECT c_custkey AS user_id, CAST(floor(c_acctbal / 500) AS BIGINT) AS ip_hash, TIMESTAMP '2023-01-01' + to_days(CAST(c_custkey % 300 AS INT)) AS joined_at FROM customer)"
QUERY_VECTORS = "queries AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0)"
PLAYS = "plays AS (SELECT event_id AS play_id, concat('  ', upper(replace(p_name, ' ', '   '))) AS title, lower(p_brand) AS artist, CASE WHEN event_id % 2 = 0 THEN concat('mb-', CAST(event_id % 1500 AS VARCHAR)) END AS mbid, ts AS airdate, event_type AS play_type FROM events JOIN part ON event_id % 2000 = p_partkey)"


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*(f"{e.format(str='STRING')} AS {c}" for c, e in _SONG.items()), f"{_TAGS['spark']} AS tags")


def vector_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("song_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return songs(spark, sf_dir).join(vectors.hint("merge"), "song_id", "left")  # compressed keys look small: a broadcast of them takes all rows of part through the driver


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e.format(str='STRING')} AS {c}" for c, e in _MESSAGE.items()))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).alias("seconds")
    rows = table(spark, sf_dir, "events").select(*(F.expr(f"{e.format(str='STRING')} AS {c}") for c, e in _REQUEST.items()), seconds)
    return rows.withColumn("user_id", F.col("user_id").cast("long")).join(query_vectors(spark, sf_dir).select(F.col("query_id").alias("request_id")), "request_id", "left_semi")


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.expr("event_id div 10").alias("message_id"), F.col("event_type").alias("emoji"), "user_id").agg(F.min("ts").alias("created_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "CAST(floor(c_acctbal / 500) AS BIGINT) AS ip_hash", "TIMESTAMP_NTZ '2023-01-01' + make_dt_interval(CAST(c_custkey % 300 AS INT)) AS joined_at")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "events").join(table(spark, sf_dir, "part"), F.expr("event_id % 2000 = p_partkey"))
    return joined.selectExpr("event_id AS play_id", "concat('  ', upper(replace(p_name, ' ', '   '))) AS title", "lower(p_brand) AS artist", "CASE WHEN event_id % 2 = 0 THEN concat('mb-', CAST(event_id % 1500 AS STRING)) END AS mbid", "ts AS airdate", "event_type AS play_type")
