"""A message to a song: what a request goes through, for a table of requests at once.

requests: request_id long, user_id, ip string, seconds double, text, allow_explicit boolean.

In this order: a token of the bucket of user and address; a text that is not
empty, has at most MAX_TEXT characters and no blocked word; the nearest songs to
its vector; without those the user was shown lately, unless fewer than KEEP would
stay; without explicit ones, unless the request allows them; the most popular
songs if none is left. A request that is turned away has no song.

A request's matches are one array of at most MATCHES structs from the search on,
and all rules are folds over it, so after the search nothing is shuffled but one
row a request.

Null text counts as empty, null user as anonymous, null address as unknown. A
request without a vector gets the popular songs. With no song at all the outcome
is ``no_songs``. Requests need distinct ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scores
from quern.functions import text as T
from quern.operators import chat, retrieval
from quern.sources.files import stored
from quern.streaming import rate_limit

MAX_TEXT, MATCHES, KEEP, RECENT, PICKS, FALLBACK = 500, 40, 5, 10, 3, 3
STATUS = {"ok": 200, "validation_error": 400, "content_filtered": 400, "rate_limited": 429, "no_songs": 500}
MESSAGE = "user_id long, room_id string, text string, song_id long, scores string, created_at timestamp"


def judged(requests: DataFrame, keywords: list[str], capacity: float = rate_limit.CAPACITY, rate: float = rate_limit.PER_SECOND) -> DataFrame:
    """requests with text trimmed, cleaned, outcome and retry_after (seconds, of those that are limited).

    Every request asks its bucket for a token, invalid ones too. In a user's
    bucket requests are taken by time, then id.
    """
    key = F.concat_ws(":", F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")), F.coalesce("ip", F.lit("unknown")))
    allowed = rate_limit.limited(requests.select(key.alias("key"), F.col("request_id").cast("long").alias("event_id"), F.col("seconds").cast("double")), capacity, rate)
    both = requests.join(allowed.select(F.col("event_id").alias("request_id"), "allowed"), "request_id")
    both = both.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    n = F.length("text")
    outcome = F.when(~F.col("allowed"), "rate_limited").when((n == 0) | (n > MAX_TEXT), "validation_error").when(T.matches_keyword(F.col("text"), keywords), "content_filtered").otherwise("ok")
    wait = F.when(~F.col("allowed"), F.lit(math.ceil(1 / rate)))
    return stored(both.withColumns({"outcome": outcome, "retry_after": wait, "cleaned": T.clean_text(F.col("text"))}).drop("allowed"), "judged")


def history(messages: DataFrame, songs: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, shown (songs of the last RECENT messages), spans (the last PICKS are of several decades), for the users given."""
    last = chat.latest(messages.join(users.select("user_id").distinct(), "user_id", "left_semi"), ["user_id"], RECENT).select("user_id", "rank", "song_id")
    known = last.where("song_id IS NOT NULL").join(songs.select("song_id", "year"), "song_id", "left")
    decades = F.collect_set(F.when((F.col("rank") <= PICKS) & (F.col("year") != 0), T.decade(F.col("year"))))
    return known.groupBy("user_id").agg(F.collect_set("song_id").alias("shown"), (F.size(decades) > 1).alias("spans"))


def _match(rank: Column, score: Column) -> Column:
    """What the rules need to know of a match; ``by`` and ``decade`` are what alternates must differ in."""
    return F.struct(rank.alias("rank"), F.col("song_id").cast("long").alias("song_id"), score.cast("double").alias("score"), "title", "artist", "year", F.lower("artist").alias("by"), T.decade(F.col("year")).alias("decade"), T.is_explicit(F.col("tags")).alias("explicit"))


def answered(requests: DataFrame, vectors: DataFrame, songs: DataFrame, messages: DataFrame) -> DataFrame:
    """One row a judged request: outcome, primary, alternates (with scores), n_matches, confidence, strategy, mood.

    ``vectors``: request_id, query_vector. Only requests that are let through are searched for.
    """
    let = requests.where("outcome = 'ok'")
    asked = vectors.withColumnRenamed("request_id", "query_id").join(let.select(F.col("request_id").alias("query_id")), "query_id", "left_semi")
    near = retrieval.knn(retrieval.eligible(songs), asked, MATCHES, keep=("title", "artist", "year", "tags"))
    near = near.withColumn("similarity", 1 - F.col("distance")).where("similarity >= 0")
    lists = near.groupBy(F.col("query_id").alias("request_id")).agg(F.array_sort(F.collect_list(_match(F.col("rank"), F.col("similarity")))).alias("matches"))
    best = songs.orderBy(F.desc("popularity"), "song_id").limit(FALLBACK)
    place = F.row_number().over(Window.orderBy(F.desc("popularity"), "song_id"))  # of FALLBACK rows
    popular = best.withColumn("rank", place).agg(F.array_sort(F.collect_list(_match(F.col("rank"), F.lit(0.3)))).alias("popular"))  # one row
    full = requests.join(lists, "request_id", "left").join(history(messages, songs, let), "user_id", "left").crossJoin(F.broadcast(popular))
    full = full.withColumn("fresh", F.expr("filter(matches, c -> NOT coalesce(array_contains(shown, c.song_id), false))"))
    full = full.withColumn("all", F.expr(f"filter(IF(size(fresh) >= {KEEP}, fresh, matches), c -> allow_explicit OR NOT coalesce(c.explicit, false))"))
    full = full.withColumn("found", F.coalesce(F.size("all") > 0, F.lit(False))).withColumn("all", F.when(F.col("outcome") == "ok", F.when(F.col("found"), F.col("all")).otherwise(F.col("popular"))))
    n = F.size("all")
    full = full.withColumn("outcome", F.when((F.col("outcome") == "ok") & (n == 0), "no_songs").otherwise(F.col("outcome")))
    sure = F.when(n >= 1, scores.confidence(n, F.expr("get(all, 0).score"), F.expr("get(all, 1).score")))
    full = full.withColumn("spans", F.coalesce("spans", F.lit(False))).withColumn("confidence", sure)
    others = F.when(F.col("confidence") < scores.ALTERNATES_BELOW, retrieval.unlike_each_other("all", "by", 2)).otherwise(F.expr("slice(all, 1, 0)"))
    described = F.transform(others, lambda c, i: F.struct(c["song_id"].alias("song_id"), c["title"].alias("title"), c["artist"].alias("artist"), c["year"].alias("year"), scores.alternate_score(i).alias("score")))
    first = F.expr("CASE WHEN size(all) > 0 THEN named_struct('song_id', all[0].song_id, 'title', all[0].title, 'artist', all[0].artist, 'year', all[0].year, 'score', all[0].score) END")
    strategy = F.when(n > 0, F.when(F.col("found"), "embedding").otherwise("popular"))
    mood = F.when(n > 0, F.when(F.col("found"), T.mood(F.col("cleaned"))).otherwise("neutral"))
    status = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return full.select(
        "request_id", "user_id", "seconds", "text", "cleaned", "outcome", status[F.col("outcome")].alias("status"), "retry_after", first.alias("primary"), described.alias("alternates"),
        F.when(n > 0, n).alias("n_matches"), "confidence", strategy.alias("strategy"), mood.alias("mood"),
    )


def stored_messages(answers: DataFrame, room: str) -> DataFrame:
    """The message each answered request of a known user leaves: MESSAGE, the scores as JSON and no chosen song."""

    def song(c: Column) -> Column:
        return F.struct(c["title"].alias("title"), c["artist"].alias("artist"), c["year"].alias("year"))

    what = F.struct(song(F.col("primary")).alias("primary"), F.transform("alternates", song).alias("alternates"), F.coalesce("mood", F.lit("song match")).alias("reasoning"), F.lit("api_map").alias("source"))
    done = answers.where("outcome = 'ok' AND user_id IS NOT NULL")
    return done.select(
        F.col("user_id").cast("long").alias("user_id"), F.lit(room).alias("room_id"), "text", F.lit(None).cast("long").alias("song_id"),
        F.to_json(what, {"ignoreNullFields": "false"}).alias("scores"), F.timestamp_micros(F.round(F.col("seconds") * 1_000_000).cast("long")).alias("created_at"),
    )
