"""Catalog ingestion: quality gates, caps, deduplication, matching, upserts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T


def quality_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined with reason) by the placeholder rules; columns title, artist, phrases, source, mbid."""
    judged = rows.withColumn("reason", T.placeholder_reason(*(F.col(c) for c in ("title", "artist", "phrases", "source", "mbid"))))
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def capped(rows: DataFrame, per_artist: int = 50, per_album: int = 25, order: str = "arrival", tie: str = "song_id") -> DataFrame:
    """At most so many rows of an artist's album, then of an artist, in order of arrival, ties by id; rows without album escape the first."""
    album = Window.partitionBy("artist", "album").orderBy(order, tie)
    kept = rows.withColumn("in_album", F.row_number().over(album)).where(F.col("album").isNull() | (F.col("in_album") <= per_album)).drop("in_album")
    return kept.withColumn("in_artist", F.row_number().over(Window.partitionBy("artist").orderBy(order, tie))).where(F.col("in_artist") <= per_artist).drop("in_artist")


def first_by(rows: DataFrame, keys: list[str], order: str = "arrival", tie: str = "song_id") -> DataFrame:
    """The row of each key that came first, ties by id: a minimum per key, combined before the shuffle."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(order, tie)).alias("first"))
    return first.select("first.*")


def known_by_any(new: DataFrame, have: DataFrame) -> DataFrame:
    """ids of ``new`` that ``have`` knows by ISRC, by MBID, or by title and artist in any case.

    Three equi-joins instead of one with OR, which could only be a nested loop.
    """
    by_code = [new.where(F.col(c).isNotNull()).join(have.select(c).distinct(), c, "left_semi").select("song_id") for c in ("isrc", "mbid")]
    low = lambda df: df.withColumn("t", F.lower("title")).withColumn("a", F.lower("artist"))
    by_name = low(new).join(low(have).select("t", "a").distinct(), ["t", "a"], "left_semi").select("song_id")
    return by_code[0].unionByName(by_code[1]).unionByName(by_name).distinct()


def matched_songs(plays: DataFrame, songs: DataFrame) -> DataFrame:
    """plays with song_id: by MBID if that matches, else by normalised title and artist; the smallest id of several."""
    by_mbid = songs.where(F.col("mbid").isNotNull()).groupBy("mbid").agg(F.min("song_id").alias("id_by_mbid"))
    norm = lambda c: F.lower(F.trim(F.col(c)))
    by_name = songs.groupBy(norm("title").alias("t"), norm("artist").alias("a")).agg(F.min("song_id").alias("id_by_name"))
    named = plays.withColumn("t", T.normalize_name(F.col("title"))).withColumn("a", T.normalize_name(F.col("artist")))
    both = named.join(by_mbid, "mbid", "left").join(by_name, ["t", "a"], "left")
    return both.withColumn("song_id", F.coalesce("id_by_mbid", "id_by_name")).drop("t", "a", "id_by_mbid", "id_by_name")


def upsert_new(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` and those of ``new`` whose key it lacks (insert, do nothing on conflict)."""
    return have.unionByName(new.dropDuplicates(keys).join(have.select(*keys), keys, "left_anti"))


def upsert_over(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key (insert, update on conflict)."""
    return have.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` taken from ``changes`` where the key has one."""
    renamed = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    out = rows.join(renamed, key, "left")
    return out.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def deletable(rows: DataFrame, references: list[tuple[DataFrame, str]], doomed: Column, key: str) -> DataFrame:
    """Rows left after deleting the doomed ones that no table refers to."""
    kept = rows.where(doomed).select(key)
    for table, column in references:
        kept = kept.join(table.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return rows.join(kept, key, "left_anti")


def share_of_total(rows: DataFrame, by: list[str]) -> DataFrame:
    """n and percent of all rows for each group: the window runs over groups, not rows."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1).cast("double"))


def coverage(rows: DataFrame, column: str, *more: Column) -> DataFrame:
    """One row: all rows, those with the column, their percentage, and further aggregates."""
    return rows.agg(F.count("*").alias("total"), F.count(column).alias("covered"), F.round(F.count(column) * 100.0 / F.count("*"), 1).cast("double").alias("percent"), *more)


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, n_files, bytes of tables read from files; rows by a count that reads no column, bytes of the files that hold rows."""
    parts = []
    for name, table in tables.items():
        by_file = table.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("n"))
        parts.append(by_file.agg(F.lit(name).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")))
    return functools.reduce(DataFrame.unionByName, parts)
