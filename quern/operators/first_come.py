"""The choice that a sequential import makes of one batch: first come, first served.

Rows are taken in order. A row is skipped if a row taken before it has one of its
keys (any of several: an OR), or if enough rows were taken before it in its artist
or in its artist's album. Skipped rows neither hold keys nor count.

What a loop does row by row is done here in rounds over all undecided rows: a row is
taken once no undecided row before it has one of its keys and even all undecided
rows before it would leave room in its groups; a row is skipped once a taken row has
one of its keys or its groups are full of taken rows before it. The first undecided
row is always decided, and so are all that no undecided one stands in the way of, so
there are as many rounds as the longest chain of rows that each depend on the one
before: a few, unless a batch is made to be such a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.files import deleted, stored


def song_keys() -> Column:
    """The keys of a song: ISRC, MBID, title with artist in any case; those that are there."""
    part = lambda kind, *cols: F.when(F.lit(True) if len(cols) > 1 else F.col(cols[0]).isNotNull(), F.concat_ws("\u0001", F.lit(kind), *(F.lower(c) if len(cols) > 1 else F.col(c) for c in cols)))
    return F.array_compact(F.array(part("isrc", "isrc"), part("mbid", "mbid"), part("name", "title", "artist")))


def _full(rows: DataFrame, group: str, most: int) -> DataFrame:
    """group, last: the place of the ``most``-th row of each group that has so many; Spark keeps ``most`` rows of a group in each task."""
    w = Window.partitionBy(group).orderBy("place")
    return rows.where(F.col(group).isNotNull()).select(group, "place", F.row_number().over(w).alias("n")).where(F.col("n") <= most).where(F.col("n") == most).select(group, F.col("place").alias("last"))


def first_come(rows: DataFrame, keys: Column, place: list[str], caps: list[tuple[Column, int]]) -> DataFrame:
    """The columns ``place`` of the rows of ``rows`` that are taken.

    ``place``: columns that order the rows and together name one. ``keys``: an
    array of strings; null and repeated keys say nothing. ``caps``: (group, most
    rows taken of it); a null group has no cap.
    """
    groups = [f"group{i}" for i in range(len(caps))]
    narrow = rows.select(F.struct(*place).alias("place"), F.array_distinct(F.array_compact(keys)).alias("keys"), *(c.cast("string").alias(g) for g, (c, _) in zip(groups, caps)))
    left = stored(narrow, "first-come")
    taken = []  # a table a round
    while left.limit(1).count():
        before = left.select("place", *groups)
        for t in taken:
            before = before.unionByName(t.select("place", *groups))
        first = left.select("place", F.explode("keys").alias("key")).groupBy("key").agg(F.min("place").alias("first"))  # a minimum a key, combined before the shuffle
        behind = left.select("place", F.explode("keys").alias("key")).join(first, "key").where("place > first").select("place").distinct()
        free = left.join(behind, "place", "left_anti")
        for g, (_, most) in zip(groups, caps):
            free = free.join(_full(before, g, most), g, "left").where("last IS NULL OR place <= last").drop("last")
        now = stored(free, "first-come")
        taken.append(now)
        rest = left.join(now.select("place"), "place", "left_anti")
        held = now.select(F.explode("keys").alias("key"))  # a key is held by one row of a round
        again = rest.select("place", F.explode("keys").alias("key")).join(held, "key", "left_semi").select("place").distinct()
        rest = rest.join(again, "place", "left_anti")
        full = taken[0].select("place", *groups)
        for t in taken[1:]:
            full = full.unionByName(t.select("place", *groups))
        for g, (_, most) in zip(groups, caps):
            rest = rest.join(_full(full, g, most), g, "left").where("last IS NULL OR place < last").drop("last")
        following = stored(rest, "first-come")
        deleted(left)
        left = following
    out = left.select("place.*")
    for t in taken:
        out = out.unionByName(t.select("place.*"))
    return out


def import_batch(new: DataFrame, have: DataFrame, per_artist: int = 50, per_album: int = 25) -> DataFrame:
    """arrival, song_id of the rows of ``new`` that an import into ``have`` takes, in order of arrival.

    Rows that the catalog knows by any key are skipped whatever the batch holds,
    so they go first. Columns: song_id, arrival, title, artist, album, isrc, mbid.
    """
    from quern.operators.catalog import known_by_any

    fresh = new.join(known_by_any(new, have), "song_id", "left_anti")
    artist = F.lower("artist")
    album = F.when(F.coalesce(F.col("album"), F.lit("")) != "", F.concat_ws("\u0001", artist, F.lower("album")))
    return first_come(fresh, song_keys(), ["arrival", "song_id"], [(artist, per_artist), (album, per_album)])
