"""The distributed first-come choice against a loop over the rows."""

import random

from pyspark.sql import functions as F

from quern.operators import first_come


def plain(rows, per_artist, per_album, have=()):
    """song_ids that a loop takes; rows: (arrival, song_id, title, artist, album, isrc, mbid)."""

    def keys(r):
        return {k for k in (("i", r[5]), ("m", r[6])) if k[1] is not None} | {("n", r[2].lower(), r[3].lower())}

    held = set().union(*map(keys, have))
    artists, albums, out = {}, {}, []
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        artist, album = r[3].lower(), (r[3].lower(), (r[4] or "").lower())
        if held & keys(r) or artists.get(artist, 0) >= per_artist or (r[4] and albums.get(album, 0) >= per_album):
            continue
        held |= keys(r)
        artists[artist] = artists.get(artist, 0) + 1
        albums[album] = albums.get(album, 0) + 1
        out.append(r[1])
    return sorted(out)


SCHEMA = "arrival long, song_id long, title string, artist string, album string, isrc string, mbid string"


def batch(rng, n, spread):
    pick = lambda k: rng.randrange(k)
    return [
        (pick(n), i, f"{rng.choice('Tt')}itle{pick(spread)}", f"{rng.choice('Aa')}rtist{pick(max(1, spread // 8))}", rng.choice([None, "", f"al{pick(3)}", f"AL{pick(3)}"]), rng.choice([None, f"i{pick(spread)}"]), rng.choice([None, None, f"m{pick(spread)}"]))
        for i in range(n)
    ]


def test_random_batches(spark):
    rng = random.Random(1)
    for n, spread, caps in ((40, 6, (3, 2)), (300, 60, (12, 2)), (300, 500, (50, 25)), (200, 20, (1000, 1000))):
        rows, have = batch(rng, n, spread), batch(rng, n // 10, spread)
        have = [(a, 10_000 + i, *rest) for a, i, *rest in have]
        got = first_come.import_batch(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(have, SCHEMA), *caps)
        want = plain(rows, *caps, have)
        assert sorted(r.song_id for r in got.collect()) == want and 0 < len(want) < n


def test_a_row_skipped_by_a_cap_holds_no_key(spark):
    """The second song of an artist with room for one leaves its code to a later song of another artist."""
    rows = [(1, 1, "a", "x", None, None, None), (2, 2, "b", "x", None, "code", None), (3, 3, "c", "y", None, "code", None), (4, 4, "d", "z", None, "code", None)]
    got = first_come.import_batch(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA), 1, 1)
    assert sorted(r.song_id for r in got.collect()) == [1, 3] == plain(rows, 1, 1)


def test_chain_hot_key_and_empty(spark):
    """Each row shares a key with the next: every second one is taken, a round for each. One key on all rows: the first."""
    chain = [(i, i, f"t{i}", f"a{i}", None, f"i{i // 2}", f"m{(i + 1) // 2}") for i in range(8)]
    got = first_come.import_batch(spark.createDataFrame(chain, SCHEMA), spark.createDataFrame([], SCHEMA))
    assert sorted(r.song_id for r in got.collect()) == [0, 2, 4, 6] == plain(chain, 50, 25)
    hot = spark.range(20_000).select(F.col("id").alias("arrival"), F.col("id").alias("song_id"), F.lit("t").alias("title"), F.lit("a").alias("artist"), F.lit(None).cast("string").alias("album"), F.lit(None).cast("string").alias("isrc"), F.lit(None).cast("string").alias("mbid"))
    assert [r.song_id for r in first_come.import_batch(hot, hot.limit(0)).collect()] == [0]
    assert first_come.import_batch(hot.limit(0), hot).count() == 0
