"""Hand cases: identities, edge values, and rules that SQL does not cover."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import embedders, scores, vectors
from quern.functions import text as T
from quern.operators import catalog, chat, retrieval
from quern.plans import standins
from quern.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def vec(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_cosine_identities(spark):
    cos = vectors.cosine
    got = one(spark, cos(vec(1, 2), vec(1, 2)), cos(vec(1, 0), vec(0, 1)), cos(vec(1, 1), vec(-1, -1)), cos(vec(0, 0), vec(1, 2)), cos(vec(1, 2), vec(2, 1)) == cos(vec(2, 1), vec(1, 2)))
    assert got == pytest.approx((1, 0, -1, 0, True))
    zero, unit = one(spark, vectors.normalize(vec(0, 0)), vectors.normalize(vec(3, 4)))
    assert zero == [0, 0] and unit == pytest.approx([0.6, 0.8])


def test_dimension_guard(spark):
    assert one(spark, vectors.checked(vec(1, 2), 2)) == ([1, 2],)
    with pytest.raises(PySparkException):
        one(spark, vectors.checked(vec(1, 2, 3), 2))


def test_confidence(spark):
    c = lambda n, a, b: scores.confidence(F.lit(n), F.lit(a), F.lit(b))
    assert one(spark, c(0, None, None), c(1, 0.9, None), c(2, 0.5, 0.5), c(2, 9.0, 0.0), c(2, 0.0, 9.0)) == pytest.approx((0, 0.95, 0.5, 0.99, 0.1))
    assert one(spark, c(2, scores.GAP_FOR_ALTERNATES, 0.0)) == pytest.approx((scores.ALTERNATES_BELOW,))


def test_strength_and_boost(spark):
    s = lambda x: scores.strength(F.lit(x))
    assert one(spark, s(0.5), s(0.3), s(0.15), s(0.1)) == ("Strong match", "Good match", "Loose match", None)
    tags, like = F.array(F.lit("Rock"), F.lit("x")), F.array(F.lit("rock"))
    assert one(spark, scores.tag_boost(F.lit(0.5), tags, like), scores.tag_boost(F.lit(0.95), tags, like)) == pytest.approx((0.55, 1.0))


def test_keywords_are_whole_words(spark):
    m = lambda text: T.matches_keyword(F.lit(text), ["bad", "c++"])
    assert one(spark, m("a BAD day"), m("badge"), m("not bad.")) == (True, False, True)


def test_rolling_hash(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return np.base_repr(abs(h - (1 << 32) if h >> 31 else h), 36).lower()

    texts = ["", "a", "10.0.0.1", "192.168.100.200", "2001:db8::ff00:42:8329"]
    assert one(spark, *(T.rolling_hash36(F.lit(t)) for t in texts)) == tuple(map(plain, texts))


def test_avatar_bucket(spark):
    def int32(x):
        return (x + (1 << 31)) % (1 << 32) - (1 << 31)

    def plain(s):
        h = 2166136261
        for c in s:
            h = int32(h) ^ ord(c)
            h += sum(int32(h << k) for k in (1, 4, 7, 8, 24))
        return abs(h) % 60

    texts = ["", "a", "calm-river", "bright-stone", "zzzzzzzzzzzzzzzz-zzzzzzzz"]
    assert one(spark, *(T.avatar_bucket(F.lit(t), 60) for t in texts)) == tuple(map(plain, texts))


def test_salted_hash(spark):
    assert one(spark, T.hashed_ip(F.lit("1.2.3.4"), "s"))[0] == hashlib.sha256(b"1.2.3.4s").hexdigest()[:32]


def test_moments_need_an_emotion_hit(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id int, song_id int, distance double")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id int, query_vector array<double>")
    moments = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0])], "song_id int, moment_vector array<double>")
    out = retrieval.three_signals(leg([(1, 10, 0.5), (2, 10, 0.5)]), leg([(1, 11, 0.2), (2, 12, 0.2)]), moments, queries, 5)
    got = {(r.query_id, r.song_id): r.score for r in out.collect()}
    assert got == pytest.approx({(1, 10): 0.1 + 0.3, (1, 11): 0.4 + 0.3, (2, 10): 0.1, (2, 12): 0.4})


def test_caps_count_only_kept_rows(spark):
    rows = [(i, "a", "x", i) for i in range(5)] + [(10 + i, "a", None, 10 + i) for i in range(5)]
    kept = catalog.capped(spark.createDataFrame(rows, "song_id int, artist string, album string, arrival int"), 4, 2)
    assert sorted(r.song_id for r in kept.collect()) == [0, 1, 10, 11]


def test_threads(spark):
    rows = [(1, 7, 1, None), (2, 8, 2, 1), (3, 9, 3, 2), (4, 7, 4, 99), (5, 7, 5, 6), (6, 7, 6, 5)]
    m = spark.createDataFrame(rows, "message_id long, user_id long, created_at long, reply_to long")
    roots = {r.message_id: r.root_id for r in chat.thread_roots(m).collect()}
    assert roots[3] == roots[2] == roots[1] == 1 and roots[4] == 4 and roots[5] == 5 and roots[6] == 6
    first = {r.root_id: r for r in chat.threads(m).collect()}[1]
    assert [(x["message_id"], x["answers"]) for x in first.replies] == [(2, None), (3, 8)]


def test_deep_threads_and_cycles(spark):
    """A chain far deeper than 64, a cycle of 70 with a tail of 5, a message that replies to itself."""
    rows = [(i, 7, i, i - 1 if i else None) for i in range(300)]
    rows += [(1000 + i, 8, i, 1000 + (i + 1) % 70) for i in range(70)] + [(500 + i, 8, i, 501 + i if i < 4 else 1033) for i in range(5)] + [(2000, 9, 0, 2000)]
    m = spark.createDataFrame(rows, "message_id long, user_id long, created_at long, reply_to long")
    got = {r.message_id: (r.root_id, r.depth) for r in chat.thread_roots(m).collect()}
    want = {i: (0, i) for i in range(300)} | {1000 + i: (1000 + i, 0) for i in range(70)} | {500 + i: (1033, 5 - i) for i in range(5)} | {2000: (2000, 0)}
    assert got == want
    assert {r.root_id: r.n_replies for r in chat.threads(m).collect()} == {0: 299, 1033: 5, 2000: 0} | {1000 + i: 0 for i in range(70) if i != 33}
    assert chat.thread_replies(m).where("root_id = 0").count() == 299


def test_walks_end_where_they_come_again(spark):
    """Random links with cycles of many lengths, orphans and self-replies, each walked step by step."""
    import random

    rng = random.Random(6)
    to = {i: rng.choice([None, rng.randrange(400), rng.randrange(max(0, i - 3), i + 1), 10_000]) for i in range(400)}

    def walked(at):
        seen = []
        while True:
            if at in seen:
                return at, seen.index(at)
            seen.append(at)
            if to[at] is None or to[at] not in to:
                return at, len(seen) - 1
            at = to[at]

    m = spark.createDataFrame(list(to.items()), "message_id long, reply_to long")
    assert {r.message_id: (r.root_id, r.depth) for r in chat.thread_roots(m).collect()} == {i: walked(i) for i in to}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "user_id long, song_id long")
    assert retrieval.without_recent(empty, empty, 3).count() == 0
    m = spark.createDataFrame([], "message_id long, created_at timestamp, confidence double, scored boolean, user_id long")
    users = spark.createDataFrame([], "user_id long, ip_hash long")
    assert chat.analytics(m, users).first().success_rate == 0


def test_embedders(spark):
    class Broken:
        dimensions = 8

        def available(self):
            return True

        def embed(self, texts):
            raise OSError

    e = embedders.FirstAvailable(Broken(), embedders.HashEmbedder(8))
    got = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(embedders.embedding(F.col("t"), e, 2).alias("v")).collect()
    assert np.linalg.norm(got[0].v) == pytest.approx(1, abs=1e-6) and got[1].v is None and not any(got[2].v)
    with pytest.raises(RuntimeError):
        embedders.FirstAvailable(Broken()).embed(["x"])


def test_knn_plan_keeps_k_rows_a_task(spark):
    songs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "song_id int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    plan = retrieval.knn(songs, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search("WindowGroupLimit.*Partial", plan) and "CartesianProduct" not in plan


def test_blocks_equal_pairs(spark):
    rng = np.random.default_rng(3)
    songs = spark.createDataFrame([(i, rng.normal(size=6).tolist() if i % 10 else None) for i in range(300)] + [(300, [0.0] * 6)], "song_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(4)], "query_id long, query_vector array<double>")
    take = lambda df: sorted((r.query_id, r["rank"], r.song_id, round(r.distance, 9)) for r in df.collect())
    assert take(retrieval.knn_blocks(songs, q, 8)) == take(retrieval.knn(songs.where("embedding IS NOT NULL"), q, 8))
    assert retrieval.knn_blocks(songs, q.limit(0), 8).count() == 0 == retrieval.knn_blocks(songs.limit(0), q, 8).count()


def test_many_queries_are_searched_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    songs = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(60)], "song_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(9)], "query_id long, query_vector array<double>")
    take = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    others = q.select(F.col("query_id").alias("id"), F.col("query_vector").alias("vector"))
    rows = songs.select(F.col("song_id").alias("id"), F.col("embedding").alias("vector"))
    calls = (lambda: retrieval.knn(songs, q, 4), lambda: retrieval.knn_blocks(songs, q, 4), lambda: retrieval.similarity_matrix(rows, others))
    at_once = [take(f()) for f in calls]
    assert [len(x) for x in at_once] == [36, 36, 540]
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 4)
    assert len(retrieval.query_blocks(q)) == 5
    assert [take(f()) for f in calls] == at_once


def test_copies_tie_to_the_last_bit(spark):
    """A vector and its copies have similarity 1 exactly, in expressions and in tasks, so ids decide; null vectors give null."""
    rng = np.random.default_rng(11)
    base = [rng.normal(size=64).astype(np.float32).tolist() for _ in range(40)]
    songs = spark.createDataFrame([(i, base[i % 40]) for i in range(399, -1, -1)], "song_id long, embedding array<float>").repartition(7)
    q = spark.createDataFrame([(i, base[i]) for i in range(40)], "query_id long, query_vector array<float>")
    both = songs.where("song_id < 40").join(q, F.expr("song_id = query_id")).select(vectors.cosine("embedding", "query_vector").alias("c"), vectors.cosine("embedding", F.lit(None).cast("array<double>")).alias("none"))
    assert {(r.c, r.none) for r in both.collect()} == {(1.0, None)}
    near = retrieval.knn(songs, q, 10).collect()
    assert sorted((r.query_id, r["rank"], r.song_id, r.distance) for r in near) == [(i, n + 1, i + 40 * n, 0.0) for i in range(40) for n in range(10)]


def test_tiles_give_what_pairs_give(spark, monkeypatch):
    """Any metric, in tiles of any size, with few rows, ties, NaN, zero and null vectors, columns kept, ids of their own types."""
    monkeypatch.setattr(retrieval, "TILE", 64)
    monkeypatch.setattr(retrieval, "TILE_ROWS", 16)
    rng = np.random.default_rng(12)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), f"t{i}") for i in range(200)] + [(200, None, "none"), (201, [0.0] * 4, "zero"), (202, [float("nan")] * 4, "nan")]
    songs = spark.createDataFrame(rows, "song_id int, embedding array<double>, title string").repartition(3)
    q = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(9)] + [(9, None)], "query_id int, query_vector array<double>")
    for metric in ("cosine", "euclidean", "dot"):
        pairs = songs.where("embedding IS NOT NULL").join(q.where("query_vector IS NOT NULL")).withColumn("distance", vectors.distance("embedding", "query_vector", metric))
        for k in (7, 300):
            take = lambda df: sorted((r.query_id, r["rank"], r.song_id, r.title, repr(r.distance)) for r in df.collect())
            got = retrieval.knn(songs, q, k, metric, keep=("title",))
            assert take(got) == take(retrieval.top_k(pairs, k, ["query_id"], [F.col("distance"), F.col("song_id")]))
            assert got.schema["song_id"].dataType == got.schema["query_id"].dataType == songs.schema["song_id"].dataType
    with pytest.raises(Exception, match="expected vectors of 4 dimensions"):
        retrieval.knn(spark.createDataFrame([(1, [1.0])], "song_id int, embedding array<double>"), q, 3).collect()


def test_matrix_of_all_pairs(spark):
    """Tiles in tasks give every pair, null vectors too."""
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, -float(i)]) for i in range(500)] + [(500, None)], "id int, vector array<double>").repartition(3)
    for others in (v.where("id % 50 = 0"), v.where("id = 500"), v.limit(0)):
        want = v.join(others.select(F.col("id").alias("b_id"), F.col("vector").alias("b"))).select("id", "b_id", vectors.cosine("vector", "b").alias("c"))
        take = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
        plan = retrieval.similarity_matrix(v, others)
        assert take(plan) == take(want.select("id", "b_id", (1 - (1 - F.col("c"))).alias("c")))
        assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_snapshot_of_several_objects(spark, monkeypatch):
    """Objects that one task writes are all read back."""
    monkeypatch.setattr(files, "SNAPSHOT_ROWS", 10)
    path = files.scratch(spark, "snapshot")
    files.write_snapshot(spark.range(95).coalesce(1).withColumnRenamed("id", "song_id"), path, "2024-01-31T00:00:00Z")
    back = files.read_json_array(spark, path, "timestamp string, count long, songs array<struct<song_id: long>>").collect()
    assert sorted(r["count"] for r in back) == [5] + [10] * 9
    assert sorted(s.song_id for r in back for s in r.songs) == list(range(95))


def test_rows_that_arrive_at_once_go_by_id(spark):
    rows = spark.createDataFrame([(i, "a", "x", "t", i % 2) for i in range(9, -1, -1)], "song_id int, artist string, album string, title string, arrival int").repartition(4)
    assert sorted(r.song_id for r in catalog.capped(rows, 7, 9).collect()) == [0, 1, 2, 3, 4, 6, 8]
    assert [r.song_id for r in catalog.first_by(rows, ["title", "artist"]).collect()] == [0]


def test_ended_walks_are_not_moved_again(spark, monkeypatch):
    """What the rounds write: walks that ended stay as they are, and only those into a cycle are walked again."""
    written = []
    monkeypatch.setattr(chat, "stored", lambda df, what: (written.append(out := files.stored(df, what)), out)[1])
    parent = lambda i: 7 if i == 5 else i - 1 if i % 120 else None
    out = chat.thread_roots(spark.createDataFrame([(i, parent(i)) for i in range(600)], "message_id int, reply_to int"))
    got = {r.message_id: (r.root_id, r.depth) for r in out.collect()}
    assert len(got) == 600 and got[599] == (480, 119) and got[6] == (6, 0) and got[10] == (7, 3)
    assert sum(df.count() for df in written) < 12 * 600


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_few_pairs_are_compared_exactly(monkeypatch, metric):
    """A tile is one matrix product by any metric; of 400,000 pairs some thousands are compared element by element."""
    rng = np.random.default_rng(3)
    m, ids = rng.normal(size=(8000, 16)), rng.permutation(8000)
    m[4000:] = m[:4000]  # ties
    m[7], m[4007] = np.nan, 0.0
    pairs, exact = [], vectors.distances
    monkeypatch.setattr(vectors, "distances", lambda a, b, by="cosine": pairs.append(np.prod(np.broadcast_shapes(a.shape[1:], b.shape[1:]))) or exact(a, b, by))
    best = retrieval.Best(m[:50], 6, metric)
    for at in range(0, 8000, 1000):
        best.add(ids[at : at + 1000], m[at : at + 1000])
    assert sum(pairs) < 40_000
    d = exact(m[:50].T[:, :, None], m.T[:, None], metric)
    d[np.isnan(d)] = np.inf
    first = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :6]
    assert (best.ids == ids[first]).all() and (best.d == np.take_along_axis(d, first, 1)).all()


def test_single_precision_only_screens(monkeypatch):
    """By cosine a tile is a product in single precision; neighbours that differ by less than it holds are still told apart, and few pairs are compared."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(40, 16))
    m = np.concatenate([base + 1e-9 * rng.normal(size=base.shape) for _ in range(12)] + [rng.normal(size=(3520, 16)), np.zeros((1, 16))])
    ids, kinds, pairs = rng.permutation(len(m)), set(), []
    within, exact = retrieval._within, vectors.distances
    monkeypatch.setattr(retrieval, "_within", lambda s, *rest: kinds.add(s.dtype) or within(s, *rest))
    monkeypatch.setattr(vectors, "distances", lambda a, b, by="cosine": pairs.append(a.shape[1]) or exact(a, b, by))
    best = retrieval.Best(base, 6, tile=1 << 14, tile_rows=512)
    for at in range(0, len(m), 900):
        best.add(ids[at : at + 900], m[at : at + 900])
    d = exact(base.T[:, :, None], m.T[:, None])
    first = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :6]
    assert (best.ids == ids[first]).all() and (best.d == np.take_along_axis(d, first, 1)).all()
    assert kinds == {np.dtype(np.float32)} and sum(pairs) < 4_000


def test_three_signals_read_each_leg_once(spark):
    """Whether a query's moments count is found in one pass: no second copy of the legs is joined to the first."""
    leg = lambda rows: spark.createDataFrame(rows, "query_id long, song_id long, distance double")
    meta, emotions = leg([(1, 10, 0.5), (1, 11, 0.25), (2, 10, 0.5)]), leg([(1, 11, 0.5), (2, 12, 0.25)])
    moments = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, None)], "song_id long, moment_vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id long, query_vector array<double>")
    out = retrieval.three_signals(meta, emotions, moments, queries, 5)
    got = {(r.query_id, r.song_id): (r.d1, r.d2, r.d3) for r in out.collect()}
    assert got == {(1, 10): (0.5, None, 0.0), (1, 11): (0.25, 0.5, 1.0), (2, 10): (0.5, None, None), (2, 12): (None, 0.25, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3


def test_songs_with_vectors_are_not_sent_through_the_driver(spark, tmp_path):
    """The keys of part, which compress well, are not broadcast: the join is by shuffle however small its sides look."""
    spark.range(1000).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(100).selectExpr("id AS vec_id", "array(1.0f, 2.0f) AS embedding", "1 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    songs = standins.vector_songs(spark, str(tmp_path))
    eligible = retrieval.eligible(songs).select("song_id", "embedding")
    assert "Broadcast" not in eligible._jdf.queryExecution().executedPlan().toString()
    assert (songs.count(), eligible.count()) == (1000, 94)
