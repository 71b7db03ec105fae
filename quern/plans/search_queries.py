"""Vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scores, vectors
from quern.operators import retrieval
from quern.operators.inverted_lists import InvertedLists, recall
from quern.sources.files import scratch

from . import standins as S
from .registry import query

V, Q = S.VECTOR_SONGS, S.QUERY_VECTORS
ELIGIBLE = "SELECT * FROM vsongs WHERE embedding IS NOT NULL AND NOT is_placeholder"
NEAR = f"near AS (SELECT query_id, song_id, 1 - list_cosine_similarity(embedding, qv) AS distance, embedding, qv FROM ({ELIGIBLE}), queries)"
RANKED = "ranked AS (SELECT query_id, song_id, distance, 1 - distance AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY distance, song_id) AS rank FROM near)"
HEAD = f"WITH {V}, {Q}, {NEAR}, {RANKED}"
PAIRS = "WITH pairs AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7)"


def _pairs(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select(F.col("vec_id").alias("a_id"), F.col("v").alias("a"), (F.col("vec_id") + 7).alias("b_id")).join(e.select(F.col("vec_id").alias("b_id"), F.col("v").alias("b")), "b_id")


@query(
    "t01_knn_top_k",
    "SELECT vec_id, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INT) AS rank, round(s, 6) AS similarity FROM (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0) ORDER BY s DESC, vec_id LIMIT 10",
)
def knn_top_k(spark, sf_dir):
    """The ten nearest to vector 0."""
    e = S.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query_vector"))
    near = retrieval.knn(e, q, 10, vector="embedding", id_col="vec_id")
    return near.select("vec_id", "rank", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query("v01_v08_pair_functions", f"{PAIRS} SELECT a_id, b_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_distance(a, b), 6) AS euclidean, round(list_dot_product(a, b), 6) AS dot, round(sqrt(list_dot_product(a, a)), 6) AS magnitude, round(1 - list_cosine_similarity(a, b), 6) AS cosine_distance, CAST(len(a) AS INT) AS dims, round(1 / (1 + list_distance(a, b)), 6) AS sim_euclidean, round(list_dot_product(a, b), 6) AS sim_dot FROM pairs")
def pair_functions(spark, sf_dir):
    d = lambda m: vectors.distance("a", "b", m)
    named = {
        "cosine": vectors.cosine("a", "b"), "euclidean": vectors.euclidean("a", "b"), "dot": vectors.dot("a", "b"), "magnitude": vectors.magnitude("a"), "cosine_distance": vectors.cosine_distance("a", "b"),
        "sim_euclidean": vectors.similarity_of(d("euclidean"), "euclidean"), "sim_dot": vectors.similarity_of(d("dot"), "dot"),
    }
    return _pairs(spark, sf_dir).select("a_id", "b_id", *(F.round(c, 6).alias(n) for n, c in named.items()), vectors.dims("a").alias("dims"))


@query("v05_normalize", "WITH s AS (SELECT vec_id, [x * 3 FOR x IN CAST(embedding AS DOUBLE[])] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM s")
def normalize(spark, sf_dir):
    v = vectors.normalize(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3))
    return S.table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(v, 1), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"))


@query(
    "a29_vector_statistics",
    "WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(list_min(v), 6) AS v_min, round(list_max(v), 6) AS v_max, round(list_avg(v), 6) AS v_mean, round(list_stddev_pop(v), 6) AS v_std, round(sqrt(list_dot_product(v, v)), 6) AS v_norm, CAST(len(list_filter(v, lambda x: x = 0)) AS INT) AS n_zero, CAST(len(list_filter(v, lambda x: x <> 0 AND abs(x) < 0.001)) AS INT) AS n_tiny, CAST(len(list_filter(v, lambda x: abs(x) > 0.25)) AS INT) AS n_huge, 0 AS n_odd FROM s",
)
def vector_statistics(spark, sf_dir):
    s = vectors.statistics("embedding", tiny=0.001, huge=0.25)
    return S.table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(c, 6).alias(n) if n.startswith("v_") else c.alias(n) for n, c in s.items()))


@query("v11_json_vectors", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(embedding[1] AS DOUBLE), 4) AS first FROM embeddings")
def json_vectors(spark, sf_dir):
    v = vectors.from_json(F.to_json("embedding"), 64)
    return S.table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("n"), F.round(F.element_at("v", 1).cast("double"), 4).alias("first"))


@query("j02_batch_knn", f"{HEAD} SELECT query_id, song_id, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 7")
def batch_knn(spark, sf_dir):
    return retrieval.knn(retrieval.eligible(S.vector_songs(spark, sf_dir)), S.query_vectors(spark, sf_dir), 7).withColumn("distance", F.round("distance", 6))


@query("t01_find_similar", f"{HEAD}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, song_id) AS r FROM ranked WHERE rank <= 20 AND similarity >= 0.1) SELECT query_id, song_id, round(similarity, 6) AS similarity, CAST(r AS INT) AS rank FROM kept WHERE r <= 10")
def find_similar(spark, sf_dir):
    near = retrieval.find_similar(S.vector_songs(spark, sf_dir), S.query_vectors(spark, sf_dir), 10, 0.1)
    return near.select("query_id", "song_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("t02_search", f"{HEAD} SELECT query_id, ranked.song_id, round(similarity, 6) AS similarity FROM ranked JOIN songs2 USING (song_id) WHERE rank <= 15 AND similarity > 0.3 AND NOT list_contains(tags, 'Explicit')".replace("ranked AS", "songs2 AS (SELECT song_id, tags FROM vsongs), ranked AS", 1))
def search(spark, sf_dir):
    near = retrieval.search(S.vector_songs(spark, sf_dir), S.query_vectors(spark, sf_dir), 15)
    return near.select("query_id", "song_id", F.round("similarity", 6).alias("similarity"))


@query(
    "t03_similar_in_context",
    f"{HEAD}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, song_id) AS r FROM ranked WHERE rank <= 60), "
    "ctx AS (SELECT k.query_id, k.song_id, k.similarity AS s0, len(list_filter(tags, lambda t: lower(t) IN ('small', 'economy', 'explicit'))) AS o FROM kept k JOIN vsongs USING (song_id) WHERE r <= 30 AND year BETWEEN 1955 AND 2010 AND popularity >= 10 AND k.song_id % 9 <> 0) "
    "SELECT query_id, song_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, song_id) AS INT) AS rank, round(s, 6) AS similarity FROM (SELECT *, CASE WHEN o > 0 THEN least(1.0, s0 * (1 + least(o * 0.1, 0.5))) ELSE s0 END AS s FROM ctx)",
)
def similar_in_context(spark, sf_dir):
    songs = S.vector_songs(spark, sf_dir)
    excluded = songs.where("song_id % 9 = 0").select("song_id")
    preferred = F.array(*map(F.lit, ("small", "economy", "explicit")))
    near = retrieval.similar_in_context(songs, S.query_vectors(spark, sf_dir), 30, preferred, excluded, (1955, 2010), 10)
    return near.select("query_id", "song_id", "rank", F.round("similarity", 6).alias("similarity"))


LEGS = f"""WITH {V}, {Q}, {NEAR},
    l1 AS (SELECT query_id, song_id, distance AS d1 FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, song_id) <= 40),
    about AS (SELECT song_id + 3 AS song_id, embedding FROM vsongs WHERE embedding IS NOT NULL AND song_id % 7 <> 0),
    l2 AS (SELECT query_id, song_id, 1 - list_cosine_similarity(embedding, qv) AS d2 FROM about, queries QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, song_id) <= 40)"""


def _legs(spark, sf_dir):
    songs, queries = S.vector_songs(spark, sf_dir), S.query_vectors(spark, sf_dir)
    about = songs.where("embedding IS NOT NULL AND song_id % 7 <> 0").select((F.col("song_id") + 3).alias("song_id"), "embedding")
    return songs, queries, retrieval.knn(retrieval.eligible(songs), queries, 40), retrieval.knn(about, queries, 40)


@query("t04_two_leg_union", f"{LEGS} SELECT query_id, song_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT query_id, song_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS rank FROM (SELECT query_id, song_id, coalesce(1 - d1, 0) * 0.3 + coalesce(1 - d2, 0) * 0.7 AS score FROM l1 FULL JOIN l2 USING (query_id, song_id))) WHERE rank <= 20")
def two_leg_union(spark, sf_dir):
    _, _, meta, about = _legs(spark, sf_dir)
    return retrieval.two_legs(meta, about, 20).select("query_id", "song_id", F.round("score", 6).alias("score"), "rank")


@query(
    "t05_three_signals",
    f"{LEGS}, moments AS (SELECT song_id + 5 AS song_id, embedding AS mv FROM vsongs WHERE embedding IS NOT NULL AND song_id % 3 = 0), "
    "c AS (SELECT query_id, song_id, d1, d2, mv FROM l1 FULL JOIN l2 USING (query_id, song_id) LEFT JOIN moments USING (song_id)), "
    "u AS (SELECT DISTINCT query_id AS uq FROM c WHERE d2 IS NOT NULL AND mv IS NOT NULL), "
    "s AS (SELECT query_id, song_id, coalesce(1 - d1, 0) * 0.2 + coalesce(1 - d2, 0) * 0.5 + coalesce(CASE WHEN uq IS NOT NULL THEN list_cosine_similarity(mv, qv) END, 0) * 0.3 AS score FROM c JOIN queries USING (query_id) LEFT JOIN u ON uq = query_id) "
    "SELECT query_id, song_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS rank FROM s) WHERE rank <= 20",
)
def three_signals(spark, sf_dir):
    songs, queries, meta, about = _legs(spark, sf_dir)
    moments = songs.where("embedding IS NOT NULL AND song_id % 3 = 0").select((F.col("song_id") + 5).alias("song_id"), F.col("embedding").alias("moment_vector"))
    return retrieval.three_signals(meta, about, moments, queries, 20).select("query_id", "song_id", F.round("score", 6).alias("score"), "rank")


@query("t06_popular", f"WITH {S.SONGS} SELECT song_id, popularity, 0.3::DOUBLE AS score, 'neutral' AS mood FROM songs ORDER BY popularity DESC, song_id LIMIT 3")
def popular(spark, sf_dir):
    return retrieval.popular(S.songs(spark, sf_dir))


RERANK_IN = "SELECT song_id, title, artist, year, (song_id % 100) / 80.0 AS semantic, (song_id % 37) / 36.0 AS keyword, popularity, CASE WHEN song_id % 5 = 0 THEN 0.0 ELSE (song_id % 10) / 10.0 END AS clarity, song_id % 6 = 0 AS recent, CAST(floor(year / 10) * 10 AS INT) = 1980 AS avoided FROM songs"


@query(
    "t07_rerank",
    f"WITH {S.SONGS}, c AS ({RERANK_IN}), p AS (SELECT *, least(1.0, semantic) * 0.45 AS a, least(1.0, keyword) * 0.3 AS b, least(1.0, popularity / 100) * 0.15 AS c, coalesce(nullif(clarity, 0), 0.5) * 0.1 AS d, CASE WHEN recent THEN 0.25 * 0.8 ELSE 0 END + CASE WHEN coalesce(avoided, false) THEN 0.25 * 0.2 ELSE 0 END AS pen FROM c) "
    "SELECT song_id, round(greatest(0.0, least(1.0, a + b + c + d - pen)), 6) AS final FROM p ORDER BY greatest(0.0, least(1.0, a + b + c + d - pen)) DESC, song_id LIMIT 20",
)
def rerank(spark, sf_dir):
    songs = S.songs(spark, sf_dir).selectExpr("song_id", "(song_id % 100) / 80.0D AS semantic", "(song_id % 37) / 36.0D AS keyword", "popularity", "CASE WHEN song_id % 5 = 0 THEN 0.0D ELSE (song_id % 10) / 10.0D END AS clarity", "song_id % 6 = 0 AS recent", "coalesce(CAST(floor(year / 10) * 10 AS INT) = 1980, false) AS avoided")
    return retrieval.rerank(songs, 0.25).select("song_id", F.round("final", 6).alias("final"))


@query(
    "v17_contributions",
    f"WITH {S.SONGS}, c AS ({RERANK_IN}) SELECT song_id, round(least(1.0, semantic) * 0.45, 6) AS semantic, round(least(1.0, keyword) * 0.3, 6) AS keyword, round(least(1.0, popularity / 100) * 0.15, 6) AS popularity, round(coalesce(nullif(clarity, 0), 0.5) * 0.1, 6) AS clarity, round(CAST(CASE WHEN recent THEN 0.25 * 0.8 ELSE 0 END + CASE WHEN coalesce(avoided, false) THEN 0.25 * 0.2 ELSE 0 END AS DOUBLE), 6) AS penalty FROM c",
)
def contributions(spark, sf_dir):
    songs = S.songs(spark, sf_dir).selectExpr("song_id", "(song_id % 100) / 80.0D AS semantic", "(song_id % 37) / 36.0D AS keyword", "popularity", "CASE WHEN song_id % 5 = 0 THEN 0.0D ELSE (song_id % 10) / 10.0D END AS clarity", "song_id % 6 = 0 AS recent", "coalesce(CAST(floor(year / 10) * 10 AS INT) = 1980, false) AS avoided")
    parts = scores.contributions(*(F.col(c) for c in ("semantic", "keyword", "popularity", "clarity")))
    return songs.select("song_id", *(F.round(c, 6).alias(n) for n, c in parts.items()), F.round(scores.repetition_penalty(0.25, F.col("recent"), F.col("avoided")), 6).alias("penalty"))


@query("v12_confidence", f"{HEAD}, two AS (SELECT query_id, count(*) AS n_matches, max(CASE WHEN rank = 1 THEN similarity END) AS a, max(CASE WHEN rank = 2 THEN similarity END) AS b FROM ranked WHERE rank <= 10 GROUP BY 1) SELECT query_id, n_matches, round(a - b, 6) AS gap, round(greatest(0.1, least(0.99, 1 / (1 + exp(-5 * (a - b))))), 6) AS confidence FROM two")
def confidence(spark, sf_dir):
    near = retrieval.knn(retrieval.eligible(S.vector_songs(spark, sf_dir)), S.query_vectors(spark, sf_dir), 10).withColumn("score", 1 - F.col("distance"))
    return retrieval.confidence_by_query(near).select("query_id", "n_matches", F.round("gap", 6).alias("gap"), F.round("confidence", 6).alias("confidence"))


@query("v18_strength", f"{HEAD} SELECT query_id, song_id, CASE WHEN similarity >= 0.5 THEN 'Strong match' WHEN similarity >= 0.3 THEN 'Good match' WHEN similarity >= 0.15 THEN 'Loose match' END AS strength FROM ranked WHERE rank <= 100")
def strength(spark, sf_dir):
    near = retrieval.knn(retrieval.eligible(S.vector_songs(spark, sf_dir)), S.query_vectors(spark, sf_dir), 100)
    return near.select("query_id", "song_id", scores.strength(1 - F.col("distance")).alias("strength"))


@query(
    "w07_alternates",
    f"""{HEAD}, m AS (SELECT query_id, rank, song_id, lower(artist) AS artist, CAST(floor(year / 10) * 10 AS INT) AS decade FROM ranked JOIN vsongs USING (song_id) WHERE rank <= 30),
    p AS (SELECT query_id, artist AS pa, decade AS pd, query_id % 100 = 50 AS spans FROM m WHERE rank = 1),
    a1 AS (SELECT m.*, spans, pa, pd FROM m JOIN p USING (query_id) WHERE rank > 1 AND (spans OR artist <> pa) AND (spans OR decade IS NULL OR pd IS NULL OR decade <> pd) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1),
    a2 AS (SELECT m.* FROM m JOIN a1 USING (query_id) WHERE m.rank > a1.rank AND (spans OR m.artist <> pa) AND (spans OR m.decade IS NULL OR pd IS NULL OR m.decade <> pd) AND m.artist <> a1.artist AND (spans OR m.decade IS NULL OR a1.decade IS NULL OR m.decade <> a1.decade) QUALIFY row_number() OVER (PARTITION BY m.query_id ORDER BY m.rank) = 1)
    SELECT query_id, 0 AS index, song_id, 0.8::DOUBLE AS score FROM a1 UNION ALL SELECT query_id, 1, song_id, 0.7::DOUBLE FROM a2""",
)
def alternates(spark, sf_dir):
    songs = S.vector_songs(spark, sf_dir)
    near = retrieval.knn(retrieval.eligible(songs), S.query_vectors(spark, sf_dir), 30).join(songs.select("song_id", "artist", "year"), "song_id")
    return retrieval.alternates(near, F.col("query_id") % 100 == 50).withColumn("score", F.round("score", 6))


@query(
    "f14_without_recent",
    f"WITH {S.MESSAGES}, {S.SONGS}, recent AS (SELECT user_id, song_id FROM messages WHERE song_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, message_id DESC) <= 10), "
    "matches AS (SELECT DISTINCT user_id, song_id FROM messages WHERE song_id IS NOT NULL), seen AS (SELECT DISTINCT user_id, song_id, true AS seen FROM recent), "
    "j AS (SELECT m.user_id, m.song_id, seen, count(*) FILTER (WHERE seen IS NULL) OVER (PARTITION BY m.user_id) AS rest FROM matches m LEFT JOIN seen USING (user_id, song_id)) SELECT user_id, song_id FROM j WHERE seen IS NULL OR rest < 17",
)
def without_recent(spark, sf_dir):
    from quern.operators.chat import latest

    messages = S.messages(spark, sf_dir).where("song_id IS NOT NULL")
    return retrieval.without_recent(messages.select("user_id", "song_id").distinct(), latest(messages, ["user_id"], 10), 17)


@query("t08_nearest_by_metric", "WITH " + Q + ", d AS (SELECT query_id, vec_id, list_distance(CAST(embedding AS DOUBLE[]), qv) AS e, -list_dot_product(CAST(embedding AS DOUBLE[]), qv) AS p FROM embeddings, queries) SELECT 'euclidean' AS metric, query_id, vec_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY e, vec_id) AS r FROM d) WHERE r <= 5 UNION ALL SELECT 'dot', query_id, vec_id, CAST(r AS INT) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, vec_id) AS r FROM d) WHERE r <= 5")
def nearest_by_metric(spark, sf_dir):
    e, q = S.table(spark, sf_dir, "embeddings"), S.query_vectors(spark, sf_dir)
    legs = [retrieval.knn(e, q, 5, metric, id_col="vec_id").select(F.lit(metric).alias("metric"), "query_id", "vec_id", "rank") for metric in ("euclidean", "dot")]
    return legs[0].unionByName(legs[1])


@query("v07_similarity_matrix", "SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0")
def similarity_matrix(spark, sf_dir):
    v = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.similarity_matrix(v, v.where("id % 50 = 0")).withColumn("similarity", F.round("similarity", 6))


@query("v10_dimension_guard", "SELECT vec_id, CAST(len(embedding) AS INT) AS dims FROM embeddings")
def dimension_guard(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").select("vec_id", F.size(vectors.checked("embedding", 64)).alias("dims"))


@query("j02_batch_knn_blocks", f"{HEAD} SELECT query_id, song_id, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 7")
def batch_knn_blocks(spark, sf_dir):
    return retrieval.knn_blocks(retrieval.eligible(S.vector_songs(spark, sf_dir)), S.query_vectors(spark, sf_dir), 7).withColumn("distance", F.round("distance", 6))


def _indexed(spark, sf_dir):
    rows = S.table(spark, sf_dir, "embeddings")
    return rows, InvertedLists.build(rows, scratch(spark, "inverted-lists"), "vec_id")


@query("t01_j02_inverted_lists")
def inverted_lists(spark, sf_dir):
    """The ten nearest of all vectors for every query by the stored approximate index."""
    near = _indexed(spark, sf_dir)[1].search(S.query_vectors(spark, sf_dir), 10, id_col="vec_id")
    return near.withColumn("distance", F.round("distance", 6))


@query("t01_j02_all_lists", f"WITH {Q} SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INT) AS rank, round(d, 6) AS distance FROM (SELECT query_id, vec_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS d FROM embeddings, queries) QUALIFY rank <= 10")
def all_lists(spark, sf_dir):
    """The same index with every list probed is exact."""
    _, index = _indexed(spark, sf_dir)
    near = index.search(S.query_vectors(spark, sf_dir), 10, probes=len(index.centroids), id_col="vec_id")
    return near.withColumn("distance", F.round("distance", 6))


@query("t01_j02_recall")
def inverted_lists_recall(spark, sf_dir):
    """What share of the ten exact neighbours of all queries the approximate index finds."""
    rows, index = _indexed(spark, sf_dir)
    queries = S.query_vectors(spark, sf_dir)
    return recall(retrieval.knn_blocks(rows, queries, 10, id_col="vec_id"), index.search(queries, 10, id_col="vec_id"), "vec_id")
