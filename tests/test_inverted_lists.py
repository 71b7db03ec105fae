"""The approximate index: recall against the exact search, all lists, appended rows, sizes of lists."""

import numpy as np
import pytest

from quern.operators import inverted_lists, retrieval
from quern.operators.inverted_lists import InvertedLists
from quern.plans import standins as S
from quern.sources import files

SF = "/root/testdata/sf0.1"


def clustered(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, dims))
    return [(i, (centers[i % 40] + 0.5 * rng.normal(size=dims)).tolist()) for i in range(n)]


def test_recall_over_all_queries(spark):
    """Every id divisible by 50 of the given vectors against the exact path."""
    e = S.table(spark, SF, "embeddings").withColumnRenamed("vec_id", "song_id")
    index = InvertedLists.build(e, files.scratch(spark, "t"))
    assert index.rows().count() == e.count() and index.probes < len(index.centroids)
    queries = S.query_vectors(spark, SF)
    exact = retrieval.knn_blocks(e, queries, 10)
    row = inverted_lists.recall(exact, index.search(queries, 10)).first()
    assert row.n_queries == 40 and row.n_neighbours == 400 and row.recall >= 0.9
    take = lambda df: sorted((r.query_id, r["rank"], r.song_id, round(r.distance, 9)) for r in df.collect())
    assert take(index.search(queries, 10, probes=len(index.centroids))) == take(exact)


def test_appended_rows_blocks_and_reopening(spark, monkeypatch):
    rows = clustered(3000, 16)
    schema = "song_id long, embedding array<double>"
    path = files.scratch(spark, "t")
    half = InvertedLists.build(spark.createDataFrame(rows[:1500] + [(9000, None)], schema), path, lists=30)
    half.append(spark.createDataFrame(rows[1500:] + [(9001, None), (9002, [0.0] * 16)], schema))
    index = InvertedLists(spark, path)
    assert index.rows().count() == 3001 and len(index.centroids) == 30
    queries = spark.createDataFrame([(i, v) for i, v in rows if i % 50 == 0] + [(7, None)], "query_id long, query_vector array<double>")
    found = lambda: sorted((r.query_id, r.song_id, round(r.distance, 9), r["rank"]) for r in index.search(queries, 5).collect())
    want = found()
    assert [r[1] for r in want if r[3] == 1] == [r[0] for r in want if r[3] == 1]  # each its own nearest
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 20)
    monkeypatch.setattr(inverted_lists, "NAMED_LISTS", 2)
    assert found() == want
    exact = retrieval.knn_blocks(spark.createDataFrame(rows, schema), queries.where("query_vector IS NOT NULL"), 5)
    assert inverted_lists.recall(exact, index.search(queries, 5)).first().recall >= 0.9


def test_one_hot_list(spark, monkeypatch):
    """A third of the vectors are one vector: its list lies in several files, and ties go by id."""
    monkeypatch.setattr(inverted_lists, "ROWS_PER_FILE", 200)
    rows = clustered(2000, 8, 1) + [(i, [1.0] * 8) for i in range(2000, 3000)]
    df = spark.createDataFrame(rows, "song_id long, embedding array<double>")
    index = InvertedLists.build(df, files.scratch(spark, "t"))
    counts = index.rows().groupBy("list_id").count().collect()
    assert max(r["count"] for r in counts) >= 1000
    assert max(r["count"] for r in index.rows().groupBy("_metadata.file_name").count().collect()) < 600
    near = index.search(spark.createDataFrame([(1, [2.0] * 8)], "query_id long, query_vector array<double>"), 4).collect()
    assert [(r.song_id, r["rank"]) for r in sorted(near, key=lambda r: r["rank"])] == [(2000, 1), (2001, 2), (2002, 3), (2003, 4)]


def test_empty_table_and_wrong_length(spark):
    empty = spark.createDataFrame([], "song_id long, embedding array<double>")
    index = InvertedLists.build(empty, files.scratch(spark, "t"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert index.search(queries, 3).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "song_id long, embedding array<double>")
    index = InvertedLists.build(rows, files.scratch(spark, "t"))
    assert [r.song_id for r in index.search(queries, 1).collect()] == [1]
    with pytest.raises(Exception):
        index.append(spark.createDataFrame([(3, [1.0, 0.0, 0.0])], "song_id long, embedding array<double>"))


def test_hot_list_is_searched_in_tiles(monkeypatch):
    """Many queries that ask one long list: no product of all of them at once."""
    seen, within = [], retrieval._within
    monkeypatch.setattr(retrieval, "_within", lambda s, *rest: seen.append(s.size) or within(s, *rest))
    m = np.asarray([v for _, v in clustered(20_000, 8)])
    best = retrieval.Best(m[:1000], 5)
    best.add(np.arange(20_000), m, np.arange(0, 1000, 2))
    assert max(seen) <= retrieval.TILE and sum(seen) == 500 * 20_000
    assert (best.ids[::2, 0] == np.arange(0, 1000, 2)).all() and np.isinf(best.d[1::2]).all()


def test_copies_tie_in_all_lists(spark):
    """Copies of a vector, apart from each other in a list, tie to the last bit, so ids decide."""
    base = clustered(300, 64, 5)
    rows = [(i + 300 * n, v) for n in range(7) for i, v in base]
    index = InvertedLists.build(spark.createDataFrame(rows, "song_id long, embedding array<double>"), files.scratch(spark, "t"), lists=3)
    near = index.search(spark.createDataFrame(base, "query_id long, query_vector array<double>"), 7, probes=3).collect()
    assert sorted((r.query_id, r["rank"], r.song_id) for r in near) == [(i, n + 1, i + 300 * n) for i in range(300) for n in range(7)]
