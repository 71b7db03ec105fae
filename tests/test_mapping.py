"""Requests for songs: order of the checks, what history removes, the fallback, what is stored."""

import json

import pytest

from quern.operators import mapping

REQUEST = "request_id long, user_id long, ip string, seconds double, text string, allow_explicit boolean"
SONG = "song_id long, title string, artist string, year int, popularity int, tags array<string>, is_placeholder boolean, embedding array<double>"
SHOWN = "message_id long, user_id long, song_id long, created_at long"


def songs(spark, n=12):
    """Song i lies at angle i of the query (1, 0); odd ones are explicit."""
    rows = [(i, f"t{i}", f"a{i % 5}", 1950 + 10 * i, 100 - i, ["Explicit" if i % 2 else "pop"], False, [1.0, 0.1 * i]) for i in range(n)]
    return spark.createDataFrame(rows, SONG)


def run(spark, requests, table=None, shown=(), capacity=10.0, rate=0.5, vectors=None):
    judged = mapping.judged(spark.createDataFrame(requests, REQUEST), ["bad word"], capacity, rate)
    given = [(r[0], [1.0, 0.0]) for r in requests] if vectors is None else vectors
    given = spark.createDataFrame(given, "request_id long, query_vector array<double>")
    answers = mapping.answered(judged, given, songs(spark) if table is None else table, spark.createDataFrame(list(shown), SHOWN))
    return {r["request_id"]: r for r in answers.collect()}, answers


def test_checks_in_order_and_limits(spark):
    rows = [
        (1, 7, "x", 0.0, "  Hello, you! ", True), (2, 7, "x", 0.1, None, True), (3, 7, "x", 0.2, "fine", True), (4, 7, "y", 0.2, "A BAD WORD here", True),
        (5, None, None, 0.0, "x" * 501, True), (6, None, None, 0.0, " " + "y" * 500 + "\n", True), (7, 7, "x", 2.3, "again", True), (8, 9, "x", 0.0, "badword", True),
    ]
    got, answers = run(spark, rows, capacity=2.0)
    assert {i: (r["outcome"], r["status"]) for i, r in got.items()} == {
        1: ("ok", 200), 2: ("validation_error", 400), 3: ("rate_limited", 429), 4: ("content_filtered", 400), 5: ("validation_error", 400), 6: ("ok", 200), 7: ("ok", 200), 8: ("ok", 200),
    }
    assert (got[1]["text"], got[1]["cleaned"], got[3]["retry_after"], got[1]["retry_after"]) == ("Hello, you!", "hello you", 2, None)
    for i in (2, 3, 4, 5):
        assert got[i]["primary"] is None and not got[i]["alternates"] and got[i]["confidence"] is None and got[i]["strategy"] is None
    left = {r["text"]: r for r in mapping.stored_messages(answers, "lobby").collect()}
    assert set(left) == {"Hello, you!", "again", "badword"}  # no message of an unknown user
    scores = json.loads(left["again"]["scores"])
    assert scores["primary"] == {"title": "t0", "artist": "a0", "year": 1950} and scores["source"] == "api_map" and left["again"]["song_id"] is None


def test_history_explicit_and_alternates(spark):
    shown = [(i, 1, i, i) for i in range(4)] + [(50 + i, 2, i, i) for i in range(9)] + [(80, 3, 5, 1)] + [(81 + i, 3, None, 2 + i) for i in range(10)]
    got, _ = run(spark, [(1, 1, "x", 0.0, "a", True), (2, 2, "x", 0.0, "a", True), (3, 3, "x", 0.0, "a", False), (4, 4, "x", 0.0, "a", True)], shown=shown)
    assert got[1]["primary"]["song_id"] == 4 and got[1]["n_matches"] == 8
    assert got[2]["primary"]["song_id"] == 0 and got[2]["n_matches"] == 12  # three new ones would be too few
    assert [c["song_id"] for c in got[1]["alternates"]] == [5, 6]
    assert got[3]["primary"]["song_id"] == 0 and got[3]["n_matches"] == 6  # song 5 was shown eleven messages ago
    assert [(c["song_id"], c["score"]) for c in got[3]["alternates"]] == [(2, 0.8), (4, pytest.approx(0.7))]
    assert got[4]["n_matches"] == 12 and got[4]["strategy"] == "embedding"


def test_confident_answers_have_no_alternates(spark):
    table = spark.createDataFrame([(1, "near", "a", 1960, 1, [], False, [1.0, 0.0]), (2, "far", "b", 1980, 2, [], False, [0.01, 1.0])], SONG)
    got, _ = run(spark, [(1, 1, "x", 0.0, "a", True)], table)
    assert got[1]["confidence"] == pytest.approx(0.99) and got[1]["alternates"] == []


def test_popular_songs_when_nothing_matches(spark):
    got, _ = run(spark, [(1, 1, "x", 0.0, "so happy", False), (2, 1, "x", 0.0, "b", True)], vectors=[(2, [-1.0, 0.0])])
    for r in got.values():
        assert (r["outcome"], r["primary"]["song_id"], r["primary"]["score"], r["strategy"], r["mood"], r["n_matches"]) == ("ok", 0, 0.3, "popular", "neutral", 3)


def test_no_songs_no_requests_and_null_columns(spark):
    nothing = songs(spark).limit(0)
    got, answers = run(spark, [(1, 1, "x", 0.0, "a", True)], nothing)
    assert (got[1]["outcome"], got[1]["status"], got[1]["primary"], got[1]["n_matches"]) == ("no_songs", 500, None, None)
    assert mapping.stored_messages(answers, "lobby").count() == 0
    assert run(spark, [])[0] == {}
    table = spark.createDataFrame([(1, None, None, None, None, None, False, [1.0, 0.0]), (2, "t", "a", 1950, 1, None, False, [1.0, 0.1])], SONG)
    got, _ = run(spark, [(1, 1, "x", 0.0, "a", False)], table)
    assert got[1]["primary"]["song_id"] == 1 and got[1]["alternates"] == [] and got[1]["n_matches"] == 2
