"""Streams over paged services: stopped in the middle of a batch and started again, nothing is lost or doubled."""

import json
import os
import time

import pytest

from quern.sources import paged_stream as P

ROWS = {"rock": 25, "pop": 0, "folk": 10, "jazz": 7, "soul": 40}


def service(log, broken):
    """Numbered rows by subject; fails once the file ``broken`` names a subject and an offset."""

    def fetch(subject, offset, limit):
        with open(log, "a") as f:
            f.write(f"{subject} {offset} {limit} {time.time()}\n")
        if os.path.exists(broken) and open(broken).read() == f"{subject} {offset}":
            raise ValueError("service broke")
        return json.dumps({"results": [{"id": f"{subject}-{i}"} for i in range(offset, min(offset + limit, ROWS[subject]))]})

    return fetch


def start(spark, source, out, check, **options):
    rows = spark.readStream.format(source).options(**options).load()
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()


def drained(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def ids(spark, out):
    return sorted(json.loads(r.row)["id"] for r in spark.read.parquet(out).select("row").collect())


def test_plan_resumes_inside_a_range(spark, tmp_path):
    log, broken, out, check = (str(tmp_path / n) for n in ("log", "broken", "out", "check"))
    spark.dataSource.register(P.planned_pages("planned_test", service(log, broken), list(ROWS)))
    options = {"state": str(tmp_path / "state"), "pageSize": 5, "perSubject": 32, "pagesPerBatch": 4, "tasks": 2, "intervalMs": 1, "waitMs": 1}
    open(broken, "w").write("folk 5")
    with pytest.raises(Exception):
        drained(start(spark, "planned_test", out, check, **options))
    had = ids(spark, out)
    assert had == sorted(f"rock-{i}" for i in range(25))  # the batch that broke left nothing
    os.remove(broken)
    drained(start(spark, "planned_test", out, check, **options))
    want = sorted(f"{s}-{i}" for s, n in ROWS.items() for i in range(min(n, 32)))
    assert ids(spark, out) == want
    before = len(open(log).readlines())
    drained(start(spark, "planned_test", out, check, **options))  # a whole plan is done
    assert ids(spark, out) == want and len(open(log).readlines()) == before
    asked = [tuple(line.split()[:3]) for line in open(log)]
    assert ("soul", "30", "2") in asked and ("soul", "35", "5") not in asked  # 32 rows of a subject
    assert sum(a[0] == "pop" for a in asked) == 1 and sum(a[0] == "jazz" for a in asked) == 2  # ends are kept
    assert sum(a[0] == "rock" for a in asked) <= 6


def test_requests_keep_their_distance(tmp_path):
    log = str(tmp_path / "log")
    reader = P.PlanReader(service(log, str(tmp_path / "none")), ["rock"], {"state": str(tmp_path / "s"), "pageSize": 5, "intervalMs": 60})
    assert reader.latestOffset() == {"page": 50}
    (part,) = reader.partitions({"page": 0}, {"page": 4})
    assert len(list(reader.read(part))) == 20
    times = [float(line.split()[3]) for line in open(log)]
    assert all(b - a > 0.05 for a, b in zip(times, times[1:]))


def test_failures_are_retried_then_raised():
    calls = []

    def fetch(n):
        calls.append(n)
        if len(calls) < 3:
            raise OSError("busy")
        return "{}"

    assert P.Pace(0, 3, 0.001).ask(fetch, 4) == {} and calls == [4, 4, 4]
    with pytest.raises(OSError):
        P.Pace(0, 1, 0.001).ask(lambda n: (_ for _ in ()).throw(OSError()), 1)


def test_feed_reads_whole_ranges(spark, tmp_path):
    """The run dies on its second page: the older pages, which a cursor kept after the first page would skip, come with the next run."""
    store, broken, out, check = (str(tmp_path / n) for n in ("store", "broken", "out", "check"))

    def write(n):
        json.dump([{"id": i, "airdate": f"2024-01-{i + 1:02d}"} for i in range(n)], open(store, "w"))

    def fetch(page):
        if page == 2 and os.path.exists(broken):
            raise ValueError("service broke")
        rows = json.load(open(store))[::-1]
        return json.dumps({"results": rows[page * 4 : page * 4 + 4], "next": "more" if len(rows) > page * 4 + 4 else None})

    spark.dataSource.register(P.newest_first_feed("feed_test", fetch))
    options = {"state": str(tmp_path / "state"), "timeField": "airdate", "keyField": "id", "after": "2024-01-02", "intervalMs": 1, "waitMs": 1}
    write(14)
    open(broken, "w").close()
    with pytest.raises(Exception):
        drained(start(spark, "feed_test", out, check, **options))
    write(17)  # pages shift meanwhile
    os.remove(broken)
    drained(start(spark, "feed_test", out, check, **options))
    assert ids(spark, out) == list(range(2, 17))
    write(19)
    drained(start(spark, "feed_test", out, check, **options))
    assert ids(spark, out) == list(range(2, 19))
    write(10)  # rows were withdrawn: the cursor stays
    drained(start(spark, "feed_test", out, check, **options))
    assert ids(spark, out) == list(range(2, 19))


def test_feed_rows_that_move_come_once(tmp_path):
    pages = iter([[9, 8, 7], [7, 6, 5], [4, None, 3]])
    reader = P.FeedReader(lambda n: json.dumps({"results": [{"id": i, "at": i and str(i)} for i in next(pages)], "next": "more"}), {"state": str(tmp_path), "timeField": "at", "keyField": "id", "intervalMs": 0})
    (part,) = reader.partitions({"after": "3"}, {"after": "8"})
    assert [json.loads(row)["id"] for _, row in reader.read(part)] == [8, 7, 6, 5, 4]
    assert reader.partitions({"after": "8"}, {"after": "8"}) == []


def test_empty_service_and_no_subjects(tmp_path):
    feed = P.FeedReader(lambda n: "{}", {"state": str(tmp_path / "a"), "timeField": "at", "keyField": "id", "intervalMs": 0})
    assert feed.latestOffset() == feed.initialOffset() == {"after": ""}
    plan = P.PlanReader(None, [], {"state": str(tmp_path / "b")})
    assert plan.latestOffset() == {"page": 0} and plan.partitions({"page": 0}, {"page": 0}) == []
