"""Changes against a dictionary; files of untouched buckets; two writers."""

import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.operators.backfill import backfilled
from quern.sources.keyed_table import Conflict, KeyedTable

SCHEMA = "id long, name string, n int"


def made(spark, tmp_path, rows, buckets=8):
    t = KeyedTable(spark, str(tmp_path / "table"))
    assert t.create(spark.createDataFrame(rows, SCHEMA), ["id"], buckets) == 1
    return t


def state(table, version=None):
    rows = [tuple(r) for r in table.read(version).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def files(tmp_path):
    return {f: hashlib.md5(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{tmp_path}/table/data/*/*/*.parquet")}


def test_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    want = {i: (f"a{i}", i) for i in range(40)}
    t = made(spark, tmp_path, [(k, *v) for k, v in want.items()])
    for step in range(6):
        rows = [(rng.randrange(60), rng.choice(["x", "y", None]), step * 100 + i) for i in range(12)] + [(None, "no key", 1)]
        df = spark.createDataFrame(rows, SCHEMA)
        kind = ("insert_ignore", "upsert", "update")[step % 3]
        getattr(t, kind)(df, order="n")
        for k, name, n in sorted((r for r in rows if r[0] is not None), key=lambda r: r[2]):
            if kind == "upsert" or (k in want) == (kind == "update"):
                want[k] = (name, n)
        assert state(t) == want
    t.delete(spark.createDataFrame([(1,), (2,), (999,), (None,)], "id long"))
    want.pop(1, None), want.pop(2, None)
    assert state(t) == want and state(t, 1) == {i: (f"a{i}", i) for i in range(40)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = made(spark, tmp_path, [(i, "a", i) for i in range(100)])
    before, first = files(tmp_path), t.manifest()
    assert t.upsert(spark.createDataFrame([(5, "b", 5)], SCHEMA)) == 2
    second, after = t.manifest(), files(tmp_path)
    moved = [b for b in first["folders"] if first["folders"][b] != second["folders"][b]]
    assert len(moved) == 1 and all(after[f] == h for f, h in before.items()) and len(after) == len(before) + 1
    assert t.upsert(spark.createDataFrame([(5, "b", 5)], SCHEMA)) == 2  # nothing changes
    assert t.insert_ignore(spark.createDataFrame([(5, "c", 9)], SCHEMA)) == 2
    assert t.update(spark.createDataFrame([(500, "c", 9)], SCHEMA)) == 2
    assert t.delete(spark.createDataFrame([(500,)], "id long")) == 2
    assert files(tmp_path) == after
    t.update(spark.createDataFrame([(5, 77, "x")], "id int, n int, other string"))  # some columns, one that the table lacks
    assert state(t)[5] == ("b", 77)
    t.upsert(spark.createDataFrame([(500, 1)], "id long, n int"))
    assert state(t)[500] == (None, 1)


def test_second_writer_gets_a_conflict(spark, tmp_path):
    t = made(spark, tmp_path, [(i, "a", i) for i in range(20)])
    t.upsert(spark.createDataFrame([(1, "first", 1)], SCHEMA), since=1)
    before, want = files(tmp_path), state(t)
    with pytest.raises(Conflict):
        t.upsert(spark.createDataFrame([(2, "second", 2)], SCHEMA), since=1)
    assert t.version() == 2 and state(t) == want and files(tmp_path) == before
    with pytest.raises(Conflict):
        t.create(spark.createDataFrame([], SCHEMA), ["id"], 4)
    t.upsert(spark.createDataFrame([(2, "second", 2)], SCHEMA))
    assert state(t)[1][0] == "first" and state(t)[2][0] == "second"


def test_empty_tables_and_changes(spark, tmp_path):
    t = made(spark, tmp_path, [])
    assert state(t) == {} and t.delete(spark.createDataFrame([(1,)], "id long")) == 1
    assert t.upsert(spark.createDataFrame([], SCHEMA)) == 1
    t.insert_ignore(spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", None)], SCHEMA), order="n")
    assert state(t) == {1: ("c", None)}  # nulls come first
    t.delete(spark.createDataFrame([(1,)], "id long"))
    assert state(t) == {} and t.version() == 3


def test_backfill_stops_anywhere_and_fills_no_row_twice(spark, tmp_path):
    asked = str(tmp_path / "asked")
    t = made(spark, tmp_path, [(i, None if i % 4 else "had", i) for i in range(60)])

    @F.udf("string")
    def name(i, broken):
        if broken and i > 30:
            raise ValueError("service broke")
        with open(asked, "a") as f:
            f.write(f"{i}\n")
        return None if i == 7 else f"made {i}"

    def fill(broken):
        return lambda rows: rows.select("id", name("id", F.lit(broken)).alias("name"))

    lacking = F.col("name").isNull()
    assert backfilled(t, lacking, fill(False), 2, most=1) == 1
    first = {int(i) for i in open(asked)}
    with pytest.raises(Exception):
        backfilled(t, lacking, fill(True), 2)
    assert t.version() == 2
    open(asked, "w").close()
    assert backfilled(t, lacking, fill(False), 2) == 3 + (7 in first)  # row 7 got nothing
    again = [int(i) for i in open(asked)]
    assert len(again) == len(set(again)) and set(again) == {i for i in range(60) if i % 4} - (first - {7})
    want = {i: ("had" if i % 4 == 0 else None if i == 7 else f"made {i}", i) for i in range(60)}
    assert state(t) == want
    open(asked, "w").close()
    assert backfilled(t, lacking, fill(False), 2) == 1 and open(asked).read() == "7\n"  # the one that got nothing
    assert state(t) == want
