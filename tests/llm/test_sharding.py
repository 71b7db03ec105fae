"""Shards by virtual slots: sizes, places, versions, moves."""

import random
import zlib

import pytest

from quern.llm import sharding
from quern.llm.common import shared_path

from .conftest import ODD, SF


def checked(rows, docs, shards=8):
    """Each document once with its own figures, places gapless in each shard; returns bytes by shard."""
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    by, total = {}, dict.fromkeys(range(shards), 0)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    return total


def test_query(spark, documents):
    total = checked(sharding.op12_virtual_slots(spark, SF).collect(), documents)
    mean = sum(total.values()) / 8
    most = max(len((t or "").encode()) + 1 for _, t in documents)
    assert max(total.values()) <= mean + most and min(total.values()) >= mean - most


def test_shards_are_near_equal_and_grow(spark, tmp_path):
    """Texts of 1 to 400 bytes, a third of them copies of one; then more rows, more shards, fewer shards."""
    rng = random.Random(2)
    rows = [(i, "copy" if i % 3 == 0 else "x" * rng.randrange(400)) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slot_map = sharding.SlotMap(spark, str(tmp_path / "map"), 2048)
    total = checked(sharding.assigned(docs, slot_map).collect(), rows)
    assert max(total.values()) - min(total.values()) <= 0.01 * sum(total.values()) / 8
    assert slot_map.versions() == [1]
    again = checked(sharding.assigned(docs, slot_map).collect(), rows)
    assert slot_map.versions() == [1] and again == total

    before = {r.doc_id: r.shard for r in sharding.assigned(docs, slot_map).collect()}
    grown = sharding.assigned(docs, slot_map, 9).collect()
    total = checked(grown, rows, 9)
    assert slot_map.versions() == [1, 2] and max(total.values()) <= 1.003 * sum(total.values()) / 9
    moved = [r for r in grown if before[r.doc_id] != r.shard]
    assert all(r.shard == 8 for r in moved) and sum(r.size for r in moved) == total[8]

    before = {r.doc_id: r.shard for r in grown}
    fewer = sharding.assigned(docs, slot_map, 7).collect()
    total = checked(fewer, rows, 7)
    assert slot_map.versions() == [1, 2, 3] and max(total.values()) <= 1.003 * sum(total.values()) / 7
    assert {r.shard for r in fewer if before[r.doc_id] < 7 and before[r.doc_id] != r.shard} <= set(range(7))
    assert slot_map.read(1) != slot_map.read(3) and set(slot_map.read(2).values()) == set(range(9))


def test_odd_rows(spark, odd, empty):
    checked(sharding.assigned(odd.withColumn("shard", odd["key"]), sharding.SlotMap(spark, shared_path(spark, "map"))).collect(), ODD)
    assert sharding.assigned(empty, sharding.SlotMap(spark, shared_path(spark, "map"))).count() == 0


def test_written_shards(spark, odd):
    slot_map = sharding.SlotMap(spark, shared_path(spark, "map"))
    want = {(r.doc_id, r.size, r.shard) for r in sharding.assigned(odd, slot_map).collect()}
    path = shared_path(spark, "shards")
    sharding.write_shards(odd, slot_map, path)
    back = spark.read.parquet(path)
    assert back.count() == len(ODD) and set(odd.columns) | {"shard"} == set(back.columns)
    assert {(r.doc_id, len((r.text or "").encode()) + 1, r.shard) for r in back.collect()} == want


def test_two_writers_of_a_version(spark, tmp_path):
    a, b = (sharding.SlotMap(spark, str(tmp_path / "map"), 4) for _ in range(2))
    a.versions()
    b.versions = lambda: []  # saw the folder before a wrote
    a.write({0: 0, 1: 1, 2: 0, 3: 1})
    with pytest.raises(Exception, match="exists"):
        b.write({0: 1, 1: 1, 2: 0, 3: 1})
    assert a.read() == {0: 0, 1: 1, 2: 0, 3: 1}
