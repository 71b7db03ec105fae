"""Sharding by fixed virtual slots.

Each record (doc_id and text) is hashed into one of SLOTS virtual slots, a number
that never changes. Bytes and rows are summed by slot, and a small table says
which shard each slot is in: the slot map, a Parquet folder a version. A first map
deals slots to shards by their bytes, heaviest first, each to the lightest shard.
Rebalancing (other sizes, more shards or fewer) edits the newest map: slots of
shards that go, and slots of shards above their share, move to the lightest, and
nothing else moves; the result is the next version, older ones stay readable.

Sizes of shards are near equal in bytes (law `bytes`): with thousands of slots a
slot is a small part of a shard, unless one record is. A row's place in its shard is
its rank in its slot behind the rows of the shard's earlier slots, so no task ever
sorts a shard.

Defined results: a null text has 0 bytes, so size 1, and the crc32 of nothing, 0;
rows equal in doc_id and text share a slot and get successive places; a null doc_id
is hashed as such; an empty table gives none. Columns other than doc_id and text
are not read by ``assigned``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, stored

SLOTS = 4096
SHARDS = 8
#: Share by which a shard may exceed the mean before slots leave it.
TOLERANCE = 0.002


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    crc = F.crc32(text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sums(rows: DataFrame) -> DataFrame:
    """virtual_slot, rows, bytes; map-side sums, at most a row a slot."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def dealt(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """A first map: heaviest slot first, each to the lightest shard; empty slots in turn."""
    out = {slot: slot % shards for slot in range(slots)}
    loads = [(0, shard) for shard in range(shards)]
    for size, slot in sorted(((-size, slot) for slot, size in sizes.items() if size), reverse=False):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load - size, shard))
    return out


def rebalanced(now: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """``now`` edited for other sizes or another number of shards; slots that need not move stay.

    Slots of shards that go are dealt to the lightest. Then the heaviest shard
    gives the lightest a slot that brings both nearer to their share, until it
    exceeds the mean by ``tolerance`` at most or no such slot is left.
    """
    out = dict(now)
    loads = dict.fromkeys(range(shards), 0)
    held: dict[int, list[tuple[int, int]]] = {shard: [] for shard in range(shards)}
    homeless = []
    for slot, shard in sorted(now.items()):
        if shard < shards:
            loads[shard] += sizes.get(slot, 0)
            held[shard].append((sizes.get(slot, 0), slot))
        else:
            homeless.append((sizes.get(slot, 0), slot))

    def put(size: int, slot: int, shard: int) -> None:
        out[slot] = shard
        loads[shard] += size
        held[shard].append((size, slot))

    for size, slot in sorted(homeless, reverse=True):
        put(size, slot, min(loads, key=lambda s: (loads[s], s)))
    mean = sum(loads.values()) / shards
    for _ in range(4 * len(now)):
        high, low = max(loads, key=lambda s: (loads[s], -s)), min(loads, key=lambda s: (loads[s], s))
        gap = loads[high] - loads[low]
        fits = [(size, -slot) for size, slot in held[high] if 0 < size < gap]
        if loads[high] <= mean * (1 + tolerance) or not fits:
            break
        size, slot = max((x for x in fits if 2 * x[0] <= gap), default=min(fits))  # the most that does not turn them round, else the least
        held[high].remove((size, -slot))
        loads[high] -= size
        put(size, -slot, low)
    return out


class SlotMap:
    """Versions of the map from virtual slots to shards below ``path``: a small Parquet folder each.

    A version is one folder with all slots, written as a whole; the newest is the
    greatest that was written to its end. Two writers of one version: the second fails.
    """

    SCHEMA = "virtual_slot int, shard int"

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots

    def versions(self) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        top = hadoop(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v") and fs.exists(hadoop(f"{self.path}/{n}/_SUCCESS")))

    def table(self, version: int | None = None) -> DataFrame:
        """The map of ``version``, by default the newest."""
        version = self.versions()[-1] if version is None else version
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v{version}")

    def read(self, version: int | None = None) -> dict[int, int]:
        return {r["virtual_slot"]: r["shard"] for r in self.table(version).collect()}  # ``slots`` rows

    def write(self, shards: dict[int, int]) -> int:
        """The next version."""
        version = (self.versions() or [0])[-1] + 1
        self.spark.createDataFrame(sorted(shards.items()), self.SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v{version}")
        return version

    def rebalance(self, sums: DataFrame, shards: int, tolerance: float = TOLERANCE) -> int:
        """Make the first map, or edit the newest, for the sums of ``slot_sums``; returns the version that then holds."""
        sizes = {r["virtual_slot"]: r["bytes"] for r in sums.select("virtual_slot", "bytes").collect()}  # at most ``slots`` rows
        have = self.versions()
        if not have:
            return self.write(dealt(sizes, shards, self.slots))
        now = self.read(have[-1])
        new = rebalanced(now, sizes, shards, tolerance)
        return have[-1] if new == now else self.write(new)


def placed(rows: DataFrame, sums: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` of ``slotted`` with shard and slot, the gapless place in the shard."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(F.broadcast(shards), "virtual_slot").withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))  # a row a virtual slot
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size"))
    return rows.withColumn("within", within).join(F.broadcast(starts.select("virtual_slot", "shard", "start")), "virtual_slot").withColumn("slot", F.col("start") + F.col("within") - 1).drop("start", "within")


def assigned(docs: DataFrame, slot_map: SlotMap, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version for every row of ``docs``.

    The newest map is rebalanced for these documents first. Texts are read once;
    what is shuffled are ids and numbers.
    """
    rows = stored(slotted(docs, slot_map.slots), "slotted")
    sums = stored(slot_sums(rows), "slot-sums", slot_map.slots)
    version = slot_map.rebalance(sums, shards)
    out = placed(rows, sums, slot_map.table(version))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str, version: int | None = None) -> None:
    """All columns of ``docs`` as Parquet in a folder a shard (``shard=0`` ...), by the map of ``version``.

    Rows are dealt by virtual slot, so a shard is written by many tasks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = docs.withColumn("_quern_slot", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(slot_map.slots)).cast("int"))
    where = slot_map.table(version).select(F.col("virtual_slot").alias("_quern_slot"), F.col("shard").alias("_quern_shard"))
    rows = own.drop("shard").join(F.broadcast(where), "_quern_slot").withColumnRenamed("_quern_shard", "shard")
    rows.repartition("_quern_slot").drop("_quern_slot").write.partitionBy("shard").parquet(path)


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by a new map."""
    return assigned(spark.read.parquet(f"{sf_dir}/documents.parquet"), SlotMap(spark, shared_path(spark, "slot-map")))


QUERIES = {"op12_virtual_slots": op12_virtual_slots}
ORACLE_SQL: dict[str, str] = {}
