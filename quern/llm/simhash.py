"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint is the bitwise majority of the XXH64 values (seed 42) of a text's
4-word shingles. Fingerprints link at 4 or fewer differing bits. 64 bits are cut
into 3 segments: of 4 differing bits at most one lies in some segment. So each
segment is indexed by its one-wildcard variants (64 keys a fingerprint in all),
and fingerprints that share a key are compared.

Work is on distinct fingerprints, so copies cost nothing. A bucket of a key with
few fingerprints (mostly chance) is compared pair by pair where it lies. In a
large bucket (many near copies), all pairs are not emitted: each fingerprint is
compared with its neighbour in sorted order, and components are formed of the
links so far; then only fingerprints of different components are compared, those
of a bucket's largest component on one side only. A pair is reported under one
key at most. No link between components is lost, as every pair within reach that
is skipped is already connected.

Defined results: null is the empty text; a text without words has fingerprint
zero. Rows with a null doc_id get the component of their fingerprint (null if
no row in it has an id). Repeated rows get equal results; an empty table gives
none. Columns other than doc_id and text are never read. As a filter
(``representatives``), exactly one row of each component stays: one with the
component's id, or any if none has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_on_disk, short_batches, small_side, stored, without
from .components import components

SHINGLE = 4
MAX_BITS = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Buckets of at most so many fingerprints are compared pair by pair where they lie; larger ones by components.
SMALL_BUCKET = 32
#: Buckets with more fingerprints beside their largest component are cut by further bits before these are compared.
FEW = 256
#: Above so many distinct fingerprints (16 a bucket by chance) keys also hold a part of the other bits.
MANY = 1 << 24
#: Most dropped ids that are sent to every executor; beyond it the join shuffles.
BROADCAST_DROPPED = 500_000
#: Shingle hashes that are counted at once, however long the text is.
BLOCK = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of UTF-8 text, as a signed 64-bit integer."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(1, len(words) - shingle + 1)
    k = min(shingle, len(words))
    bits = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        h = np.array([h64(joined[s : e - 1], 42) for s, e in zip(starts[at:to], ends[at + k - 1 : to + k - 1])], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.int64)[0])


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp: one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([fingerprint(t.as_py() or b"", shingle) for t in texts], pa.int64())], ["doc_id", "text_key", "fp"])

    short_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, text_key long, fp long")


def _parts(width: int, parts: int) -> list[tuple[int, int]]:
    """First bit and width of the parts into which the bits beside a segment are cut; one empty part if they are not."""
    rest, cuts = 64 - width, []
    for j in range(parts):
        first = rest * j // parts
        cuts.append((first, rest * (j + 1) // parts - first))
    return cuts if parts > 1 else [(0, 0)]


def _beside(fp: str, at: int, width: int) -> str:
    """SQL for the bits beside a segment, moved to the low end."""
    to = (at + width) % 64
    return f"(shiftrightunsigned({fp}, {to}) | shiftleft({fp}, {64 - to}))" if to else fp


def _variants(fps: DataFrame, segments=SEGMENTS, parts: int = 1) -> DataFrame:
    """fp and key, a row for each of its keys.

    From the top: the wildcard's place, the number of the part, the segment's
    bits but the wildcard, the part's bits (9 at most).
    """
    keys = []
    for at, width in segments:
        for j, (first, size) in enumerate(_parts(width, parts)):
            part = f"(shiftrightunsigned({_beside('fp', at, width)}, {first}) & {(1 << size) - 1}L)"
            for i in range(width):
                kept = ((1 << width) - 1) & ~(1 << i)
                keys.append(F.expr(f"(shiftrightunsigned(fp, {at}) & {kept}L) << 9 | {part} | {((at + i) * 8 + j) << 32}L"))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _first_key(diff: str, segments=SEGMENTS, parts: int = 1) -> str:
    """SQL for the wildcard and part under which a pair that differs in ``diff`` is reported."""
    whens = []
    for at, width in segments:
        own = f"(shiftrightunsigned({diff}, {at}) & {(1 << width) - 1}L)"
        equal = " ".join(f"WHEN (shiftrightunsigned({_beside(diff, at, width)}, {first}) & {(1 << size) - 1}L) = 0 THEN {j}" for j, (first, size) in enumerate(_parts(width, parts)))
        part = f"(CASE {equal} END)"
        whens.append(f"WHEN bit_count({own}) = 0 THEN {at * 8} + {part} WHEN bit_count({own}) = 1 THEN ({at} + bit_count({own} - 1)) * 8 + {part}")
    return "CASE " + " ".join(whens) + " END"


def _within(a: str, b: str, max_bits: int, segments, parts: int) -> str:
    """SQL: the pair links, and ``key`` is the one that reports it."""
    return f"bit_count({a} ^ {b}) <= {max_bits} AND ({_first_key(f'({a} ^ {b})', segments, parts)}) = shiftrightunsigned(key, 32)"


def linked(fps: DataFrame, max_bits: int = MAX_BITS, segments=SEGMENTS, parts: int | None = None) -> DataFrame:
    """node, root for distinct fingerprints (column fp) that have a link; root is the least fp of the component.

    ``parts``: how many parts of the bits beside a segment go into its keys, one
    at a time (1: none; max_bits + 1: all links still share a key, keys are 8 to
    9 bits longer and so many times more). Above MANY fingerprints the latter is
    the default, or buckets would fill by chance.
    """
    n = fps.count()
    if parts is None:
        parts = max_bits + 1 if n > MANY else 1
    bucket = Window.partitionBy("key").orderBy("fp")
    indexed = (
        _variants(fps, segments, parts)
        .withColumn("before", F.lag("fp").over(bucket))
        .withColumn("n", F.count("*").over(bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .where("n > 1")  # alone in its bucket: no candidate
    )
    indexed = kept_on_disk(indexed)
    pairs = f"flatten(transform(fps, (a, i) -> transform(filter(slice(fps, i + 2, n), b -> {_within('a', 'b', max_bits, segments, parts)}), b -> struct(a AS a, b AS b))))"
    small = indexed.where(F.col("n") <= SMALL_BUCKET).groupBy("key", "n").agg(F.collect_list("fp").alias("fps")).select(F.explode(F.expr(pairs)).alias("link")).select("link.a", "link.b")
    large = indexed.where(F.col("n") > SMALL_BUCKET)
    near = large.where(f"bit_count(fp ^ before) <= {max_bits}").select(F.col("fp").alias("a"), F.col("before").alias("b"))
    chained = stored(components(small.unionByName(near), n), "chained", n)
    joined = stored(_across(large, chained, max_bits, segments, parts, n), "joined", n)
    indexed.unpersist()
    roots = chained.select("node", F.col("root").alias("label")).unionByName(
        joined.join(chained.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), "label")
    )
    return roots.join(joined, "label", "left").select("node", F.coalesce("top", "label").alias("root"))


def _finer(segments, parts: int) -> Column:
    """Parts of the bits beside the segment of a row's key, numbered: rows of a large bucket that link share one of max_bits + 1."""
    of = []
    for at, width in segments:
        cut = (f"{j << 32}L | (shiftrightunsigned({_beside('fp', at, width)}, {first}) & {(1 << size) - 1}L)" for j, (first, size) in enumerate(_parts(width, parts)))
        of.append(f"WHEN shiftrightunsigned(key, 35) < {at + width} THEN array({', '.join(cut)})")
    return F.expr("CASE " + " ".join(of) + " END")


def _meet(rows: DataFrame, by: list[str], max_bits: int) -> DataFrame:
    """a, b: labels of fingerprints that share ``by`` and link, those of the largest component on one side only."""
    left = rows.where("label <> largest").select(*by, "fp", "label")
    right = rows.select(*(F.col(c).alias(f"{c}2") for c in by), F.col("fp").alias("fp2"), F.col("label").alias("label2"), (F.col("label") == F.col("largest")).alias("in_largest"))
    same = " AND ".join(f"{c} = {c}2" for c in by)
    reach = F.expr(f"{same} AND label <> label2 AND (in_largest OR fp < fp2) AND bit_count(fp ^ fp2) <= {max_bits}")
    return left.join(right.hint("merge"), reach).select(F.col("label").alias("a"), F.col("label2").alias("b"))


def _across(large: DataFrame, chained: DataFrame, max_bits: int, segments, parts: int, n: int) -> DataFrame:
    """label, top: what the links between different components of large buckets join."""
    named = large.select("key", "fp").join(chained.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("label"))
    named = kept_on_disk(named)
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("labels"), (F.sum("n") - F.max("n")).alias("rest"))
    open_ = kept_on_disk(named.join(split.where("labels > 1").drop("labels"), "key"))
    many = open_.where(F.col("rest") > FEW) if parts == 1 else open_.limit(0)  # with more parts, keys are fine already
    finer = many.withColumn("part", F.explode(_finer(segments, max_bits + 1)))
    few = open_.where(F.col("rest") <= FEW) if parts == 1 else open_
    across = _meet(few, ["key"], max_bits).unionByName(_meet(finer, ["key", "part"], max_bits)).distinct()
    found = components(across, n)  # stored by then
    open_.unpersist()
    named.unpersist()
    return found.select(F.col("node").alias("label"), F.col("root").alias("top"))


def _classes(rows: DataFrame, max_bits: int) -> DataFrame:
    """fp, root, component_id for each distinct fingerprint of ``rows`` (doc_id, fp)."""
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints", n := rows.count())
    # Only what has a link meets by root, and against a stored table: a large component skews neither join nor aggregate.
    tied = stored(linked(fps.select("fp"), max_bits).withColumnRenamed("node", "fp").join(fps, "fp"), "rooted", n)
    first = stored(tied.groupBy("root").agg(F.min("first_id").alias("component_id")), "first", n)
    tied = stored(tied.select("fp", "root").join(small_side(first, BROADCAST_DROPPED), "root"), "tied", n)
    both = fps.join(tied, "fp", "left")
    both = both.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    return stored(both, "classes", n)  # so that joins with it are of two plain shuffles, which adaptive execution splits


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable over links."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    return rows.join(_classes(rows, max_bits).hint("merge"), "fp").select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component, that with the component's id; all columns."""
    rows = stored(fingerprints(docs), "fingerprints")
    named = rows.join(_classes(rows, max_bits).hint("merge"), "fp").select("doc_id", "text_key", "root", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("could"))
    named = stored(named, "named", n := rows.count())
    several = named.groupBy("root").agg(F.count("*").alias("n"), F.min(F.when(F.col("could"), F.col("text_key"))).alias("stays")).where("n > 1").drop("n")
    several = small_side(stored(several, "several", n), BROADCAST_DROPPED)
    told = named.join(several, "root").select("doc_id", "text_key", (F.col("could") & (F.col("text_key") == F.col("stays"))).alias("stays"))
    told = told.groupBy("doc_id", "text_key", "stays").agg(F.count("*").alias("n")).where("NOT stays OR n > 1")
    gone = told.select(F.col("doc_id").alias("_quern_id"), F.col("text_key").alias("_quern_head"), F.col("stays").alias("twin"))
    return without(docs, gone, docs["doc_id"], _text_key(docs["text"]), BROADCAST_DROPPED)


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_simhash_variants": op8_simhash_variants}
ORACLE_SQL: dict[str, str] = {}
