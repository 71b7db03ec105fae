"""Ranked lexical search by WAND over shards of documents.

The documents are read once into an inverted index's raw form: for each document
its length in terms and the count of each term that some query item holds. The
corpus figures (N, L, df) are sums over that table. Each task then takes its part
of the index as a shard, inverts SHARD_DOCS documents at a time and walks the
posting lists of each item document by document: cursors stand in order of their
documents, the greatest impacts of their lists are summed in that order, and the
document where the sum reaches the least score in the item's heap is the pivot.
Cursors before the pivot jump to it; only if the first of them stands there too is
a document scored. Heaps go on from block to block of a shard; the heaps of all
shards are merged by rank.

Query items are taken in blocks of bounded size (BLOCK_ITEMS, BLOCK_TERMS), each
searched over all documents. What a task keeps is one heap an item and the
postings of SHARD_DOCS documents; what is shuffled is k rows an item and task.

Defined results: a null or empty text has no terms, is not counted in N and is
never found; an item without terms (or null) finds nothing; rows of one item_id
(null is one id) are one item with the terms of all; repeated documents are
ranked each for itself; of equal scores the smaller doc_id comes first, null last.
Empty tables give none. Columns other than doc_id, text, item_id are never read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import short_batches, stored, word_array

TOP = 10
#: Documents whose postings a task holds at once.
SHARD_DOCS = 8_000
#: Most items, and about the most terms of them, that are searched at once.
BLOCK_ITEMS, BLOCK_TERMS = 5_000, 500_000
#: First level of the merge: tasks that share a group.
MERGE_GROUPS = 64
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Bytes of terms as they are, A-Z lower-cased; all others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_doc = itemgetter(0)
#: Order of a null doc_id among equal scores.
_LAST = -(1 << 64)


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, piece by piece."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        to = folded.find(b" ", at + PIECE)
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


def query_items(benchmark: DataFrame) -> DataFrame:
    """item_id, terms (distinct), block, blocks: the items of the query set in blocks of bounded size."""
    terms = benchmark.select("item_id", F.explode(word_array(F.col("text"))).alias("term"))
    items = stored(terms.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "items")
    sizes = items.agg(F.count("*").alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    blocks = max(1, -(-sizes["items"] // BLOCK_ITEMS), -(-(sizes["terms"] or 0) // BLOCK_TERMS))
    return items.select("item_id", "terms", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)).alias("block"), F.lit(blocks).alias("blocks"))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document, with repeats), terms, counts (numbers of vocabulary terms, and how often) for documents with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in batches:
            lengths, terms, counts, ends = [], [], [], [0]
            for cell in b.column(1).cast(pa.binary()):
                found: Counter = Counter()
                n = 0
                for words in term_lists(cell.as_py() or b""):
                    n += len(words)
                    found.update(map(number, words))
                found.pop(None, None)
                for t in sorted(found):
                    terms.append(t)
                    counts.append(found[t])
                lengths.append(n)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    short_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def weight(n: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, counts: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """What each posting adds to its document's score; ``damping`` is the m of the document."""
    counts = counts.astype(np.int64)
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * damping))


def posting_lists(terms: np.ndarray, places: np.ndarray, values: np.ndarray) -> dict[int, tuple[list[int], list[int], int]]:
    """For each term: the places of its documents in order, their impacts, the greatest impact."""
    order = np.argsort(terms, kind="stable")
    terms, places, values = terms[order], places[order], values[order]
    starts = np.flatnonzero(np.diff(terms, prepend=-1))
    lists = {}
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(terms)]):
        own = values[s:e]
        if most := int(own.max()):
            lists[int(terms[s])] = places[s:e].tolist(), own.tolist(), most
    return lists


def wand(lists: list[tuple[list[int], list[int], int]], order: list[int], heap: list[tuple[int, int]], k: int) -> int:
    """Bring the best ``k`` of a block into ``heap`` of (score, -doc_id); ``order`` has -doc_id for each place. Returns the documents that were scored."""
    cursors = [[places[0], most, 0, places, values] for places, values, most in lists]
    least = heap[0][0] if len(heap) == k else 1
    scored = 0
    while cursors:
        cursors.sort(key=_doc)
        bound = 0
        for at, c in enumerate(cursors):
            bound += c[1]
            if bound >= least:
                break
        else:
            break  # all lists together cannot reach the heap
        pivot, ended = c[0], False
        if cursors[0][0] == pivot:
            score = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                i = c[2]
                score += c[4][i]
                c[2] = i = i + 1
                if i < len(c[3]):
                    c[0] = c[3][i]
                else:
                    c[0], ended = -1, True
            scored += 1
            entry = score, order[pivot]
            if len(heap) < k:
                if score:
                    heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == k:
                least = heap[0][0]
        else:
            for c in cursors[:at]:
                if c[0] < pivot:
                    places = c[3]
                    c[2] = i = bisect_left(places, pivot, c[2])
                    if i < len(places):
                        c[0] = places[i]
                    else:
                        c[0], ended = -1, True
        if ended:
            cursors = [c for c in cursors if c[0] >= 0]
    return scored


def shard_heaps(index: DataFrame, items: list[list[int]], weights: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """item (its number), score, doc_id, part: the best ``k`` of each shard for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        for block in _blocks(batches):
            ids = block.column("doc_id").to_pylist()
            damping = np.array([10 + (90 * x * n) // length for x in block.column("n").to_pylist()], np.int64)
            listed = block.column("terms").combine_chunks()
            places = np.repeat(np.arange(len(ids)), np.diff(listed.offsets.to_numpy()))
            terms, counts = (block.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "counts"))
            lists = posting_lists(terms, places, impacts(weights[terms], counts, damping[places]))
            order = [_LAST if i is None else -i for i in ids]
            for item, heap in zip(items, heaps):
                wand([lists[t] for t in item if t in lists], order, heap, k)
        rows = [(i, score, None if o == _LAST else -o) for i, heap in enumerate(heaps) for score, o in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "score", "doc_id"])

    found = index.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, score long, doc_id long")
    return found.withColumn("part", F.spark_partition_id())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of an index put together to blocks of at least SHARD_DOCS documents, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= SHARD_DOCS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """item, score, doc_id, rank: the heaps of all shards in two levels, so that no task meets a row of every shard."""
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    group = Window.partitionBy("item", F.pmod("part", F.lit(MERGE_GROUPS))).orderBy(*order)
    some = heaps.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= k).drop("rank", "part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, benchmark: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents for each item."""
    spark = docs.sparkSession
    items = stored(query_items(benchmark), "query-items")
    blocks = items.agg(F.max("blocks")).first()[0] or 0
    out = None
    for i in range(blocks):
        block = items.where(F.col("block") == i).select("item_id", "terms").collect()  # at most about BLOCK_ITEMS items, BLOCK_TERMS terms
        vocabulary = {t.encode(): j for j, t in enumerate(sorted({t for r in block for t in r["terms"]}))}
        index = stored(term_counts(docs, vocabulary), "term-counts")
        sums = index.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
        held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # at most the vocabulary
        weights = np.zeros(len(vocabulary), np.int64)
        for r in held:
            weights[r["term"]] = weight(sums["n"], r["df"])
        wanted = [[vocabulary[t.encode()] for t in r["terms"]] for r in block]
        best = merged(shard_heaps(index, wanted, weights, sums["n"], sums["length"], k), k)
        schema = f"item int, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
        names = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(block)], schema)
        found = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # BLOCK_ITEMS rows
        out = found if out is None else out.unionByName(found)
    return benchmark.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0) if out is None else out


def op13_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_wand_search": op13_wand_search}
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op13_wand_search": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
t AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s),
m AS (SELECT row, doc_id, term, tf, 10 + (90 * n * big_n) // big_l AS m FROM p, s),
r AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN m USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INT) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {TOP}
"""
}
