"""Mixture-controlled packing into sequences of at most 4096 tokens.

Every document is tokenized once; its ids (uint16) are written to the shared
folder with a small ledger of tokens by block (input partition) and source. The
ledger gives each source its target share of the tokens and each document the
offset at which it stands among its source's tokens, and so its place in the
packed stream, in which every source goes on at its share until it is dry. The
stream is cut into parts of BUFFER tokens at most and the ids are shuffled to
them (documents across an edge are cut), so that each part holds its share of
every source however the table is stored. In a part, deficit round-robin over
the source queues fills each window to the target shares, carrying deficits from
window to window. A task holds one part.

What is left of a task at the end goes into sequences whose lengths are powers
of two, which need no padding.

Defined results: a null text has no ids but the closing one; a null source is a
source of its own; a null doc_id is carried through; repeated rows are packed
each; an empty table gives no pieces. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import short_batches, small_side, stored
from .wordbpe import word_bpe

WINDOW = 4096
END_ID = 2
#: Tokens of a part, at most.
BUFFER = 1 << 22
#: Rows of a tokenizing step, at most, and characters.
STEP_ROWS, STEP_CHARS = 512, 1 << 21
BROADCAST_LEDGER = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """block, source, doc_id, tokens, ids, and the block's tokens before the document: of all sources, of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, block = word_bpe(path), TaskContext.get().partitionId()
        end, before, own = np.array([end_id], bpe.dtype).tobytes(), 0, {}
        for b in batches:
            row = 0
            chars = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while row < len(b):
                to = int(np.searchsorted(chars, chars[row] + STEP_CHARS, "right"))
                to = min(max(to, row + 1), row + STEP_ROWS)
                part = b.slice(row, to - row)
                ids = [x + end for x in bpe.encode([t or "" for t in part.column(2).to_pylist()])]
                tokens, all_before, own_before = [len(x) // bpe.dtype.itemsize for x in ids], [], []
                for source, n in zip(part.column(1).to_pylist(), tokens):
                    all_before.append(before)
                    own_before.append(own.get(source, 0))
                    before += n
                    own[source] = own.get(source, 0) + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(ids), pa.int64()), part.column(1), part.column(0), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary()), pa.array(all_before, pa.int64()), pa.array(own_before, pa.int64())],
                    ["block", "source", "doc_id", "tokens", "ids", "all_before", "own_before"],
                )
                row = to

    short_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "block long, source string, doc_id long, tokens long, ids binary, all_before long, own_before long")


def block_sums(tokens: DataFrame) -> DataFrame:
    return stored(tokens.groupBy("block", "source").agg(F.sum("tokens").alias("tokens")), "ledger", 0)


def ledger(tokens: DataFrame, shares: dict[str, float] | None = None, sums: DataFrame | None = None) -> DataFrame:
    """block, source, share, owed, block_before, of_source: the target share, the deficit when the block starts,
    the source's tokens before the block, and in all.

    ``shares`` gives target proportions by source (others: 0, served when nothing
    else is left); by default each source's share of all tokens is its target.
    """
    sums = block_sums(tokens) if sums is None else sums
    blocks = sums.groupBy("block").agg(F.sum("tokens").alias("in_block")).withColumn("all_before", F.sum("in_block").over(Window.orderBy("block")) - F.col("in_block"))
    if shares is None:
        total = sums.agg(F.sum("tokens").alias("total"))  # one row
        share = sums.groupBy("source").agg(F.sum("tokens").alias("t")).join(F.broadcast(total)).select("source", (F.col("t") / F.col("total")).alias("share"))
    else:
        whole = float(sum(shares.values()))
        share = sums.sparkSession.createDataFrame([(s, w / whole) for s, w in shares.items()], "source string, share double")
    of_source = sums.groupBy("source").agg(F.sum("tokens").alias("of_source"))
    own = sums.withColumn("own_before", F.sum("tokens").over(Window.partitionBy("source").orderBy("block")) - F.col("tokens")).join(blocks, "block")
    owed = F.coalesce("share", F.lit(0.0)) * F.col("all_before") - F.col("own_before")
    return (
        own.alias("o")
        .join(share.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")), "left")
        .join(of_source.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
        .select("block", F.col("o.source").alias("source"), F.coalesce("share", F.lit(0.0)).alias("share"), owed.alias("owed"), F.col("own_before").alias("block_before"), "of_source")
    )


class Course:
    """Where in the packed stream a source's tokens stand.

    Time runs so that a source of share w gives its token o at time o / w; places
    count the tokens given by all. Sources without a share follow at the end, each
    in proportion to its tokens.
    """

    def __init__(self, total: int, totals: dict[str, int] | None = None, shares: dict[str, float] | None = None):
        """``totals``: tokens of the sources in ``shares``; without them each source's share is that of its tokens."""
        self.total = total
        self.rest, self.dry = (0, float(total)) if shares is None else (total, 0.0)
        times, places = [0.0], [0.0]
        if shares is None:
            times, places = [0.0, float(total)], [0.0, float(total)]
        else:
            whole = float(sum(shares.values()))
            ends = sorted((totals[s] / (w / whole), w / whole) for s, w in shares.items() if w > 0 and totals.get(s))
            rate = sum(w for _, w in ends)
            for end, w in ends:
                if end > times[-1]:
                    places.append(places[-1] + rate * (end - times[-1]))
                    times.append(end)
                rate -= w
            self.rest = total - sum(totals.get(s, 0) for s, w in shares.items() if w > 0)
            self.dry = times[-1]
            if self.rest:
                times.append(times[-1] + self.rest)
                places.append(places[-1] + self.rest)
        self.times, self.places = np.array(times), np.array(places)
        self.parts = max(1, -(-total // BUFFER))
        self.size = total / self.parts

    def cut(self, share, of_source, before, tokens) -> tuple:
        """For documents of ``tokens`` tokens at offset ``before``: row, first token, end, part and place of each piece."""
        rate = np.where(share > 0, share, of_source / max(self.rest, 1))
        begin = np.where(share > 0, 0.0, self.dry)
        place = lambda row, offset: np.interp(begin[row] + offset / rate[row], self.times, self.places)
        part_of = lambda offset: np.minimum((place(slice(None), offset) / self.size).astype(np.int64), self.parts - 1)
        first, last = part_of(before), part_of(before + tokens - 1)
        n = last - first + 1
        row = np.repeat(np.arange(len(n)), n)
        part = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        edge = np.ceil((np.interp(part * self.size, self.places, self.times) - begin[row]) * rate[row]).astype(np.int64)
        lo = np.where(part > first[row], np.clip(edge - before[row], 0, tokens[row]), 0)
        hi = tokens[row]
        same = row[1:] == row[:-1]
        hi[:-1][same] = lo[1:][same]
        some = hi > lo
        row, lo, hi, part = row[some], lo[some], hi[some], part[some]
        return row, lo, hi, part, place(row, before[row] + lo)


class Mixer:
    """Queues by source, drained window by window by deficit round-robin."""

    def __init__(self, first_id: int, window: int = WINDOW):
        self.window, self.next_id = window, first_id
        self.queues: dict = {}
        self.shares: dict = {}
        self.deficits: dict = {}
        self.waiting = 0
        self.turn = 0
        self.out: list[tuple] = []

    def add(self, source, share: float, owed: float, doc_id, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> None:
        """``ids`` are a document's, or those from ``start`` on of one of ``doc_tokens`` tokens."""
        if source not in self.queues:
            self.queues[source], self.shares[source], self.deficits[source] = deque(), share, owed
        self.queues[source].append([doc_id, ids, 0, start, len(ids) if doc_tokens is None else doc_tokens])
        self.waiting += len(ids)

    def _take(self, source, most: int, at: int) -> int:
        """Put up to ``most`` tokens of the source's queue at offset ``at`` of the open sequence."""
        queue, taken = self.queues[source], 0
        while queue and taken < most:
            doc_id, ids, start, first, doc_tokens = entry = queue[0]
            n = min(most - taken, len(ids) - start)
            crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
            self.out.append((doc_id, first + start, n, crc, doc_tokens, self.next_id, at + taken, source))
            entry[2] += n
            taken += n
            if entry[2] == len(ids):
                queue.popleft()
        self.deficits[source] -= taken
        self.waiting -= taken
        return taken

    def _fill(self, size: int) -> None:
        """One sequence of exactly ``size`` tokens; at least so many must wait."""
        active = [s for s, q in self.queues.items() if q]
        weight = sum(self.shares[s] for s in active)
        for s in active:
            self.deficits[s] += size * (self.shares[s] / weight if weight else 1 / len(active))
        self.turn += 1
        first = self.turn % len(active)
        at = 0
        for s in active[first:] + active[:first]:
            at += self._take(s, min(size - at, max(0, int(self.deficits[s]))), at)
        while at < size:  # what a dry queue left over goes to those owed most
            s = max((s for s in active if self.queues[s]), key=lambda s: self.deficits[s])
            at += self._take(s, size - at, at)
        self.next_id += 1

    def drain(self, down_to: int) -> None:
        while self.waiting >= max(down_to, self.window):
            self._fill(self.window)

    def finish(self) -> None:
        self.drain(0)
        while self.waiting:
            self._fill(1 << (self.waiting.bit_length() - 1))

    def pieces(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [()] * 8
        self.out = []
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, path: str | None = None, shares: dict[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    ids = stored(tokenized(docs, path or public_tokenizer()), "token-ids")
    sums = block_sums(ids)
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    totals = None if shares is None else {r.source: r.tokens for r in sums.where(F.col("source").isin(list(shares))).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    course = Course(total, totals, shares)
    book = stored(ledger(ids, shares, sums).drop("owed"), "shares", 0)
    on = (F.col("i.block") == F.col("l.block")) & F.col("i.source").eqNullSafe(F.col("l.source"))
    due = ids.alias("i").join(small_side(book, BROADCAST_LEDGER).alias("l"), on)
    due = due.select("i.source", "share", "doc_id", "ids", "tokens", (F.col("block_before") + F.col("own_before")).alias("before"), "of_source")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, share, doc_id, ids, tokens, before, of_source = b.columns
            row, lo, hi, part, place = course.cut(*(c.to_numpy(zero_copy_only=False) for c in (share, of_source, before, tokens)))
            plain = len(row) == len(b)
            take = lambda c: c if plain else c.take(pa.array(row))  # noqa: E731, B023
            cut = ids if plain else pa.array([ids[r].as_py()[2 * s : 2 * e] for r, s, e in zip(row.tolist(), lo.tolist(), hi.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(place), take(source), take(share), take(doc_id), pa.array(lo), take(tokens), cut], ["part", "place", "source", "share", "doc_id", "start", "doc_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(TaskContext.get().partitionId() << 33, window)
        for b in batches:
            for source, share, doc_id, start, doc_tokens, ids in zip(*(c.to_pylist() for c in b.columns)):
                mixer.add(source, share, 0.0, doc_id, np.frombuffer(ids, "<u2"), start, doc_tokens)
        mixer.finish()
        yield mixer.pieces()

    pieces = due.mapInArrow(deal, "part int, place double, source string, share double, doc_id long, start long, doc_tokens long, ids binary")
    dealt = pieces.repartitionById(course.parts, "part").sortWithinPartitions("place", "source", "doc_id", "start")
    return dealt.select("source", "share", "doc_id", "start", "doc_tokens", "ids").mapInArrow(run, PIECES)


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_mixture_packing": op3_mixture_packing}
ORACLE_SQL: dict[str, str] = {}
