"""Runs of repeated words in documents, by block matching.

A run is a stretch of words with smallest period q, at least max(6, 4 q) words long,
that no neighbour extends. Words become integers; for each scale B, a power of two,
the aligned blocks of B words are the keys of a pyahocorasick automaton of integer
sequences, which is searched across the document; long blocks are sequences of KEY
names of parts, so that the work grows with the words times the scales. A block found again at a distance
d with B <= d < 2 B is a seed: a run of period d holds four periods, so it holds an
aligned block of its scale and that block's next copy. A seed is extended word by
word to both sides; what comes out is exact, and is kept if it is long enough and
has no smaller period. Seeds inside a run of a smaller scale say nothing new.

Words that occur fewer than four times in a stretch are in no run of it: stretches
are cut at them until nothing changes, and only what is left is searched, block by
block of at most SEARCH words at small scales.

Everything happens inside a row, in the task that reads it. Memory is in proportion
to one text.

Defined results: a null or empty text has no words and no runs, and the sha256 of
nothing twice; a null doc_id leaves the words as they are; repeated rows give equal
results; an empty table gives none. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches

#: A run's least length in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that one automaton is made of, beside what reaches into the next part; more at scales above a sixteenth of it.
SEARCH = 1 << 16
#: Most integers of a key. Blocks of more words are keys of names of their parts: states of long loops would else fall back step by step.
KEY = 8

Run = tuple[int, int, int]  # start, end, period


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of stretches that hold all runs: each word occurs LEAST_PERIODS times in its stretch at least."""
    done, left = [], [(0, len(ids))]
    while left:
        start, end = left.pop()
        if end - start < LEAST_WORDS:
            continue
        _, where, counts = np.unique(ids[start:end], return_inverse=True, return_counts=True)
        often = counts[where] >= LEAST_PERIODS
        if often.all():
            done.append((start, end))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], often, [False]))))
        left += [(start + s, start + e) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return sorted(done)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of two arrays of one length are equal."""
    at, step = 0, 16
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return len(a)


def extended(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch with ``period`` that holds ids[at] and ids[at + period], which are equal."""
    right = _agree(ids[at : len(ids) - period], ids[at + period :])
    left = _agree(ids[:at][::-1], ids[period : at + period][::-1])
    return at - left, at + right + period


def _has_smaller(ids: np.ndarray, period: int) -> bool:
    """Whether a part of ``period``, itself a period of ``ids``, is one too. A smaller period of so long a stretch divides it."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor:
            factor += 1
            continue
        while rest % factor == 0:
            rest //= factor
        smaller = period // factor
        if np.array_equal(ids[smaller:], ids[:-smaller]):
            return True
    return False


def doubled(names: np.ndarray, unit: int) -> np.ndarray:
    """Names of all stretches of 2 ``unit`` words, of the names of those of ``unit``: equal names for equal words."""
    _, out = np.unique(names[:-unit] * (int(names.max()) + 1) + names[unit:], return_inverse=True)
    return out


def seeds(names: np.ndarray, unit: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of aligned blocks, distances) at which a block of ``block`` words stands again, ``block`` to twice that further on.

    names[i] stands for the words from i to i + ``unit``, so a block is a key of
    block / unit names, and the document is searched once for each place that a
    step of ``unit`` words can begin at. The blocks of a part of the document make
    an automaton; it is searched over that part and as far beyond as a distance
    reaches. Of the places that a copy could repeat only one is aligned.
    """
    part, symbols, end = max(SEARCH, 16 * block) // block * block, block // unit, int(names.max()) + 1
    for begin in range(0, len(names), part):
        own = names[begin : begin + part + 3 * block]
        starts = np.arange(0, min(part, len(own) - block + unit), block)
        if not len(starts):
            continue
        keys: dict[tuple, int] = {}
        number = np.array([keys.setdefault(tuple(key), len(keys)) for key in own[starts[:, None] + unit * np.arange(symbols)].tolist()])
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, i in keys.items():
            machine.add_word(key, i)
        machine.make_automaton()
        length = -(-len(own) // unit) + 1  # of a line of every unit-th name; the last is ``end``, which no key has
        lines = np.full(length * unit, end)
        lines[: len(own)] = own
        found = np.fromiter((x for hit in machine.iter(tuple(lines.reshape(length, unit).T.ravel().tolist())) for x in hit), np.int64).reshape(-1, 2)
        line, at = np.divmod(found[:, 0], length)
        again = (at - symbols + 1) * unit + line
        first = (again - block) // block
        near = (first >= 0) & (first < len(starts))
        again, first, hit = again[near], first[near], found[near, 1]
        same = number[first] == hit
        yield begin + first[same] * block, again[same] - first[same] * block


def _runs(ids: np.ndarray) -> list[Run]:
    """The runs of one stretch."""
    found: list[Run] = []
    names, unit, block = ids, 1, 1
    while LEAST_PERIODS * block <= len(ids):
        reach = np.zeros(len(ids), np.int64)  # how far a run of a smaller scale that begins here or before goes
        for s, e, _ in found:
            reach[s] = max(reach[s], e)
        reach = np.maximum.accumulate(reach)
        got: dict[int, int] = {}  # per distance, the end of what was extended last
        new: list[Run] = []
        for at, distance in seeds(names, unit, block):
            fresh = reach[at] < at + distance + block
            order = np.lexsort((at[fresh], distance[fresh]))
            for i, d in zip(at[fresh][order].tolist(), distance[fresh][order].tolist()):
                if i + d + block <= got.get(d, 0):
                    continue
                s, e = extended(ids, i, d)
                got[d] = e
                if e - s >= max(LEAST_WORDS, LEAST_PERIODS * d) and not _has_smaller(ids[s:e], d):
                    new.append((s, e, d))
        found += new
        block *= 2
        if block > KEY * unit:
            names, unit = doubled(names, unit), 2 * unit
    return found


def runs(ids: np.ndarray) -> list[Run]:
    """(start, end, period) of all runs, by start, then period."""
    return sorted({(s + start, e + start, q) for start, end in stretches(ids) for s, e, q in _runs(ids[start:end])}, key=lambda r: (r[0], r[2]))


def longest(found: list[Run]) -> Run | None:
    """The run of the most periods; of several the one that begins first, then that of the smaller period."""
    best = None
    for s, e, q in sorted(found, key=lambda r: (r[0], r[2])):
        if best is None or (e - s) * best[2] > (best[1] - best[0]) * q:
            best = s, e, q
    return best


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as integers, equal ones alike."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a loop for a tail, in a tenth of the documents by crc32 of the id."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that some run holds beyond its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, e, q in found:
        change[s + q] += 1
        change[e] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(docs: DataFrame, schema: str, row) -> DataFrame:
    """``row`` (doc_id, words) -> values of ``schema`` after doc_id, for every row of ``docs``."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [row(i, (cell.as_py() or b"").split()) for i, cell in zip(ids, b.column(1).cast(pa.binary()))]
            columns = [ids, *(zip(*out) if out else [()] * (len(names) - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    short_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, schema)


def _digests(words: list[bytes]) -> tuple:
    found = runs(numbered(words))
    best = longest(found)
    s, e, q = best or (None, None, None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    told = (s, e - s, q, 1000 * (e - s) // q) if best else (None,) * 4
    return len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text, for every row of ``docs``."""
    return _rows(docs, SCHEMA, lambda doc_id, words: _digests(words))


def without_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: each run cut to its first period, words joined by one space; n_dropped words."""

    def row(doc_id: int | None, words: list[bytes]) -> tuple:
        kept = collapsed(words, runs(numbered(words)))
        return b" ".join(kept).decode(), len(words) - len(kept)

    return _rows(docs, "doc_id long, text string, n_dropped long", row)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of them with a loop for a tail."""
    return _rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), SCHEMA, lambda doc_id, words: _digests(looped(words, doc_id)))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
