"""Quality by supervised subword embeddings.

A text is the mean of learned vectors of its hashed words, its neighbouring
word pairs and its character n-grams (runs of UTF-8 bytes); a softmax over two
classes reads the mean. Vectors and softmax are trained together by stochastic
gradient descent in numpy. As the softmax reads a mean, the model scores with
one number a hashed slot: the difference that the slot's vector makes.

Training takes a sample of at most TRAIN_DOCS labelled documents; scoring reads
every whole text. Defined results: null and empty texts score as the softmax's
bias alone; a null doc_id is never held out; if there are no usable labels every
score is 0.5; repeated rows score alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import short_batches
from .labelled import fit, fold, sample
from .textvec import byte_values, chunks, mix, ngram_hashes, word_hashes

if TYPE_CHECKING:
    import pandas as pd

BITS = 17
DIM = 8
NGRAMS = (3, 4)
TRAIN_DOCS = 4_000
EPOCHS = 6
RATE = 0.5
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: The column that scores() adds.
SCORE = "_quern_quality"
_WORDS = byte_values("space")
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
#: A word that repeats the one before it is a token of its own: which word it is does not matter.
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def slots(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and slot of each word, word pair and n-gram of a chunk, in parts."""
    for h, text, repeated in word_hashes(data, offsets, _WORDS, again=1):
        together = text[:-1] == text[1:]
        pair = np.where(h[:-1] == h[1:], _AGAIN, mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:]))
        yield text[repeated:], _slot(h[repeated:])
        yield text[:-1][together], _slot(pair[together])
    for n in NGRAMS:
        for h, text in ngram_hashes(data, offsets, n, _BYTES):
            yield text, _slot(h ^ np.uint64(n))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _counted(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """text << BITS | slot, sorted, each once; and how often each occurs."""
    keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for text, at in parts:
        more, m = np.unique(text << BITS | at, return_counts=True)
        keys, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
        n = np.bincount(where, np.concatenate([n, m]), len(keys)).astype(np.int64)
    return keys, n


def _train(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    import pandas as pd

    seen, labels = [], []
    for b in batches:
        labels += b["label"].tolist()
        for data, offsets in chunks(pa.array(b["text"], pa.large_string())):
            both, n = _counted(slots(data, offsets))
            cut = np.searchsorted(both, np.arange(1, len(offsets) - 1) << BITS)
            for own, count in zip(np.split(both & ((1 << BITS) - 1), cut), np.split(n, cut)):
                seen.append((own.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(seen) if len(set(labels)) > 1 else 0, 0
    for _ in range(EPOCHS if steps else 0):
        for i in rng.permutation(len(seen)):
            (at, share), rate = seen[i], RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[at]
            x = out @ mean + bias
            p = np.exp(x - x.max())
            miss = p / p.sum()
            miss[labels[i]] -= 1
            back = out.T @ miss
            out -= rate * np.outer(miss, mean)
            bias -= rate * 0.1 * miss
            if len(at):  # scaled so that the text's mean moves by rate * back, however many slots it has
                vectors[at] -= (rate / float(share @ share)) * np.outer(share, back)
    slot = vectors @ (out[1] - out[0]) if steps else np.zeros(1 << BITS)
    return pd.DataFrame({"slot": [slot.astype("<f4").tobytes()], "bias": [float(bias[1] - bias[0])]})


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """What each slot adds to the log-odds of label 1, and the bias."""
    row = fit(sample(docs, labels, "quality", FOLDS, HELD_OUT, most), _train, "slot binary, bias double").iloc[0]
    return np.frombuffer(row["slot"], "<f4"), row["bias"]


def _log_odds(texts: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    slot, bias = model
    found = [np.empty(0)]
    for data, offsets in chunks(texts):
        total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        for text, at in slots(data, offsets):
            n += np.bincount(text, minlength=len(n))
            total += np.bincount(text, slot[at], len(n))
        found.append(total / np.maximum(n, 1))
    return np.clip(np.concatenate(found) + bias, -35, 35)


def _numbered(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *more: StructField) -> DataFrame:
    """``docs`` through ``run`` with numbers for names, as Spark looks columns up by name there; then its names again."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = [StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)]
    short_batches(docs.sparkSession)
    return docs.toDF(*names).mapInArrow(run, StructType([*plain, *more])).toDF(*docs.columns, *(f.name for f in more))


def scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with all its columns and a further one, SCORE."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = 1 / (1 + np.exp(-_log_odds(b.column(place), model)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, SCORE])

    return _numbered(docs, run, StructField(SCORE, DoubleType()))


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns whatever these are named."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(1 / (1 + np.exp(-_log_odds(b.column(place), model))) >= threshold))

    return _numbered(docs, run)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return scores(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col(SCORE).alias("score"),
        (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"),
    )


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op2_subword_quality": op2_subword_quality}
ORACLE_SQL: dict[str, str] = {}
