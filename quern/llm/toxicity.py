"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed words, pairs of neighbours and pairs with one
word between, each present or not. Per-coordinate rates and L1 leave a sparse
weight vector, small enough to go to every task with the code.

Training takes a sample of at most TRAIN_DOCS labelled documents; scoring reads
every whole text. Defined results: null and empty texts score as the bias alone;
a null doc_id is never held out; if there are no usable labels every score is
0.5; repeated rows score alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches
from .labelled import fit, fold, sample
from .textvec import byte_values, chunks, mix, word_hashes

if TYPE_CHECKING:
    import pandas as pd

BITS = 20
TRAIN_DOCS = 15_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.2, 1.0, 8.0, 0.1
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
_VALUES = byte_values("lower")


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and feature of each word, neighbouring pair and skip pair, in parts if a chunk is one long text.

    Parts overlap by two words, which does not matter: features are present or not.
    """
    for h, text, _ in word_hashes(data, offsets, _VALUES, again=2):
        found = [(text, h)]
        for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xD3A2646CAB3487E3)):
            together = text[:-gap] == text[gap:]
            pair = h[:-gap] * np.uint64(salt) + (h[gap:] ^ np.uint64(salt))
            found.append((text[:-gap][together], mix(pair[together])))
        text, h = (np.concatenate(x) for x in zip(*found))
        yield text, (h >> np.uint64(64 - bits)).astype(np.int64)


def _once(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """text << BITS | feature, sorted, each once."""
    found = np.empty(0, np.int64)
    for text, at in parts:
        found = np.union1d(found, text << BITS | at)
    return found


class Ftrl:
    """Per-coordinate FTRL-proximal updates; the last coordinate is the bias, which L1 does not touch."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, np.full(size + 1, l1), l2
        self.l1[-1] = 0

    def weights(self, at) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        root = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (root - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _train(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    import pandas as pd

    seen, labels = [], []
    for b in batches:
        labels += b["label"].tolist()
        for data, offsets in chunks(pa.array(b["text"], pa.large_string())):
            once = _once(features(data, offsets))
            for own in np.split(once & ((1 << BITS) - 1), np.searchsorted(once, np.arange(1, len(offsets) - 1) << BITS)):
                seen.append(own.astype(np.int32))
    model = Ftrl(1 << BITS)
    for _ in range(EPOCHS if len(set(labels)) > 1 else 0):
        for at, y in zip(seen, labels):
            model.learn(at, y)
    w = model.weights(np.arange((1 << BITS) + 1))
    kept = np.union1d(np.flatnonzero(w), [1 << BITS])
    return pd.DataFrame({"feature": kept, "weight": w[kept]})


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> pd.DataFrame:
    """The sparse model: feature, weight; the last feature is the bias."""
    return fit(sample(docs, labels, "toxic", FOLDS, HELD_OUT, most), _train, "feature long, weight double")


def score(docs: DataFrame, model: pd.DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    feature, weight = model["feature"].to_numpy(), model["weight"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[feature] = weight
        for b in batches:
            sums = []
            for data, offsets in chunks(b.column(1)):
                once = _once((text[heavy], at[heavy]) for text, at in features(data, offsets) for heavy in [w[at] != 0])
                sums.append(np.bincount(once >> BITS, w[once & ((1 << BITS) - 1)], len(offsets) - 1))
            total = np.concatenate(sums) if sums else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_sigmoid(total + w[-1]))], ["doc_id", "score"])

    short_batches(docs.sparkSession)
    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op1_ftrl_toxicity": op1_ftrl_toxicity}
ORACLE_SQL: dict[str, str] = {}
