"""Embedders behind one interface, run in Arrow batches.

Models come from outside: an embedder is an object with ``dimensions``,
``available`` and ``embed`` (texts to unit vectors). ``HashEmbedder`` needs no
model; it spreads hashed words over dimensions, is deterministic and serves
tests. It does not understand language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimensions: int

    def available(self) -> bool: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def available(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                row[h % self.dimensions] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class Down:
    """An embedder that cannot serve: it says so, or fails when asked. For tests of fallbacks."""

    def __init__(self, dimensions: int, says_available: bool = False):
        self.dimensions, self.says_available = dimensions, says_available

    def available(self) -> bool:
        return self.says_available

    def embed(self, texts: list[str]) -> np.ndarray:
        raise ConnectionError("no model")


class FirstAvailable:
    """The first embedder that is available and does not fail."""

    def __init__(self, *embedders: Embedder):
        self.embedders, self.dimensions = embedders, embedders[0].dimensions

    def available(self) -> bool:
        return any(e.available() for e in self.embedders)

    def embed(self, texts: list[str]) -> np.ndarray:
        error: Exception | None = None
        for e in self.embedders:
            try:
                if e.available():
                    return e.embed(texts)
            except Exception as failed:  # the next one may do
                error = failed
        raise RuntimeError("no embedder is available") from error


def embedding(text: Column, embedder: Embedder, batch: int = 32) -> Column:
    """The vector of each text as array<float>; null for null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = [v for a in range(0, len(texts), batch) for v in embedder.embed(texts[a : a + batch])]
            yield pd.Series([None if missing else v.astype("float32") for v, missing in zip(vectors, part.isna())])

    return run(text)
