"""Vectors held as array columns. Arithmetic is in double; a null vector gives null.

``zip_with`` pads the shorter side with nulls, so arrays of different length
would give null; where the caller must know, ``checked`` raises instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row: inside a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dims(v) -> Column:
    return F.size(v)


def checked(v, n: int) -> Column:
    """The vector, or an error if its length is not ``n``."""
    v = _double(v)
    return F.when(v.isNull() | (F.size(v) == n), v).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} dimensions, got "), F.size(v).cast("string"))))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def _squares(a) -> Column:
    return _sum(F.transform(_double(a), lambda x: x * x))


def magnitude(a) -> Column:
    return F.sqrt(_squares(a))


def normalize(a) -> Column:
    """Unit vector; the zero vector stays as it is."""
    return _once(magnitude(a), lambda m: F.when(m == 0, _double(a)).otherwise(F.transform(_double(a), lambda x: x / m)))


def cosine(a, b) -> Column:
    """Cosine similarity within -1 and 1, 0 if either vector is zero.

    One root of the product of squares: of a vector and its copy it gives 1 to the
    last bit, so that ties stay ties.
    """
    squares = _squares(a) * _squares(b)
    inside = _once(dot(a, b) / F.sqrt(squares), lambda s: F.when(s.isNull() | F.isnan(s), s).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))
    return F.when(squares == 0, F.lit(0.0)).otherwise(inside)


def cosine_distance(a, b) -> Column:
    return 1.0 - cosine(a, b)


def euclidean(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def distance(a, b, metric: str = "cosine") -> Column:
    """Distances as vector stores give them: the inner product negated, so that smaller is nearer."""
    return {"cosine": cosine_distance, "euclidean": euclidean, "dot": lambda x, y: -dot(x, y)}[metric](a, b)


def similarity_of(d: Column, metric: str = "cosine") -> Column:
    """Similarity for a distance: 1 - d, 1 / (1 + d) or -d."""
    return {"cosine": 1.0 - d, "euclidean": 1.0 / (1.0 + d), "dot": -d}[metric]


def from_json(text, n: int | None = None) -> Column:
    """A vector written as a JSON array; null unless it parses (and has ``n`` elements)."""
    v = F.from_json(text, "array<float>")
    return v if n is None else F.when(F.size(v) == n, v)


def mean(a) -> Column:
    return _sum(_double(a)) / F.size(a)


def stddev_pop(a) -> Column:
    return _once(mean(a), lambda m: F.sqrt(_sum(F.transform(_double(a), lambda x: (x - m) * (x - m))) / F.size(a)))


def statistics(a, tiny: float = 1e-6, huge: float = 1e3) -> dict[str, Column]:
    """Named statistics of each vector: extremes, mean, population deviation, norm, odd values."""
    v = _double(a)
    count = lambda test: F.size(F.filter(v, test))
    return {
        "v_min": F.array_min(v),
        "v_max": F.array_max(v),
        "v_mean": mean(a),
        "v_std": stddev_pop(a),
        "v_norm": magnitude(a),
        "n_zero": count(lambda x: x == 0),
        "n_tiny": count(lambda x: (x != 0) & (F.abs(x) < tiny)),
        "n_huge": count(lambda x: F.abs(x) > huge),
        "n_odd": count(lambda x: F.isnan(x) | (F.abs(x) == float("inf"))),
    }


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """A column of vectors of ``n`` numbers, a row each; an error if one is of another length. Null elements are NaN."""
    lengths = pc.list_value_length(column)
    if len(column) and (column.null_count or pc.min(lengths).as_py() != n or pc.max(lengths).as_py() != n):
        raise ValueError(f"expected vectors of {n} dimensions, got {pc.min(lengths)} to {pc.max(lengths)}")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), n)


def unit(m: np.ndarray) -> np.ndarray:
    """``normalize`` of the rows of a matrix."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _products(a: np.ndarray, b: np.ndarray, of: Callable = np.multiply) -> np.ndarray:
    """Sum of ``of`` over the first axis, element after element as ``_sum`` does it, so that both give the same bits."""
    total = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    for x, y in zip(a, b):
        total += of(x, y)
    return total


def distances(a: np.ndarray, b: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """``distance`` in numpy: the numbers of a vector lie along the first axis, the others broadcast."""
    if metric == "euclidean":
        return np.sqrt(_products(a, b, lambda x, y: np.square(x - y)))
    products = _products(a, b)
    if metric == "dot":
        return -products
    squares = _products(a, a) * _products(b, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - np.where(squares == 0, 0.0, np.clip(products / np.sqrt(squares), -1.0, 1.0))
