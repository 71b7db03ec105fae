"""Approximate nearest neighbours by cosine: a stored index of inverted lists.

Centroids are fitted by spherical k-means on a bounded sample (SAMPLE_FLOATS numbers
at most, chosen by a hash of the id); every row with a vector is then written under
the list of its nearest centroid. A search computes each query's nearest lists and
compares the query with the rows of those lists only: rows meet queries by equality
of list ids, in tiles of one matrix product for each list in a batch; what may be
among the best is compared exactly, so that copies tie wherever they lie. How many lists are probed
is measured when the index is fitted: as many as bring RECALL of the true neighbours
within the sample, where neighbours are farther apart than in the whole table.
``retrieval.knn`` is the exact path.

The index is a folder: ``centroids`` and ``rows`` (list_id, id, unit vector), ranged
by list and a hash of the id, so that a list of any size is cut into files of about
ROWS_PER_FILE rows, and files and row groups tell the lists they hold. New rows are
appended under the same centroids. Rows without a vector are not in the index; a
vector of another length than the first is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import unit
from quern.operators import retrieval

#: Most lists, and most numbers in the sample that centroids are fitted on.
MAX_LISTS, SAMPLE_FLOATS = 4096, 8_000_000
SAMPLE_PER_LIST = 64
ROUNDS = 10
#: Share of the true neighbours that the probed lists must hold, over CHECKED rows of the sample.
RECALL, CHECKED = 0.97, 400
ROWS_PER_FILE = 1_000_000
#: With at most so many lists to read, the scan is told which.
NAMED_LISTS = 500


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def nearest_lists(m: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest centroids of each row, in no order; rows are taken in pieces that bound the products."""
    step, out = max(1, 4_000_000 // len(centroids)), []
    for at in range(0, len(m), step):
        near = m[at : at + step] @ centroids.T
        out.append(near.argmax(1)[:, None] if n == 1 else np.argpartition(-near, min(n, len(centroids)) - 1, 1)[:, :n])
    return np.concatenate(out) if out else np.empty((0, n), int)


def fitted(m: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids of unit rows by spherical k-means; a list that loses all its rows begins again at a row."""
    rng = np.random.default_rng(seed)
    centroids = m[rng.permutation(len(m))[:lists]]
    for _ in range(rounds):
        own = nearest_lists(m, centroids)[:, 0]
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums = m[rng.integers(0, len(m), len(centroids))]
        sums[own[order][starts]] = np.add.reduceat(m[order], starts)
        centroids = unit(sums)
    return centroids


def probes_for(m: np.ndarray, centroids: np.ndarray, k: int = 10, recall: float = RECALL) -> int:
    """How many lists hold ``recall`` of the ``k`` nearest of rows of the sample."""
    asked, k = m[:CHECKED], min(k, len(m) - 1)
    if k < 1:
        return 1
    found, step = [], max(1, 4_000_000 // len(m))
    for at in range(0, len(asked), step):
        far = -(asked[at : at + step] @ m.T)
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        found.append(np.argpartition(far, k - 1, 1)[:, :k])
    found = np.concatenate(found)
    place = np.argsort(np.argsort(-(asked @ centroids.T), 1), 1)  # of each list among the row's nearest
    needed = np.sort(np.take_along_axis(place, nearest_lists(m, centroids)[:, 0][found], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


class InvertedLists:
    """An index at ``path``: ``build`` makes it, ``InvertedLists(spark, path)`` opens it in any session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()  # MAX_LISTS at most
        self.centroids, self.probes = np.array([r["centroid"] for r in rows], float), rows[0]["probes"] if rows else 0

    @classmethod
    def build(cls, rows: DataFrame, path: str, id_col: str = "song_id", vector: str = "embedding", lists: int | None = None) -> InvertedLists:
        """An index of all rows with a vector. ``lists``: by default about the root of their number."""
        spark = rows.sparkSession
        vectors = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        n = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
        lists = max(1, min(MAX_LISTS, lists or round(n["n"] ** 0.5)))
        most = max(lists, min(SAMPLE_PER_LIST * lists, SAMPLE_FLOATS // (n["dims"] or 1)))
        thinned = vectors.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n["n"] // (2 * most)))) == 0)  # twice as many as needed; spares the others the sort
        sample = thinned.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(most)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [_matrix(b.column(0)) for b in batches if len(b)]
            if parts:
                m = unit(np.concatenate(parts))
                centroids = fitted(m, lists)
                yield pa.RecordBatch.from_pydict({"list_id": pa.array(np.arange(len(centroids)), pa.int32()), "centroid": pa.array(centroids.tolist(), pa.list_(pa.float64())), "probes": pa.array([probes_for(m, centroids)] * len(centroids), pa.int32())})

        sample.select("vector").coalesce(1).mapInArrow(fit, "list_id int, centroid array<double>, probes int").write.parquet(f"{path}/centroids")
        index = cls(spark, path)
        index._write(vectors, n["n"], "errorifexists")
        return index

    def append(self, rows: DataFrame, id_col: str = "song_id", vector: str = "embedding") -> None:
        """Further rows, under the centroids that are there."""
        vectors = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        self._write(vectors, vectors.count(), "append")

    def _write(self, vectors: DataFrame, n: int, mode: str) -> None:
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = unit(_matrix(b.column(1))) if len(b) else np.empty((0, 0))
                own = nearest_lists(m, centroids)[:, 0] if len(b) else []
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column(0), pa.array(list(m), pa.list_(pa.float64()))], ["list_id", "id", "vector"])

        dealt = vectors.mapInArrow(run, "list_id int, id long, vector array<double>").repartitionByRange(1 + n // ROWS_PER_FILE, "list_id", F.xxhash64("id"))
        dealt.sortWithinPartitions("list_id").write.mode(mode).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("list_id int, id long, vector array<double>").parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "song_id") -> DataFrame:
        """query_id, id, distance, rank: the ``k`` nearest rows of each query's nearest lists; ties by id.

        ``queries``: query_id (long), query_vector, any number; they are searched
        in counted blocks. ``probes``: by default what the index measured; as many
        as there are lists makes the result exact.
        """
        probes = max(1, min(len(self.centroids), probes or self.probes))
        return retrieval.nearest(lambda block: self._probed(block, k, probes, id_col), retrieval.query_blocks(queries), k, id_col)

    def _probed(self, queries: DataFrame, k: int, probes: int, id_col: str) -> DataFrame:
        asked = queries.where("query_vector IS NOT NULL").select("query_id", F.col("query_vector").cast("array<double>")).collect()  # MAX_QUERIES at most
        rows = self.rows()
        if not asked or not len(self.centroids):
            return rows.select(F.lit(0).cast("long").alias("query_id"), F.col("id").alias(id_col), F.lit(0.0).alias("distance")).limit(0)
        names, wanted = np.array([r[0] for r in asked], np.int64), unit(np.array([r[1] for r in asked], float))
        near = nearest_lists(wanted, self.centroids, probes)
        order = np.argsort(near.ravel(), kind="stable")
        starts = np.flatnonzero(np.diff(near.ravel()[order], prepend=-1))
        by_list = dict(zip(near.ravel()[order][starts].tolist(), np.split(order // near.shape[1], starts[1:])))
        if len(by_list) <= NAMED_LISTS:
            rows = rows.where(F.col("list_id").isin(list(by_list)))

        tile, tile_rows = retrieval.TILE, retrieval.TILE_ROWS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = retrieval.Best(wanted, k, tile=tile, tile_rows=tile_rows)
            for b in batches:
                if not len(b):
                    continue
                lists, ids, m = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
                sort = np.argsort(lists, kind="stable")
                cuts = np.flatnonzero(np.diff(lists[sort], prepend=-1))
                for own in np.split(sort, cuts[1:]):
                    asking = by_list.get(int(lists[own[0]]))
                    if asking is not None:
                        best.add(ids[own], m[own], asking)
            full = np.isfinite(best.d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, full.sum(1))), pa.array(best.ids[full]), pa.array(best.d[full])], ["query_id", id_col, "distance"])

        return rows.mapInArrow(run, f"query_id long, {id_col} long, distance double")


def recall(exact: DataFrame, approximate: DataFrame, id_col: str = "song_id") -> DataFrame:
    """One row: n_queries, n_neighbours of the exact result, n_found of them, their share."""
    found = approximate.select("query_id", id_col, F.lit(1).alias("found"))
    both = exact.select("query_id", id_col).join(found, ["query_id", id_col], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_neighbours"), F.count("found").alias("n_found"), (F.count("found") / F.count("*")).alias("recall"))
