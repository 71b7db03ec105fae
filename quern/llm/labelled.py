"""What the text classifiers share: a bounded labelled sample, and fitting in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """text, label of at most ``most`` labelled documents outside the held-out fold, the first by a hash of the id."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id"), folds) != held_out)
    )
    chosen = usable.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("id", "text", "label")  # at most `most` ids are broadcast


def fit(rows: DataFrame, train: Callable[[Iterator[pd.DataFrame]], pd.DataFrame], schema: str) -> pd.DataFrame:
    """Run ``train`` over the bounded sample in one task, in an order that a rerun repeats; the model comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield train(batches)

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    model = ordered.mapInPandas(run, schema).toPandas()
    return model if len(model) else train(iter(()))  # a sample without rows runs no task
