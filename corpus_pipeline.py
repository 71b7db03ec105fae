"""From raw documents to packed training sequences in five stages.

Each stage is a function of (spark, docs, sf_dir) over all rows that the stage
before kept; its result is written as Parquet in the shared folder and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, exact_dedup, packing, quality, simhash
from quern.llm.common import delete, on_leaving, scratch, shared_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labelled ones among ``docs``."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.deduplicated(docs, exact_dedup.DigestIndex(spark, shared_path(spark, "digest-index")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest id stays."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4096 tokens, mixed by source in the proportions of what is left."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of ``sf_dir``. What they store on the way is deleted; the last result stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch():  # the stages' results
        for i, (name, stage) in enumerate(STAGES, 1):
            with scratch():  # a stage's own tables
                out = stage(spark, docs, sf_dir)
                path = shared_path(spark, name.replace(" ", "-"), lasting=True)
                out.write.parquet(path)
            if i < len(STAGES):
                on_leaving(lambda path=path: delete(spark, path))
            docs = spark.read.schema(out.schema).parquet(path)
    return docs


QUERIES = {"pipeline": run}
#: SQL cannot express the classifier, the fingerprints' components or the tokenizer.
ORACLE_SQL = None
