"""Exact deduplication with a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the
normalised text (A-Z lower-cased, nothing else). A batch is reduced to one row
per digest with map-side combining, compared with the index by a sort-merge
anti-join that does not shuffle the index, and what is new is appended.

Defined results: a null text is the empty text. Of the equal texts of a batch
exactly one row stays, that of the largest doc_id; a null doc_id stays only if no
row with that text has an id, and of rows that tie (same id and text, or several
without id) one stays. If the digest was indexed by an earlier batch, the
document recorded there stays: rows of this batch with its id do, those without
an id do not. group_size counts the copies of the batch that brought the digest.
A batch that is run again after a failure appends nothing twice and gives rows
with an id the same verdicts. An empty batch gives an empty result. Columns other
than doc_id and text are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, on_leaving, shared_path, stored, without

#: Fewest buckets of an index, and about the most rows of one of its first batch.
LEAST_BUCKETS, BUCKET_ROWS = 64, 1_000_000
#: Most dropped rows that are sent to every executor; beyond it the join shuffles.
BROADCAST_DROPPED = 500_000


class DigestIndex:
    """Digests seen so far, with the document that stays for each.

    ``path`` holds the files; opening it again, from any session, continues the
    index. The number of buckets is chosen from the rows of the first batch, unless
    it is given, and stored beside the files; ``compact`` can choose anew. The
    table's name in the session's catalog is dropped with an open ``scratch``.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.name = f"quern_digests_{uuid.uuid4().hex}"
        self.buckets = self._noted()
        if self.buckets:
            self._create()
        elif buckets:
            self._note(buckets)

    def _meta(self) -> str:
        return f"{self.path}/_buckets"

    def _noted(self) -> int | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._meta()}/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("buckets int").json(self._meta()).first()["buckets"]

    def _note(self, buckets: int) -> None:
        self.buckets = buckets
        self.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(self._meta())
        self._create()

    def _create(self) -> None:
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        on_leaving(lambda: self.spark.sql(f"DROP TABLE IF EXISTS {self.name}"))

    def prepare(self, rows: int) -> None:
        """Choose the buckets of a new index for a first batch of ``rows`` rows."""
        if not self.buckets:
            self._note(max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` whose digest the index lacks. The batch is dealt like the buckets, so the index stays in place."""
        return groups.repartition(self.buckets, "digest").hint("merge").join(self.table(), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """One sorted file a bucket and batch."""
        groups.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").write.insertInto(self.name)

    def compact(self, buckets: int | None = None) -> "DigestIndex":
        """The same index with one file a bucket, at a new path: merges what many batches appended. ``buckets``: by default for the rows it has now."""
        to = DigestIndex(self.spark, f"{self.path}-{uuid.uuid4().hex[:8]}", buckets or max(self.buckets, -(-self.table().count() // BUCKET_ROWS)))
        to.append(self.table())
        return to


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, and a number that tells rows apart once they are stored."""
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"))


def _verdicts(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept, twin for every row of ``docs``; new digests enter ``index``.

    twin: a row that goes although it has the id and text of one that stays.
    """
    rows = stored(digests(docs), "digests")
    n = rows.count()
    index.prepare(n)
    last = F.max(F.struct("doc_id", "row"))  # a null id is the least
    groups = rows.groupBy("digest").agg(last.alias("last"), F.count("*").alias("group_size"))
    groups = stored(groups.select("digest", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"), "groups", n)
    fresh = stored(index.unseen(groups), "fresh", n)
    known = groups.select("digest", F.col("keep_id").alias("last_id"), "keep_row").hint("merge").join(index.table(), "digest")
    # keep_row is of use if the recorded document is this batch's last one
    known = stored(known.withColumn("keep_row", F.when(F.col("last_id") == F.col("keep_id"), F.col("keep_row"))).drop("last_id"), "known", n)
    index.append(fresh)
    verdict = fresh.withColumn("fresh", F.lit(True)).unionByName(known.withColumn("fresh", F.lit(False)))
    holder = F.when(F.col("fresh"), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    stays = holder & (F.col("row") == F.coalesce("keep_row", "row"))
    return rows.join(verdict.hint("merge"), "digest").select("doc_id", "digest", "keep_id", "group_size", stays.alias("kept"), (holder & ~stays).alias("twin"))


def dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``; new digests enter ``index``.

    The texts are read once. What is shuffled is a digest and two numbers a
    document, and one row a digest and task for the groups. The last join is one
    of two plain shuffles, which adaptive execution splits where one digest is hot.
    """
    return _verdicts(docs, index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text that is new to ``index``.

    Rows are told by id and 60 bits of the digest. Twins of rows that stay share
    both, so where there are any they are reduced to one row each.
    """
    head = lambda sha: F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")
    gone = _verdicts(docs, index).where("NOT kept").select(F.col("doc_id").alias("_quern_id"), head(F.hex("digest")).alias("_quern_head"), "twin")
    digest = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    return without(docs, gone, docs["doc_id"], head(digest), BROADCAST_DROPPED)


def op10_digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a new index."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), DigestIndex(spark, shared_path(spark, "digest-index")))


QUERIES = {"op10_digest_dedup": op10_digest_dedup}
ORACLE_SQL = {
    "op10_digest_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
}
