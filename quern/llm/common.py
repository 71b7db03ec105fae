"""What several operators share: shared storage, normalisation, tokenisation, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of text that are handed to Python at once.
BATCH_ROWS = 1_000
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased: every ASCII code that is neither a digit nor a-z.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` as the session names it.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would
    be invisible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        given = spark.sparkContext.getCheckpointDir()
        named = given if given else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        named = tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: What the innermost open ``scratch`` will undo.
_UNDO: list[list[Callable[[], object]]] = []


def on_leaving(undo: Callable[[], object]) -> None:
    """Run ``undo`` when the innermost open ``scratch`` is left; without one, never."""
    if _UNDO:
        _UNDO[-1].append(undo)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path in whatever store it is."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)


@contextmanager
def scratch() -> Iterator[None]:
    """What is stored inside is deleted on leaving. Store what shall last outside, but read it to its end inside."""
    _UNDO.append([])
    try:
        yield
    finally:
        for undo in reversed(_UNDO.pop()):
            undo()


def shared_path(spark: SparkSession, what: str, lasting: bool = False) -> str:
    """A fresh path below the shared folder; unless ``lasting``, an open ``scratch`` deletes it."""
    path = f"{shared_dir(spark)}/quern/{what}-{uuid.uuid4().hex}"
    if not lasting:
        on_leaving(lambda: delete(spark, path))
    return path


def tasks_for(rows: int) -> int:
    """Tasks, and so files, for writing a narrow table of about ``rows`` rows."""
    return 8 + rows // 250_000


def stored(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there, and any executor can be lost.

    ``rows``, if something is known of them, keeps small results of a shuffle
    from being written as a file for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(tasks_for(rows))
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_on_disk(df: DataFrame) -> DataFrame:
    """Kept on the executors' disks for several uses; what is lost with an executor is computed again. Unpersist it."""
    return df.persist(StorageLevel.DISK_ONLY)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch to ``rows``: Spark's 10,000 rows of long text fill tens of MB on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


#: About the most bytes of a table that is sent to every executor, where its rows have no bound of their own.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, max_rows: int, width: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it was counted to hold at most ``max_rows`` rows, else as it is (shuffle join).

    ``width``: about the bytes of a row that holds texts or arrays; their sum may
    then not exceed BROADCAST_BYTES either. ``df`` should be cheap to count, as a
    stored table is. Either way the result of a join is the same.
    """
    if width is None:
        return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
    has = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if has["rows"] <= max_rows and has["bytes"] <= BROADCAST_BYTES else df


def without(docs: DataFrame, gone: DataFrame, id_: Column, key: Column, max_rows: int) -> DataFrame:
    """``docs`` without the rows that ``gone`` (_quern_id, _quern_head, twin) names by ``id_`` and ``key``.

    A twin names the key of a row that stays: of the rows with that key one is left.
    """
    gone = stored(gone.distinct(), "dropped")
    rows = docs.withColumns({"_quern_row_id": id_, "_quern_row_key": key})
    on = F.col("_quern_row_id").eqNullSafe(F.col("_quern_id")) & (F.col("_quern_row_key") == F.col("_quern_head"))
    left = rows.join(small_side(gone.drop("twin"), max_rows), on, "left_anti")
    twins = small_side(gone.where("twin").drop("twin"), max_rows)
    if twins.limit(1).count():
        one = rows.join(twins, on, "left_semi").dropDuplicates(["_quern_row_id", "_quern_row_key"])
        left = left.unionByName(one)
    return left.drop("_quern_row_id", "_quern_row_key")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII texts take the byte-wise ``lower``; others a per-character map."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """Words of a whole text, in order; null gives none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def row_key(*cols: Column) -> Column:
    """Tells rows of one id but different content apart; identical rows share it, and so share results."""
    return F.xxhash64(*cols)
