"""File sources and sinks. Schemas are given, never inferred; bad rows are kept apart, not dropped silently."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
#: Rows of one object of a snapshot.
SNAPSHOT_ROWS = 10_000


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names, which all executors share; a local session may lack it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quern/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read back, so that an iteration's plan stays one round long."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Remove the files that ``stored`` wrote for ``df``, once nothing reads them any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Quoted, trimmed CSV with a header; rows that lack a required field are left out."""
    df = spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    for c in required:
        df = df.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"', quoteAll=True).csv(path)


def append_new_csv(df: DataFrame, path: str, schema: str, keys: list[str]) -> None:
    """Append the rows whose keys, in any case, the CSV at ``path`` lacks."""
    low = [F.lower(c).alias(c) for c in keys]
    have = read_csv(df.sparkSession, path, schema, keys).select(*low).distinct()
    fresh = df.join(have, [F.lower(df[c]) == have[c] for c in keys], "left_anti")
    write_csv(stored(fresh, "csv-append"), path, "append")  # read before the folder changes


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines as text) of a file of JSON objects, one a line."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = spark.read.text(path).select("value", F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("row"))
    return parsed.where(f"row.{CORRUPT} IS NULL").select("row.*").drop(CORRUPT), parsed.where(f"row.{CORRUPT} IS NOT NULL").select(F.col("value").alias("line"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array (or a single object) a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_snapshot(df: DataFrame, path: str, taken: str) -> None:
    """JSON objects of at most SNAPSHOT_ROWS rows, a file each as ``read_json_array`` reads no more: when, how many, and the rows."""
    numbered = df.withColumn("_row", F.monotonically_increasing_id())  # partition, then row
    block = F.floor(F.col("_row") / 2**33).alias("part"), F.floor(F.col("_row") % 2**33 / SNAPSHOT_ROWS).alias("block")
    packed = numbered.groupBy(*block).agg(F.count("*").alias("count"), F.collect_list(F.struct(*df.columns)).alias("songs"))
    packed.select(F.lit(taken).alias("timestamp"), "count", "songs").write.option("maxRecordsPerFile", 1).json(path)


def write_quarantine(df: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated text, a row a line."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value")).write.text(path)


class Checkpoints:
    """The newest cursor of each source, as appended Parquet: the latest by version counts."""

    SCHEMA = "source string, cursor string, version long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).option("ignoreMissingFiles", True).parquet(self.path)

    def save(self, source: str, cursor: str, version: int) -> None:
        self.spark.createDataFrame([(source, cursor, version)], self.SCHEMA).write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        return self._all().groupBy("source").agg(F.max_by("cursor", "version").alias("cursor"))


def newer_than(plays: DataFrame, cursor) -> DataFrame:
    """Rows after the cursor; null takes all. The cursor moves only when a whole run is done, so none is skipped."""
    return plays if cursor is None else plays.where(F.col("airdate") > F.lit(cursor))
