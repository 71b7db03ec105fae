"""A publish sink: frames of a stream are sent once a batch, and a room's members are pruned by what fails.

``published_channel`` is a Python data source. Tasks stage their frames as files in a
shared folder and tell the driver where; the commit of a batch writes a manifest that
names them, under the batch's id, if there is none yet. A batch that is run again after
a crash finds its manifest and throws its own files away, so nothing is published
twice; an aborted batch leaves nothing. ``published`` reads what manifests name.

``audience`` joins frames with the members of their room but the sender, ``deliver``
hands each to a transport in the tasks, and ``pruned`` drops the members that failed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Frames that a task holds before they go to its file.
GROUP = 10_000


@dataclass
class Staged(WriterCommitMessage):
    file: str
    frames: int


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if ":" in path else (pa.fs.LocalFileSystem(), path)


class ChannelWriter(DataSourceStreamWriter):
    def __init__(self, schema: StructType, path: str):
        self.schema, self.path = schema, path.rstrip("/")

    def write(self, iterator) -> Staged:
        """One task's frames, as one file that no manifest names yet."""
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        fs, top = _store(self.path)
        file, frames, writer, held = f"{uuid.uuid4().hex}.parquet", 0, None, []

        def flush() -> None:
            columns = [pa.array([r[i] for r in held], k) for i, k in enumerate(kinds.types)]
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=kinds))
            held.clear()

        for row in iterator:
            if writer is None:
                fs.create_dir(f"{top}/frames", recursive=True)
                writer = pa.parquet.ParquetWriter(f"{top}/frames/{file}", kinds, filesystem=fs)
            held.append(tuple(row))
            frames += 1
            if len(held) == GROUP:
                flush()
        if writer:
            flush()
            writer.close()
        return Staged(file, frames)

    def commit(self, messages, batchId: int) -> None:
        fs, top = _store(self.path)
        manifest = f"{top}/manifests/{batchId}.json"
        if fs.get_file_info(manifest).type != pa.fs.FileType.NotFound:
            return self.abort(messages, batchId)  # published before the crash
        fs.create_dir(f"{top}/manifests", recursive=True)
        told = [{"file": m.file, "frames": m.frames} for m in messages if m is not None and m.frames]
        half = f"{manifest}.{uuid.uuid4().hex}"
        with fs.open_output_stream(half) as out:
            out.write(json.dumps(told).encode())
        fs.move(half, manifest)  # a manifest is there whole or not at all

    def abort(self, messages, batchId: int) -> None:
        fs, top = _store(self.path)
        for m in messages:
            if m is not None and m.frames and fs.get_file_info(f"{top}/frames/{m.file}").type != pa.fs.FileType.NotFound:
                fs.delete_file(f"{top}/frames/{m.file}")


class Channel(DataSource):
    """``df.writeStream.format("channel").option("path", shared folder)``."""

    @classmethod
    def name(cls) -> str:
        return "channel"

    def streamWriter(self, schema: StructType, overwrite: bool) -> ChannelWriter:
        return ChannelWriter(schema, self.options["path"])


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """batch_id and the frames of all batches that were committed."""
    fs, top = _store(path.rstrip("/"))
    if fs.get_file_info(f"{top}/manifests").type == pa.fs.FileType.NotFound:
        return spark.createDataFrame([], f"batch_id long, {schema}")
    named = spark.read.schema("file string, frames long").json(f"{path.rstrip('/')}/manifests/*.json").select(F.regexp_extract("_metadata.file_name", r"^([0-9]+)", 1).cast("long").alias("batch_id"), F.col("file").alias("_file"))
    frames = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path.rstrip('/')}/frames").withColumn("_file", F.col("_metadata.file_name"))
    return frames.join(named, "_file").drop("_file").select("batch_id", *spark.createDataFrame([], schema).columns)


def audience(frames: DataFrame, members: DataFrame) -> DataFrame:
    """conn_id and the frame, for every connection in the frame's room but the sender's. frames: room_id, sender, ...; members: room_id, conn_id."""
    return frames.join(members.select("room_id", "conn_id"), "room_id").where(~F.col("conn_id").eqNullSafe(F.col("sender")))


def deliver(addressed: DataFrame, send: Callable[[int, str], bool], payload: str = "payload") -> DataFrame:
    """room_id, conn_id, sent, failed: what ``send(conn_id, payload)`` made of each frame, in the tasks.

    A connection's frames go in order of message_id; once one fails, the rest of
    that connection are not tried and count as failed. A task keeps one connection in hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, dead = None, False
        for b in batches:
            rooms, conns, sent = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for conn, text in zip(conns, b.column(2).to_pylist()):
                if conn != at:
                    at, dead = conn, False
                ok = not dead and bool(send(conn, text))
                dead = dead or not ok
                sent.append(ok)
            yield pa.RecordBatch.from_arrays([pa.array(rooms, b.column(0).type), pa.array(conns, b.column(1).type), pa.array(sent, pa.bool_())], ["room_id", "conn_id", "ok"])

    ordered = addressed.repartition("conn_id").sortWithinPartitions("conn_id", "message_id")
    kinds = {f.name: f.dataType.simpleString() for f in addressed.schema}
    told = ordered.select("room_id", "conn_id", payload).mapInArrow(run, f"room_id {kinds['room_id']}, conn_id {kinds['conn_id']}, ok boolean")
    return told.groupBy("room_id", "conn_id").agg(F.count_if("ok").alias("sent"), F.count_if(~F.col("ok")).alias("failed"))


def pruned(members: DataFrame, delivered: DataFrame) -> DataFrame:
    """``members`` without the connections to which something failed."""
    return members.join(delivered.where("failed > 0").select("conn_id").distinct(), "conn_id", "left_anti")
