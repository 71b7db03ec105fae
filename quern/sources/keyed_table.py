"""A table of rows with unique keys whose changes rewrite only the buckets they touch.

A row's bucket is a hash of its keys. A version is a small manifest that names the
folder of each bucket; a change writes new folders for the buckets in which a row
changes and then a manifest one higher, which all other buckets' folders go into as
they are. The manifest is moved to its place by a rename that fails if the place is
taken: of two writers that began at one version the second gets ``Conflict``, its
files are removed, and the table is as the first left it. A writer that dies leaves
folders that no manifest names. Readers keep the version they began with.

Both sides of a change are dealt by bucket, which serves the join by key and the
writing, so a touched row moves once. Buckets are even, as keys are unique.

Rows of a change with a null key are left out. Of several rows of a change for one
key the one with the greatest ``order`` counts (``insert_ignore``: the least); ties
are broken by the values, so a change that is run again gives the same table.
A change without effect makes no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer was first; read again and repeat the change."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs_api, self._io = jvm.org.apache.hadoop.fs, jvm.org.apache.commons.io.IOUtils
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # Files

    def _path(self, name: str):
        return self._fs_api.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _move_new(self, source: str, target: str) -> bool:
        """Rename within the table, unless the target is there."""
        files = self._fs_api.FileContext.getFileContext(self._fs().getUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self._fs_api, "Options$Rename"), 0)
        try:
            files.rename(self._path(source), self._path(target), no_options)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False

    # Versions

    def version(self) -> int:
        """The newest version; 0 if there is no table."""
        folder = self._path("versions")
        if not self._fs().exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """keys, schema, buckets (their number) and folders (bucket: folder) of a version, the newest by default."""
        n = self.version() if version is None else version
        stream = self._fs().open(self._path(f"versions/{n}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8")) | {"version": n}
        finally:
            stream.close()

    def _commit(self, manifest: dict, version: int, written: list[str]) -> int:
        half = f"versions/{version}.{uuid.uuid4().hex}.half"
        out = self._fs().create(self._path(half))
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._move_new(half, f"versions/{version}.json"):
            for name in [half, *written]:
                self._fs().delete(self._path(name), True)
            raise Conflict(f"version {version} of {self.path} was written by another")
        return version

    # Rows

    def create(self, rows: DataFrame, keys: list[str], buckets: int) -> int:
        """Version 1. ``buckets``: fix it by the rows expected, about a million a bucket. Of equal keys one row stays, by its values."""
        bad = [f.name for f in rows.schema if f.name == BUCKET]
        if bad:
            raise ValueError(f"a column is named {BUCKET}")
        meta = {"keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": {}}
        one = self._one_a_key(rows, keys, [], F.desc)
        folder = f"data/{uuid.uuid4().hex}"
        return self._commit(meta | {"folders": self._written(self._dealt(one, meta), meta, folder)}, 1, [folder])

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of some buckets only, if named."""
        m = self.manifest(version)
        return self._rows(m, list(m["folders"]) if buckets is None else [str(b) for b in buckets]).drop(BUCKET)

    def insert_ignore(self, rows: DataFrame, order: str | None = None, since: int | None = None) -> int:
        """Add the rows whose keys the table lacks. ``since``: the version the change was made for, the newest by default."""
        return self._change(rows, order, since, F.asc, lambda here: ~here)

    def upsert(self, rows: DataFrame, order: str | None = None, since: int | None = None) -> int:
        """Add rows, or put their columns in place of what the table has; columns that ``rows`` lacks stay (null in new rows)."""
        return self._change(rows, order, since, F.desc, lambda here: F.lit(True))

    def update(self, rows: DataFrame, order: str | None = None, since: int | None = None) -> int:
        """Put columns in place in rows that the table has; other rows of the change are left out."""
        return self._change(rows, order, since, F.desc, lambda here: here)

    def delete(self, keys: DataFrame, since: int | None = None) -> int:
        return self._change(keys, None, since, F.desc, lambda here: here, gone=True)

    def _one_a_key(self, rows: DataFrame, keys: list[str], order: list[str], direction) -> DataFrame:
        with_keys = rows.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
        rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
        w = Window.partitionBy(*keys).orderBy(*(direction(F.col(f"`{c}`")) for c in order), rest)
        return with_keys.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")

    def _dealt(self, rows: DataFrame, meta: dict) -> DataFrame:
        """With the bucket, a partition holding whole buckets."""
        kinds = {f["name"]: f for f in meta["schema"]["fields"]}
        typed = [F.col(f"`{k}`").cast(StructType.fromJson({"type": "struct", "fields": [kinds[k]]})[0].dataType) for k in meta["keys"]]
        bucket: Column = F.pmod(F.xxhash64(*typed), F.lit(meta["buckets"])).cast("int")
        return rows.withColumn(BUCKET, bucket).repartition(BUCKET)

    def _rows(self, meta: dict, buckets: list[str]) -> DataFrame:
        """The rows of some buckets, with their number."""
        schema = StructType.fromJson(meta["schema"])
        folders = [f"{self.path}/{meta['folders'][b]}" for b in buckets if b in meta["folders"]]
        if not folders:
            return self.spark.createDataFrame([], schema.add(BUCKET, IntegerType()))
        number = F.regexp_extract(F.col("_metadata.file_path"), f"/{BUCKET}=([0-9]+)/", 1).cast("int")
        return self.spark.read.schema(schema).parquet(*folders).withColumn(BUCKET, number)

    def _written(self, dealt: DataFrame, meta: dict, folder: str) -> dict[str, str]:
        """Write rows by bucket; the folder of each bucket that has any."""
        dealt.select(*(f["name"] for f in meta["schema"]["fields"]), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in self._fs().listStatus(self._path(folder))]
        return {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in found if n.startswith(f"{BUCKET}=")}

    def _change(self, rows: DataFrame, order: str | None, since: int | None, direction, counts, gone: bool = False) -> int:
        meta = self.manifest(since)
        keys, names = meta["keys"], [f["name"] for f in meta["schema"]["fields"]]
        given = [c for c in rows.columns if c in names and c not in keys]
        ordered = [order] if order else []
        one = self._one_a_key(rows.select(*keys, *given, *(c for c in ordered if c not in keys + given)), keys, ordered, direction)
        new = self._dealt(one, meta).select(BUCKET, *keys, F.struct(F.lit(True).alias("_here"), *(F.col(f"`{c}`") for c in given)).alias("_new"))
        work = f"{self.path}/work/{uuid.uuid4().hex}"
        try:
            new.write.partitionBy(BUCKET).parquet(work)  # the change is computed once
            return self._applied(self.spark.read.schema(new.schema).parquet(work), meta, given, counts, gone)
        finally:
            self._fs().delete(self._fs_api.Path(work), True)

    def _applied(self, back: DataFrame, meta: dict, given: list[str], counts, gone: bool) -> int:
        keys, version, names = meta["keys"], meta["version"], [f["name"] for f in meta["schema"]["fields"]]
        asked = [str(r[0]) for r in back.select(BUCKET).distinct().collect()]  # at most as many as buckets
        old = self._rows(meta, asked).withColumn("_old", F.lit(True)).repartition(BUCKET)
        both = old.join(back.repartition(BUCKET), [BUCKET, *keys], "full_outer")
        here, changed = F.col("_old").isNotNull(), F.col("_new").isNotNull()
        takes = changed & counts(here)
        if not gone:
            differs = [~F.col(f"`{c}`").eqNullSafe(F.col(f"_new.`{c}`")) for c in given]
            takes = takes & (~here | (F.greatest(F.lit(False), *differs) if differs else F.lit(False)))
        touched = [str(r[0]) for r in both.where(takes).select(BUCKET).distinct().collect()]
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            values = [F.when(takes & F.lit(c in given), F.col(f"_new.`{c}`") if c in given else F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) if c not in keys else F.col(f"`{c}`") for c in names]
            stays = (here & ~takes) if gone else (here | takes)
            after = both.where(F.col(BUCKET).isin([int(b) for b in touched]) & F.coalesce(stays, F.lit(False))).select(*values, BUCKET)
            fresh = self._written(after, meta, folder)
            kept = {b: f for b, f in meta["folders"].items() if b not in touched}
            told = {k: meta[k] for k in ("keys", "buckets", "schema")}
            version = self._commit(told | {"folders": kept | fresh}, version + 1, [folder])
        return version
