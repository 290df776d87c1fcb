"""Tables that change in whole versions: upserts, inserts and replacements that a lost writer can't leave half done.

A table is a folder. Rows lie in data folders, one a bucket and change; a version is a small file that names the data folder of
each bucket. A change reads the buckets that its new rows touch, writes them anew and then moves its version file to the next
number by one rename. Of two writers that started from the same version one gets the number; the other reads the new version
and does its change again. Readers see the newest version, whole; earlier ones stay readable until they are dropped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators import incidents as n


class Conflict(RuntimeError):
    """Other writers took every version that was tried for."""


class VersionedTable:
    """bucket_by: columns that decide a row's bucket; a key must lie in one bucket, so they are the key or depend on it."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, bucket_by: list[str], buckets: int = 16):
        self.spark, self.path, self.bucket_by, self.buckets = spark, path.rstrip("/"), bucket_by, buckets
        self.schema = spark.createDataFrame([], schema if isinstance(schema, str) else schema.simpleString()).schema  # all nullable
        self.fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The newest version, 0 for a table without any."""
        log = self._path("log")
        if not self.fs.exists(log):
            return 0
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(log) if s.getPath().getName().isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"id": None, "data": {}}
        lines = self.spark.sparkContext._jvm.scala.io.Source.fromInputStream(self.fs.open(self._path(f"log/{version:012d}/manifest")), "UTF-8")
        try:
            return json.loads(lines.mkString())
        finally:
            lines.close()

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows; the newest one's, if none is named."""
        return self._folders(list(self._manifest(self.version() if version is None else version)["data"].values()))

    def change(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], everywhere: bool = False, attempts: int = 5) -> int:
        """The version in which the touched buckets hold merge(their rows, new); all buckets are touched if `everywhere`."""
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        touched = list(range(self.buckets)) if everywhere else sorted(r[0] for r in new.select(self._bucket().alias("b")).distinct().collect())  # a number a bucket
        for _ in range(attempts):
            base = self.version()
            data = self._manifest(base)["data"]
            current = self._folders([data[str(b)] for b in touched if str(b) in data])
            change = uuid.uuid4().hex
            merged = merge(current, new).select(*self.schema.names).withColumn("__bucket", self._bucket())
            merged.repartition(len(touched) or 1, "__bucket").write.partitionBy("__bucket").option("compression", "zstd").parquet(f"{self.path}/data/{change}")
            made = {int(s.getPath().getName().split("=")[1]) for s in self.fs.listStatus(self._path(f"data/{change}")) if "=" in s.getPath().getName()}
            left = {b: f for b, f in data.items() if int(b) not in touched}
            if self._commit(base + 1, {"id": change, "data": left | {str(b): f"{change}/__bucket={b}" for b in sorted(made)}}):
                return base + 1
            self.fs.delete(self._path(f"data/{change}"), True)
        raise Conflict(f"{self.path}: {attempts} versions went to other writers")

    def _commit(self, version: int, manifest: dict) -> bool:
        """Whether this manifest has become the version. A folder moves to a name that is free, or else into the folder that
        has the name, or not at all; so the manifest at its place tells who came first."""
        stage = f".stage-{manifest['id']}"
        out = self.fs.create(self._path(f"{stage}/manifest"))
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        self.fs.mkdirs(self._path("log"))
        to = self._path(f"log/{version:012d}")
        try:
            if not self.fs.exists(to):
                self.fs.rename(self._path(stage), to)
            return self._manifest(version)["id"] == manifest["id"]
        finally:
            self.fs.delete(self._path(stage), True)
            self.fs.delete(self._path(f"log/{version:012d}/{stage}"), True)

    def insert_new(self, rows: DataFrame, key: str) -> int:
        """Rows whose keys the table has not; of rows that repeat a key one is taken. Doing it again changes nothing."""
        return self.change(rows, lambda current, new: current.unionByName(new.dropDuplicates([key]).join(current.select(key), key, "left_anti").select(*current.columns)))

    def upsert(self, rows: DataFrame, key: str, preserve: tuple[str, ...] = ("status",)) -> int:
        """Rows take the place of those with their keys, but for the preserved columns."""
        return self.change(rows, lambda current, new: n.upsert(current, new, key, preserve))

    def replace(self, rows: DataFrame, entity: str = "entity_id") -> int:
        """Rows take the place of all rows of their entities."""
        return self.change(rows, lambda current, new: n.replace_entities(current, new, entity), everywhere=entity not in self.bucket_by)

    def overwrite(self, rows: DataFrame) -> int:
        """Rows take the place of all."""
        return self.change(rows, lambda current, new: new, everywhere=True)

    def drop_before(self, version: int) -> None:
        """Forget versions before this one, and data that later ones don't name."""
        named = {f.split("/")[0] for v in range(version, self.version() + 1) for f in self._manifest(v)["data"].values()}
        for v in range(1, version):
            self.fs.delete(self._path(f"log/{v:012d}"), True)
        for s in self.fs.listStatus(self._path("data")) if self.fs.exists(self._path("data")) else []:
            if s.getPath().getName() not in named:
                self.fs.delete(s.getPath(), True)
