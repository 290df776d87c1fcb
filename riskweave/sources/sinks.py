"""Sinks: CSV, text, partitioned Parquet and reports, each into a new folder of the warehouse or of the path given."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(spark: SparkSession) -> str:
    """A new path in the session's warehouse, which the whole cluster sees."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/riskweave-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a local one on a local master, an error on a cluster without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_.get() if set_.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="riskweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows written to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str | None = None) -> str:
    path = path or fresh(df.sparkSession)
    df.write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)
    return path


def write_lines(df: DataFrame, path: str | None = None) -> tuple[SparkSession, str]:
    path = path or fresh(df.sparkSession)
    df.write.mode("errorifexists").text(path)
    return df.sparkSession, path


def write_partitioned(df: DataFrame, keys: list[str], path: str | None = None, missing: dict[str, str] | None = None) -> str:
    """zstd Parquet by keys; columns that the table should have and df hasn't are null. An existing path is refused."""
    path = path or fresh(df.sparkSession)
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in (missing or {}).items() if c not in df.columns}) if missing else df
    df.repartition(*keys).write.mode("errorifexists").partitionBy(*keys).option("compression", "zstd").parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> None:
    """A few rows of figures as JSON lines."""
    df.coalesce(1).write.mode("errorifexists").json(path)


class OutputExists(ValueError):
    """A result stands where another should be written."""


def published(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let `write` fill a staging folder beside path and then rename it, so that readers see all of a result or none.

    An existing path is refused before anything is written; a failed write leaves nothing behind.
    """
    jvm, stage = spark._jvm, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    to, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(stage)
    fs = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(to):
        raise OutputExists(path)
    try:
        write(stage)
        if fs.exists(to) or not fs.rename(staged, to):
            raise OutputExists(path)
    finally:
        fs.delete(staged, True)
    return path
