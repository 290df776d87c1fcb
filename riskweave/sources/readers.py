"""Scans with their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A file isn't what its contract says."""


def header(spark: SparkSession, path: str, expected: list[str]) -> None:
    """Raise unless the header is exactly the expected list."""
    found = spark.read.option("header", True).csv(path).columns
    if found != expected:
        raise ContractError(f"header {found} differs from {expected}")


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; an empty field stays empty, not null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def one_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file, or a folder with exactly one."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    if len(df.inputFiles()) != 1:
        raise ContractError(f"{path} must hold exactly one file")
    return df


def partition(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """One partition of a Hive-partitioned table; the filter prunes folders."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v).cast(df.schema[k].dataType))
    return df


def backfilled(df: DataFrame, optional: dict[str, Column]) -> DataFrame:
    """Optional columns that are absent, or null, from their expressions."""
    return df.withColumns({c: F.coalesce(F.col(c), e) if c in df.columns else e for c, e in optional.items()})


def lines(spark_path: tuple[SparkSession, str]) -> DataFrame:
    """Non-empty lines of text files."""
    spark, path = spark_path
    return spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")


def entity_mapping(spark: SparkSession, path: str) -> DataFrame:
    """source, raw_id and entity_id of a mapping document whose account ids are a string or a list of strings."""
    schema = "entities array<struct<entity: struct<entity_id: string>, source_ids: struct<cert: struct<user: string>, paysim: struct<nameOrig: string>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    e = doc.select(F.explode("d.entities").alias("e")).select(F.col("e.entity.entity_id").alias("entity_id"), F.col("e.source_ids.cert.user").alias("user"), F.col("e.source_ids.paysim.nameOrig").alias("accounts"))
    several = F.when(F.col("accounts").startswith("["), F.from_json("accounts", "array<string>")).otherwise(F.array("accounts"))
    both = F.concat(F.array(F.struct(F.lit("cert").alias("source"), F.col("user").alias("raw_id"))), F.transform(several, lambda a: F.struct(F.lit("paysim").alias("source"), a.alias("raw_id"))))
    return e.select("entity_id", F.explode(both).alias("s")).select("s.source", "s.raw_id", "entity_id").where("raw_id is not null")


def json_array(spark: SparkSession, path: str, schema: str, field: str | None = None, inner: dict[str, str] | None = None) -> DataFrame:
    """A row for each object of a JSON document's array, which stands alone or in a field; inner: columns that hold JSON as
    text, with its type. Raises if the document has no such array."""
    doc = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{schema}>>"
    rows = doc.select(F.from_json("value", kind).alias("a") if field is None else F.from_json("value", f"struct<`{field}`: {kind}>")[field].alias("a"))
    if rows.where("a is null").limit(1).count():
        raise ContractError(f"{path}: no array{f' {field}' if field else ''}")
    out = rows.select(F.explode("a").alias("x")).select("x.*")
    return out.withColumns({c: F.from_json(c, t) for c, t in (inner or {}).items()})


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Name, size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.sha2("content", 256).alias("sha256"))
