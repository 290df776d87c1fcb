"""Entity resolution: crosswalks, selections and bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ResolutionError(ValueError):
    """An id has no entity, or has two."""


def flatten(crosswalk: DataFrame, strict: bool = False) -> DataFrame:
    """source, raw_id, entity_id from a crosswalk with one column a source; null ids are skipped.

    strict raises if an id names two entities.
    """
    sources = F.array(F.struct(F.lit("cert").alias("source"), F.col("user_id").alias("raw_id")), F.struct(F.lit("paysim").alias("source"), F.col("account").alias("raw_id")))
    index = crosswalk.select("entity_id", F.explode(sources).alias("s")).select("s.source", "s.raw_id", "entity_id").where("raw_id is not null")
    if strict and (bad := conflicts(index).limit(5).collect()):
        raise ResolutionError(f"ids of two entities: {', '.join(f'{r.source}:{r.raw_id}' for r in bad)}")
    return index


def conflicts(index: DataFrame) -> DataFrame:
    """(source, raw_id) that name more than one entity."""
    return index.groupBy("source", "raw_id").agg(F.count_distinct("entity_id").alias("n_entities")).where("n_entities > 1")


def resolve(rows: DataFrame, index: DataFrame, source: str, raw: str, strict: bool = False) -> DataFrame:
    """entity_id of the raw id; strict raises if one has none."""
    known = index.where(F.col("source") == source).select(F.col("raw_id").alias(raw), "entity_id")
    if strict and rows.join(known, raw, "left_anti").limit(1).count():
        raise ResolutionError(f"unknown ids of source {source}")
    return rows.join(known, raw, "left")


def with_fallback(explicit: Column, mapped: Column, user: Column) -> Column:
    return F.coalesce(explicit, mapped, F.concat(F.lit("CERT:"), user))


def reverse(index: DataFrame) -> DataFrame:
    """All ids of each entity, as source:id in order."""
    return index.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", "raw_id"))), ",").alias("ids"))


def first_distinct(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n distinct keys in the order of their first rows."""
    return rows.groupBy(key).agg(F.min(order).alias("first_row")).orderBy("first_row").limit(n)


def buckets(users: DataFrame, summary: DataFrame, k: int, version: str = "v1") -> DataFrame:
    """k accounts with fraud, then k privileged users' names, then k others by hash; each leaves out the ones before."""
    fraud = summary.where("fraud_count > 0").orderBy(F.desc("fraud_count"), F.desc("total_amount"), "nameOrig").limit(k).select(F.col("nameOrig").alias("member"), F.lit("fraud").alias("bucket"))
    privileged = users.where("job_title = 'ITAdmin'").select(F.col("user_id").alias("member")).orderBy(F.sha2(F.concat(F.lit(f"{version}:"), "member"), 256)).limit(k).withColumn("bucket", F.lit("privileged"))
    rest = summary.select(F.col("nameOrig").alias("member")).join(fraud, "member", "left_anti").join(privileged, "member", "left_anti")
    normal = rest.orderBy(F.sha2(F.concat(F.lit(f"{version}:"), "member"), 256)).limit(k).withColumn("bucket", F.lit("normal"))
    return fraud.unionByName(privileged).unionByName(normal)


def hash_bridge(left: DataFrame, right: DataFrame, a: str, b: str, version: str = "v1") -> DataFrame:
    """Pairs of the two sides' distinct values, each side in the order of its hashes.

    Places come from counts per hash prefix and ranks within the prefix, so no task holds a whole side.
    """

    def placed(df: DataFrame, c: str) -> DataFrame:
        h = df.select(c).distinct().withColumn("__h", F.sha2(F.concat(F.lit(f"{version}:"), c), 256)).withColumn("__p", F.substring("__h", 1, 2))
        sizes = h.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # 256 rows at most
        before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).select("__p", "__before")
        rank = F.row_number().over(Window.partitionBy("__p").orderBy("__h"))
        return h.join(F.broadcast(before), "__p").withColumn("n", F.col("__before") + rank).select(c, "n")

    return placed(left, a).join(placed(right, b), "n")


def first_off_hours(logons: DataFrame, start: int = 8, end: int = 18) -> DataFrame:
    """Each user's first logon outside working hours."""
    hour = F.hour("event_time")
    off = logons.where((hour < start) | (hour >= end))
    return off.groupBy("user_id").agg(F.min(F.struct("event_time", "event_id")).alias("m")).select("user_id", "m.event_time", "m.event_id")
