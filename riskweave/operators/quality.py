"""Data-quality operators over normalised events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import scalars as s

#: Columns of the user dimension.
USER_COLUMNS = ("user_id", "role", "projects", "business_unit", "functional_unit", "department", "team", "end_date")
# The activities of each source.
ACTIVITIES = {"logon": ("Logon", "Logoff"), "device": ("Connect", "Disconnect"), "file": ("File Open", "File Write", "File Copy", "File Delete"), "email": ("Send", "View")}
REQUIRED = ("event_id", "user_id", "pc_id", "event_type")


class QualityError(ValueError):
    """A table breaks its contract."""


def report(events: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Per source: rows, first and last time, missing required values, and exact duplicate ids (rows less distinct ids)."""
    missing = F.col("event_time").isNull().cast("int")
    for c in required:
        missing = missing + (F.coalesce(F.col(c), F.lit("")) == "").cast("int")
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"), F.sum(missing).alias("missing_required"), (F.count(F.lit(1)) - F.count_distinct("event_id")).alias("duplicate_ids"))


def unknown(rows: DataFrame, known: DataFrame, key: str, examples: int = 20) -> DataFrame:
    """How many distinct keys are not known, and the first of them in order."""
    lost = rows.join(known.select(key), key, "left_anti").select(key).distinct()
    some = lost.orderBy(key).limit(examples).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("examples"))
    return lost.agg(F.count(F.lit(1)).alias("n_unknown")).join(some)


def require(found: DataFrame, allowed: int = 0) -> None:
    """Raise unless a report has no missing values and no duplicate ids."""
    bad = found.where((F.col("missing_required") > allowed) | (F.col("duplicate_ids") > allowed)).count()
    if bad:
        raise QualityError(f"{bad} sources fail the quality gate")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order with a unique last column."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def listed(values: DataFrame, kind: str, value: str, examples: int = 20) -> DataFrame:
    """kind, number of distinct values, and the first of them in order; only those few are gathered."""
    distinct = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).distinct()
    some = distinct.orderBy("v").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("examples"))
    return distinct.agg(F.count(F.lit(1)).alias("n")).join(some).select(F.lit(kind).alias("kind"), "n", "examples")  # one row each


def invalid_values(events: DataFrame, user_pattern: str = s.USER_ID, pc_pattern: str = s.PC_ID, activities: dict[str, tuple[str, ...]] = ACTIVITIES) -> DataFrame:
    """Distinct user and PC ids that break their patterns, and activities that their source should not have."""
    expected = F.lit(False)
    for source, kinds in activities.items():
        expected = F.when(F.col("source") == source, F.col("event_type").isin(*kinds)).otherwise(expected)
    users = listed(events.where(~F.col("user_id").rlike(user_pattern)), "user_id", "user_id")
    pcs = listed(events.where(~F.col("pc_id").rlike(pc_pattern)), "pc_id", "pc_id")
    return users.unionByName(pcs).unionByName(listed(events.where(~expected), "event_type", "event_type"))


def user_dimension(users: DataFrame) -> DataFrame:
    """The users with end_time (UTC); raises if a column is missing, an id repeats, or an end date can't be read."""
    missing = [c for c in USER_COLUMNS if c not in users.columns]
    if missing:
        raise QualityError(f"the user dimension lacks {missing}")
    if not users.groupBy("user_id").count().where("count > 1").isEmpty():
        raise QualityError("a user_id occurs twice")
    timed = users.withColumn("end_time", F.coalesce(s.iso_time(F.col("end_date").cast("string")), s.us_time(F.col("end_date").cast("string"))))
    bad = [r[0] for r in timed.where("end_time is null").select("user_id").orderBy("user_id").limit(5).collect()]
    if bad:
        raise QualityError(f"end dates can't be read, as of {bad}")
    return timed


def parsed_times(rows: DataFrame, text: str, out: str, zone: str = "UTC") -> DataFrame:
    """Rows with the UTC time of a local one like 01/31/2010 07:00:00; raises with examples if one can't be read."""
    local = s.us_time(F.col(text))
    bad = [r[0] for r in rows.where(local.isNull()).select(text).limit(5).collect()]
    if bad:
        raise QualityError(f"times can't be read, as {bad}")
    return rows.withColumn(out, s.to_utc_strict(local, zone))
