"""Serving incidents: lifecycle, suppression, upserts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states, and where each action leads from each.
TARGET = {"escalate": "escalated", "acknowledge": "acknowledged", "dismiss": "dismissed"}
ALLOWED = {"new": ("escalated", "acknowledged", "dismissed"), "escalated": ("acknowledged", "dismissed"), "acknowledged": ("escalated", "dismissed"), "dismissed": ()}


def lifecycle(feedback: DataFrame, start: str = "new") -> DataFrame:
    """State of each incident after its actions in order, and how many were not allowed and changed nothing."""
    target = "case x.action " + " ".join(f"when '{a}' then '{s}'" for a, s in TARGET.items()) + " end"
    legal = " or ".join(f"(a.state = '{s}' and {target} in ({', '.join(repr(t) for t in to)}))" for s, to in ALLOWED.items() if to)
    ordered = feedback.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("xs"))
    fold = f"aggregate(xs, named_struct('state', '{start}', 'rejected', 0L), (a, x) -> if(coalesce({legal}, false), named_struct('state', {target}, 'rejected', a.rejected), named_struct('state', a.state, 'rejected', a.rejected + 1L)))"
    return ordered.withColumn("f", F.expr(fold)).select("incident_id", "f.state", "f.rejected")


def suppression(feedback: DataFrame) -> DataFrame:
    """The last dismissal of each entity."""
    last = F.max_by(F.struct("reason", "ts"), F.struct("ts", "seq"))
    return feedback.where("action = 'dismiss'").groupBy("entity_id").agg(last.alias("d")).select("entity_id", "d.reason", "d.ts")


def flagged(incidents: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Incidents with a flag, none left out."""
    return incidents.join(suppressed.select("entity_id", F.lit(True).alias("suppressed")), "entity_id", "left").fillna({"suppressed": False})


def upsert(current: DataFrame, new: DataFrame, key: str, preserve: tuple[str, ...] = ("status",)) -> DataFrame:
    """New rows replace current ones but for the preserved columns; the rest of both stays."""
    names = new.columns
    c, n = current.alias("c"), new.alias("n")
    pick = [F.coalesce(f"c.{x}", f"n.{x}").alias(x) if x in preserve or x == key else F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in names]
    return c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full_outer").select(*pick)


def replace_entities(current: DataFrame, new: DataFrame, entity: str = "entity_id", entities: DataFrame | None = None) -> DataFrame:
    """All rows of the given entities, or of those that occur in new, give way to the new rows; a given entity without new
    rows is left with none."""
    gone = (new if entities is None else entities).select(entity).distinct()
    return current.join(gone, entity, "left_anti").unionByName(new)


def summary(incidents: DataFrame) -> DataFrame:
    """Counts by decision, by confidence and in all, in one pass."""
    sets = incidents.groupingSets([["access_decision"], ["confidence"], []], "access_decision", "confidence")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("access_decision") == "revoke").alias("revoked"))


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Rows in each bin of [0, 1], the last one closed; empty bins are there."""
    spark = rows.sparkSession
    n = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").fillna({"n": 0})


def domain_stats(signals: DataFrame) -> DataFrame:
    """Per domain: signals, how many stand in corroborated incidents, and their mean score."""
    return signals.groupBy("domain").agg(F.count(F.lit(1)).alias("signals"), F.count_if("corroborated").alias("corroborated"), F.avg("score").alias("mean_score"))


def provider_compare(rows: DataFrame) -> DataFrame:
    """What each provider reports; shadow providers are compared, never fused."""
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("entity_id").alias("entities"), F.round(F.avg("score"), 6).alias("mean_score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def exploded(incidents: DataFrame, contributing: str = "contributing_assessments") -> DataFrame:
    """One row for each incident and record."""
    return incidents.withColumn("a", F.explode(contributing)).select("*", "a.*").drop("a", contributing)


def short_gap(minutes: Column) -> Column:
    """A gap as text: 1h 5m, 42m."""
    h, m = F.floor(minutes / 60), F.floor(minutes) % 60
    return F.when(minutes.isNull(), "").when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def reasons_by_domain(signals: DataFrame, k: int = 5) -> DataFrame:
    """Per domain: signals, and the first k of their records by id. Each task sends k records of a domain at most."""
    first = signals.withColumn("__rn", F.row_number().over(Window.partitionBy("domain").orderBy("assessment_id"))).where(F.col("__rn") <= k)
    examples = first.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list("assessment_id")), ",").alias("examples"))
    return signals.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).join(examples, "domain")


def by_landing(incidents: DataFrame, landed: str = "landed_at", last: str = "incident_id") -> DataFrame:
    """The latest landing time first, untimed incidents last."""
    return incidents.orderBy(F.desc_nulls_last(landed), last)
