"""Correlation of assessments from two domains into incidents with a graded access decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scalars import half_even

WINDOW_MINUTES = 120
FIRING, BONUS = 0.5, 0.15
WEIGHTS = {"ps1_behavioral": 1.0, "ps2_transaction": 1.0}


def invalid(assessments: DataFrame) -> DataFrame:
    """errors: the names of the rules that each record breaks, none for an accepted one."""
    rules = {
        "assessment_id": F.coalesce(F.trim("assessment_id"), F.lit("")) == "",
        "entity_id": F.coalesce(F.trim("entity_id"), F.lit("")) == "",
        "domain": ~F.coalesce(F.col("domain").isin(*WEIGHTS), F.lit(False)),
        "score": ~F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False)),
    }
    return assessments.withColumn("errors", F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull()))


def inferred_domain(domains: Column) -> Column:
    """The most frequent of an array of domains, the first by name at a tie."""
    counted = F.transform(F.array_distinct(domains), lambda d: F.struct((-F.size(F.filter(domains, lambda x: x == d))).alias("n"), d.alias("d")))
    return F.array_min(counted)["d"]


def dedupe(assessments: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each id."""
    w = Window.partitionBy("assessment_id").orderBy(*order)
    return assessments.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def new_only(assessments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records whose ids the ledger does not have."""
    return assessments.join(ledger.select("assessment_id"), "assessment_id", "left_anti")


def anchored(assessments: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """anchor: the time that opens each record's window.

    A window opens at its entity's earliest record not yet in one and holds what comes at most `minutes` later. Behind a gap
    longer than that a window opens anyway, so an entity's history is cut there first, and only the times between two gaps
    are folded together, each distinct one once. Untimed records are windows of their own (anchor null).
    """
    limit = minutes * 60_000_000
    w = Window.partitionBy("entity_id").orderBy("t")
    times = assessments.where("event_time is not null").select("entity_id", F.unix_micros("event_time").alias("t"))
    times = times.withColumn("gap", F.coalesce(F.col("t") - F.lag("t").over(w) > limit, F.lit(False)).cast("int")).withColumn("stretch", F.sum("gap").over(w))
    times = times.groupBy("entity_id", "stretch").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    step = "named_struct('open', {o}, 'out', concat(a.out, array(named_struct('t', t, 'anchor', {o}))))".format(o="if(a.open is null or t - a.open > %d, t, a.open)" % limit)
    fold = f"aggregate(ts, named_struct('open', cast(null as bigint), 'out', cast(array() as array<struct<t: bigint, anchor: bigint>>)), (a, t) -> {step}, a -> a.out)"
    anchors = times.select("entity_id", F.explode(F.expr(fold)).alias("w")).select("entity_id", F.timestamp_micros("w.t").alias("event_time"), F.timestamp_micros("w.anchor").alias("anchor"))
    return assessments.join(anchors, ["entity_id", "event_time"], "left")


def window_key() -> Column:
    """What tells an entity's windows apart: the anchor, or the record itself if untimed."""
    return F.coalesce(F.col("anchor").cast("string"), F.col("assessment_id"))


def strongest(windowed: DataFrame) -> DataFrame:
    """The record with the highest score of each domain in a window; the newer, then the smaller id, at a tie."""
    w = Window.partitionBy("entity_id", "window", "domain").orderBy(F.desc("score"), F.desc_nulls_last("event_time"), "assessment_id")
    return windowed.withColumn("window", window_key()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def fused(score: str = "score", domain: str = "domain", weights: dict[str, float] | None = None) -> tuple[Column, Column]:
    """Combined score and number of firing domains of a group of strongest records."""
    w = F.lit(1.0)
    for name, value in (weights or WEIGHTS).items():
        w = F.when(F.col(domain) == name, F.lit(value)).otherwise(w)
    average = F.sum(w * F.col(score)) / F.sum(w)
    firing = F.count_if(F.col(score) >= FIRING)
    boosted = F.when(firing >= 2, F.least(F.lit(1.0), average + (1 - average) * BONUS * (firing - 1))).otherwise(average)
    return half_even(boosted, 4), firing


def confidence(firing: Column) -> Column:
    return F.when(firing >= 2, "high").otherwise("low")


def decision(score: Column, conf: Column) -> Column:
    """Revoking takes two independent domains, whatever the score."""
    return F.when((score >= 0.9) & (conf == "high"), "revoke").when(score >= 0.7, "step_up_auth").when(score >= 0.4, "throttle").otherwise("allow")


def uuid5(namespace: str, name: Column) -> Column:
    """The UUID of version 5 as text: the SHA-1 of namespace and name with its version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


INCIDENTS = "7c9e6679-7425-40de-944b-e07fc1f90ae7"


def incidents(windowed: DataFrame) -> DataFrame:
    """One incident for each window: fused score, decision, sorted domains and the strongest records that made it."""
    top = strongest(windowed)
    score, firing = fused()
    out = top.groupBy("entity_id", "window").agg(
        score.alias("combined_score"), firing.alias("firing"), F.array_sort(F.collect_set("domain")).alias("contributing_domains"),
        F.array_sort(F.collect_list(F.struct("assessment_id", "domain", "score", "event_time"))).alias("contributing_assessments"), F.max("event_time").alias("landed_at"),
    )
    out = out.withColumn("confidence", confidence(F.col("firing")))
    return out.withColumns({"access_decision": decision(F.col("combined_score"), F.col("confidence")), "status": F.when(F.col("firing") >= 2, "escalated").otherwise("new"), "incident_id": uuid5(INCIDENTS, F.concat_ws(":", "entity_id", "window"))})


def gap_minutes(contributing: Column) -> Column:
    """Minutes between the first and last contributing times; null with fewer than two."""
    times = F.filter(F.transform(contributing, lambda a: F.unix_micros(a["event_time"])), lambda t: t.isNotNull())
    return F.when(F.size(times) >= 2, (F.array_max(times) - F.array_min(times)) / 60_000_000)


def recorrelate(ledger: DataFrame, arrived: DataFrame, current: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Incidents after new records: only entities that got some are windowed again, whole, so late records land right."""
    new = new_only(arrived, ledger)
    touched = new.select("entity_id").distinct()
    again = incidents(anchored(ledger.join(touched, "entity_id", "left_semi").unionByName(new), minutes))
    return current.join(touched, "entity_id", "left_anti").unionByName(again)


def overlap_match(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each new incident, the old one that shares most of its records (the smaller id at a tie)."""
    flat = lambda df, name: df.select(F.col("incident_id").alias(name), F.explode("contributing_assessments.assessment_id").alias("assessment_id"))
    shared = flat(old, "old_id").join(flat(new, "new_id"), "assessment_id").groupBy("new_id", "old_id").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("new_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "old_id")).alias("b")).select("new_id", F.col("b.old_id").alias("old_id"))


def band_join(alerts: DataFrame, tx: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Each user's nearest transaction within `minutes` of an alert, higher risk first at a tie.

    Alerts join the bands of time that they can reach, so a key with many rows meets only near ones.
    """
    width = minutes * 60
    band = F.floor(F.unix_seconds("txn_time") / width)
    reach = F.floor(F.unix_seconds("alert_time") / width)
    a = alerts.withColumn("band", F.explode(F.array(reach - 1, reach, reach + 1)))
    met = a.join(tx.withColumn("band", band), ["account", "band"])
    gap = F.abs(F.unix_micros("alert_time") - F.unix_micros("txn_time")) / 60_000_000
    near = met.withColumn("gap_minutes", gap).where(F.col("gap_minutes") <= minutes)
    w = Window.partitionBy("user_id").orderBy("gap_minutes", F.desc("risk"), "alert_id", "row_id")
    return near.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "band")


def scenarios(pairs: DataFrame, n: int = 17) -> DataFrame:
    """The n best pairs by risk and gap, numbered."""
    top = pairs.orderBy(F.desc("risk"), "gap_minutes", "user_id").limit(n)
    k = F.row_number().over(Window.orderBy(F.desc("risk"), "gap_minutes", "user_id"))
    return top.withColumn("scenario_id", F.format_string("GLOBAL-%02d", k))
