"""Queries of correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import correlation as c
from riskweave.plans.registry import half_even_sql, query

BAD = "case when entity_id like '%7' then '' else entity_id end as entity_id, case when score = 1 then 1.5 else score end as score, case when assessment_id like '%99' then 'other' else domain end as domain"
BAD_SPARK = ["assessment_id", "case when entity_id like '%7' then '' else entity_id end as entity_id", "case when score = 1 then 1.5 else score end as score", "case when assessment_id like '%99' then 'other' else domain end as domain"]


@query("c_validate", "asm", f"select assessment_id, array_to_string(list_filter([case when entity_id = '' then 'entity_id' end, case when domain = 'other' then 'domain' end, case when score > 1 then 'score' end], lambda x: x is not null), ',') as errors from (select assessment_id, {BAD} from asm) x")
def c_validate(asm: DataFrame) -> DataFrame:
    return c.invalid(asm.selectExpr(*BAD_SPARK)).select("assessment_id", F.array_join("errors", ",").alias("errors"))


@query("dlq_split", "asm", f"select (entity_id <> '' and domain <> 'other' and score <= 1) as accepted, count(*) as n from (select assessment_id, {BAD} from asm) x group by 1")
def dlq_split(asm: DataFrame) -> DataFrame:
    return c.invalid(asm.selectExpr(*BAD_SPARK)).groupBy((F.size("errors") == 0).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


@query("c_domain", "asm", "select entity_id, domain from (select entity_id, domain, count(*) as n from asm group by all) x qualify row_number() over (partition by entity_id order by n desc, domain) = 1")
def c_domain(asm: DataFrame) -> DataFrame:
    return asm.groupBy("entity_id").agg(F.collect_list("domain").alias("d")).select("entity_id", c.inferred_domain(F.col("d")).alias("domain"))


TWICE = "tw as (select *, 1 as arrival from asm union all select assessment_id, entity_id, domain, 0.0 as score, event_time, 0 as arrival from asm where assessment_id like '%3')"


@query("c_dedupe", "asm", f"with {TWICE} select assessment_id, score from tw qualify row_number() over (partition by assessment_id order by arrival) = 1")
def c_dedupe(asm: DataFrame) -> DataFrame:
    again = asm.where("assessment_id like '%3'").withColumns({"score": F.lit(0.0), "arrival": F.lit(0)})
    return c.dedupe(asm.withColumn("arrival", F.lit(1)).unionByName(again), ["arrival"]).select("assessment_id", "score")


ANCHORED = """ts as (select entity_id, event_time, row_number() over (partition by entity_id order by event_time) as k from (select distinct entity_id, event_time from asm where event_time is not null) d),
fold as (select entity_id, event_time, k, event_time as anchor from ts where k = 1
  union all select t.entity_id, t.event_time, t.k, case when epoch_us(t.event_time) - epoch_us(f.anchor) > 7200000000 then t.event_time else f.anchor end from fold f join ts t on t.entity_id = f.entity_id and t.k = f.k + 1),
an as (select a.*, f.anchor, coalesce(f.anchor::varchar, a.assessment_id) as window_ from asm a left join fold f on a.entity_id = f.entity_id and a.event_time = f.event_time)"""
STRONG = f"{ANCHORED}, st as (select * from an qualify row_number() over (partition by entity_id, window_, domain order by score desc, event_time desc nulls last, assessment_id) = 1)"
FUSED = f"""{STRONG},
f0 as (select entity_id, window_, min(anchor) as anchor, avg(score) as a, count_if(score >= 0.5) as firing, array_to_string(list_sort(list(distinct domain)), ',') as domains, array_to_string(list_sort(list(assessment_id)), ',') as members, max(event_time) as landed_at, min(event_time) as first_at, count(event_time) as timed from st group by entity_id, window_),
fu as (select *, {half_even_sql("case when firing >= 2 then least(1.0, a + (1 - a) * 0.15 * (firing - 1)) else a end", 4)} as combined_score, case when firing >= 2 then 'high' else 'low' end as confidence from f0),
inc as (select *, case when combined_score >= 0.9 and confidence = 'high' then 'revoke' when combined_score >= 0.7 then 'step_up_auth' when combined_score >= 0.4 then 'throttle' else 'allow' end as access_decision, case when firing >= 2 then 'escalated' else 'new' end as status from fu)"""


@query("c_anchor_windows", "asm", f"with recursive {ANCHORED} select assessment_id, anchor from an where event_time is not null")
def c_anchor_windows(asm: DataFrame) -> DataFrame:
    return c.anchored(asm).where("event_time is not null").select("assessment_id", "anchor")


@query("c_untimed", "asm", "select assessment_id, entity_id from asm where event_time is null")
def c_untimed(asm: DataFrame) -> DataFrame:
    return c.anchored(asm).withColumn("window", c.window_key()).where("window = assessment_id").select("assessment_id", "entity_id")


@query("c_strongest", "asm", f"with recursive {STRONG} select assessment_id from st")
def c_strongest(asm: DataFrame) -> DataFrame:
    return c.strongest(c.anchored(asm)).select("assessment_id")


def incidents(asm: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.col("contributing_assessments.assessment_id")), ",")
    return c.incidents(c.anchored(asm)).withColumns({"members": ids, "domains": F.array_join("contributing_domains", ",")})


@query("c_fuse", "asm", f"with recursive {FUSED} select entity_id, members, combined_score, firing::bigint as firing from inc")
def c_fuse(asm: DataFrame) -> DataFrame:
    return incidents(asm).select("entity_id", "members", "combined_score", "firing")


@query("c_decide", "asm", f"with recursive {FUSED} select access_decision, confidence, count(*) as n from inc group by all")
def c_decide(asm: DataFrame) -> DataFrame:
    return incidents(asm).groupBy("access_decision", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("c_incidents", "asm", f"with recursive {FUSED} select entity_id, members, domains, combined_score, status, access_decision, confidence, landed_at from inc")
def c_incidents(asm: DataFrame) -> DataFrame:
    return incidents(asm).select("entity_id", "members", "domains", "combined_score", "status", "access_decision", "confidence", "landed_at")


@query("c_overlap_match", "asm", f"""with recursive {FUSED}, m as (select entity_id || ':' || members as incident, unnest(string_split(members, ',')) as a from inc)
select new_id, old_id from (select n.incident as new_id, o.incident as old_id, count(*) as k from m n join m o on n.a = o.a and not (n.incident like '%0:%') group by all) p qualify row_number() over (partition by new_id order by k desc, old_id) = 1""")
def c_overlap_match(asm: DataFrame) -> DataFrame:
    found = incidents(asm).withColumn("incident_id", F.concat_ws(":", "entity_id", "members"))
    return c.overlap_match(found, found.where("not incident_id like '%0:%'"))


@query("c_incremental", "asm", f"with recursive {FUSED} select entity_id, members, combined_score, access_decision from inc")
def c_incremental(asm: DataFrame) -> DataFrame:
    late = asm.where("assessment_id like '%5'")
    ledger = asm.where("not assessment_id like '%5'")
    after = c.recorrelate(ledger, late, c.incidents(c.anchored(ledger)))
    return after.select("entity_id", F.array_join(F.array_sort(F.col("contributing_assessments.assessment_id")), ",").alias("members"), "combined_score", "access_decision")


@query("c_gap_minutes", "asm", f"with recursive {FUSED} select entity_id, members, case when timed >= 2 then round((epoch_us(landed_at) - epoch_us(first_at)) / 60000000.0, 6) end as gap_minutes from inc")
def c_gap_minutes(asm: DataFrame) -> DataFrame:
    return incidents(asm).select("entity_id", "members", F.round(c.gap_minutes(F.col("contributing_assessments")), 6).alias("gap_minutes"))


BAND = """al as (select event_id as alert_id, user_id, event_time as alert_time, email_size / 1700.0::double as risk, 'C' || user_key::varchar as account from act where source = 'email'),
tx as (select row_id, nameOrig as account, timestamp '2024-01-01 00:00:00' + (row_id * 137 % 43200) * interval '1' minute as txn_time from led),
nr as (select user_id, alert_id, row_id, risk, abs(epoch_us(alert_time) - epoch_us(txn_time)) / 60000000.0 as gap_minutes from al join tx on al.account = tx.account where abs(epoch_us(alert_time) - epoch_us(txn_time)) <= 7200000000
  qualify row_number() over (partition by user_id order by gap_minutes, risk desc, alert_id, row_id) = 1)"""


def _pairs(act: DataFrame, led: DataFrame) -> DataFrame:
    alerts = act.where("source = 'email'").select(F.col("event_id").alias("alert_id"), "user_id", F.col("event_time").alias("alert_time"), (F.col("email_size") / 1700.0).alias("risk"), F.concat(F.lit("C"), F.col("user_key").cast("string")).alias("account"))
    tx = led.select("row_id", F.col("nameOrig").alias("account"), F.timestamp_add("MINUTE", F.pmod(F.col("row_id") * 137, F.lit(43200)), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("txn_time"))
    return c.band_join(alerts, tx)


@query("c_band_join", "act led", f"with {BAND} select user_id, alert_id, row_id, round(risk, 6) as risk, round(gap_minutes, 6) as gap_minutes from nr")
def c_band_join(act: DataFrame, led: DataFrame) -> DataFrame:
    return _pairs(act, led).select("user_id", "alert_id", "row_id", F.round("risk", 6).alias("risk"), F.round("gap_minutes", 6).alias("gap_minutes"))


@query("c_semi_back", "led", "select row_id, amount from led where row_id in (select min(row_id) from led where isFraud = 1 group by nameOrig)")
def c_semi_back(led: DataFrame) -> DataFrame:
    keys = led.where("isFraud = 1").groupBy("nameOrig").agg(F.min("row_id").alias("row_id"))
    return led.join(keys.select("row_id"), "row_id", "left_semi").select("row_id", "amount")


@query("c_scenarios", "act led", f"with {BAND} select 'GLOBAL-' || lpad((row_number() over (order by risk desc, gap_minutes, user_id))::varchar, 2, '0') as scenario_id, user_id, row_id from nr order by risk desc, gap_minutes, user_id limit 17")
def c_scenarios(act: DataFrame, led: DataFrame) -> DataFrame:
    return c.scenarios(_pairs(act, led)).select("scenario_id", "user_id", "row_id")
