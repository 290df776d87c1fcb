"""Queries of entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import entities as n
from riskweave.operators import transactions as t
from riskweave.operators.ranks import numbered
from riskweave.plans.registry import query

FLAT = "ix as (select 'cert' as source, user_id as raw_id, entity_id from xwalk union all select 'paysim', account, entity_id from xwalk)"


@query("xwalk_flatten", "xwalk", f"with {FLAT} select * from ix")
def xwalk_flatten(xwalk: DataFrame) -> DataFrame:
    return n.flatten(xwalk)


@query("xwalk_conflicts", "led", "select 'paysim' as source, nameOrig as raw_id, count(distinct nameDest) as n_entities from led group by all having count(distinct nameDest) > 1")
def xwalk_conflicts(led: DataFrame) -> DataFrame:
    return n.conflicts(led.select(F.lit("paysim").alias("source"), F.col("nameOrig").alias("raw_id"), F.col("nameDest").alias("entity_id")))


@query("resolve_strict", "act xwalk", "select event_id, entity_id from act left join xwalk on act.user_id = xwalk.user_id")
def resolve_strict(act: DataFrame, xwalk: DataFrame) -> DataFrame:
    return n.resolve(act.select("event_id", "user_id"), n.flatten(xwalk), "cert", "user_id").select("event_id", "entity_id")


@query("xwalk_reverse", "xwalk", f"with {FLAT} select entity_id, array_to_string(list_sort(list(source || ':' || raw_id)), ',') as ids from ix group by entity_id")
def xwalk_reverse(xwalk: DataFrame) -> DataFrame:
    return n.reverse(n.flatten(xwalk))


@query("resolve_fallback", "usr xwalk", "select u.user_id, coalesce(case when role = 'BUILDING' then 'X' || u.user_id end, entity_id, 'CERT:' || u.user_id) as entity from usr u left join xwalk x on u.user_id = x.user_id")
def resolve_fallback(usr: DataFrame, xwalk: DataFrame) -> DataFrame:
    explicit = F.when(F.col("role") == "BUILDING", F.concat(F.lit("X"), "user_id"))
    return usr.join(xwalk.select("user_id", "entity_id"), "user_id", "left").select("user_id", n.with_fallback(explicit, F.col("entity_id"), F.col("user_id")).alias("entity"))


@query("first_n_distinct", "led", "select nameOrig, min(row_id) as first_row from led group by nameOrig order by first_row limit 25")
def first_n_distinct(led: DataFrame) -> DataFrame:
    return n.first_distinct(led, "nameOrig", "row_id", 25)


@query("topk_accounts", "led", "select nameOrig, count(*) as txns, sum(isFraud)::bigint as frauds from led group by nameOrig order by frauds desc, txns desc, nameOrig limit 20")
def topk_accounts(led: DataFrame) -> DataFrame:
    return led.groupBy("nameOrig").agg(F.count(F.lit(1)).alias("txns"), F.sum("isFraud").alias("frauds")).orderBy(F.desc("frauds"), F.desc("txns"), "nameOrig").limit(20)


@query("select_buckets", "usr led", """with s as (select nameOrig, sum(isFraud) as f, round(sum(amount), 3) as a from led group by nameOrig),
fr as (select nameOrig as member from s where f > 0 order by f desc, a desc, nameOrig limit 10),
pr as (select user_id as member from usr where job_title = 'ITAdmin' order by sha256('v1:' || user_id) limit 10),
nm as (select nameOrig as member from s where nameOrig not in (select member from fr) and nameOrig not in (select member from pr) order by sha256('v1:' || nameOrig) limit 10)
select member, 'fraud' as bucket from fr union all select member, 'privileged' from pr union all select member, 'normal' from nm""")
def select_buckets(usr: DataFrame, led: DataFrame) -> DataFrame:
    return n.buckets(usr, t.account_summary(led).withColumn("total_amount", F.round("total_amount", 3)), 10)


@query("assign_entities", "usr", "select user_id, 'G' || cast(k as varchar) as entity_id, ['admin', 'analyst', 'teller'][((k - 1) % 3 + 1)::int] as duty from (select user_id, row_number() over (order by user_id) as k from usr) x")
def assign_entities(usr: DataFrame) -> DataFrame:
    k = numbered(usr.select("user_id"), ["user_id"])
    duty = F.element_at(F.array(*[F.lit(x) for x in ("admin", "analyst", "teller")]), ((F.col("n") - 1) % 3 + 1).cast("int"))
    return k.select("user_id", F.concat(F.lit("G"), F.col("n").cast("string")).alias("entity_id"), duty.alias("duty"))


@query("hash_bridge", "events orders", """with u as (select x, row_number() over (order by sha256('v1:' || x)) as n from (select distinct 'U' || user_id::varchar as x from events) a),
b as (select y, row_number() over (order by sha256('v1:' || y)) as n from (select distinct 'C' || o_custkey::varchar as y from orders) a)
select u.n, x as user_id, y as account from u join b on u.n = b.n""")
def hash_bridge(events: DataFrame, orders: DataFrame) -> DataFrame:
    u = events.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"))
    return n.hash_bridge(u, orders.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account")), "user_id", "account")


@query("first_off_hours", "act", "select user_id, event_time, event_id from act where event_type = 'Logon' and (hour(event_time) < 8 or hour(event_time) >= 18) qualify row_number() over (partition by user_id order by event_time, event_id) = 1")
def first_off_hours(act: DataFrame) -> DataFrame:
    return n.first_off_hours(act.where("event_type = 'Logon'"))
