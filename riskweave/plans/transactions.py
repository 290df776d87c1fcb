"""Queries of transaction features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import transactions as t
from riskweave.plans.registry import query

W = 30  # steps of the trailing windows: the test ledger has days as steps


@query("t_balance_error", "led", "select row_id, round(oldbalanceOrg - amount - newbalanceOrig, 4) + 0.0 as error_balance_orig, round(oldbalanceDest + amount - newbalanceDest, 4) + 0.0 as error_balance_dest from led")
def t_balance_error(led: DataFrame) -> DataFrame:
    return t.balances(led).select("row_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("error_balance_orig", "error_balance_dest")])


@query("t_calendar", "led", "select row_id, starts_with(nameDest, 'M') as is_merchant_dest, step % 24 as hour_of_day, step // 24 as day_index, timestamp '2010-01-01 00:00:00' + step * interval '1' hour as event_time from led")
def t_calendar(led: DataFrame) -> DataFrame:
    return t.calendar(led).select("row_id", "is_merchant_dest", "hour_of_day", "day_index", "event_time")


@query("t_recency", "led", "select row_id, step - lag(step) over (partition by nameOrig order by step, row_id) as steps_since_prev from led")
def t_recency(led: DataFrame) -> DataFrame:
    return t.recency(led).select("row_id", "steps_since_prev")


OVER = f"over (partition by nameOrig order by step range between {W} preceding and current row)"


@query("t_trailing", "led", f"select row_id, txn_count, round(total_amount, 3) as total_amount, round(case when total_amount / txn_count <> 0 then amount / (total_amount / txn_count) else 1.0 end, 6) as amount_ratio from (select *, count(*) {OVER} as txn_count, sum(amount) {OVER} as total_amount from led) x")
def t_trailing(led: DataFrame) -> DataFrame:
    return t.trailing(led, W).select("row_id", "txn_count", F.round("total_amount", 3).alias("total_amount"), F.round("amount_ratio", 6).alias("amount_ratio"))


@query("t_trailing_distinct", "led", f"select row_id, count(distinct nameDest) {OVER} as unique_dest from led")
def t_trailing_distinct(led: DataFrame) -> DataFrame:
    return t.trailing(led, W).select("row_id", "unique_dest")


@query("t_transfer_cashout", "led", f"select row_id, type = 'CASH_OUT' and coalesce(step - transfer_step <= {W}, false) as is_transfer_then_cashout from led asof left join (select nameOrig as account, step as transfer_step from led where type = 'TRANSFER') r on led.nameOrig = r.account and led.step >= r.transfer_step")
def t_transfer_cashout(led: DataFrame) -> DataFrame:
    return t.transfer_then_cash_out(led, W).select("row_id", "is_transfer_then_cashout")


@query("asof_backward", "led", "select c.row_id, r.amount as last_transfer_amount from (select * from led where type = 'CASH_OUT') c asof left join (select nameOrig as account, step as transfer_step, max(amount) as amount from led where type = 'TRANSFER' group by all) r on c.nameOrig = r.account and c.step >= r.transfer_step")
def asof_backward(led: DataFrame) -> DataFrame:
    return t.as_of(led.where("type = 'CASH_OUT'").select("row_id", "nameOrig", "step"), led.where("type = 'TRANSFER'"), "nameOrig", "step", "amount", "last_transfer_amount").select("row_id", "last_transfer_amount")


ADJACENT = "select distinct nameOrig from (select *, lead(type) over w as nt, lead(step) over w as ns from led where type in ('TRANSFER', 'CASH_OUT') window w as (partition by nameOrig order by step, row_id)) x where type = 'TRANSFER' and nt = 'CASH_OUT' and ns - step between 0 and 30"


@query("t_adjacent_pattern", "led", ADJACENT)
def t_adjacent_pattern(led: DataFrame) -> DataFrame:
    return t.adjacent_pattern(led, W)


@query("t_onehot", "led", "select row_id, type, " + ", ".join(f"(type = '{k}')::int as type_{k}" for k in t.TYPES) + " from led")
def t_onehot(led: DataFrame) -> DataFrame:
    return t.one_hot(led).select("row_id", "type", *[f"type_{k}" for k in t.TYPES])


@query("t_entity_id", "led xwalk", "select row_id, entity_id from led left join xwalk on nameOrig = account")
def t_entity_id(led: DataFrame, xwalk: DataFrame) -> DataFrame:
    return t.with_entity(led, xwalk).select("row_id", "entity_id")


@query("t_account_summary", "led", f"with p as ({ADJACENT.replace('between 0 and 30', 'between 0 and 2')}) select l.nameOrig, count(*) as total_txn_count, round(sum(amount), 3) as total_amount, count_if(type = 'TRANSFER')::bigint as transfer_count, count_if(type = 'CASH_OUT')::bigint as cashout_count, sum(isFraud)::bigint as fraud_count, sum(isFlaggedFraud)::bigint as flagged_fraud_count, l.nameOrig in (select nameOrig from p) as has_transfer_then_cashout from led l group by l.nameOrig having count(*) >= 3")
def t_account_summary(led: DataFrame) -> DataFrame:
    return t.account_summary(led, 3).withColumn("total_amount", F.round("total_amount", 3))


@query("t_entity_coverage", "xwalk led", "select x.account, entity_id, count(l.row_id) as txn_count, count(l.row_id) = 0 as missing, count(l.row_id) = 1 as low_activity from xwalk x left join led l on l.nameOrig = x.account group by x.account, entity_id")
def t_entity_coverage(xwalk: DataFrame, led: DataFrame) -> DataFrame:
    return t.entity_coverage(xwalk, led).select("account", "entity_id", "txn_count", "missing", "low_activity")


@query("t_eligible", "led", "select row_id from led where type in ('TRANSFER', 'CASH_OUT')")
def t_eligible(led: DataFrame) -> DataFrame:
    return t.eligible(led).select("row_id")


@query("t_earliest_fraud", "led", "select nameOrig, row_id, step from led where isFraud = 1 qualify row_number() over (partition by nameOrig order by step, amount, row_id) = 1")
def t_earliest_fraud(led: DataFrame) -> DataFrame:
    return t.earliest_fraud(led).select("nameOrig", "row_id", "step")


@query("t_time_split", "led", """with s as (select step, row_number() over (order by step) - 1 as i, count(*) over () as n from led),
cut as (select max(step) filter (where i = floor(n * 0.6::double)) as a, max(step) filter (where i = floor(n * 0.8::double)) as b from s),
parts as (select case when step <= a then 'train' when step <= greatest(b, a + 1) then 'val' else 'test' end as part, isFraud from led, cut)
select part, count(*) as n_rows, sum(isFraud)::bigint as n_fraud from parts group by part""")
def t_time_split(led: DataFrame) -> DataFrame:
    return t.time_split(led).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("isFraud").alias("n_fraud"))


@query("t_joined_back", "led", """with k as (select distinct nameOrig, step, amount from led where isFraud = 1)
select k.nameOrig, k.step, k.amount, led.row_id, count(*) over (partition by k.nameOrig, k.step, k.amount) as n_rows from k join led on k.nameOrig = led.nameOrig and k.step = led.step and k.amount = led.amount""")
def t_joined_back(led: DataFrame) -> DataFrame:
    return t.joined_back(led.where("isFraud = 1"), led).select("nameOrig", "step", "amount", "row_id", "n_rows")
