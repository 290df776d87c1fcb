"""Queries of model operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import models as m
from riskweave.operators import transactions as t
from riskweave.operators.ranks import quantiles
from riskweave.plans.behaviour import ALL_Z, ALL_ZS, FEATURES, Z, ZS, all_scored, scored
from riskweave.plans.registry import half_even_sql, query
from riskweave.sources.sinks import kept


@query("m_date_split", "act", "select event_date, case when k <= floor(n * 0.6::double) then 'train' when k <= floor(n * 0.6::double) + floor(n * 0.2::double) then 'val' else 'test' end as part from (select event_date, row_number() over (order by event_date) as k, count(*) over () as n from (select distinct event_date from act) d) x")
def m_date_split(act: DataFrame) -> DataFrame:
    return m.date_split(act)


@query("m_stratified", "act", "select event_date, event_id from act qualify row_number() over (partition by event_date order by sha256('42:' || event_id), event_id) <= 20")
def m_stratified(act: DataFrame) -> DataFrame:
    return m.stratified(act, "event_date", "event_id", 20).select("event_date", "event_id")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("m_variance", "lineitem", " union all ".join(f"select '{c}' as feature, round(var_pop({c}::double), 4) as variance, var_pop({c}::double) > 1e-12 as kept from lineitem" for c in NUMBERS))
def m_variance(lineitem: DataFrame) -> DataFrame:
    return m.variances(lineitem.select(*[F.col(c).cast("double") for c in NUMBERS]), NUMBERS).withColumn("variance", F.round("variance", 4))


@query("m_robust_scale", "lineitem", " union all ".join(f"select '{c}' as feature, round(quantile_cont({c}::double, 0.5), 6) as center, round(case when quantile_cont({c}::double, 0.75) = quantile_cont({c}::double, 0.25) then 1.0 else quantile_cont({c}::double, 0.75) - quantile_cont({c}::double, 0.25) end, 6) as scale from lineitem" for c in NUMBERS))
def m_robust_scale(lineitem: DataFrame) -> DataFrame:
    return m.robust_parameters(lineitem.select(*[F.col(c).cast("double") for c in NUMBERS]), NUMBERS).select("feature", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


GREATEST = f"greatest({', '.join(f'abs({z})' for z in ZS)}, 0.0)"


@query("m_max_abs_z", "act usr", f"with {Z} select user_id, window_start, round({GREATEST}, 6) as max_abs_z from zs")
def m_max_abs_z(act: DataFrame, usr: DataFrame) -> DataFrame:
    return scored(act, usr).select("user_id", "window_start", F.round(m.max_abs(ZS), 6).alias("max_abs_z"))


@query("m_knots", "events", "select i::int as i, round(quantile_cont_at, 6) as knot from (select unnest(range(1001)) as i, unnest((select quantile_cont(value::double, list_transform(range(1001), lambda i: i / 1000.0::double)) from events)) as quantile_cont_at) x")
def m_knots(events: DataFrame) -> DataFrame:
    return m.knots(events, "value").select("i", F.round("knot", 6).alias("knot"))


@query("m_alerts", "events", "select event_id from (select event_id, percent_rank() over (order by value) as risk from events) x where risk >= 0.99")
def m_alerts(events: DataFrame) -> DataFrame:
    return m.alerts(events, "value").select("event_id")


TOP = "list_slice(list_sort(list_filter([" + ", ".join(f"{{'size': -abs({z}), 'place': {i}, 'name': '{z}', 'z': {z}}}" for i, z in enumerate(ZS)) + "], lambda x: x.z <> 0)), 1, 3)"


@query("m_top_deviations", "act usr", f"with {Z} select user_id, window_start, array_to_string(list_transform({TOP}, lambda x: x.name), ',') as top from zs")
def m_top_deviations(act: DataFrame, usr: DataFrame) -> DataFrame:
    top = m.top_deviations(ZS)
    return scored(act, usr).select("user_id", "window_start", F.array_join(F.transform(top, lambda x: x["name"]), ",").alias("top"))


@query("m_reasons", "act usr", f"with {Z} select user_id, window_start, len({TOP})::int as n_reasons, round(case when len({TOP}) > 0 then least(1.0, abs({TOP}[1].z) / 25) else 0.0 end, 9) as first_weight from zs")
def m_reasons(act: DataFrame, usr: DataFrame) -> DataFrame:
    df = scored(act, usr).withColumn("top", m.top_deviations(ZS)).withColumn("reasons", m.reasons(F.col("top")))
    return df.select("user_id", "window_start", F.size("top").alias("n_reasons"), F.round(F.col("reasons")[0]["weight"], 9).alias("first_weight"))


ALL_TOP = "list_slice(list_sort(list_filter([" + ", ".join(f"{{'size': -abs({z}), 'place': {i}, 'name': '{z}', 'z': {z}}}" for i, z in enumerate(ALL_ZS)) + "], lambda x: x.z <> 0)), 1, 3)"


@query("m_max_abs_z_all", "act usr", f"with {ALL_Z} select user_id, window_start, round(greatest({', '.join(f'abs({z})' for z in ALL_ZS)}, 0.0), 6) as max_abs_z from zs")
def m_max_abs_z_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    return all_scored(act, usr).select("user_id", "window_start", F.round(m.max_abs(ALL_ZS), 6).alias("max_abs_z"))


@query("m_top_deviations_all", "act usr", f"with {ALL_Z}, tops as (select *, {ALL_TOP} as top3 from zs) select user_id, window_start, array_to_string(list_transform(top3, lambda x: x.name), ',') as top from tops")
def m_top_deviations_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    top = m.top_deviations(ALL_ZS)
    return all_scored(act, usr).select("user_id", "window_start", F.array_join(F.transform(top, lambda x: x["name"]), ",").alias("top"))


@query("m_reasons_all", "act usr", f"with {ALL_Z}, tops as (select *, {ALL_TOP} as top3 from zs) select user_id, window_start, len(top3)::int as n_reasons, round(case when len(top3) > 0 then least(1.0, abs(top3[1].z) / 25) else 0.0 end, 9) as first_weight from tops")
def m_reasons_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    df = all_scored(act, usr).withColumn("top", m.top_deviations(ALL_ZS)).withColumn("reasons", m.reasons(F.col("top")))
    return df.select("user_id", "window_start", F.size("top").alias("n_reasons"), F.round(F.col("reasons")[0]["weight"], 9).alias("first_weight"))


@query("m_distribution", "events", "select round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, min(value) as min, max(value) as max from events")
def m_distribution(events: DataFrame) -> DataFrame:
    return m.distribution(events, "value").select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p95", "p99")], "min", "max")


@query("m_alert_stability", "events", "select round(avg((value >= 60)::int), 6) as alert_rate, round(corr(value, user_id::double), 6) as correlation, round((select stddev_pop(r) / avg(r) from (select ts::date as d, avg((value >= 60)::int) as r from events group by 1) x), 6) as daily_cv from events")
def m_alert_stability(events: DataFrame) -> DataFrame:
    rows = events.select("value", F.col("user_id").cast("double").alias("u"), F.to_date("ts").alias("d"))
    return m.alert_stability(rows, "value", "u", "d", 60.0).select(*[F.round(c, 6).alias(c) for c in ("alert_rate", "correlation", "daily_cv")])


@query("m_top100", "events", "select event_id, value from events order by value desc, event_id limit 100")
def m_top100(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("value"), "event_id").limit(100).select("event_id", "value")


@query("m_select", "events", "select event_type, n from (select event_type, count(*) as n from events group by 1) x order by n, event_type limit 1")
def m_select(events: DataFrame) -> DataFrame:
    n = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min(F.struct("n", "event_type")).alias("m")).select("m.event_type", "m.n")


FOREST = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _forest(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), *[F.col(c).cast("double") for c in FOREST])
    return m.anomaly_scores(rows, FOREST, m.isolation_forest(rows, FOREST, "key"))


@query("m_iforest", "lineitem")
def m_iforest(lineitem: DataFrame) -> DataFrame:
    return _forest(lineitem).select("key", "anomaly")


@query("m_perturb", "lineitem")
def m_perturb(lineitem: DataFrame) -> DataFrame:
    """How often, and by how much, a row scores higher once one feature is far out."""
    rows = lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), *[F.col(c).cast("double") for c in FOREST])
    forest = m.isolation_forest(rows, FOREST, "key")
    far = m.anomaly_scores(m.anomaly_scores(rows, FOREST, forest).withColumn("l_extendedprice", F.col("l_extendedprice") + 1e6), FOREST, forest, "moved")
    far = kept(far.select((F.col("moved") - F.col("anomaly")).alias("delta")))
    half = quantiles(far, ["delta"], [0.5]).select(F.col("values")[0].alias("median_delta"))
    return half.join(far.agg(F.avg("delta").alias("mean_delta"), F.avg((F.col("delta") > 0).cast("double")).alias("raised")))  # one row each


@query("m_fraud_model", "led")
def m_fraud_model(led: DataFrame) -> DataFrame:
    features = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "step"]
    rows = kept(led.select("row_id", "isFraud", *features))
    learnt = t.time_split(rows).where("part <> 'test'").withColumn("validation", F.col("part") == "val")
    return m.fraud_scores(rows, m.fraud_model(learnt, features, validation="validation"), features).select("row_id", "fraud_score")


COEF, MEAN = {"l_quantity": 0.02, "l_discount": -1.5, "l_tax": 3.0}, {"l_quantity": 25.0, "l_discount": 0.05, "l_tax": 0.04}
PHI = {f: f"({c}::double * ({f}::double - {MEAN[f]}::double))" for f, c in COEF.items()}


@query("m_linear_shap", "lineitem", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"round({p}, 6) + 0.0 as phi_{f}" for f, p in PHI.items()) + " from lineitem")
def m_linear_shap(lineitem: DataFrame) -> DataFrame:
    out = m.linear_shap(lineitem.withColumns({f: F.col(f).cast("double") for f in COEF}), COEF, MEAN)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[(F.round(f"{f}__phi", 6) + 0.0).alias(f"phi_{f}") for f in COEF])


@query("m_importance", "lineitem", " union all ".join(f"select '{f}' as feature, round(avg(abs({p})), 6) as importance from lineitem" for f, p in PHI.items()))
def m_importance(lineitem: DataFrame) -> DataFrame:
    out = m.linear_shap(lineitem.withColumns({f: F.col(f).cast("double") for f in COEF}), COEF, MEAN)
    return out.agg(*[F.round(F.avg(F.abs(f"{f}__phi")), 6).alias(f) for f in COEF]).unpivot([], list(COEF), "feature", "importance")


LABELLED = "x as (select d.doc_id, (n_chars // 50)::double as score, quality::bigint as y from documents d join labels l on d.doc_id = l.doc_id where quality is not null)"
CURVE = f"""{LABELLED}, g as (select score as threshold, sum(y)::bigint as p, count(*) as n from x group by score),
cv as (select *, sum(p) over (order by threshold desc) as tp, sum(n) over (order by threshold desc) - sum(p) over (order by threshold desc) as fp, sum(p) over () as positives, sum(n) over () as total from g)"""


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.join(labels.where("quality is not null"), "doc_id").select("doc_id", F.floor(F.col("n_chars") / 50).cast("double").alias("score"), F.col("quality").cast("bigint").alias("y"))


@query("m_best_f1", "documents labels", f"with {CURVE} select threshold, round(2 * tp / (tp + fp + positives), 12) as f1 from cv order by f1 desc, threshold limit 1")
def m_best_f1(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return m.best_f1(m.by_threshold(labelled(documents, labels), "score", "y"))


@query("m_average_precision", "documents labels", f"with {CURVE} select round(sum(p / positives * tp / (tp + fp)), 9) as average_precision from cv")
def m_average_precision(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return m.average_precision(m.by_threshold(labelled(documents, labels), "score", "y")).select(F.round("average_precision", 9).alias("average_precision"))


@query("m_roc_auc", "documents labels", f"with {LABELLED} select round(sum(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0 end) / count(*), 9) as roc_auc from x a join x b on a.y = 1 and b.y = 0")
def m_roc_auc(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return m.roc_auc(m.by_threshold(labelled(documents, labels), "score", "y")).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("m_confusion", "documents labels", f"with {LABELLED}, c as (select count_if(score < 20 and y = 0)::bigint as tn, count_if(score >= 20 and y = 0)::bigint as fp, count_if(score < 20 and y = 1)::bigint as fn, count_if(score >= 20 and y = 1)::bigint as tp from x) select *, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall, round(2 * tp / (2 * tp + fp + fn), 9) as f1 from c")
def m_confusion(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return m.confusion(labelled(documents, labels), "score", "y", 20.0).select("tn", "fp", "fn", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("m_tfidf_top", "benchmark", r"""with t as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) as term from benchmark), tf as (select item_id, term, count(*) as tf from t group by all), df as (select term, count(*) as df from tf group by term),
w0 as (select tf.item_id, tf.term, tf.tf * (ln((1 + (select count(*) from benchmark)) / (1 + df)) + 1) as w from tf join df on tf.term = df.term), w as (select item_id, term, round(w / sqrt(sum(w * w) over (partition by item_id)), 9) as w from w0),
r as (select *, row_number() over (partition by item_id order by w desc, term) as rn from w) select item_id, string_agg(term, ' ' order by rn) as terms from r where rn <= 5 group by item_id""")
def m_tfidf_top(benchmark: DataFrame) -> DataFrame:
    return m.tfidf_top(benchmark, "item_id", "text")


@query("m_templates", "rawlog", "select regexp_replace(line, '[0-9]+', '<*>', 'g') as template, count(*) as n from rawlog group by 1")
def m_templates(rawlog: DataFrame) -> DataFrame:
    return m.templates(rawlog)


@query("m_anomaly_adapter", "act", """with s as (select user_id, event_type, email_size, event_id, row_number() over (partition by user_id order by email_size desc nulls last, event_id) as k from act where source = 'email')
select a.user_id, a.event_type as top_activity, coalesce((select array_to_string(list_slice(list_sort(list(distinct b.event_type)), 1, 2), ',') from act b where b.user_id = a.user_id and b.event_type <> a.event_type), '') as further from s a where k = 1""")
def m_anomaly_adapter(act: DataFrame) -> DataFrame:
    top = act.where("source = 'email'").groupBy("user_id").agg(F.min(F.struct((-F.coalesce("email_size", F.lit(-1))).alias("s"), "event_id", "event_type")).alias("t"))
    kinds = act.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    further = F.slice(F.array_except("kinds", F.array("t.event_type")), 1, 2)
    return top.join(kinds, "user_id").select("user_id", F.col("t.event_type").alias("top_activity"), F.array_join(further, ",").alias("further"))


@query("m_select_cv", "events", """with d as (select event_type, ts::date as day, avg((value >= 60)::int::double) as r from events group by all), c as (select event_type, case when avg(r) > 0 then stddev_pop(r) / avg(r) else 0 end as daily_cv from d group by 1)
select event_type, round(daily_cv, 9) as daily_cv from c order by c.daily_cv, event_type limit 1""")
def m_select_cv(events: DataFrame) -> DataFrame:
    rows = events.select("event_type", "value", F.to_date("ts").alias("day"))
    return m.select_variant(rows, "event_type", "value", "day", 60.0).select("event_type", F.round("daily_cv", 9).alias("daily_cv"))


@query("m_importance_ranked", "lineitem", "select *, (row_number() over (order by importance desc, feature))::int as place from (" + " union all ".join(f"select '{f}' as feature, round(avg(abs({p})), 6) as importance from lineitem" for f, p in PHI.items()) + ") x")
def m_importance_ranked(lineitem: DataFrame) -> DataFrame:
    return m.ranked_importance(m_importance(lineitem))


@query("m_perturbed", "lineitem", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, 1.0::double as tax_ratio, l_extendedprice::double + 1000000 as price_bytes, l_quantity::double + 10 as quantity from lineitem")
def m_perturbed(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_tax").cast("double").alias("tax_ratio"), F.col("l_extendedprice").cast("double").alias("price_bytes"), F.col("l_quantity").cast("double").alias("quantity"))
    return m.perturbed(rows, ["tax_ratio", "price_bytes", "quantity"])


@query("m_entity_assessments", "act xwalk", f"""with a as (select x.entity_id, act.event_id, act.event_type, act.user_id, act.pc_id, event_time, 0.05::double - coalesce(email_size, 0) / 20000.0::double as score from act join xwalk x on act.user_id = x.user_id),
t as (select *, {half_even_sql("1 / (1 + exp(45 * score))", 4)} as risk from a qualify row_number() over (partition by entity_id order by score, event_id) = 1),
o as (select t.entity_id, list_slice(list_sort(list(distinct a.event_type)), 1, 2) as others from t join a on a.entity_id = t.entity_id and a.event_type <> t.event_type group by t.entity_id)
select t.entity_id, event_id as log_id, risk, array_to_string(list_prepend(event_type, coalesce(others, [])), ',') as signals, case when len(others) > 0 then {half_even_sql("risk * 0.3::double", 4)} end as further_weight,
  'flagged ''' || event_type || ''' on PC ' || pc_id || ' at ' || strftime(event_time, '%Y-%m-%d ') || hour(event_time) || ':' || minute(event_time) || ' (user ' || user_id || '); decision_function=' || printf('%.4f', score) as raw_value
from t left join o on t.entity_id = o.entity_id""")
def m_entity_assessments(act: DataFrame, xwalk: DataFrame) -> DataFrame:
    mapped = act.join(xwalk.select("user_id", "entity_id"), "user_id")
    score = F.lit(0.05) - F.coalesce("email_size", F.lit(0)) / 20000.0
    anomalies = mapped.select("entity_id", F.col("event_id").alias("log_id"), score.alias("score"), F.col("event_type").alias("activity"), F.col("user_id").alias("user"), F.col("pc_id").alias("pc"), F.col("event_time").alias("time"))
    r = F.col("reasons")
    return m.entity_assessments(anomalies).select("entity_id", "log_id", "risk", F.array_join(F.transform(r, lambda x: x["signal_name"]), ",").alias("signals"), F.get(r, F.lit(1))["weight"].alias("further_weight"), r[0]["raw_value"].alias("raw_value"))
