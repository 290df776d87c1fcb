"""Queries of scalar functions, scans and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import scalars as s
from riskweave.operators.correlation import INCIDENTS, uuid5
from riskweave.plans.registry import half_even_sql, query
from riskweave.sources import readers, sinks

TS = "coalesce(try_strptime(split_part(line, chr(9), 2), '%d-%m-%Y %H:%M:%S'), try_strptime(split_part(line, chr(9), 2), '%Y-%m-%d %H:%M'))"


@query("s_parse_multi_format", "rawlog", f"select event_id, {TS} as ts from rawlog where not line like 'malformed%'")
def s_parse_multi_format(rawlog: DataFrame) -> DataFrame:
    return rawlog.where("not line like 'malformed%'").select("event_id", s.parse_any(F.get(F.split("line", "\t"), F.lit(1))).alias("ts"))


@query("s_log_fields", "rawlog", f"select event_id, split_part(line, chr(9), 1) as log_id, {TS} as ts, split_part(split_part(line, chr(9), 3), '/', -1) as \"user\", replace(split_part(line, chr(9), 4), 'PC-', '') as pc, split_part(line, chr(9), 5) as activity from rawlog where len(string_split(line, chr(9))) = 5")
def s_log_fields(rawlog: DataFrame) -> DataFrame:
    return rawlog.select("event_id", *[c.alias(k) for k, c in s.log_fields(F.col("line")).items()]).where("log_id is not null")


@query("rawlog_scan", "rawlog", "select count(*) as n_lines, count_if(line like 'malformed%')::bigint as malformed from rawlog where trim(line) <> ''")
def rawlog_scan(rawlog: DataFrame) -> DataFrame:
    return readers.lines(sinks.write_lines(rawlog.select("line"))).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").startswith("malformed")).alias("malformed"))


@query("s_logistic", "events", "select event_id, round(1 / (1 + exp(45 * (value / 1000.0::double - 0.02))), 4) as p from events")
def s_logistic(events: DataFrame) -> DataFrame:
    return events.select("event_id", s.logistic(F.col("value") / 1000.0 - 0.02).alias("p"))


@query("s_uuid5", "asm", f"""select assessment_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id
from (select assessment_id, sha1(unhex('{INCIDENTS.replace('-', '')}') || (entity_id || ':' || assessment_id)::blob) as h from asm) x""")
def s_uuid5(asm: DataFrame) -> DataFrame:
    return asm.select("assessment_id", uuid5(INCIDENTS, F.concat_ws(":", "entity_id", "assessment_id")).alias("id"))


@query("s_interp", "events", "select event_id, round(case when value <= 10 then 0.1 when value <= 40 then 0.1 + 0.4 * (value - 10) / 30 when value < 90 then 0.5 + 0.5 * (value - 40) / 50 else 1.0 end, 9) as y from events")
def s_interp(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.round(s.interpolate(F.col("value"), [10, 40, 90], [0.1, 0.5, 1.0]), 9).alias("y"))


STATUS = "case " + " ".join(f"when contains(upper(crypto_algorithm), '{t}') then '{q}'" for t, q, _, _ in s.ALGORITHMS) + " else 'unknown' end"
RISK = "case " + " ".join(f"when contains(upper(crypto_algorithm), '{t}') then {r}::double" for t, _, r, _ in s.ALGORITHMS) + " else 0.5::double end"
WEIGHT = "case data_sensitivity " + " ".join(f"when '{k}' then {v}::double" for k, v in s.SENSITIVITY.items()) + " else 0.4::double end"
ASSETS = f"""sc as (select *, {half_even_sql("risk * weight * (0.4::double + 0.6::double * least(retention_years / 10, 1.0))", 3)} as priority_score, status = 'quantum_vulnerable' and data_sensitivity in ('confidential', 'restricted') and retention_years >= 5 as hndl_risk
  from (select *, {STATUS} as status, {RISK} as risk, {WEIGHT} as weight from ast) x),
sa as (select *, case when priority_score >= 0.7 then 'CRITICAL' when priority_score >= 0.45 then 'HIGH' when priority_score >= 0.2 then 'MEDIUM' else 'LOW' end as priority_tier from sc)"""


def assets(ast: DataFrame) -> DataFrame:
    status, risk = s.algorithm(F.col("crypto_algorithm"))
    out = ast.withColumns({"status": status, "priority_score": s.priority(risk, F.col("data_sensitivity"), F.col("retention_years"))})
    return out.withColumns({"priority_tier": s.tier(F.col("priority_score")), "hndl_risk": s.harvest_now(F.col("status"), F.col("data_sensitivity"), F.col("retention_years"))})


@query("s_asset_score", "ast", f"with {ASSETS} select asset_id, status, priority_score, priority_tier, hndl_risk from sa")
def s_asset_score(ast: DataFrame) -> DataFrame:
    return assets(ast).select("asset_id", "status", "priority_score", "priority_tier", "hndl_risk")


@query("s_asset_report", "ast", f"with {ASSETS} select priority_tier, count(*) as assets, count_if(status = 'quantum_vulnerable')::bigint as vulnerable, count_if(hndl_risk)::bigint as hndl from sa group by priority_tier")
def s_asset_report(ast: DataFrame) -> DataFrame:
    return assets(ast).groupBy("priority_tier").agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("status") == "quantum_vulnerable").alias("vulnerable"), F.count_if("hndl_risk").alias("hndl"))


@query("scan_csv_roundtrip", "act", "select event_id, user_id, pc_id, event_type, coalesce(file_name, '') as file_name from act")
def scan_csv_roundtrip(act: DataFrame) -> DataFrame:
    columns = ["event_id", "user_id", "pc_id", "event_type", "file_name"]
    path = sinks.write_csv(act.select(*columns[:4], F.coalesce("file_name", F.lit("")).alias("file_name")))
    return readers.csv_strings(act.sparkSession, path, columns)


@query("scan_partition_pruned", "act", "select event_id, user_id, event_type from act where source = 'logon' and event_date = date '2024-01-05'")
def scan_partition_pruned(act: DataFrame) -> DataFrame:
    path = sinks.write_partitioned(act.select("event_id", "user_id", "event_type", "source", "event_date"), ["source", "event_date"])
    return readers.partition(act.sparkSession, path, source="logon", event_date="2024-01-05").select("event_id", "user_id", "event_type")


@query("sink_roundtrip", "act", "select event_id, source, event_date, null::varchar as note from act")
def sink_roundtrip(act: DataFrame) -> DataFrame:
    path = sinks.write_partitioned(act.select("event_id", "source", "event_date"), ["source", "event_date"], missing={"note": "string"})
    return act.sparkSession.read.parquet(path).select("event_id", "source", F.col("event_date").cast("date").alias("event_date"), "note")


@query("scan_backfill_optional", "act", "select user_id, date_trunc('hour', event_time)::timestamp as window_start, date_trunc('hour', event_time)::timestamp + interval '1' hour as window_end, count(*) as n from act group by all")
def scan_backfill_optional(act: DataFrame) -> DataFrame:
    hours = act.groupBy("user_id", F.date_trunc("hour", "event_time").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    return readers.backfilled(hours, {"window_end": F.col("window_start") + F.expr("interval 1 hour")}).select("user_id", "window_start", "window_end", "n")


@query("json_in_string", "events", "select event_id, (props->>'$.k')::int as k from events")
def json_in_string(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("file_fingerprint", "region")
def file_fingerprint(region: DataFrame) -> DataFrame:
    return readers.fingerprints(region.sparkSession, region.inputFiles())


FAMILY = "case " + " ".join(f"when contains(upper(crypto_algorithm), '{t}') then '{f}'" for t, _, _, f in s.ALGORITHMS) + " else 'unknown' end"


@query("s_asset_replacement", "ast", f"select asset_id, family, case when status in ('quantum_safe', 'pqc', 'quantum_adequate') then 'none (already adequate)' when family = 'symmetric' then 'AES-256' when purpose = 'key_exchange' then 'ML-KEM (Kyber)' when purpose = 'signature' then 'ML-DSA (Dilithium)' else 'ML-KEM / ML-DSA' end as replacement from (select *, {STATUS} as status, {FAMILY} as family from ast) x")
def s_asset_replacement(ast: DataFrame) -> DataFrame:
    status, _ = s.algorithm(F.col("crypto_algorithm"))
    kind = s.family(F.col("crypto_algorithm"))
    return ast.select("asset_id", kind.alias("family"), s.replacement(status, kind, F.col("purpose")).alias("replacement"))


@query("s_iso_time", "events", "select event_id, case when event_id % 7 = 0 then null else date_trunc('second', ts)::timestamp - (event_id % 5) * interval '1' hour end as t from events")
def s_iso_time(events: DataFrame) -> DataFrame:
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, "Z").otherwise(F.format_string("+%02d:00", F.col("event_id") % 5)))
    return events.select("event_id", s.iso_time(F.when(F.col("event_id") % 7 == 0, "nonsense").otherwise(text)).alias("t"))


@query("s_us_time", "events", "select event_id, case when event_id % 7 = 0 then null else date_trunc('second', ts)::timestamp end as t from events")
def s_us_time(events: DataFrame) -> DataFrame:
    return events.select("event_id", s.us_time(F.when(F.col("event_id") % 7 == 0, "31/31/2024").otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))).alias("t"))


@query("s_canonical_json", "asm", """select assessment_id, '{"assessment_id":"' || assessment_id || '","at":{"day":' || coalesce('"' || case when epoch_us(event_time) % 1000000 = 0 then strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') else strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ') end || '"', 'null') || ',"of":"' || "domain" || '"},"entity_id":"' || entity_id || '"}' as json from asm""")
def s_canonical_json(asm: DataFrame) -> DataFrame:
    at = F.struct(F.col("domain").alias("of"), F.col("event_time").alias("day"))
    df = asm.select("entity_id", at.alias("at"), "assessment_id")
    return df.select("assessment_id", s.canonical_json(df).alias("json"))
