"""The canonical tables (events, users, transactions, ...) as views over the test tables, for Spark and for DuckDB.

Each view is written once, in SQL that both engines read; what differs between them stands as a token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.operators.transactions import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# token: (Spark SQL, DuckDB SQL); {0} and so on are arguments
TOKENS = {
    "@DAYS(l_shipdate)": ("datediff(cast(l_shipdate as date), date '1995-01-01')", "datediff('day', date '1995-01-01', cast(l_shipdate as date))"),
    "@SHA(": ("riskweave_sha(", "sha256("),
    "@FMT_A": ("date_format(ts, 'dd-MM-yyyy HH:mm:ss')", "strftime(ts, '%d-%m-%Y %H:%M:%S')"),
    "@FMT_B": ("date_format(ts, 'yyyy-MM-dd HH:mm')", "strftime(ts, '%Y-%m-%d %H:%M')"),
}

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

#: For Spark, the column by which a view's table is dealt before its join and window, which sort whole parts.
DEALT = {("led", "lineitem"): "l_orderkey"}


def _view(name: str, needs: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (needs, sql)


_view("act", ("events",), """
select cast(event_id as string) as event_id, cast(ts as timestamp) as event_time, 'U' || cast(user_id as string) as user_id, user_id as user_key,
  'PC-' || cast(1000 + k % 4 as string) as pc_id,
  case when event_type in ('signup', 'error') then 'logon' when event_type = 'view' then 'device' when event_type = 'click' then 'file' else 'email' end as source,
  case when event_type = 'signup' then 'Logon' when event_type = 'error' then 'Logoff'
    when event_type = 'view' then case when v % 2 = 0 then 'Connect' else 'Disconnect' end
    when event_type = 'click' then case v % 4 when 0 then 'File Open' when 1 then 'File Write' when 2 then 'File Copy' else 'File Delete' end
    else case when v % 3 = 0 then 'View' else 'Send' end end as event_type,
  cast(ts as date) as event_date,
  case when event_type = 'view' and k % 9 <> 0 then 'R:' || chr(92) || 'T' || cast(k % 10 as string) end as device_file_tree,
  case when event_type = 'click' then 'C:' || chr(92) || 'd' || cast(k % 12 as string) || chr(92) || 'f' || cast(v % 3 as string)
    || case k % 4 when 0 then '.DOC' when 1 then '.pdf' when 2 then '.zip' else '' end end as file_name,
  case when event_type = 'click' then k % 5 = 0 end as to_removable_media, case when event_type = 'click' then k % 7 = 0 end as from_removable_media,
  case when event_type = 'purchase' then 'u' || cast(k % 15 as string) || case when k % 4 = 0 then '@dtaa.com' else '@ext.test' end || '; U' || cast(v % 10 as string) || '@dtaa.com' end as email_to,
  case when event_type = 'purchase' and k % 3 = 0 then 'u' || cast(k % 15 as string) || '@dtaa.com' end as email_cc,
  case when event_type = 'purchase' and k % 11 = 0 then 'audit@ext.test' end as email_bcc,
  case when event_type = 'purchase' then 's' || cast(k % 8 as string) || case when k % 2 = 0 then '@dtaa.com' else '@ext.test' end end as email_from,
  case when event_type = 'purchase' then cast(1000 + v * 10 as bigint) end as email_size,
  case when event_type = 'purchase' and k % 2 = 0 then 'a.txt(' || cast(100 + k as string) || ');b.pdf(' || cast(v as string) || ')' end as email_attachments
from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k, cast(floor(value) as int) as v from events) e""")
_view("usr", ("customer", "nation", "region"), """
select 'U' || cast(c_custkey as string) as user_id, c_mktsegment as role, r_name as business_unit, n_name as department,
  case c_custkey % 4 when 0 then 'P1;P2' when 1 then 'P1' when 2 then '' else 'P1,P2|P3' end as projects,
  case c_custkey % 3 when 0 then 'ITAdmin' when 1 then 'Production Manager' else 'Salesman' end as job_title,
  timestamp '2024-01-01 00:00:00' + (c_custkey % 90) * interval '1' day as end_time
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
_view("led", ("lineitem", "orders"), """
select l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) as row_id, cast(@DAYS(l_shipdate) as bigint) as step,
  case l_linenumber % 5 when 0 then 'PAYMENT' when 1 then 'TRANSFER' when 2 then 'CASH_OUT' when 3 then 'CASH_IN' else 'DEBIT' end as type,
  l_extendedprice as amount, 'C' || cast(o_custkey as string) as nameOrig,
  case when l_suppkey % 4 = 0 then 'M' else 'C' end || cast(l_suppkey as string) as nameDest,
  l_extendedprice * (1 + l_discount) as oldbalanceOrg, l_extendedprice * l_discount as newbalanceOrig, l_quantity * 100 as oldbalanceDest,
  l_quantity * 100 + case when l_tax < 0.04 then l_extendedprice else 0 end as newbalanceDest,
  case when l_discount >= 0.09 and l_tax <= 0.01 then 1 else 0 end as isFraud, 0 as isFlaggedFraud
from lineitem join orders on l_orderkey = o_orderkey""")
_view("xwalk", ("events", "orders"), """
select u.user_id, a.account, 'E' || cast(u.rn as string) as entity_id
from (select user_id, row_number() over (order by @SHA('v1:' || user_id)) as rn from (select distinct 'U' || cast(user_id as string) as user_id from events) x) u
join (select account, row_number() over (order by @SHA('v1:' || account)) as rn from (select distinct 'C' || cast(o_custkey as string) as account from orders) y) a on u.rn = a.rn""")
_view("asm", ("events",), """
select 'A' || cast(event_id as string) as assessment_id, 'U' || cast(user_id as string) as entity_id,
  case when event_type in ('signup', 'error', 'view') then 'ps1_behavioral' else 'ps2_transaction' end as domain,
  case when value / 60.0 > 1 then 1.0 else value / 60.0 end as score, case when event_id % 97 = 0 then null else cast(ts as timestamp) end as event_time
from events""")
_view("ast", ("part",), """
select p_partkey as asset_id,
  case p_partkey % 12 when 0 then 'RSA-2048' when 1 then 'ECDSA-P256' when 2 then 'AES-128' when 3 then 'AES-256' when 4 then '3DES' when 5 then 'HMAC-SHA256'
    when 6 then 'ML-KEM-512' when 7 then 'ECDHE-RSA' when 8 then 'SHA-1' when 9 then 'rsa-3072' when 10 then 'MD5' else 'Unknown-X' end as crypto_algorithm,
  case p_size % 3 when 0 then 'key_exchange' when 1 then 'signature' else 'symmetric' end as purpose,
  case p_partkey % 5 when 0 then 'public' when 1 then 'internal' when 2 then 'confidential' when 3 then 'restricted' else 'other' end as data_sensitivity,
  cast(p_size % 16 as double) as retention_years
from part""")
_view("rawlog", ("events",), """
select event_id, case when event_id % 50 = 0 then 'malformed line ' || cast(event_id as string)
  else 'ID-' || cast(event_id as string) || chr(9) || case when event_id % 2 = 0 then @FMT_A else @FMT_B end
    || chr(9) || 'DTAA/U' || cast(user_id as string) || chr(9) || 'PC-' || cast(1000 + event_id % 4 as string) || chr(9) || event_type end as line
from events""")
_view("fb", ("events",), """
select event_id as seq, 'INC-' || cast(user_id as string) as incident_id, 'U' || cast(user_id as string) as entity_id,
  case event_type when 'click' then 'acknowledge' when 'view' then 'escalate' when 'error' then 'dismiss' else 'bogus' end as action,
  'r' || cast(event_id % 5 as string) as reason, cast(ts as timestamp) as ts
from events""")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or one of the views over them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = VIEWS[name]
    for token, (ours, _) in TOKENS.items():
        sql = sql.replace(token, ours)
    sql = sql.replace("riskweave_sha('v1:' || user_id)", "sha2('v1:' || user_id, 256)").replace("riskweave_sha('v1:' || account)", "sha2('v1:' || account, 256)")
    for need in needs:
        sql = sql.replace(f"from {need}", f"from {{{need}}}").replace(f"join {need}", f"join {{{need}}}")
    found = {need: table(spark, sf_dir, need) for need in needs}
    return spark.sql(sql, **{need: spread(df, DEALT[name, need]) if (name, need) in DEALT else df for need, df in found.items()})


def duckdb(name: str) -> str:
    """The same view as DuckDB SQL."""
    sql = VIEWS[name][1]
    for token, (_, theirs) in TOKENS.items():
        sql = sql.replace(token, theirs)
    return sql
