"""Queries of activity events, user-hour windows, baselines, scans, sinks and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import events as e
from riskweave.operators import quality as q
from riskweave.operators import windows as w
from riskweave.plans.registry import query

ORD = "order by event_time, event_id"


@query("b_new_pc", "act", f"select event_id, (row_number() over (partition by user_id, pc_id {ORD}) = 1)::int as new_pc from act where event_type = 'Logon'")
def b_new_pc(act: DataFrame) -> DataFrame:
    return e.first_of(act.where("event_type = 'Logon'"), ["user_id", "pc_id"], "new_pc").select("event_id", "new_pc")


NON_PRIMARY = f"""
lg as (select * from act where event_type = 'Logon'),
met as (select l.event_id, l.pc_id, c.candidate, count(*) filter (where l.pc_id = c.candidate) over (partition by l.user_id, c.candidate order by l.event_time, l.event_id rows between unbounded preceding and 1 preceding) as hits
  from lg l join (select distinct user_id, pc_id as candidate from lg) c on l.user_id = c.user_id),
best as (select event_id, pc_id, candidate from met where hits > 0 qualify row_number() over (partition by event_id order by hits desc, candidate) = 1),
np as (select l.event_id, coalesce((b.candidate <> l.pc_id)::int, 0) as non_primary from lg l left join best b on l.event_id = b.event_id)"""


@query("b_nonprimary_pc", "act", f"with {NON_PRIMARY} select * from np")
def b_nonprimary_pc(act: DataFrame) -> DataFrame:
    return e.non_primary_pc(act.where("event_type = 'Logon'"))


SURPRISE = "-ln((count(*) over (partition by user_id, hour(event_time) order by event_time, event_id rows between unbounded preceding and 1 preceding) + 1) / (count(*) over (partition by user_id order by event_time, event_id rows between unbounded preceding and 1 preceding) + 24))"


@query("b_hour_surprise", "act", f"select event_id, round({SURPRISE}, 9) as hour_surprise from act where event_type = 'Logon'")
def b_hour_surprise(act: DataFrame) -> DataFrame:
    return e.hour_surprise(act.where("event_type = 'Logon'")).select("event_id", F.round("hour_surprise", 9).alias("hour_surprise"))


def session_sql(source: str, opens: str, closes: str) -> str:
    w_ = "over (partition by user_id, pc_id order by event_time, event_id)"
    return f"""select event_id, event_type, user_id, pc_id, event_time, case when m between 0 and 1440 then m end as minutes from (
  select *, case when event_type = '{closes}' and lag(event_type) {w_} = '{opens}' then (epoch_us(event_time) - epoch_us(lag(event_time) {w_})) / 60000000.0 end as m from act where source = '{source}') s"""


@query("b_logon_session", "act", f"select event_id, round(minutes, 6) as minutes from ({session_sql('logon', 'Logon', 'Logoff')}) x where event_type = 'Logoff'")
def b_logon_session(act: DataFrame) -> DataFrame:
    return e.session_minutes(act.where("source = 'logon'"), "Logon", "Logoff", "minutes").where("event_type = 'Logoff'").select("event_id", F.round("minutes", 6).alias("minutes"))


@query("b_device_session", "act", f"select event_id, round(minutes, 6) as minutes from ({session_sql('device', 'Connect', 'Disconnect')}) x where event_type = 'Disconnect'")
def b_device_session(act: DataFrame) -> DataFrame:
    return e.session_minutes(act.where("source = 'device'"), "Connect", "Disconnect", "minutes").where("event_type = 'Disconnect'").select("event_id", F.round("minutes", 6).alias("minutes"))


@query("b_new_tree", "act", f"select event_id, (row_number() over (partition by user_id, device_file_tree {ORD}) = 1)::int as new_tree from act where event_type = 'Connect' and coalesce(device_file_tree, '') <> ''")
def b_new_tree(act: DataFrame) -> DataFrame:
    return e.first_of(act.where("event_type = 'Connect' and coalesce(device_file_tree, '') <> ''"), ["user_id", "device_file_tree"], "new_tree").select("event_id", "new_tree")


@query("b_new_path", "act", f"select event_id, (row_number() over (partition by user_id, file_name {ORD}) = 1 and coalesce(file_name, '') <> '')::int as new_path from act where source = 'file'")
def b_new_path(act: DataFrame) -> DataFrame:
    return e.first_of(act.where("source = 'file'"), ["user_id", "file_name"], "new_path").select("event_id", "new_path")


EXT = r"nullif(lower(regexp_extract(file_name, '[^\\/.][^\\/]*(\.[^.\\/]+)$', 1)), '')"


@query("b_file_ext", "act", f"select event_id, {EXT} as extension from act where source = 'file'")
def b_file_ext(act: DataFrame) -> DataFrame:
    return act.where("source = 'file'").select("event_id", e.extension(F.col("file_name")).alias("extension"))


def addr(*columns: str) -> str:
    return f"list_filter(list_transform(string_split(concat_ws(';', {', '.join(columns)}), ';'), lambda a: lower(trim(a))), lambda a: a <> '')"


ALL, CC = addr("email_to", "email_cc", "email_bcc"), addr("email_cc", "email_bcc")
OUTSIDE = "(contains(a, '@') and split_part(a, '@', -1) <> 'dtaa.com')"


@query("b_addresses", "act", f"select event_id, array_to_string({ALL}, '|') as addresses from act where source = 'email'")
def b_addresses(act: DataFrame) -> DataFrame:
    return act.where("source = 'email'").select("event_id", F.array_join(e.addresses("email_to", "email_cc", "email_bcc"), "|").alias("addresses"))


@query("b_external", "act", f"select event_id, len(list_filter({ALL}, lambda a: {OUTSIDE}))::int as external_count from act where source = 'email'")
def b_external(act: DataFrame) -> DataFrame:
    return act.where("source = 'email'").select("event_id", F.size(F.filter(e.addresses("email_to", "email_cc", "email_bcc"), lambda a: e.external(a))).alias("external_count"))


PIECES = "len(list_filter(string_split(coalesce(email_attachments, ''), ';'), lambda p: trim(p) <> ''))"
BYTES = r"coalesce(list_sum(list_transform(regexp_extract_all(coalesce(email_attachments, ''), '\(([0-9]+)\)(?:;|$)', 1), lambda x: x::bigint)), 0)::bigint"


@query("b_attach", "act", f"select event_id, {PIECES}::int as attachment_count, {BYTES} as attachment_bytes from act where source = 'email'")
def b_attach(act: DataFrame) -> DataFrame:
    pieces, sizes = e.attachments(F.col("email_attachments"))
    return act.where("source = 'email'").select("event_id", pieces.alias("attachment_count"), sizes.alias("attachment_bytes"))


NEW_TO = f"""
each as (select distinct event_id, event_time, user_id, a from (select event_id, event_time, user_id, unnest({ALL}) as a from act where source = 'email' and event_type = 'Send') u),
nr as (select event_id, sum(n)::bigint as new_recipients from (select event_id, (row_number() over (partition by user_id, a {ORD}) = 1)::int as n from each) x group by event_id)"""


@query("b_new_recipient", "act", f"with {NEW_TO} select * from nr")
def b_new_recipient(act: DataFrame) -> DataFrame:
    return e.new_recipients(act.where("source = 'email' and event_type = 'Send'"))


SENDER = f"""
vw as (select *, lower(trim(coalesce(email_from, ''))) as sender from act where source = 'email' and event_type = 'View'),
ns as (select event_id, (row_number() over (partition by user_id, sender {ORD}) = 1 and sender <> '')::int as new_sender, (contains(sender, '@') and split_part(sender, '@', -1) <> 'dtaa.com')::int as external_sender from vw)"""


@query("b_new_sender", "act", f"with {SENDER} select * from ns")
def b_new_sender(act: DataFrame) -> DataFrame:
    views = act.where("source = 'email' and event_type = 'View'").withColumn("sender", F.lower(F.trim(F.coalesce("email_from", F.lit("")))))
    return e.first_of(views, ["user_id", "sender"], "new_sender").select("event_id", "new_sender", e.external(F.col("sender")).cast("int").alias("external_sender"))


def sessions(p: str) -> str:
    return f"count(minutes)::double as {p}_session_count, coalesce(sum(minutes), 0)::double as {p}_session_minutes_sum, coalesce(avg(minutes), 0) as {p}_session_minutes_mean, coalesce(max(minutes), 0)::double as {p}_session_minutes_max"


LOGON = f"""{NON_PRIMARY},
lm as (select event_id, (row_number() over (partition by user_id, pc_id {ORD}) = 1)::int as new_pc, {SURPRISE} as hour_surprise from lg),
lh0 as (select s.user_id, date_trunc('hour', s.event_time)::timestamp as window_start, count(*)::double as logon_event_count, sum((s.event_type = 'Logon')::int)::double as logon_count, sum((s.event_type = 'Logoff')::int)::double as logoff_count,
    count(distinct s.pc_id)::double as unique_logon_pc_count, coalesce(sum(new_pc), 0)::double as new_logon_pc_count, coalesce(sum(non_primary), 0)::double as non_primary_logon_count, coalesce(avg(hour_surprise), 0) as login_hour_surprise_mean, {sessions('logon')}, max(s.event_time) as logon_last
  from ({session_sql('logon', 'Logon', 'Logoff')}) s left join lm on s.event_id = lm.event_id left join np on s.event_id = np.event_id group by all),
lh as (select *, case when logon_count <> 0 then non_primary_logon_count / logon_count else 0.0 end as non_primary_logon_ratio from lh0)"""
DEVICE = f"""
dt as (select event_id, (row_number() over (partition by user_id, device_file_tree {ORD}) = 1)::int as new_tree from act where event_type = 'Connect' and coalesce(device_file_tree, '') <> ''),
dh as (select s.user_id, date_trunc('hour', s.event_time)::timestamp as window_start, count(*)::double as device_event_count, sum((s.event_type = 'Connect')::int)::double as device_connect_count, sum((s.event_type = 'Disconnect')::int)::double as device_disconnect_count,
    coalesce(sum(new_tree), 0)::double as new_device_tree_count, {sessions('device')}, max(s.event_time) as device_last from ({session_sql('device', 'Connect', 'Disconnect')}) s left join dt on s.event_id = dt.event_id group by all)"""
FILE = f"""
fp as (select *, {EXT} as ext, (row_number() over (partition by user_id, file_name {ORD}) = 1 and coalesce(file_name, '') <> '')::int as new_path from act where source = 'file'),
fh as (select user_id, date_trunc('hour', event_time)::timestamp as window_start, count(*)::double as file_activity_count, sum((event_type = 'File Open')::int)::double as file_open_count, sum((event_type = 'File Write')::int)::double as file_write_count,
    sum((event_type = 'File Copy')::int)::double as file_copy_count, sum((event_type = 'File Delete')::int)::double as file_delete_count, sum(coalesce(to_removable_media, false)::int)::double as file_to_removable_count,
    sum(coalesce(from_removable_media, false)::int)::double as file_from_removable_count, count(distinct ext)::double as file_extension_count, sum(new_path)::double as new_file_path_count, max(event_time) as file_last from fp group by all)"""
EMAIL = f"""{NEW_TO}, {SENDER},
em as (select a.user_id, date_trunc('hour', a.event_time)::timestamp as window_start, a.event_time, a.event_type = 'Send' as s, hour(a.event_time) < 8 or hour(a.event_time) >= 18 as off_hours, {ALL} as tos, {CC} as ccs, email_size,
    {PIECES} as pieces, {BYTES} as bytes, coalesce(new_recipients, 0) as new_recipients, coalesce(new_sender, 0) as new_sender, coalesce(external_sender, 0) as external_sender
  from act a left join nr on a.event_id = nr.event_id left join ns on a.event_id = ns.event_id where a.source = 'email'),
eu as (select user_id, window_start, count(distinct a)::double as email_unique_recipient_count from (select user_id, window_start, unnest(tos) as a from em where s) u group by all),
eh0 as (select user_id, window_start, count(*)::double as email_event_count, sum(s::int)::double as email_send_count, sum((not s)::int)::double as email_view_count, sum(case when s then len(tos) else 0 end)::double as email_recipient_count,
    sum(case when s then len(list_filter(tos, lambda a: {OUTSIDE})) else 0 end)::double as email_external_recipient_count, sum(case when s then new_recipients else 0 end)::double as email_new_recipient_count, sum(case when s then len(ccs) else 0 end)::double as email_cc_bcc_recipient_count,
    coalesce(sum(email_size) filter (where s), 0)::double as email_size_sum, coalesce(avg(email_size) filter (where s), 0) as email_size_mean, coalesce(max(email_size) filter (where s), 0)::double as email_size_max,
    sum(case when s then pieces else 0 end)::double as email_attachment_count, sum(case when s then bytes else 0 end)::double as email_attachment_bytes, sum((s and off_hours)::int)::double as email_off_hours_send_count,
    sum(new_sender)::double as email_new_sender_count, sum(external_sender)::double as email_external_sender_count, sum((not s and off_hours)::int)::double as email_off_hours_view_count, max(event_time) as email_last from em group by all),
eh as (select eh0.*, coalesce(email_unique_recipient_count, 0.0) as email_unique_recipient_count, case when email_recipient_count <> 0 then email_external_recipient_count / email_recipient_count else 0.0 end as email_external_recipient_ratio
  from eh0 left join eu on eh0.user_id = eu.user_id and eh0.window_start = eu.window_start)"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(source: str, doubles: list[str], others: list[str], places: int = 6) -> str:
    return f"select {', '.join([*others, *(f'round({c}, {places}) as {c}' for c in doubles)])} from {source}"


@query("b_logon_hourly", "act", f"with {LOGON} {rounded_sql('lh', [*w.LOGON, ], ['user_id', 'window_start', 'logon_last'])}")
def b_logon_hourly(act: DataFrame) -> DataFrame:
    return rounded(e.logon_hourly(act))


@query("b_device_hourly", "act", f"with {DEVICE} {rounded_sql('dh', w.DEVICE, ['user_id', 'window_start', 'device_last'])}")
def b_device_hourly(act: DataFrame) -> DataFrame:
    return rounded(e.device_hourly(act))


@query("b_file_hourly", "act", f"with {FILE} {rounded_sql('fh', w.FILE, ['user_id', 'window_start', 'file_last'])}")
def b_file_hourly(act: DataFrame) -> DataFrame:
    return rounded(e.file_hourly(act))


@query("b_email_hourly", "act", f"with {EMAIL} {rounded_sql('eh', w.EMAIL, ['user_id', 'window_start', 'email_last'])}")
def b_email_hourly(act: DataFrame) -> DataFrame:
    return rounded(e.email_hourly(act))


@query("w_user_hour", "act", "select user_id, date_trunc('hour', event_time)::timestamp as window_start, count(*) as n_events from act group by all")
def w_user_hour(act: DataFrame) -> DataFrame:
    return w.tumbling(act).groupBy("user_id", "window_start").agg(F.count(F.lit(1)).alias("n_events"))


RAW = [*w.LOGON, *w.DEVICE, *w.FILE, *w.EMAIL]
COMBINED = f"""{LOGON}, {DEVICE}, {FILE}, {EMAIL},
k as (select user_id, window_start from lh union select user_id, window_start from dh union select user_id, window_start from fh union select user_id, window_start from eh),
hourly as (select k.user_id, k.window_start, greatest(logon_last, device_last, file_last, email_last) as event_time, {', '.join(f'coalesce({c}, 0.0) as {c}' for c in RAW)}
  from k left join lh on k.user_id = lh.user_id and k.window_start = lh.window_start left join dh on k.user_id = dh.user_id and k.window_start = dh.window_start
  left join fh on k.user_id = fh.user_id and k.window_start = fh.window_start left join eh on k.user_id = eh.user_id and k.window_start = eh.window_start),
ctx as (select h.*, role, business_unit, department, h.window_start::date as event_date, h.logon_event_count + h.device_event_count + h.file_activity_count + h.email_event_count as event_count_total,
    (isodow(h.window_start) >= 6)::int as is_weekend, (hour(h.window_start) < 8 or hour(h.window_start) >= 18)::int as is_off_hours,
    (epoch_us(end_time) - epoch_us(h.window_start)) / 86400000000.0 as days_to_employment_end, ((epoch_us(end_time) - epoch_us(h.window_start)) / 86400000000.0 between 0 and 30)::int as employment_end_proximity_30d,
    len(list_filter(string_split_regex(projects, '[;,|]'), lambda p: trim(p) <> ''))::int as project_count, regexp_matches(job_title, '(?i)admin|manager|director|president|supervisor|security')::int as is_privileged_role
  from hourly h left join usr u on h.user_id = u.user_id)"""


@query("w_combine", "act", f"with {COMBINED.split('ctx as')[0].rstrip().rstrip(',')} {rounded_sql('hourly', RAW, ['user_id', 'window_start', 'event_time'])}")
def w_combine(act: DataFrame) -> DataFrame:
    return rounded(w.combine(act))


@query("w_user_context", "act usr", "select h.user_id, h.window_start, role, business_unit, department from (select distinct user_id, date_trunc('hour', event_time)::timestamp as window_start from act) h left join usr u on h.user_id = u.user_id")
def w_user_context(act: DataFrame, usr: DataFrame) -> DataFrame:
    hours = w.tumbling(act).select("user_id", "window_start").distinct()
    return w.with_users(hours, usr).select("user_id", "window_start", "role", "business_unit", "department")


CONTEXT = ["is_weekend", "is_off_hours", "is_privileged_role", "project_count", "employment_end_proximity_30d"]


@query("w_context", "act usr", f"with {COMBINED} {rounded_sql('ctx', ['days_to_employment_end', 'event_count_total'], ['user_id', 'window_start', *CONTEXT])}")
def w_context(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(w.with_context(w.combine(act), usr).select("user_id", "window_start", *CONTEXT, "days_to_employment_end", "event_count_total"))


@query("w_privileged", "usr", "select user_id, len(list_filter(string_split_regex(projects, '[;,|]'), lambda p: trim(p) <> ''))::int as project_count, regexp_matches(job_title, '(?i)admin|manager|director|president|supervisor|security')::int as is_privileged_role from usr")
def w_privileged(usr: DataFrame) -> DataFrame:
    return usr.select("user_id", w.project_count(F.col("projects")).alias("project_count"), w.privileged(F.col("job_title")).cast("int").alias("is_privileged_role"))


#: Baseline features, window and least history of the queries; the test data has about 30 days a user.
FEATURES, DAYS, HISTORY = ["logon_count", "file_activity_count", "device_connect_count", "email_size_sum"], 14, 3


def daily_sql(features: list[str]) -> str:
    return f"""{COMBINED},
med as (select user_id, event_date, role, {', '.join(f'median({f}) as {f}__median' for f in features)} from ctx group by all),
daily as (select m.*, {', '.join(f'd.{f}__mad' for f in features)} from med m join (select c.user_id, c.event_date, {', '.join(f'median(abs(c.{f} - m.{f}__median)) as {f}__mad' for f in features)} from ctx c join med m on c.user_id = m.user_id and c.event_date = m.event_date group by all) d
  on m.user_id = d.user_id and m.event_date = d.event_date)"""


def profile_sql(features: list[str], name: str, source: str, key: str, peer: str) -> str:
    over = f"over (partition by {key} order by event_date rows between {DAYS} preceding and 1 preceding)"
    enough = f"count(*) {over} >= {HISTORY}"
    columns = [f"least(row_number() over (partition by {key} order by event_date) - 1, {DAYS})::bigint as {peer}_history_days"]
    for f in features:
        columns.append(f"case when {enough} then quantile_cont({f}__median, 0.5) {over} end as {f}__{peer}_location")
        columns.append(f"case when {enough} then greatest(1.4826 * quantile_cont({f}__mad, 0.5) {over}, (quantile_cont({f}__median, 0.75) {over} - quantile_cont({f}__median, 0.25) {over}) / 1.349) end as {f}__{peer}_scale")
    return f"{name} as (select {'user_id, ' if peer == 'user' else ''}event_date, role, {', '.join(columns)} from {source})"


def role_daily_sql(features: list[str]) -> str:
    return f"rd as (select role, event_date, {', '.join(f'median({f}__{s}) as {f}__{s}' for f in features for s in ('median', 'mad'))} from daily group by all)"


def profiles_sql(features: list[str]) -> str:
    return f"{daily_sql(features)}, {role_daily_sql(features)}, {profile_sql(features, 'up', 'daily', 'user_id', 'user')}, {profile_sql(features, 'rp', 'rd', 'role', 'role')}"


def z_sql(features: list[str]) -> str:
    return f"""{profiles_sql(features)}, zs as (select c.user_id, c.window_start, {', '.join(
    f"case when coalesce({p}.{q_}_history_days, 0) >= {HISTORY} and {p}.{f}__{q_}_scale is not null and {p}.{f}__{q_}_location is not null then greatest(-25.0, least(25.0, (c.{f} - {p}.{f}__{q_}_location) / greatest({p}.{f}__{q_}_scale, {w.scale_floor(f)}))) else 0.0 end as {f}_{q_}_robust_z"
    for f in features for p, q_ in (('up', 'user'), ('rp', 'role')))}
  from ctx c left join up on c.user_id = up.user_id and c.event_date = up.event_date left join rp on c.role = rp.role and c.event_date = rp.event_date)"""


DAILY, ROLE_DAILY, PROFILES, Z = daily_sql(FEATURES), role_daily_sql(FEATURES), profiles_sql(FEATURES), z_sql(FEATURES)
DAY = ["user_id", "event_date", "role"]


def _daily(act: DataFrame, usr: DataFrame) -> DataFrame:
    return w.daily(w.with_context(w.combine(act), usr), FEATURES)


@query("w_daily_median", "act usr", f"with {DAILY} {rounded_sql('daily', [f'{f}__median' for f in FEATURES], DAY)}")
def w_daily_median(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(_daily(act, usr).select(*DAY, *[f"{f}__median" for f in FEATURES]))


@query("w_daily_mad", "act usr", f"with {DAILY} {rounded_sql('daily', [f'{f}__mad' for f in FEATURES], DAY)}")
def w_daily_mad(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(_daily(act, usr).select(*DAY, *[f"{f}__mad" for f in FEATURES]))


OVER = f"over (partition by user_id order by event_date rows between {DAYS} preceding and 1 preceding)"


@query("w_rolling_quantiles", "act usr", f"with {DAILY} select user_id, event_date, case when count(*) {OVER} >= {HISTORY} then round(quantile_cont(logon_count__median, 0.25) {OVER}, 6) end as q25, case when count(*) {OVER} >= {HISTORY} then round(quantile_cont(logon_count__median, 0.5) {OVER}, 6) end as q50, case when count(*) {OVER} >= {HISTORY} then round(quantile_cont(logon_count__median, 0.75) {OVER}, 6) end as q75 from daily")
def w_rolling_quantiles(act: DataFrame, usr: DataFrame) -> DataFrame:
    three = w.rolling_prior(F.col("logon_count__median"), "user_id", DAYS, HISTORY)
    return _daily(act, usr).select("user_id", "event_date", *[F.round(three[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


def _columns(peer: str) -> list[str]:
    return [f"{f}__{peer}_{s}" for f in FEATURES for s in ("location", "scale")]


@query("w_user_profile", "act usr", f"with {PROFILES} {rounded_sql('up', _columns('user'), [*DAY, 'user_history_days'])}")
def w_user_profile(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(w.profile(_daily(act, usr), FEATURES, "user_id", "user", DAYS, HISTORY).select(*DAY, "user_history_days", *_columns("user")))


@query("w_role_daily", "act usr", f"with {DAILY}, {ROLE_DAILY} {rounded_sql('rd', [f'{f}__{s}' for f in FEATURES for s in ('median', 'mad')], ['role', 'event_date'])}")
def w_role_daily(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(w.role_daily(_daily(act, usr), FEATURES))


@query("w_role_profile", "act usr", f"with {PROFILES} {rounded_sql('rp', _columns('role'), ['role', 'event_date', 'role_history_days'])}")
def w_role_profile(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(w.profile(w.role_daily(_daily(act, usr), FEATURES), FEATURES, "role", "role", DAYS, HISTORY).select("role", "event_date", "role_history_days", *_columns("role")))


ZS = [f"{f}_{p}_robust_z" for f in FEATURES for p in ("user", "role")]


def scored(act: DataFrame, usr: DataFrame) -> DataFrame:
    return w.robust_z(w.with_context(w.combine(act), usr), FEATURES, DAYS, HISTORY)


@query("w_robust_z", "act usr", f"with {Z} {rounded_sql('zs', ZS, ['user_id', 'window_start'], 7)}")
def w_robust_z(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(scored(act, usr).select("user_id", "window_start", *ZS), 7)


@query("w_variants", "act usr", f"with {Z} select (select count(*) from zs) as n_windows, {len(w.CONTEXT) + len(w.BASE_RAW)}::int as base_features, {len(w.CONTEXT) + len(w.BASE_RAW) + len(w.EMAIL)}::int as email_features, round((select sum(logon_event_count + file_activity_count) from ctx), 3) as base_checksum, round((select sum(email_event_count) from ctx), 3) as email_checksum")
def w_variants(act: DataFrame, usr: DataFrame) -> DataFrame:
    df = w.with_context(w.combine(act), usr)
    base, email = w.variant(df, "base"), w.variant(df, "email")
    n = len(base.columns) - 2, len(email.columns) - 2
    return email.agg(F.count(F.lit(1)).alias("n_windows"), F.lit(n[0]).alias("base_features"), F.lit(n[1]).alias("email_features"), F.round(F.sum(F.col("logon_event_count") + F.col("file_activity_count")), 3).alias("base_checksum"), F.round(F.sum("email_event_count"), 3).alias("email_checksum"))


# The queries above and their SQL are over FEATURES; these are the same over all features of the base and email lists.
ALL = [*w.BASELINE_BASE, *w.BASELINE_EMAIL]
ALL_DAILY, ALL_PROFILES, ALL_Z = daily_sql(ALL), profiles_sql(ALL), z_sql(ALL)
ALL_ZS = [f"{f}_{p}_robust_z" for f in ALL for p in ("user", "role")]


def _all_columns(peer: str) -> list[str]:
    return [f"{f}__{peer}_{s}" for f in ALL for s in ("location", "scale")]


def _all_daily(act: DataFrame, usr: DataFrame) -> DataFrame:
    return w.daily(w.with_context(w.combine(act), usr), ALL)


def all_scored(act: DataFrame, usr: DataFrame) -> DataFrame:
    return w.robust_z(w.with_context(w.combine(act), usr), ALL, DAYS, HISTORY)


@query("w_daily_median_all", "act usr", f"with {ALL_DAILY} {rounded_sql('daily', [f'{f}__median' for f in ALL], DAY)}")
def w_daily_median_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(_all_daily(act, usr).select(*DAY, *[f"{f}__median" for f in ALL]))


@query("w_daily_mad_all", "act usr", f"with {ALL_DAILY} {rounded_sql('daily', [f'{f}__mad' for f in ALL], DAY)}")
def w_daily_mad_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(_all_daily(act, usr).select(*DAY, *[f"{f}__mad" for f in ALL]))


@query("w_user_profile_all", "act usr", f"with {ALL_PROFILES} {rounded_sql('up', _all_columns('user'), [*DAY, 'user_history_days'])}")
def w_user_profile_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(w.profile(_all_daily(act, usr), ALL, "user_id", "user", DAYS, HISTORY).select(*DAY, "user_history_days", *_all_columns("user")))


@query("w_role_daily_all", "act usr", f"with {ALL_DAILY}, {role_daily_sql(ALL)} {rounded_sql('rd', [f'{f}__{s}' for f in ALL for s in ('median', 'mad')], ['role', 'event_date'])}")
def w_role_daily_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(w.role_daily(_all_daily(act, usr), ALL))


@query("w_role_profile_all", "act usr", f"with {ALL_PROFILES} {rounded_sql('rp', _all_columns('role'), ['role', 'event_date', 'role_history_days'])}")
def w_role_profile_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(w.profile(w.role_daily(_all_daily(act, usr), ALL), ALL, "role", "role", DAYS, HISTORY).select("role", "event_date", "role_history_days", *_all_columns("role")))


@query("w_robust_z_all", "act usr", f"with {ALL_Z} {rounded_sql('zs', ALL_ZS, ['user_id', 'window_start'], 7)}")
def w_robust_z_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    return rounded(all_scored(act, usr).select("user_id", "window_start", *ALL_ZS), 7)


@query("w_variants_all", "act usr", f"with {ALL_Z} select (select count(*) from zs) as n_windows, 60::int as base_features, 100::int as email_features, round((select sum({' + '.join(f'abs({z})' for z in ALL_ZS if not z.startswith('email_'))}) from zs), 3) as base_z, round((select sum({' + '.join(f'abs({z})' for z in ALL_ZS)}) from zs), 3) as email_z")
def w_variants_all(act: DataFrame, usr: DataFrame) -> DataFrame:
    df = all_scored(act, usr)
    base, email = w.variant(df, "base"), w.variant(df, "email")
    total = lambda of: F.round(F.sum(sum((F.abs(c) for c in of.columns if c.endswith("_robust_z")), F.lit(0.0))), 3)
    return email.agg(F.count(F.lit(1)).alias("n_windows"), F.lit(len(base.columns) - 2).alias("base_features"), F.lit(len(email.columns) - 2).alias("email_features"), total(base).alias("base_z"), total(email).alias("email_z"))


@query("dq_report", "act", """select source, count(*) as n_rows, min(event_time) as first_time, max(event_time) as last_time, sum((coalesce(event_id, '') = '')::int + (event_time is null)::int + (coalesce(user_id, '') = '')::int + (coalesce(pc_id, '') = '')::int + (coalesce(event_type, '') = '')::int)::bigint as missing_required, count(*) - count(distinct event_id) as duplicate_ids from act group by source""")
def dq_report(act: DataFrame) -> DataFrame:
    return q.report(act)


@query("dq_unknown_users", "act usr", "select count(distinct user_id) as n_unknown, array_to_string(list_slice(list_sort(list(distinct user_id)), 1, 20), ',') as examples from (select a.user_id from act a where not exists (select 1 from usr u where u.user_id = a.user_id and u.role <> 'BUILDING')) x")
def dq_unknown_users(act: DataFrame, usr: DataFrame) -> DataFrame:
    return q.unknown(act, usr.where("role <> 'BUILDING'"), "user_id")


@query("normalize_events", "act", "select event_id, event_time, user_id, pc_id, event_type, source, strftime(event_date, '%Y-%m-%d') as event_date, to_removable_media, email_size from act")
def normalize_events(act: DataFrame) -> DataFrame:
    return act.select("event_id", "event_time", "user_id", "pc_id", "event_type", "source", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "to_removable_media", "email_size")


@query("list_dates", "act", "select distinct source, event_date from act")
def list_dates(act: DataFrame) -> DataFrame:
    return act.select("source", "event_date").distinct()


@query("dedupe_first", "act", "select source, pc_id, event_id from act qualify row_number() over (partition by source, pc_id order by event_time, event_id) = 1")
def dedupe_first(act: DataFrame) -> DataFrame:
    return q.first_per_key(act, ["source", "pc_id"], ["event_time", "event_id"]).select("source", "pc_id", "event_id")


@query("dq_invalid_values", "act", """with u as (select distinct user_id as v from act where not regexp_full_match(user_id, '[A-Z]{3}[0-9]{4}')), p as (select distinct pc_id as v from act where not regexp_full_match(pc_id, 'PC-[0-9]{4}')),
e as (select distinct event_type as v from act where not coalesce(case source when 'logon' then event_type in ('Logon', 'Logoff') when 'device' then event_type in ('Connect', 'Disconnect') when 'file' then event_type in ('File Open', 'File Write', 'File Copy', 'File Delete') when 'email' then event_type in ('Send', 'View') end, false))
select 'user_id' as kind, (select count(*) from u) as n, coalesce((select string_agg(v, ',' order by v) from (select v from u order by v limit 20) x), '') as examples
union all select 'pc_id', (select count(*) from p), coalesce((select string_agg(v, ',' order by v) from (select v from p order by v limit 20) x), '')
union all select 'event_type', (select count(*) from e), coalesce((select string_agg(v, ',' order by v) from (select v from e order by v limit 20) x), '')""")
def dq_invalid_values(act: DataFrame) -> DataFrame:
    return q.invalid_values(act)
