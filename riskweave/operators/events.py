"""Causal features of activity events: what each event is against the same user's earlier ones, in (time, id) order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("event_time", "event_id")
INTERNAL = "dtaa.com"
MAX_SESSION_MINUTES = 1440.0


def _by(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def first_of(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """flag = 1 where the keys occur for the first time; a null or empty last key is never new."""
    last = F.col(keys[-1])
    new = (F.row_number().over(_by(*keys)) == 1) & (F.coalesce(last, F.lit("")) != "")
    return rows.withColumn(flag, new.cast("int"))


def non_primary_pc(logons: DataFrame) -> DataFrame:
    """1 where the pc isn't the user's most frequent earlier one (ties to the smaller name); 0 without history.

    Each row brings its pc's count so far. Of the rows before, those with the largest count are pcs that have been seen so
    often, and none has been seen more often since; so a running minimum of (-count, pc) is the most frequent one.
    """
    n = F.row_number().over(_by("user_id", "pc_id"))
    counted = logons.withColumn("__seen", F.when(F.col("pc_id").isNotNull(), F.struct((-n).alias("n"), F.col("pc_id").alias("pc"))))
    found = counted.withColumn("__best", F.min("__seen").over(_before(_by("user_id"))))
    return found.select("event_id", F.coalesce((F.col("pc_id") != F.col("__best.pc")).cast("int"), F.lit(0)).alias("non_primary"))


def hour_surprise(logons: DataFrame) -> DataFrame:
    """-ln of the smoothed share of the user's earlier logons in this hour of the day."""
    hour = logons.withColumn("hour", F.hour("event_time"))
    same, every = F.count(F.lit(1)).over(_before(_by("user_id", "hour"))), F.count(F.lit(1)).over(_before(_by("user_id")))
    return hour.withColumn("hour_surprise", -F.log((same + 1) / (every + 24))).drop("hour")


def session_minutes(events: DataFrame, opens: str, closes: str, out: str) -> DataFrame:
    """Minutes since the open event of (user, pc) that a close event ends; null without one, or beyond a day."""
    w = _by("user_id", "pc_id")
    minutes = (F.unix_micros("event_time") - F.lag(F.unix_micros("event_time")).over(w)) / 60000000.0
    paired = F.when((F.col("event_type") == closes) & (F.lag("event_type").over(w) == opens), minutes)
    return events.withColumn(out, paired).withColumn(out, F.when(F.col(out).between(0, MAX_SESSION_MINUTES), F.col(out)))


def extension(name: Column) -> Column:
    """Lower-cased suffix of a path's last part, from its last dot, or null."""
    return F.nullif(F.lower(F.regexp_extract(name, r"[^\\/.][^\\/]*(\.[^.\\/]+)$", 1)), F.lit(""))


def addresses(*columns: str) -> Column:
    """The trimmed, lower-cased addresses of semicolon lists, empty ones dropped."""
    return F.filter(F.transform(F.split(F.concat_ws(";", *columns), ";"), lambda a: F.lower(F.trim(a))), lambda a: a != "")


def external(address: Column, internal: str = INTERNAL) -> Column:
    """Whether an address has a domain, after its last @, other than the internal one."""
    return F.contains(address, F.lit("@")) & (F.substring_index(address, "@", -1) != internal)


def attachments(column: Column) -> tuple[Column, Column]:
    """Count of non-empty pieces of an attachment list, and the sum of the sizes in brackets."""
    pieces = F.size(F.filter(F.split(F.coalesce(column, F.lit("")), ";"), lambda p: F.trim(p) != ""))
    sizes = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"\(([0-9]+)\)(?:;|$)"), F.lit(1))
    return pieces, F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def new_recipients(sends: DataFrame) -> DataFrame:
    """Per sent message, how many of its distinct recipients the user has not written to before."""
    each = sends.select("event_id", "event_time", "user_id", F.explode(F.array_distinct(addresses("email_to", "email_cc", "email_bcc"))).alias("address"))
    return first_of(each, ["user_id", "address"], "new").groupBy("event_id").agg(F.sum("new").cast("bigint").alias("new_recipients"))


def off_hours(ts: Column, start: int = 8, end: int = 18) -> Column:
    return (F.hour(ts) < start) | (F.hour(ts) >= end)


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0."""
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def _hour(events: DataFrame) -> DataFrame:
    return events.withColumn("window_start", F.date_trunc("hour", "event_time"))


def _sum(column: Column, name: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("double").alias(name)


def _sessions(prefix: str) -> list[Column]:
    m = F.col("minutes")
    return [F.count(m).cast("double").alias(f"{prefix}_session_count"), _sum(m, f"{prefix}_session_minutes_sum"), F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{prefix}_session_minutes_mean"), F.coalesce(F.max(m), F.lit(0.0)).alias(f"{prefix}_session_minutes_max")]


def logon_hourly(act: DataFrame) -> DataFrame:
    """The logon measures of each (user, hour)."""
    rows = act.where("source = 'logon'")
    logons = rows.where("event_type = 'Logon'")
    marked = hour_surprise(first_of(logons, ["user_id", "pc_id"], "new_pc")).select("event_id", "new_pc", "hour_surprise").join(non_primary_pc(logons), "event_id")
    rows = _hour(session_minutes(rows, "Logon", "Logoff", "minutes")).join(marked, "event_id", "left")
    kind = lambda k: (F.col("event_type") == k).cast("int")
    out = rows.groupBy("user_id", "window_start").agg(
        F.count(F.lit(1)).cast("double").alias("logon_event_count"), _sum(kind("Logon"), "logon_count"), _sum(kind("Logoff"), "logoff_count"),
        F.count_distinct("pc_id").cast("double").alias("unique_logon_pc_count"), _sum(F.col("new_pc"), "new_logon_pc_count"), _sum(F.col("non_primary"), "non_primary_logon_count"),
        F.coalesce(F.avg("hour_surprise"), F.lit(0.0)).alias("login_hour_surprise_mean"), *_sessions("logon"), F.max("event_time").alias("logon_last"),
    )
    return out.withColumn("non_primary_logon_ratio", ratio(F.col("non_primary_logon_count"), F.col("logon_count")))


def device_hourly(act: DataFrame) -> DataFrame:
    """The device measures of each (user, hour)."""
    rows = act.where("source = 'device'")
    new = first_of(rows.where("event_type = 'Connect' and coalesce(device_file_tree, '') <> ''"), ["user_id", "device_file_tree"], "new_tree").select("event_id", "new_tree")
    rows = _hour(session_minutes(rows, "Connect", "Disconnect", "minutes")).join(new, "event_id", "left")
    kind = lambda k: (F.col("event_type") == k).cast("int")
    return rows.groupBy("user_id", "window_start").agg(
        F.count(F.lit(1)).cast("double").alias("device_event_count"), _sum(kind("Connect"), "device_connect_count"), _sum(kind("Disconnect"), "device_disconnect_count"),
        _sum(F.col("new_tree"), "new_device_tree_count"), *_sessions("device"), F.max("event_time").alias("device_last"),
    )


def file_hourly(act: DataFrame) -> DataFrame:
    """The file measures of each (user, hour)."""
    rows = _hour(first_of(act.where("source = 'file'"), ["user_id", "file_name"], "new_path"))
    kind = lambda k: (F.col("event_type") == k).cast("int")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return rows.groupBy("user_id", "window_start").agg(
        F.count(F.lit(1)).cast("double").alias("file_activity_count"), _sum(kind("File Open"), "file_open_count"), _sum(kind("File Write"), "file_write_count"), _sum(kind("File Copy"), "file_copy_count"),
        _sum(kind("File Delete"), "file_delete_count"), _sum(flag("to_removable_media"), "file_to_removable_count"), _sum(flag("from_removable_media"), "file_from_removable_count"),
        F.count_distinct(extension(F.col("file_name"))).cast("double").alias("file_extension_count"), _sum(F.col("new_path"), "new_file_path_count"), F.max("event_time").alias("file_last"),
    )


def email_hourly(act: DataFrame) -> DataFrame:
    """The e-mail measures of each (user, hour); recipients count for sent messages, senders for viewed ones."""
    rows = _hour(act.where("source = 'email'"))
    sends, views = rows.where("event_type = 'Send'"), rows.where("event_type = 'View'")
    to = addresses("email_to", "email_cc", "email_bcc")
    pieces, sizes = attachments(F.col("email_attachments"))
    sent = sends.join(new_recipients(sends), "event_id", "left").select(
        "user_id", "window_start", "event_time", F.lit(1).alias("send"), F.lit(0).alias("view"), F.size(to).alias("recipients"), F.size(F.filter(to, lambda a: external(a))).alias("outside"),
        F.coalesce("new_recipients", F.lit(0)).alias("new_recipients"), F.size(addresses("email_cc", "email_bcc")).alias("cc_bcc"), F.col("email_size").alias("size"), pieces.alias("pieces"), sizes.alias("bytes"),
        off_hours(F.col("event_time")).cast("int").alias("send_off"), F.lit(0).alias("new_sender"), F.lit(0).alias("external_sender"), F.lit(0).alias("view_off"),
    )
    seen = first_of(views.withColumn("sender", F.lower(F.trim(F.coalesce("email_from", F.lit(""))))), ["user_id", "sender"], "new_sender").select(
        "user_id", "window_start", "event_time", F.lit(0).alias("send"), F.lit(1).alias("view"), *[F.lit(0).alias(c) for c in ("recipients", "outside", "new_recipients", "cc_bcc")], F.lit(None).cast("bigint").alias("size"),
        F.lit(0).alias("pieces"), F.lit(0).cast("bigint").alias("bytes"), F.lit(0).alias("send_off"), "new_sender", external(F.col("sender")).cast("int").alias("external_sender"), off_hours(F.col("event_time")).cast("int").alias("view_off"),
    )
    out = sent.unionByName(seen).groupBy("user_id", "window_start").agg(
        F.count(F.lit(1)).cast("double").alias("email_event_count"), _sum(F.col("send"), "email_send_count"), _sum(F.col("view"), "email_view_count"), _sum(F.col("recipients"), "email_recipient_count"),
        _sum(F.col("outside"), "email_external_recipient_count"), _sum(F.col("new_recipients"), "email_new_recipient_count"), _sum(F.col("cc_bcc"), "email_cc_bcc_recipient_count"), _sum(F.col("size"), "email_size_sum"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("email_size_mean"), F.coalesce(F.max("size"), F.lit(0)).cast("double").alias("email_size_max"), _sum(F.col("pieces"), "email_attachment_count"), _sum(F.col("bytes"), "email_attachment_bytes"),
        _sum(F.col("send_off"), "email_off_hours_send_count"), _sum(F.col("new_sender"), "email_new_sender_count"), _sum(F.col("external_sender"), "email_external_sender_count"), _sum(F.col("view_off"), "email_off_hours_view_count"), F.max("event_time").alias("email_last"),
    )
    distinct = sends.select("user_id", "window_start", F.explode(to).alias("a")).groupBy("user_id", "window_start").agg(F.count_distinct("a").cast("double").alias("email_unique_recipient_count"))
    out = out.join(distinct, ["user_id", "window_start"], "left").withColumn("email_unique_recipient_count", F.coalesce("email_unique_recipient_count", F.lit(0.0)))
    return out.withColumn("email_external_recipient_ratio", ratio(F.col("email_external_recipient_count"), F.col("email_recipient_count")))
