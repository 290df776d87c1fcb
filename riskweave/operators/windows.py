"""User-hour windows, rolling robust baselines of users and role peers, and robust z-scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators import events as e
from riskweave.operators.ranks import quantiles
from riskweave.sources.sinks import kept

# Names of measures and features, by source, as the output's contract has them.
LOGON = ["logon_event_count", "logon_count", "logoff_count", "unique_logon_pc_count", "new_logon_pc_count", "non_primary_logon_count", "non_primary_logon_ratio", "login_hour_surprise_mean", "logon_session_count", "logon_session_minutes_sum", "logon_session_minutes_mean", "logon_session_minutes_max"]
DEVICE = ["device_event_count", "device_connect_count", "device_disconnect_count", "new_device_tree_count", "device_session_count", "device_session_minutes_sum", "device_session_minutes_mean", "device_session_minutes_max"]
FILE = ["file_activity_count", "file_open_count", "file_write_count", "file_copy_count", "file_delete_count", "file_to_removable_count", "file_from_removable_count", "file_extension_count", "new_file_path_count"]
EMAIL = ["email_event_count", "email_send_count", "email_view_count", "email_recipient_count", "email_external_recipient_count", "email_external_recipient_ratio", "email_unique_recipient_count", "email_new_recipient_count", "email_cc_bcc_recipient_count", "email_size_sum", "email_size_mean", "email_size_max", "email_attachment_count", "email_attachment_bytes", "email_off_hours_send_count", "email_new_sender_count", "email_external_sender_count", "email_off_hours_view_count"]
BASE_RAW = LOGON + DEVICE + FILE
CONTEXT = ["is_weekend", "is_off_hours", "is_privileged_role", "project_count", "days_to_employment_end", "employment_end_proximity_30d", "event_count_total"]
#: What baselines and z-scores are made of.
BASELINE_BASE = ["logon_count", "unique_logon_pc_count", "new_logon_pc_count", "non_primary_logon_count", "login_hour_surprise_mean", "logon_session_minutes_mean", "device_connect_count", "new_device_tree_count", "device_session_minutes_mean", "file_activity_count", "file_to_removable_count", "new_file_path_count"]
BASELINE_EMAIL = ["email_send_count", "email_view_count", "email_external_recipient_ratio", "email_unique_recipient_count", "email_new_recipient_count", "email_cc_bcc_recipient_count", "email_size_sum", "email_attachment_count", "email_attachment_bytes", "email_new_sender_count", "email_external_sender_count"]
CLIP = 25.0


class WindowError(ValueError):
    """Windows break their contract."""


def tumbling(rows: DataFrame, time: str = "event_time") -> DataFrame:
    """Each row with the start of its hour; hours without rows don't exist."""
    return rows.withColumn("window_start", F.date_trunc("hour", time))


def combine(act: DataFrame) -> DataFrame:
    """One row for each active (user, hour) with all measures, 0 where a source is silent, and the last event's time.

    The four hourly frames are tagged into one union and grouped once, so the outer merge costs one shuffle.
    """
    frames = [(e.logon_hourly(act), LOGON, "logon_last"), (e.device_hourly(act), DEVICE, "device_last"), (e.file_hourly(act), FILE, "file_last"), (e.email_hourly(act), EMAIL, "email_last")]
    every = [c for _, columns, _ in frames for c in columns]
    union = None
    for frame, columns, last in frames:
        part = frame.select("user_id", "window_start", F.col(last).alias("last"), *[F.col(c) if c in columns else F.lit(None).cast("double").alias(c) for c in every])
        union = part if union is None else union.unionByName(part)
    return union.groupBy("user_id", "window_start").agg(F.max("last").alias("event_time"), *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in every])


def project_count(projects: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(projects, F.lit("")), "[;,|]"), lambda p: F.trim(p) != ""))


# Words of titles with wide access.
PRIVILEGED = "(?i)admin|manager|director|president|supervisor|security"


def privileged(title: Column) -> Column:
    return F.coalesce(title.rlike(PRIVILEGED), F.lit(False))


def with_users(rows: DataFrame, users: DataFrame, strict: bool = False) -> DataFrame:
    """Left join to the user dimension; strict raises if a user is unknown."""
    joined = rows.join(users, "user_id", "left")
    if strict and joined.where("role is null").limit(1).count():
        raise WindowError("windows contain unknown users")
    return joined


def with_context(hourly: DataFrame, users: DataFrame) -> DataFrame:
    """Calendar, employment and role context of each window."""
    days = (F.col("end_time").cast("timestamp").cast("double") - F.col("window_start").cast("timestamp").cast("double")) / 86400.0
    out = with_users(hourly, users)
    return out.withColumns({
        "event_date": F.to_date("window_start"), "event_count_total": F.col("logon_event_count") + F.col("device_event_count") + F.col("file_activity_count") + F.col("email_event_count"),
        "is_weekend": (F.weekday("window_start") >= 5).cast("int"), "is_off_hours": e.off_hours(F.col("window_start")).cast("int"), "days_to_employment_end": days,
        "employment_end_proximity_30d": days.between(0, 30).cast("int"), "project_count": project_count(F.col("projects")), "is_privileged_role": privileged(F.col("job_title")).cast("int"),
    }).drop("end_time")


def _changes(batch: pa.RecordBatch, keys: list[str], last: list | None) -> np.ndarray:
    """Whether each row has other keys than the row before it; last: the keys before the first row."""
    out = np.zeros(len(batch), bool)
    for i, k in enumerate(keys):
        values = np.array([None if last is None else last[i], *batch.column(k).to_pylist()], object)
        out |= values[1:] != values[:-1]
    out[0] |= last is None
    return out


def _doubles(column: pa.Array) -> np.ndarray:
    """A null becomes NaN; both sort last."""
    return column.to_numpy(zero_copy_only=False).astype(float, copy=False)


def _between(low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The value at a place between two neighbouring ranks, as percentile has it."""
    up, down = np.ceil(place), np.floor(place)
    return np.where((up == down) | (low == high), low, (up - place) * low + (place - down) * high)


def _medians(values: np.ndarray, group: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each group's n values that aren't null; rows come by group."""
    ordered = values[np.lexsort((values, group))]
    place = np.maximum(n - 1, 0) / 2
    return _between(ordered[starts + np.floor(place).astype(int)], ordered[starts + np.ceil(place).astype(int)], place)


def _streamed(rows: DataFrame, deal: list[str], order: list[str], of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`of` over rows dealt by keys and ordered in their tasks."""
    return rows.repartition(*deal).sortWithinPartitions(*order).mapInArrow(of, schema)


def daily(windows: DataFrame, features: list[str]) -> DataFrame:
    """Median of each feature over a user's active hours of a day, and the median absolute deviation from it.

    Hours are dealt by user and day and ordered, so a task meets each day's hours in a row and holds one batch and one day.
    """
    keys = ["user_id", "event_date", "role"]
    kinds = dict(windows.dtypes)
    names = [*keys, *[f"{f}__median" for f in features], *[f"{f}__mad" for f in features]]

    def summed(day: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(day)))
        medians, deviations = [], []
        for f in features:
            x, known = _doubles(day.column(f)), day.column(f).is_valid().to_numpy(zero_copy_only=False)
            n = np.add.reduceat(known.astype(int), starts)
            median = _medians(x, group, starts, n)
            medians.append(pa.array(median, mask=n == 0))
            deviations.append(pa.array(_medians(np.abs(x - median[group]), group, starts, n), mask=n == 0))
        return pa.RecordBatch.from_arrays([*[day.column(k).take(pa.array(starts)) for k in keys], *medians, *deviations], names=names)

    def whole_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, n, last = [], [], 0, None  # rows since the day that is not known to be over, and where days start there
        for batch in batches:
            if not len(batch):
                continue
            new = np.flatnonzero(_changes(batch, keys, last))
            if len(new):
                if n + new[-1]:
                    yield summed(pa.concat_batches([*held, batch.slice(0, new[-1])]), np.array([*starts, *(n + new[:-1])], int))
                held, starts, n = [batch.slice(new[-1])], [0], len(batch) - new[-1]
            else:
                held, n = [*held, batch], n + len(batch)
            last = [batch.column(k)[-1].as_py() for k in keys]
        if held:
            yield summed(pa.concat_batches(held), np.array(starts, int))

    rows = windows.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return _streamed(rows, ["user_id", "event_date"], keys, whole_days, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names))


def rolling_prior(x: Column, key: str, days: int, least: int, order: str = "event_date") -> Column:
    """Exact quartiles over the `days` rows before this one, null until there are `least`."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-days, -1)
    return F.when(F.count(F.lit(1)).over(w) >= least, F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w))


def profile(summaries: DataFrame, features: list[str], key: str, peer: str, days: int, least: int) -> DataFrame:
    """Location (rolling median) and scale (larger of the rolling MAD and quartile estimates) of each feature, and history.

    A task meets the days of a key in a row and carries the last `days` of them from batch to batch. What rolling_prior
    finds, of all features at once.
    """
    carried = [f"{f}__{s}" for f in features for s in ("median", "mad")]
    found = [f"{f}__{peer}_{s}" for f in features for s in ("location", "scale")]
    summaries = summaries.select(*[F.col(c).cast("double").alias(c) if c in carried else F.col(c) for c in summaries.columns])

    def quartiles(x: np.ndarray, known: np.ndarray, at: np.ndarray, inside: np.ndarray, wanted: tuple[float, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
        n = (inside & known[at]).sum(1)
        ordered = np.sort(np.where(inside, x[at], np.nan), axis=1)
        row, out = np.arange(len(at)), []
        for f in wanted:
            place = np.maximum(n - 1, 0) * f
            out.append(_between(ordered[row, np.floor(place).astype(int)], ordered[row, np.ceil(place).astype(int)], place))
        return n, out

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last, seen = None, None, np.zeros(0, int)  # the last rows of the batches before, and how many of its key stand before each
        for batch in batches:
            if not len(batch):
                continue
            change = _changes(batch, [key], last)
            index = np.arange(len(batch))
            start = np.maximum.accumulate(np.where(change, index, -1))
            prior = np.where(start >= 0, index - start, index + (seen[-1] + 1 if len(seen) else 0))
            table = batch if before is None else pa.concat_batches([before, batch])
            skip = len(table) - len(batch)
            at = np.arange(skip, len(table))[:, None] - np.arange(days, 0, -1)
            history = np.minimum(prior, days)
            inside = np.arange(days, 0, -1) <= history[:, None]
            at = np.where(inside, at, 0)
            columns = []
            for f in features:
                read = lambda c: (_doubles(table.column(c)), table.column(c).is_valid().to_numpy(zero_copy_only=False))
                n, (low, middle, high) = quartiles(*read(f"{f}__median"), at, inside, (0.25, 0.5, 0.75))
                n_mad, (mad,) = quartiles(*read(f"{f}__mad"), at, inside, (0.5,))
                none, none_mad = (history < least) | (n == 0), (history < least) | (n_mad == 0)
                spread, mad = (high - low) / 1.349, 1.4826 * mad
                columns += [pa.array(middle, mask=none), pa.array(np.where(none_mad, spread, np.where(none, mad, np.maximum(mad, spread))), mask=none & none_mad)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(history), *columns], names=[*batch.schema.names, f"{peer}_history_days", *found])
            before, last, seen = table.slice(max(0, len(table) - days)), [batch.column(key)[-1].as_py()], prior[-1:]

    kinds = [*summaries.dtypes, (f"{peer}_history_days", "bigint"), *[(c, "double") for c in found]]
    return _streamed(summaries, [key], [key, "event_date"], rolled, ", ".join(f"{c} {t}" for c, t in kinds))


def role_daily(summaries: DataFrame, features: list[str]) -> DataFrame:
    """Median over a role's users of their daily medians and deviations."""
    columns = [f"{f}__{s}" for f in features for s in ("median", "mad")]
    found = quantiles(summaries, columns, [0.5], ["role", "event_date"])
    return found.groupBy("role", "event_date").agg(*[F.max(F.when(F.col("feature") == c, F.col("values")[0])).alias(c) for c in columns])


def scale_floor(feature: str) -> float:
    """The least scale of a feature, by its unit."""
    if "ratio" in feature:
        return 0.05
    if "bytes" in feature or "size_sum" in feature:
        return 1024.0
    return 0.1 if "surprise" in feature else 1.0


def robust_z(windows: DataFrame, features: list[str], days: int = 30, least: int = 7) -> DataFrame:
    """Windows with a clipped robust z against the user's own and the role's prior days; 0 without enough history, where
    profiles have no location or scale.

    Windows and their days are kept, since both profiles and the result read them.
    """
    windows = kept(windows)
    summaries = kept(daily(windows, features))
    user = profile(summaries, features, "user_id", "user", days, least).select("user_id", "event_date", "user_history_days", *[f"{f}__user_{s}" for f in features for s in ("location", "scale")])
    role = profile(role_daily(summaries, features), features, "role", "role", days, least).select("role", "event_date", "role_history_days", *[f"{f}__role_{s}" for f in features for s in ("location", "scale")])
    out = windows.join(user, ["user_id", "event_date"], "left").join(role, ["role", "event_date"], "left")
    z = {}
    for f in features:
        for peer in ("user", "role"):
            loc, scale = F.col(f"{f}__{peer}_location"), F.col(f"{f}__{peer}_scale")
            z[f"{f}_{peer}_robust_z"] = F.when(loc.isNotNull() & scale.isNotNull(), F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col(f) - loc) / F.greatest(scale, F.lit(scale_floor(f)))))).otherwise(0.0)
    return out.withColumns(z).drop(*[f"{f}__{p}_{s}" for f in features for p in ("user", "role") for s in ("location", "scale")])


def variant(windows: DataFrame, name: str) -> DataFrame:
    """The model columns of a variant, base or email, by an explicit list; raw identifiers stay out but for the key."""
    zs = [c for c in windows.columns if c.endswith("_robust_z") and (name == "email" or not c.startswith("email_"))]
    return windows.select("user_id", "window_start", *CONTEXT, *BASE_RAW, *(EMAIL if name == "email" else []), *zs)
