"""Keyed stream processors whose state is spread over small entries, so that a batch touches what it needs and no more.

They need the state store that `configured` sets. A key's rows may come in any number of batches; what is kept between them
lies in the state store and survives a restart from the checkpoint. Columns: those of activity events or assessments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskweave.operators import correlation as c
from riskweave.operators import events as e

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configured(spark: SparkSession) -> SparkSession:
    """The session with a state store that holds maps and lists by entry."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True)


class _Entries:
    """Entries of a map state that a batch has read or changed; changed ones are written once."""

    def __init__(self, state, empty):
        self.state, self.empty, self.have, self.changed = state, empty, {}, set()

    def get(self, key):
        if key not in self.have:
            self.have[key] = tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else self.empty
        return self.have[key]

    def put(self, key, value: tuple) -> None:
        self.have[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            self.state.updateValue((key,), self.have[key])


# --- what each logon or logoff is against the user's earlier ones ---------------------------------------------------------

#: Stands for no pc in the state.
NO_PC = "\0"
CAUSAL = "event_id string, user_id string, new_pc int, non_primary int, hour_surprise double, minutes double"
#: Rows of a user's state as a table: what it counts (pc, hour), or the last event of a pc, by name.
STATE = "user_id string, kind string, name string, n long, last string, micros long"


class CausalLogons(StatefulProcessor):
    """Counts by pc and by hour, and each pc's last event; see causal_logons."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pcs = handle.getMapState("pcs", "pc string", "n long")
        self.hours = handle.getMapState("hours", "hour int", "n long")
        self.last = handle.getMapState("last", "pc string", "event string, micros long")
        self.best = handle.getValueState("best", "n long, pc string, logons long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        best, logons = (0, None), 0
        for r in (initialState if isinstance(initialState, pd.DataFrame) else _rows(initialState)).to_dict("records"):
            if r["kind"] == "pc":
                self.pcs.updateValue((r["name"],), (int(r["n"]),))
                if r["name"] != NO_PC:
                    best = min(best, (-int(r["n"]), r["name"])) if best[1] is not None else (-int(r["n"]), r["name"])
            elif r["kind"] == "hour":
                self.hours.updateValue((int(r["name"]),), (int(r["n"]),))
                logons += int(r["n"])
            else:
                self.last.updateValue((r["name"],), (r["last"], int(r["micros"])))
        self.best.update((-best[0], best[1], logons))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pcs, hours, last = _Entries(self.pcs, (0,)), _Entries(self.hours, (0,)), _Entries(self.last, (None, 0))
        n, best, logons = self.best.get() if self.best.exists() else (0, None, 0)
        out = []
        for r in _rows(rows).sort_values(["event_time", "event_id"]).to_dict("records"):
            pc, micros = r["pc_id"], int(r["us"])
            known = pc is not None and pc == pc
            name = pc if known else NO_PC
            new = surprise = minutes = primary = None
            if r["event_type"] == "Logon":
                hour = micros // 3_600_000_000 % 24
                (same,), (seen,) = hours.get(hour), pcs.get(name)
                new, primary = int(known and pc != "" and not seen), int(best is not None and known and pc != best)
                surprise = -math.log((same + 1) / (logons + 24))
                hours.put(hour, (same + 1,))
                pcs.put(name, (seen + 1,))
                logons += 1
                if known and (best is None or (-(seen + 1), pc) < (-n, best)):
                    n, best = seen + 1, pc
            event, at = last.get(name)
            if r["event_type"] == "Logoff" and event == "Logon":
                minutes = (micros - at) / 60_000_000
                minutes = minutes if 0 <= minutes <= e.MAX_SESSION_MINUTES else None
            last.put(name, (r["event_type"], micros))
            out.append((r["event_id"], key[0], new, primary, surprise, minutes))
        for x in (pcs, hours, last):
            x.write()
        self.best.update((n, best, logons))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "new_pc", "non_primary", "hour_surprise", "minutes"]).astype({"new_pc": "Int32", "non_primary": "Int32", "hour_surprise": "Float64", "minutes": "Float64"})


def causal_logons(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """event_id, user_id, new_pc, non_primary, hour_surprise and minutes of logon events, as the batch operators give them.

    Batches come in order of time (a day's file a batch). initial: the state of earlier days, from causal_state, so that a
    stream can go on where a batch run ended. Hours are those of UTC. State of a user: an entry for each pc and hour.
    """
    configured(events.sparkSession)
    rows = events.select("user_id", "event_id", "event_time", "event_type", "pc_id", F.unix_micros("event_time").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(CausalLogons(), CAUSAL, "Append", "None", initial.groupBy("user_id") if initial is not None else None)


def causal_state(events: DataFrame) -> DataFrame:
    """What causal_logons keeps of each user after these events, as a table."""
    pc = F.coalesce("pc_id", F.lit(NO_PC))
    logons = events.where("event_type = 'Logon'")
    none = [F.lit(None).cast("string").alias("last"), F.lit(None).cast("long").alias("micros")]
    pcs = logons.groupBy("user_id", pc.alias("name")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.lit("pc").alias("kind"), "name", "n", *none)
    hours = logons.groupBy("user_id", F.hour("event_time").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.lit("hour").alias("kind"), "name", "n", *none)
    last = events.groupBy("user_id", pc.alias("name")).agg(F.max(F.struct("event_time", "event_id", "event_type")).alias("e"))
    last = last.select("user_id", F.lit("last").alias("kind"), "name", F.lit(None).cast("long").alias("n"), F.col("e.event_type").alias("last"), F.unix_micros("e.event_time").alias("micros"))
    return pcs.unionByName(hours).unionByName(last)


def causal_batch(events: DataFrame) -> DataFrame:
    """The same columns from a whole table."""
    logons = events.where("event_type = 'Logon'")
    of = e.hour_surprise(e.first_of(logons, ["user_id", "pc_id"], "new_pc")).select("event_id", "new_pc", "hour_surprise").join(e.non_primary_pc(logons), "event_id")
    return e.session_minutes(events, "Logon", "Logoff", "minutes").select("event_id", "user_id", "minutes").join(of, "event_id", "left").select("event_id", "user_id", "new_pc", "non_primary", "hour_surprise", "minutes")


# --- anchored windows of records that come in any order -------------------------------------------------------------------


class Rewindowed(StatefulProcessor):
    """An entity's records by stretch of time; see rewindowed."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "id string", "bucket long")
        self.buckets = handle.getMapState("buckets", "bucket long", "ids array<string>, times array<bigint>, anchors array<bigint>, open bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ids, buckets = _Entries(self.ids, ()), _Entries(self.buckets, ((), (), (), None))
        fresh: dict[int, list[tuple[int, str]]] = {}
        for i, t in _rows(rows)[["assessment_id", "us"]].itertuples(index=False):
            if not ids.get(i):
                b = int(t) // self.limit
                ids.put(i, (b,))
                fresh.setdefault(b, []).append((int(t), i))
        out, todo, folded = [], sorted(fresh), 0
        while todo:
            b = todo.pop(0)
            have, times, anchors, before = buckets.get(b)
            # an anchor two stretches back is out of reach of any record here
            open_ = buckets.get(b - 1)[3]
            old = dict(zip(have, anchors))
            records, now = sorted([*zip(times, have), *fresh.get(b, [])]), []
            for t, i in records:
                open_ = t if open_ is None or t - open_ > self.limit else open_
                now.append(open_)
                if old.get(i) != open_:
                    out.append((i, key[0], open_))
            folded += len(records)
            buckets.put(b, ([i for _, i in records], [t for t, _ in records], now, open_))
            if open_ != before and (not todo or todo[0] != b + 1) and buckets.get(b + 1)[0]:
                todo.insert(0, b + 1)
        ids.write()
        buckets.write()
        yield pd.DataFrame([(*r, folded) for r in out], columns=["assessment_id", "entity_id", "anchor", "folded"])


def rewindowed(assessments: DataFrame, minutes: int = c.WINDOW_MINUTES) -> DataFrame:
    """assessment_id, entity_id and anchor (microseconds) of timed records whose window is new or has changed, and folded:
    how many records of the entity the batch has looked at.

    Lateness has no limit. A record is put into its stretch of one window's length; windows are folded again from there,
    only until a stretch ends with the anchor that it had. So a late record costs what lies between it and the next gap,
    whatever the entity's history, and the last output of a record is what a batch over all records gives. The first record
    of an id counts. State: an entry for each stretch with records, and one for each id.
    """
    configured(assessments.sparkSession)
    timed = assessments.where("event_time is not null").select("entity_id", "assessment_id", F.unix_micros("event_time").alias("us"))
    return timed.groupBy("entity_id").transformWithStateInPandas(Rewindowed(minutes * 60_000_000), "assessment_id string, entity_id string, anchor bigint, folded bigint", "Update", "None")


# --- a buffer that fires by count -----------------------------------------------------------------------------------------


class Buffered(StatefulProcessor):
    """The rows not fired yet and the tail of those fired; see fired."""

    def __init__(self, size: int, keep: int, columns: list[str], kinds: str, order: list[str]):
        self.size, self.keep, self.columns, self.kinds, self.order = size, keep, columns, kinds, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting, self.tail = handle.getListState("waiting", self.kinds), handle.getListState("tail", self.kinds)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows).sort_values(self.order)[self.columns]
        waiting = [*(tuple(r) for r in self.waiting.get()), *new.itertuples(index=False, name=None)] if self.waiting.exists() else list(new.itertuples(index=False, name=None))
        tail = [tuple(r) for r in self.tail.get()] if self.tail.exists() else []
        n = self.count.get()[0] if self.count.exists() else 0
        while len(waiting) >= self.size:
            tail, waiting = [*tail, *waiting[: self.size]][-self.keep :], waiting[self.size :]
            n += 1
            yield pd.DataFrame(tail, columns=self.columns).assign(firing=n)
        for state, value in ((self.waiting, waiting), (self.tail, tail)):
            if value:
                state.put(value)
            else:
                state.clear()
        self.count.update((n,))


def fired(rows: DataFrame, by: str, order: list[str], size: int = 50, keep: int = 50) -> DataFrame:
    """The last `keep` rows of a key each time that `size` more have come, with the number of the firing.

    Firings depend on the order of rows alone, not on the batches that they come in; within a batch rows go by `order`.
    """
    configured(rows.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(by).transformWithStateInPandas(Buffered(size, keep, rows.columns, kinds, order), f"{kinds}, firing long", "Append", "None")
