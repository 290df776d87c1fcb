"""Streams with state, durable tables and committed offsets: stopped, replayed, late and concurrent."""

import datetime as dt
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from riskweave.operators import correlation as c
from riskweave.sources.versioned import Conflict, VersionedTable
from riskweave.streaming import stateful, streams
from tests.test_streams import feed, run

DAY = dt.datetime(2024, 1, 1)


def logons(spark, n=240):
    r = random.Random(11)
    rows = [(f"{k:05d}", DAY + dt.timedelta(minutes=17 * k + r.randrange(9)), f"U{r.randrange(4)}", r.choice(["Logon", "Logon", "Logoff"]), r.choice(["A", "B", "C", "", None])) for k in range(n)]
    return spark.createDataFrame(rows, "event_id string, event_time timestamp, user_id string, event_type string, pc_id string")


def plain(rows):
    return {r["event_id"]: tuple(None if v is None else round(v, 9) for v in (r["new_pc"], r["non_primary"], r["hour_surprise"], r["minutes"])) for r in rows}


def collected(stream, folder, keep, mode="append"):
    return stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: keep(b.collect())).option("checkpointLocation", folder).start()


@pytest.mark.parametrize("cut", [0, 100, 239])
def test_causal_state_goes_on_from_any_day(spark, tmp_path, cut):
    """A batch run up to some event, then a stream from its state; the stream is stopped and resumed too."""
    df = logons(spark)
    want = plain(stateful.causal_batch(df).collect())
    first, rest = df.where(F.col("event_id") < f"{cut:05d}"), df.where(F.col("event_id") >= f"{cut:05d}")
    initial = stateful.causal_state(first)
    found = []
    stream = feed(spark, rest, str(tmp_path), 3 if cut < 200 else 1, "event_id")
    for _ in range(2):  # the second query goes on from the checkpoint of the first
        query = stateful.causal_logons(stream, initial).writeStream.outputMode("append").trigger(availableNow=True).foreachBatch(lambda b, _: found.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.awaitTermination()
    got = plain(found)
    assert got == {k: v for k, v in want.items() if int(k) >= cut} and len(found) == len(got)


def test_late_records_refold_a_stretch_only(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"A{k}", f"E{k % 2}", "ps1_behavioral", 0.5, DAY + dt.timedelta(minutes=r.randrange(60 * 24 * 40) if k % 10 else r.randrange(600))) for k in range(600)] + [("U1", "E0", "ps1_behavioral", 0.5, None)]
    df = spark.createDataFrame(rows, "assessment_id string, entity_id string, domain string, score double, event_time timestamp")
    stream = feed(spark, df.unionByName(df.limit(40)), str(tmp_path), 12)
    seen, folded = {}, []

    def keep(batch):
        seen.update({x["assessment_id"]: x["anchor"] for x in batch})
        folded.append({x["entity_id"]: x["folded"] for x in batch})

    run(collected(stateful.rewindowed(stream), str(tmp_path / "cp"), keep, "update"))
    assert seen == {x[0]: x[1] for x in c.anchored(df.where("event_time is not null")).select("assessment_id", F.unix_micros("anchor")).collect()}
    late = spark.createDataFrame([("late", "E1", "ps1_behavioral", 0.5, DAY + dt.timedelta(days=20))], df.schema)
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(collected(stateful.rewindowed(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), str(tmp_path / "cp"), keep, "update"))
    assert seen == {x[0]: x[1] for x in c.anchored(df.unionByName(late).where("event_time is not null")).select("assessment_id", F.unix_micros("anchor")).collect()}
    assert folded[-1]["E1"] < 60  # of 300 records


def test_firings_do_not_depend_on_batches(spark, tmp_path):
    rows = [("s", f"{k:04d}", k) for k in range(100)]
    for size in (1, 7, 100):
        folder, fired = tmp_path / str(size), []
        use = rows[:21] if size == 1 else rows
        parts = -(-len(use) // size)
        df = spark.createDataFrame(use, "source string, log_id string, v int")
        stream = feed(spark, df, str(folder), parts, "log_id")
        run(collected(stateful.fired(stream, "source", ["log_id"], 10, 15), str(folder / "cp"), fired.extend))
        got = {}
        for x in fired:
            got.setdefault(x["firing"], []).append(x["v"])
        assert got == {n: list(range(max(0, 10 * n - 15), 10 * n)) for n in range(1, len(use) // 10 + 1)}


INCIDENTS = "incident_id string, entity_id string, status string, score double"


def test_upsert_keeps_lifecycle_and_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), INCIDENTS, ["incident_id"], 4)
    assert t.version() == 0 and t.read().collect() == []
    t.upsert(spark.createDataFrame([(f"I{k}", f"E{k % 3}", "new", 0.1 * k) for k in range(8)], INCIDENTS), "incident_id")
    t.upsert(spark.createDataFrame([("I1", "E1", "acknowledged", 0.1)], INCIDENTS), "incident_id", ())
    t.upsert(spark.createDataFrame([("I1", "E1", "new", 0.9), ("I9", "E0", "new", 0.9)], INCIDENTS), "incident_id")
    now = {r["incident_id"]: (r["status"], r["score"]) for r in t.read().collect()}
    assert len(now) == 9 and now["I1"] == ("acknowledged", 0.9) and now["I9"] == ("new", 0.9) and t.version() == 3
    assert {r["incident_id"]: r["status"] for r in t.read(1).collect()}["I1"] == "new"
    t.replace(spark.createDataFrame([("I20", "E0", "new", 0.5)], INCIDENTS))
    assert sorted(r["incident_id"] for r in t.read().where("entity_id = 'E0'").collect()) == ["I20"] and t.read().count() == 6
    t.drop_before(t.version())
    assert t.read().count() == 6


def test_a_lost_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), INCIDENTS, ["incident_id"], 2)
    rows = lambda *ids: spark.createDataFrame([(i, "E", "new", 0.5) for i in ids], INCIDENTS)
    t.insert_new(rows("a", "b", "b"), "incident_id")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.insert_new(rows("c"), "incident_id")
    assert t.version() == 1 and sorted(r[0] for r in t.read().collect()) == ["a", "b"]
    t.insert_new(rows("a", "c"), "incident_id")
    assert sorted(r[0] for r in t.read().collect()) == ["a", "b", "c"]


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    VersionedTable(spark, path, INCIDENTS, ["incident_id"], 2).insert_new(spark.createDataFrame([("first", "E", "new", 0.0)], INCIDENTS), "incident_id")
    wrong = []

    def write(name):
        try:
            for k in range(3):
                VersionedTable(spark, path, INCIDENTS, ["incident_id"], 2).insert_new(spark.createDataFrame([(f"{name}{k}", "E", "new", 0.5)], INCIDENTS), "incident_id")
        except Exception as x:
            wrong.append(x)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = VersionedTable(spark, path, INCIDENTS, ["incident_id"], 2)
    assert not wrong and sorted(r[0] for r in t.read().collect()) == ["first", "x0", "x1", "x2", "y0", "y1", "y2"] and t.version() == 7
    # one that always comes second gives up
    other = VersionedTable(spark, path, INCIDENTS, ["incident_id"], 2)
    taken = other._commit

    def late(version, manifest):
        t.insert_new(spark.createDataFrame([(f"z{version}", "E", "new", 0.5)], INCIDENTS), "incident_id")
        return taken(version, manifest)

    other._commit = late
    with pytest.raises(Conflict):
        other.change(spark.createDataFrame([("w", "E", "new", 0.5)], INCIDENTS), lambda current, new: current.unionByName(new), attempts=2)
    assert "w" not in {r[0] for r in t.read().collect()}


LEDGER = "assessment_id string, entity_id string, domain string, score double, event_time timestamp"


def test_offsets_are_committed_after_handling(spark, tmp_path):
    """A consumer lost between its sink and its commit gets the batch again, and leaves each record once."""
    topic = tmp_path / "topic"
    topic.mkdir()
    lines = [json.dumps({"assessment_id": f"A{k}", "entity_id": "E", "domain": "ps1_behavioral", "score": 0.5}) for k in range(30)]
    lines[4], lines[9] = "no json", json.dumps({"assessment_id": "A9", "entity_id": "E", "domain": "ps1_behavioral", "score": 7})
    (topic / "p0.log").write_text("\n".join(lines[:20]) + "\n")
    (topic / "p1.log").write_text("\n".join(lines[20:]) + "\nhalf a li")
    ledger, dead = VersionedTable(spark, str(tmp_path / "ledger"), LEDGER, ["assessment_id"], 2), VersionedTable(spark, str(tmp_path / "dead"), "at string, error string, payload string, details string", ["at"], 1)
    handled = []

    def lost(number):
        handled.append(number)
        if len(handled) == 2:
            raise RuntimeError("lost")

    query = streams.consume(streams.tailed(spark, str(topic), "g", 600), ledger, dead, str(tmp_path / "cp1"), lost)
    with pytest.raises(Exception, match="lost"):
        query.processAllAvailable()
    query.stop()
    committed = json.loads((topic / ".committed-g.json").read_text())
    assert sum(committed.values()) < sum((topic / f"p{k}.log").stat().st_size for k in (0, 1))
    before = ledger.read().count()
    assert 0 < before < 28
    # another consumer of the group, without the checkpoint, goes on from what was committed
    run(streams.consume(streams.tailed(spark, str(topic), "g", 600), ledger, dead, str(tmp_path / "cp2")))
    assert sorted(r[0] for r in ledger.read().collect()) == sorted(f"A{k}" for k in range(30) if k not in (4, 9))
    bad = {r["error"]: r for r in dead.read().collect()}
    assert len(bad) == 2 == dead.read().count() and json.loads(bad["score"]["details"]) == {"errors": ["score"]}
    with (topic / "p1.log").open("a") as f:
        f.write("ne\n" + json.dumps({"assessment_id": "new", "entity_id": "E", "domain": "ps1_behavioral", "score": 1.0}) + "\n")
    run(streams.consume(streams.tailed(spark, str(topic), "g", 600), ledger, dead, str(tmp_path / "cp2")))
    assert ledger.read().count() == 29 and dead.read().count() == 3


def test_parsed_lines_of_a_stream(spark, tmp_path):
    good = "ID-1\t01-02-2024 03:04:05\tDTAA/U7\tPC-1001\tLogon"
    df = spark.createDataFrame([(good,), ("broken",)], "line string")
    out = []
    run(collected(streams.parsed(feed(spark, df, str(tmp_path), 2)), str(tmp_path / "cp"), out.extend))
    assert [(r["log_id"], r["user"], r["pc"], r["activity"]) for r in out] == [("ID-1", "U7", "1001", "Logon")]


