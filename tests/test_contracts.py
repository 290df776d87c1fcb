"""Contracts, exact fixed cases and sinks: what raises, what is refused, and what a stream leaves."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from riskweave.functions import scalars as s
from riskweave.operators import correlation as c
from riskweave.operators import incidents as i
from riskweave.operators import models as m
from riskweave.operators import quality as q
from riskweave.operators import transactions as t
from riskweave.sources import readers, sinks
from riskweave.sources.versioned import VersionedTable
from riskweave.streaming import streams
from tests.test_operators import B, X, assessments
from tests.test_streams import feed, run, sample


def test_revoke_needs_corroborated_high_scores(spark):
    found = c.incidents(c.anchored(assessments(spark, [("E", B, 0.95, 0), ("E", X, 0.95, 119)]))).collect()
    assert [(r["access_decision"], r["confidence"]) for r in found] == [("revoke", "high")]


def test_user_dimension(spark):
    row = ("U1", "r", "P1", "b", "f", "d", "t", "2024-01-01")
    users = lambda *rows: spark.createDataFrame(list(rows), [f"{c}" for c in q.USER_COLUMNS])
    assert q.user_dimension(users(row, ("U2", *row[1:-1], "01/31/2024 07:00:00"))).orderBy("user_id").select("end_time").collect()[1][0] == dt.datetime(2024, 1, 31, 7)
    for bad in (users(row).drop("team"), users(row, row), users((*row[:-1], "soon"))):
        with pytest.raises(q.QualityError):
            q.user_dimension(bad)


def test_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+02:00", "2024-01-02", "2024", "x", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(s.iso_time(F.col("t"))).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 1, 4, 5, 500000), dt.datetime(2024, 1, 2), None, None, None]
    rows = lambda x: spark.createDataFrame([(x,)], "t string")
    assert q.parsed_times(rows("07/04/2021 12:00:00"), "t", "u", "America/New_York").first()["u"] == dt.datetime(2021, 7, 4, 16)
    for skipped_or_twice in ("03/14/2021 02:30:00", "11/07/2021 01:30:00"):
        with pytest.raises(Exception, match="skipped|ambiguous"):
            q.parsed_times(rows(skipped_or_twice), "t", "u", "America/New_York").collect()
    with pytest.raises(q.QualityError, match="31/31"):
        q.parsed_times(rows("31/31/2021"), "t", "u")
    with pytest.raises(Exception, match="not a boolean"):
        rows("yes").select(s.strict_bool(F.col("t"))).collect()
    assert [tuple(r) for r in spark.createDataFrame([(True,), (False,), (None,)], "b boolean").select(s.flag_number(F.col("b"))).collect()] == [(1.0,), (0.0,), (0.0,)]


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, (2, dt.datetime(2024, 1, 1), [("b", "a")]))], "z int, a struct<y: int, x: timestamp, w: array<struct<q: string, p: string>>>")
    assert df.select(s.canonical_json(df)).first()[0] == '{"a":{"w":[{"p":"a","q":"b"}],"x":"2024-01-01T00:00:00Z","y":2},"z":1}'


def test_published_is_whole_or_absent(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.range(5)

    def fails(p):
        rows.write.parquet(p)
        raise RuntimeError("half way")

    with pytest.raises(RuntimeError):
        sinks.published(spark, path, fails)
    assert not list(tmp_path.iterdir())
    sinks.published(spark, path, lambda p: rows.write.parquet(p))
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(sinks.OutputExists):
        sinks.published(spark, path, lambda p: rows.write.parquet(p))
    assert [x.name for x in tmp_path.iterdir()] == ["out"] and spark.read.parquet(path).count() == 5


def test_report_and_one_csv(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([("logon", 3)], "source string, n int"), str(tmp_path / "r"))
    assert json.loads("".join(x.read_text() for x in (tmp_path / "r").glob("part-*"))) == {"source": "logon", "n": 3}
    schema = spark.createDataFrame([(1, "x")], "a int, b string").schema
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.csv").write_text("a,b\n1,x\n")
    assert readers.one_csv(spark, str(tmp_path / "one"), schema).collect() == [(1, "x")]
    (tmp_path / "one/b.csv").write_text("a,b\n2,y\n")
    with pytest.raises(readers.ContractError):
        readers.one_csv(spark, str(tmp_path / "one"), schema)
    found = readers.fingerprints(spark, [str(tmp_path / "one/a.csv")]).first()
    assert tuple(found) == ("a.csv", 8, hashlib.sha256(b"a,b\n1,x\n").hexdigest())


def test_backfill_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    assert sorted(map(tuple, readers.backfilled(df, {"b": F.col("a") * 10, "c": F.lit(0)}).collect())) == [(1, 10, 0), (2, 5, 0)]


def test_exactly_one(spark):
    tx = spark.createDataFrame([("C1", 1, 2.0, 1), ("C1", 1, 2.0, 2), ("C2", 1, 2.0, 3)], "nameOrig string, step long, amount double, row_id long")
    assert t.exactly_one(t.joined_back(tx.where("row_id = 3"), tx)).collect()[0]["row_id"] == 3
    for bad in (tx.where("row_id = 1"), tx.where("row_id = 3").withColumn("step", F.lit(9).cast("long"))):
        with pytest.raises(ValueError):
            t.exactly_one(t.joined_back(bad, tx))


def test_landing_order(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("c", 2)], "incident_id string, landed_at int")
    assert [r[0] for r in i.by_landing(df).collect()] == ["c", "b", "a"]


def test_knots_never_fall_and_deltas(spark):
    df = spark.createDataFrame([(k, k / 10) for k in range(40)], "k int, x double")
    found = [r["knot"] for r in m.knots(df, "x").orderBy("i").collect()]
    assert len(found) == 1001 and found == sorted(found) and (found[0], found[-1]) == (0.0, 3.9)
    moved = m.risk_deltas(df, df.withColumn("x", F.col("x") + F.when(F.col("k") < 10, 1.0).otherwise(0.0)), "k", "x").first()
    assert tuple(moved) == (0.0, 0.25, 0.25)


def test_buffer_decisions_and_snapshots(spark, tmp_path):
    rows = [(f"{k:03d}", f"logon pc{k % 3} morning" if k != 37 else "exfiltrate secret archive upload device night") for k in range(60)]
    df = spark.createDataFrame(rows, "log_id string, line string")
    assert m.buffer_decisions(df.limit(10), "log_id", "line").collect() == []
    found = {r["log_id"]: r for r in m.buffer_decisions(df.where("log_id >= '010'"), "log_id", "line", trees=30).collect()}
    assert len(found) == 50 and found["037"]["prediction"] == -1 and found["037"]["decision"] == min(r["decision"] for r in found.values())
    assert 1 <= sum(r["prediction"] == -1 for r in found.values()) <= 3 and len(found["037"]["terms"].split()) == 5
    stream = feed(spark, df, str(tmp_path), 2, "log_id")
    schema = m.anomaly_report(m.buffer_decisions(df, "log_id", "line", window=30, trees=2)).schema
    table = VersionedTable(spark, str(tmp_path / "snap"), schema, ["total_logs"], 1)
    run(streams.snapshots(stream, table, str(tmp_path / "cp"), lambda b: m.anomaly_report(m.buffer_decisions(b.where("log_id >= '030'"), "log_id", "line", window=30, trees=20))))
    report = table.read().collect()
    assert table.version() == 2 and table.read(1).first()["total_logs"] == 0
    assert len(report) == 1 and report[0]["total_logs"] == 30 and report[0]["anomalies_count"] + report[0]["normal_count"] == 30


def test_hours_close_by_watermark(spark, tmp_path):
    """Append mode: an hour comes once, when the watermark has passed it; the last hours stay open."""
    df = sample(spark).select(F.col("assessment_id").alias("log_id"), F.col("entity_id").alias("user_id"), "event_time")
    seen = []
    run(streams.hourly(feed(spark, df, str(tmp_path), 6, "event_time"), "5 minutes").writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start())
    want = {(r[0], r[1]): r[2] for r in df.groupBy("user_id", F.date_trunc("hour", "event_time")).count().collect()}
    assert seen and len(seen) == len({x[:2] for x in seen}) and all(want[x[:2]] == x[2] for x in seen) and len(seen) < len(want)


def test_replayed_batch_leaves_each_record_once(spark, tmp_path):
    df = sample(spark, 20)
    stream = feed(spark, df, str(tmp_path), 3)
    run(streams.ingest(stream, str(tmp_path / "ledger"), str(tmp_path / "dead"), str(tmp_path / "cp")))
    commits = sorted((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the driver was lost before the last commit: the batch comes again
    for crc in (tmp_path / "cp/commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    run(streams.ingest(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), str(tmp_path / "ledger"), str(tmp_path / "dead"), str(tmp_path / "cp")))
    ids = [r[0] for r in spark.read.parquet(str(tmp_path / "ledger")).select("assessment_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in df.select("assessment_id").collect())


def test_json_arrays(spark, tmp_path):
    """Assets and assessments stand alone as arrays; anomalies lie in a field, with their logs as JSON in text."""
    (tmp_path / "assets.json").write_text(json.dumps([{"asset_id": 1, "crypto_algorithm": "RSA"}, {"asset_id": 2}], indent=1))
    found = readers.json_array(spark, str(tmp_path / "assets.json"), "asset_id long, crypto_algorithm string").collect()
    assert [tuple(r) for r in found] == [(1, "RSA"), (2, None)]
    log = json.dumps({"USER": "U1", "ACTIVITY": "Logon"})
    (tmp_path / "anomalies.json").write_text(json.dumps({"total": 1, "anomalies": [{"log": log, "score": -0.125}]}))
    found = readers.json_array(spark, str(tmp_path / "anomalies.json"), "log string, score double", "anomalies", {"log": "USER string, ACTIVITY string"}).select("log.USER", "log.ACTIVITY", "score").collect()
    assert [tuple(r) for r in found] == [("U1", "Logon", -0.125)]
    with pytest.raises(readers.ContractError):
        readers.json_array(spark, str(tmp_path / "anomalies.json"), "log string", "nothing")


def test_assessments_of_anomalies(spark):
    at = dt.datetime(2024, 1, 2, 3, 4)
    rows = [("E1", "2", -0.02, "Logon", "U1", "P1", at), ("E1", "1", -0.02, "Device", "U1", "P1", at), ("E1", "3", 0.1, "Web", "U1", "P1", at), ("E1", "4", 0.1, "Mail", "U1", "P1", at), ("E2", "5", 0.0, "Logon", "U2", None, None)]
    found = {r["entity_id"]: r for r in m.entity_assessments(spark.createDataFrame(rows, "entity_id string, log_id string, score double, activity string, user string, pc string, time timestamp")).collect()}
    risk = round(1 / (1 + 2.718281828459045 ** (-0.02 * 45)), 4)
    assert (found["E1"]["log_id"], found["E1"]["risk"], found["E2"]["risk"]) == ("1", risk, 0.5)
    assert [(x["signal_name"], x["weight"]) for x in found["E1"]["reasons"]] == [("Device", risk), ("Logon", round(risk * 0.3, 4)), ("Mail", round(risk * 0.3, 4))]
    assert found["E1"]["reasons"][0]["raw_value"] == "flagged 'Device' on PC P1 at 2024-01-02 3:4 (user U1); decision_function=-0.0200"
    assert len(found["E2"]["reasons"]) == 1


def test_gaps_as_text(spark):
    df = spark.createDataFrame([(65.0,), (42.9,), (None,), (0.0,)], "x double")
    assert [r[0] for r in df.select(i.short_gap(F.col("x"))).collect()] == ["1h 5m", "42m", "", "0m"]
