"""Hand-built rows with known results."""

import datetime as dt
import json
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions import scalars as s
from riskweave.operators import correlation as c
from riskweave.operators import entities as n
from riskweave.operators import events as e
from riskweave.operators import incidents as i
from riskweave.operators import models as m
from riskweave.operators import quality as q
from riskweave.operators import transactions as t
from riskweave.operators import windows as w
from riskweave.sources import readers, sinks

TX = "row_id long, step long, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int"
ROWS = [
    (0, 1, "PAYMENT", 100.0, "C1", 1000.0, 900.0, "M1", 0.0, 0.0, 0, 0),
    (1, 2, "TRANSFER", 200.0, "C1", 900.0, 700.0, "C9", 1000.0, 1200.0, 1, 0),
    (2, 3, "CASH_OUT", 50.0, "C1", 700.0, 650.0, "C10", 200.0, 250.0, 1, 0),
    (3, 3, "PAYMENT", 25.0, "C2", 400.0, 375.0, "M2", 0.0, 0.0, 0, 0),
    (4, 5, "TRANSFER", 500.0, "C3", 500.0, 0.0, "C11", 100.0, 600.0, 1, 0),
    (5, 28, "CASH_OUT", 300.0, "C1", 450.0, 150.0, "C12", 400.0, 700.0, 1, 0),
]


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(ROWS, TX)


def by(df, key, *columns):
    return {r[key]: tuple(r[x] for x in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_transactions(tx):
    r = by(t.trailing(t.recency(t.calendar(t.balances(tx))), 3), "row_id", "error_balance_orig", "error_balance_dest", "is_merchant_dest", "txn_count", "total_amount", "unique_dest", "steps_since_prev", "amount_ratio", "hour_of_day", "day_index")
    assert r[0] == (0.0, 100.0, True, 1, 100.0, 1, None, 1.0, 1, 0)
    assert r[2][3:7] == (3, 350.0, 3, 1) and r[2][7] == pytest.approx(50 / (350 / 3))
    assert r[5] == (0.0, 0.0, False, 1, 300.0, 1, 25, 1.0, 4, 1)
    assert t.calendar(tx).where("row_id = 0").first()["event_time"] == dt.datetime(2010, 1, 1, 1)
    assert by(t.transfer_then_cash_out(tx, 2), "row_id", "is_transfer_then_cashout") == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False}
    with pytest.raises(ValueError):
        t.trailing(tx, 0)


def test_adjacent_pattern(spark):
    rows = [(0, 1, "TRANSFER", "C1"), (1, 2, "CASH_OUT", "C1"), (2, 10, "TRANSFER", "C2"), (3, 11, "PAYMENT", "C2"), (4, 12, "CASH_OUT", "C2"), (5, 1, "TRANSFER", "C3"), (6, 9, "CASH_OUT", "C3")]
    assert {r[0] for r in t.adjacent_pattern(spark.createDataFrame(rows, "row_id long, step long, type string, nameOrig string")).collect()} == {"C1", "C2"}


def test_causal_logons(spark):
    at = lambda h: dt.datetime(2010, 1, 4, h)
    rows = [("L1", at(7), "U", "PC-1", "Logon"), ("L2", at(8), "U", "PC-1", "Logoff"), ("L3", at(9), "U", "PC-2", "Logon")]
    df = spark.createDataFrame(rows, "event_id string, event_time timestamp, user_id string, pc_id string, event_type string")
    logons = df.where("event_type = 'Logon'")
    assert by(e.first_of(logons, ["user_id", "pc_id"], "new"), "event_id", "new") == {"L1": 1, "L3": 1}
    assert by(e.non_primary_pc(logons), "event_id", "non_primary") == {"L1": 0, "L3": 1}
    assert by(e.session_minutes(df, "Logon", "Logoff", "m"), "event_id", "m") == {"L1": None, "L2": 60.0, "L3": None}


def test_attachments_and_addresses(spark):
    df = spark.createDataFrame([("C:\\a\\one.doc(125);C:\\b\\two.pdf(375)", " A@x.com ;;b"), ("", None)], "a string, t string")
    pieces, sizes = e.attachments(F.col("a"))
    assert [tuple(r) for r in df.select(pieces, sizes, e.addresses("t")).collect()] == [(2, 500, ["a@x.com", "b"]), (0, 0, [])]


def test_rolling_profile(spark):
    rows = [("U", f"2010-01-0{d}", "r", float(x), 0.5) for d, x in ((1, 1), (2, 2), (3, 3), (4, 999))]
    df = spark.createDataFrame(rows, "user_id string, event_date string, role string, f__median double, f__mad double")
    assert by(w.profile(df, ["f"], "user_id", "user", 3, 2), "event_date", "f__user_location") == {"2010-01-01": None, "2010-01-02": None, "2010-01-03": 1.5, "2010-01-04": 2.0}
    assert [w.scale_floor(x) for x in ("a_ratio", "email_size_sum", "attachment_bytes", "hour_surprise", "count")] == [0.05, 1024.0, 1024.0, 0.1, 1.0]


def assessments(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"A{k}", ent, dom, score, None if minute is None else base + dt.timedelta(minutes=minute)) for k, (ent, dom, score, minute) in enumerate(rows)], "assessment_id string, entity_id string, domain string, score double, event_time timestamp")


B, X = "ps1_behavioral", "ps2_transaction"


@pytest.mark.parametrize("rows, want", [
    ([("E", B, 0.8, 0), ("E", X, 0.7, 119)], [("step_up_auth", "high")]),  # .75 + .25 * .15
    ([("E", B, 0.8, 0), ("E", X, 0.7, 121)], [("step_up_auth", "low"), ("step_up_auth", "low")]),
    ([("E", B, 0.95, 0)], [("step_up_auth", "low")]),
    ([("E", B, 0.7, 0), ("E", B, 0.95, 5)], [("step_up_auth", "low")]),
    ([("E", B, 0.9, None), ("E", X, 0.9, None)], [("step_up_auth", "low"), ("step_up_auth", "low")]),
    ([("E", B, 0.3, 0)], [("allow", "low")]),
])
def test_decisions(spark, rows, want):
    found = c.incidents(c.anchored(assessments(spark, rows)))
    got = sorted((r["access_decision"], r["confidence"]) for r in found.collect())
    assert got == want


def test_anchored_windows(spark):
    df = c.anchored(assessments(spark, [("E", B, 0.5, 0), ("E", B, 0.5, 119), ("E", B, 0.5, 238)]))
    assert [r["anchor"].hour * 60 + r["anchor"].minute for r in df.orderBy("event_time").collect()] == [0, 0, 238]


def test_late_records_converge(spark):
    rows = [("E", B, 0.6, 0), ("E", X, 0.9, 100), ("F", B, 0.4, 10), ("E", B, 0.7, 50), ("E", X, 0.2, 180)]
    whole = assessments(spark, rows)
    ledger, late = whole.where("assessment_id in ('A0', 'A2')"), whole.where("assessment_id not in ('A0', 'A2')")
    got = c.recorrelate(ledger, late.unionByName(ledger), c.incidents(c.anchored(ledger)))
    want = c.incidents(c.anchored(whole))
    pick = lambda df: sorted((r["incident_id"], r["combined_score"]) for r in df.collect())
    assert pick(got) == pick(want)


def test_uuid5_equals_python(spark):
    got = spark.range(3).select(c.uuid5(c.INCIDENTS, F.concat(F.lit("x:"), F.col("id").cast("string"))).alias("u")).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.UUID(c.INCIDENTS), f"x:{k}")) for k in range(3)]


def test_inferred_domain_and_validation(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["b", "a"],)], "d array<string>")
    assert [r[0] for r in df.select(c.inferred_domain(F.col("d"))).collect()] == ["b", "a"]
    bad = spark.createDataFrame([("", "E", "nowhere", 2.0), ("A", "E", B, 0.5)], "assessment_id string, entity_id string, domain string, score double")
    assert [r["errors"] for r in c.invalid(bad).collect()] == [["assessment_id", "domain", "score"], []]


def test_lifecycle(spark):
    acts = ["escalate", "bogus", "acknowledge", "escalate", "dismiss", "acknowledge"]
    df = spark.createDataFrame([(k, "I", "E", a, f"r{k}", dt.datetime(2024, 1, 1, k)) for k, a in enumerate(acts)], "seq long, incident_id string, entity_id string, action string, reason string, ts timestamp")
    assert [tuple(r) for r in i.lifecycle(df).collect()] == [("I", "dismissed", 2)]
    assert i.suppression(df).first()["reason"] == "r4"


def test_upsert_keeps_status(spark):
    old = spark.createDataFrame([("a", "acknowledged", 0.1), ("b", "new", 0.2)], "id string, status string, score double")
    new = spark.createDataFrame([("a", "new", 0.9), ("c", "new", 0.3)], "id string, status string, score double")
    assert sorted(tuple(r) for r in i.upsert(old, new, "id").collect()) == [("a", "acknowledged", 0.9), ("b", "new", 0.2), ("c", "new", 0.3)]


@pytest.mark.parametrize("row, want", [
    (("RSA-2048", "restricted", 10.0), ("CRITICAL", True)), (("ECDHE-RSA", "confidential", 1.0), ("MEDIUM", False)), (("AES-256", "confidential", 10.0), ("LOW", False)), (("ECDSA-P256", "internal", 10.0), ("MEDIUM", False)),
])
def test_assets(spark, row, want):
    df = spark.createDataFrame([row], "a string, d string, y double")
    status, risk = s.algorithm(F.col("a"))
    score = s.priority(risk, F.col("d"), F.col("y"))
    assert tuple(df.select(s.tier(score), s.harvest_now(status, F.col("d"), F.col("y"))).first()) == want


def test_scalars(spark):
    df = spark.createDataFrame([("05-01-2024 07:00:00", "True", "abc"), ("2024-01-05 07:00", "", "2.5"), ("?", "False", "NaN")], "d string, b string, f string")
    got = df.select(s.parse_any(F.col("d")).alias("t"), s.strict_bool(F.col("b")), s.number(F.col("f")), s.interpolate(s.number(F.col("f")), [0, 5], [0.0, 1.0])).collect()
    assert [tuple(r)[1:] for r in got] == [(True, 0.0, 0.0), (None, 2.5, 0.5), (False, 0.0, 0.0)] and got[0]["t"] == got[1]["t"] == dt.datetime(2024, 1, 5, 7) and got[2]["t"] is None
    local = spark.createDataFrame([(dt.datetime(2010, 1, 2, 7),)], "t timestamp").select(s.to_utc(F.col("t"), "Asia/Kolkata").alias("u")).first()
    assert local["u"] == dt.datetime(2010, 1, 2, 1, 30)


def test_sources(spark, tmp_path):
    path = sinks.write_csv(spark.createDataFrame([("a", ""), ("b", "x")], "id string, note string"), str(tmp_path / "c"))
    readers.header(spark, path, ["id", "note"])
    with pytest.raises(readers.ContractError):
        readers.header(spark, path, ["note", "id"])
    assert sorted(tuple(r) for r in readers.csv_strings(spark, path, ["id", "note"]).collect()) == [("a", ""), ("b", "x")]
    with pytest.raises(Exception):
        sinks.write_csv(spark.range(1), path)
    doc = {"entities": [{"entity": {"entity_id": "E1"}, "source_ids": {"cert": {"user": "U1"}, "paysim": {"nameOrig": ["C1", "C2"]}}}, {"entity": {"entity_id": "E2"}, "source_ids": {"cert": {"user": "U2"}, "paysim": {"nameOrig": "C3"}}}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    assert sorted(tuple(r) for r in readers.entity_mapping(spark, str(tmp_path / "m.json")).collect()) == [("cert", "U1", "E1"), ("cert", "U2", "E2"), ("paysim", "C1", "E1"), ("paysim", "C2", "E1"), ("paysim", "C3", "E2")]


def test_gates(spark):
    rows = spark.createDataFrame([("1", dt.datetime(2024, 1, 1), "U", "P", "x", "s"), ("1", dt.datetime(2024, 1, 1), "", "P", "x", "s")], "event_id string, event_time timestamp, user_id string, pc_id string, event_type string, source string")
    found = q.report(rows)
    assert tuple(found.first())[1:2] + tuple(found.first())[4:] == (2, 1, 1)
    with pytest.raises(q.QualityError):
        q.require(found)
    index = spark.createDataFrame([("cert", "U", "E1")], "source string, raw_id string, entity_id string")
    with pytest.raises(n.ResolutionError):
        n.resolve(spark.createDataFrame([("V",)], "user string"), index, "cert", "user", strict=True)


def test_best_f1(spark):
    p = [0.05, 0.10, 0.20, 0.80, 0.85, 0.90]
    df = spark.createDataFrame(list(zip(p, [0, 0, 0, 1, 1, 1])), "p double, y int")
    curve = m.by_threshold(df, "p", "y")
    assert 0.2 < m.best_f1(curve).first()["threshold"] <= 0.8
    assert m.average_precision(curve).first()[0] == m.roc_auc(curve).first()[0] == 1.0


def test_iforest_finds_the_outlier(spark):
    rows = spark.createDataFrame([(str(k), float(k % 7), float(k % 5)) for k in range(300)] + [("out", 100.0, -90.0)], "key string, a double, b double")
    scored = m.anomaly_scores(rows, ["a", "b"], m.isolation_forest(rows, ["a", "b"], "key", trees=20))
    assert scored.orderBy(F.desc("anomaly")).first()["key"] == "out"


def test_conflicts_over_the_whole_ledger(spark):
    from riskweave.plans import registry

    assert registry.queries()["xwalk_conflicts"](spark, "/root/testdata/sf0.001").count() > 0


def test_fraud_scores_of_every_row(spark):
    from riskweave.plans import registry, views

    led = views.table(spark, "/root/testdata/sf0.001", "led")
    found = {r["row_id"]: r["fraud_score"] for r in registry.queries()["m_fraud_model"](spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == {r["row_id"] for r in led.select("row_id").collect()} and all(0 <= p <= 1 for p in found.values())


def test_fraud_model_tells_missing_from_zero(spark):
    # only where a is missing is there fraud; a zero is none; later rows are there to stop on
    rows = spark.createDataFrame([(k, None if k % 4 == 0 else float(k % 4 - 1), int(k % 4 == 0), k >= 300) for k in range(400)], "key long, a double, isFraud int, later boolean")
    model = m.fraud_model(rows, ["a"], validation="later", rounds=5)
    scores = {r["key"]: r["fraud_score"] for r in m.fraud_scores(rows, model, ["a"]).collect()}
    assert len(scores) == 400 and min(p for k, p in scores.items() if k % 4 == 0) > 0.5 > max(p for k, p in scores.items() if k % 4)


def ledger(spark, n=4000):
    r = np.random.default_rng(5)
    a, b = r.normal(0, 1, n), r.integers(0, 5, n)
    fraud = r.random(n) < 1 / (1 + np.exp(3 - 2 * a * (b - 2)))
    rows = [(k, None if k % 9 == 0 else float(x), float(y), int(z), k % 4 == 3) for k, (x, y, z) in enumerate(zip(a, b, fraud))]
    return spark.createDataFrame(rows, "key long, a double, b double, isFraud int, later boolean")


def fraud_scores(rows, model):
    return {r["key"]: r["fraud_score"] for r in m.fraud_scores(rows, model, ["a", "b"]).collect()}


def test_fraud_model_of_copies_costs_and_scores_the_same(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    sizes, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: sizes.append(data.count()) or fit(self, data))
    rows = ledger(spark)
    dealt = (rows.coalesce(1), rows.crossJoin(spark.range(3).select()).repartition(7))  # 12,000 rows in the second
    once, thrice = (fraud_scores(rows, m.fraud_model(x, ["a", "b"], validation="later", rounds=4)) for x in dealt)
    assert sizes[0] == sizes[1] < 700 and len(once) == 4000
    assert max(abs(once[k] - thrice[k]) for k in once) < 1e-9


def test_fraud_model_of_groups_is_that_of_rows(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = ledger(spark)
    model = m.fraud_model(rows, ["a", "b"], validation="later", rounds=4)
    found = fraud_scores(rows, model)
    binned = VectorAssembler(inputCols=["a__bin", "b__bin", "a__missing", "b__missing"], outputCol="x").transform(model.stages[0].transform(m.with_indicators(rows, ["a", "b"])))
    neg, pos = rows.where("not later").agg(F.count_if(F.col("isFraud") == 0), F.count_if(F.col("isFraud") == 1)).first()
    plain = GBTClassifier(labelCol="isFraud", featuresCol="x", weightCol="w", validationIndicatorCol="later", maxIter=4, maxDepth=4, maxBins=100, seed=42).fit(binned.withColumn("w", F.when(F.col("isFraud") == 1, F.lit(neg / pos)).otherwise(1.0)))
    assert plain.getNumTrees == model.stages[-1].getNumTrees >= 2
    assert all(abs(r["probability"][1] - found[r["key"]]) < 1e-9 for r in plain.transform(binned).select("key", "probability").collect())


def test_forest_takes_its_whole_sample(spark):
    rows = spark.createDataFrame([(str(k), float(k)) for k in range(700)], "key string, a double")
    assert [x["n"] for x in m.isolation_forest(rows, ["a"], "key", trees=3)] == [700] * 3


def test_variants_have_all_reference_columns(spark):
    from riskweave.plans import behaviour as b
    from riskweave.plans import views

    act, usr = (views.table(spark, "/root/testdata/sf0.001", x) for x in ("act", "usr"))
    df = b.all_scored(act, usr)
    assert [len(w.variant(df, x).columns) - 2 for x in ("base", "email")] == [60, 100]


def test_replaced_entities_without_new_rows_are_left_with_none(spark):
    from riskweave.plans import incidents as p

    asm = spark.createDataFrame([("A1", "U3", 0.5), ("A2", "U3", 0.6), ("A12", "U13", 0.7), ("A5", "U4", 0.8), ("A6", None, 0.9)], "assessment_id string, entity_id string, score double")
    assert sorted(tuple(r) for r in p.replace_entity(asm).select("assessment_id", "entity_id", "score").collect()) == [("A1", "U3", 0.0), ("A5", "U4", 0.8)]


def test_alerts_by_percent_rank(spark):
    # rows that tie at the top are alerts only if .99 of all others lie below every one of them
    from riskweave.plans import models as p

    alerts = lambda values: sorted(r["event_id"] for r in p.m_alerts(spark.createDataFrame(list(enumerate(values)), "event_id long, value double")).collect())
    assert alerts([float(k) for k in range(198)] + [500.0] * 3) == [198, 199, 200]
    assert alerts([float(k) for k in range(197)] + [500.0] * 3) == []
    assert alerts([float(k) for k in range(199)] + [None, None]) == [198, 199, 200]
    assert alerts([1.0]) == []


def test_levelled_trees_lead_to_the_same_leaves():
    # preorder: the root cuts feature 1, its left child feature 0; NaN and a value at a cut go right
    tree = {"feature": [1, 0, -1, -1, -1], "cut": [5.0, 2.0, 0.0, 0.0, 0.0], "left": [1, 2, -1, -1, -1], "right": [4, 3, -1, -1, -1], "depth": [0.0, 0.0, 7.0, 8.0, 9.0]}
    levels, feature, cut, left, depth = m._levelled(tree)
    assert levels == 2 and left.tolist() == [1, 3, 2, 3, 4] and depth[left[0] + 1] == 9.0 and depth[left[left[0]]] == 7.0 and depth[left[left[0]] + 1] == 8.0 and sum(cut != cut) == 3


def test_perturbed_rows_are_scored_once(spark, monkeypatch):
    from riskweave.plans import models as p

    seen = []
    monkeypatch.setattr(m, "isolation_forest", lambda *a: [{"tree": 0, "n": 4, "feature": [0, -1, -1], "cut": [2.5, 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1], "depth": [0.0, 2.0, 1.0]}])
    monkeypatch.setattr(p, "kept", lambda df: seen.append(df.columns) or df, raising=False)
    lines = spark.createDataFrame([(1, k, 1, 1, float(k), 100.0, 0.0, 0.0) for k in range(1, 5)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    assert tuple(p.m_perturb(lines).first()) == (0.0, 0.0, 0.0) and seen == [["delta"]]


def test_days_and_profiles_are_streamed(spark):
    # as median and percentile have them, with nulls and whatever the batches; before, each feature's hash maps of a group or frame
    rng = random.Random(7)
    some = lambda: None if rng.random() < 0.15 else rng.choice([0.0, 1.5, 7.0, float("nan"), -2.25])
    rows = [(f"U{u}" if u else None, dt.date(2024, 1, d), f"r{u % 2}", some(), None if u == 3 else some()) for u in range(6) for d in range(1, 12) for _ in range(rng.choice([0, 1, 2, 9]))]
    windows = spark.createDataFrame(rows, "user_id string, event_date date, role string, a double, b double")
    keys, fs = ["user_id", "event_date", "role"], ["a", "b"]
    day = Window.partitionBy(*keys)
    dev = windows.select(*keys, *fs, *[F.abs(F.col(f) - F.median(f).over(day)).alias(f"{f}__dev") for f in fs])
    days = dev.groupBy(*keys).agg(*[F.median(f).alias(f"{f}__median") for f in fs], *[F.median(f"{f}__dev").alias(f"{f}__mad") for f in fs])
    three = lambda c: w.rolling_prior(F.col(c), "user_id", 4, 2)
    wide = days.select(*days.columns, F.least(F.row_number().over(Window.partitionBy("user_id").orderBy("event_date")) - 1, F.lit(4)).alias("n"), *[three(f"{f}__{s}").alias(f"{f}_{s}") for f in fs for s in ("median", "mad")])
    profiles = wide.select(*days.columns, "n", *[c for f in fs for c in (F.col(f"{f}_median")[1], F.greatest(1.4826 * F.col(f"{f}_mad")[1], (F.col(f"{f}_median")[2] - F.col(f"{f}_median")[0]) / 1.349))])
    plain = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    want = plain(days), plain(profiles)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found = w.daily(windows, fs)
            rolled = w.profile(found, fs, "user_id", "user", 4, 2)
            assert (plain(found), plain(rolled)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    plan = rolled._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan and "Window" not in plan


def parts_of(df, key):
    """Into how many parts exchanges deal rows by a key."""
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    return [int(n) for n in re.findall(rf"hashpartitioning\({key}#\d+L?,(?: [^,()]+,)* (\d+)\)", plan)]


def test_trailing_windows_sort_small_parts(spark, tx):
    # a task's memory is its part's; before, the session's 4 shuffle partitions, whatever the cores
    from riskweave.plans import views

    least = t.SPREAD * spark.sparkContext.defaultParallelism
    for df, key in ((t.trailing(tx), "nameOrig"), (views.table(spark, "/root/testdata/sf0.001", "led"), "l_orderkey")):
        assert parts_of(df, key) == [least]


def test_fraud_features_sort_small_parts(spark, tx):
    from riskweave.operators import fraud

    assert parts_of(fraud.feature_set(tx), "nameOrig") == [t.SPREAD * spark.sparkContext.defaultParallelism] * 3
