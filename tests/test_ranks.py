"""Prefix sums, quantiles, numbering, rounding and trailing counts against plain versions."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import scalars as s
from riskweave.operators import entities as n
from riskweave.operators import events as e
from riskweave.operators import models as m
from riskweave.operators import ranks
from riskweave.operators import transactions as t


def test_prefix_sums_over_ranges(spark):
    r = random.Random(1)
    rows = [(k, r.randrange(100), r.random()) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long, x double").repartition(7)
    found = {q["k"]: (q["upto"], q["n"]) for q in ranks.prefix_sums(df, [F.desc("x")], upto=F.col("v"), n=F.lit(1)).collect()}
    total = 0
    for place, (k, v, _) in enumerate(sorted(rows, key=lambda q: -q[2]), 1):
        total += v
        assert found[k] == (total, place)
    plan = ranks.prefix_sums(df, ["x"], n=F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # the ranges are kept, so they are made once


def test_numbering_with_ties_is_gapless(spark):
    df = spark.createDataFrame([(k % 3,) for k in range(500)], "v int")
    found = ranks.numbered(df, ["v"]).collect()
    assert sorted(r["n"] for r in found) == list(range(1, 501)) and [r["v"] for r in sorted(found, key=lambda r: r["n"])] == sorted(k % 3 for k in range(500))
    assert ranks.numbered(df.limit(0), ["v"]).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_of_groups(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(["a", "b", None][r.integers(3)], float(np.round(r.normal(0, 3), r.integers(0, 3))), None if r.random() < 0.2 else float(r.integers(0, 4))) for _ in range(1500)] + [("one", 2.5, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    at = [0.0, 0.25, 1 / 3, 0.5, 0.95, 0.999, 1.0]
    found = {(q["g"], q["feature"]): q["values"] for q in ranks.quantiles(df, ["x", "y"], at, ["g"]).collect()}
    want = {(g, c): [v[i] for v in rows if v[0] == g and v[i] is not None] for g in ("a", "b", None, "one") for i, c in ((1, "x"), (2, "y"))}
    assert set(found) == {k for k, v in want.items() if v}
    for k, v in found.items():
        assert np.allclose(v, np.quantile(want[k], at), rtol=0, atol=1e-12)
    whole = ranks.quantiles(df, ["x"], [i / 1000 for i in range(1001)]).first()["values"]
    assert np.allclose(whole, np.quantile([v[1] for v in rows], [i / 1000 for i in range(1001)]), rtol=0, atol=1e-12)
    assert ranks.quantiles(df.limit(0), ["x"], [0.5], ["g"]).collect() == []


def test_curve_has_no_global_window(spark):
    r = random.Random(4)
    rows = [(round(r.random(), 2), r.randrange(2)) for _ in range(2000)]
    curve = m.by_threshold(spark.createDataFrame(rows, "score double, y long"), "score", "y")
    for q in curve.collect():
        above = [y for x, y in rows if x >= q["threshold"]]
        assert (q["tp"], q["fp"], q["positives"], q["total"]) == (sum(above), len(above) - sum(above), sum(y for _, y in rows), 2000)


def test_half_even_is_pythons_round(spark):
    r = random.Random(6)
    values = [r.random() for _ in range(40_000)] + [r.uniform(-1e6, 1e6) for _ in range(20_000)] + [(2 * r.randrange(10**6) + 1) / 2 ** r.randrange(1, 12) for _ in range(20_000)]
    values += [(r.randrange(10**5) + 0.5) / 10**4 for _ in range(20_000)] + [0.0, -0.0, 2.675, 1.005, 0.03125, 0.09375, -0.03125, 1e300, -1e18, 5e-324, 4503599627370497.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 3, 4):
        found = df.select("x", s.half_even(F.col("x"), digits).alias("y")).collect()
        assert all(q["y"] == round(q["x"], digits) for q in found)
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (None,)], "x double").select(s.half_even(F.col("x"), 4)).collect()
    assert math.isnan(odd[0][0]) and odd[1][0] == math.inf and odd[2][0] is None


def test_trailing_against_plain(spark):
    r = random.Random(9)
    rows = [(f"C{0 if k % 3 else r.randrange(5)}", r.choice([r.randrange(300), 7, r.randrange(20)]), r.choice(["M1", "M2", "C7", None, f"C{r.randrange(30)}"]), float(r.randrange(100)), k) for k in range(900)]
    df = spark.createDataFrame(rows, "nameOrig string, step long, nameDest string, amount double, row_id long")
    for window in (1, 5, 24):
        out = t.trailing(df, window)
        found = {q["row_id"]: (q["txn_count"], q["total_amount"], q["unique_dest"]) for q in out.collect()}
        assert len(found) == len(rows) and out.columns == [*df.columns, "txn_count", "total_amount", "unique_dest", "amount_ratio"]
        for a, step, _, _, k in rows:
            near = [q for q in rows if q[0] == a and step - window <= q[1] <= step]
            assert found[k] == (len(near), sum(q[3] for q in near), len({q[2] for q in near} - {None}))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan
    assert t.trailing(df, 24)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    with pytest.raises(ValueError):
        t.trailing(df, 0)


def test_most_frequent_earlier_pc(spark):
    r = random.Random(2)
    rows = [(f"{k:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), f"U{r.randrange(3)}", r.choice(["A", "B", "C", None])) for k in range(300)]
    found = {q["event_id"]: q["non_primary"] for q in e.non_primary_pc(spark.createDataFrame(rows, "event_id string, event_time timestamp, user_id string, pc_id string")).collect()}
    seen = {}
    for i, _, u, pc in rows:
        counts = seen.setdefault(u, {})
        best = min(counts, key=lambda p: (-counts[p], p)) if counts else None
        assert found[i] == int(best is not None and pc is not None and pc != best)
        if pc is not None:
            counts[pc] = counts.get(pc, 0) + 1


def test_conflicting_ids_raise(spark):
    x = spark.createDataFrame([("U1", "C1", "E1"), ("U2", "C1", "E2"), (None, "C3", "E3")], "user_id string, account string, entity_id string")
    with pytest.raises(n.ResolutionError, match="paysim:C1"):
        n.flatten(x, strict=True)
    assert n.flatten(x.where("entity_id <> 'E2'"), strict=True).count() == 3


def test_canonical_json_keeps_nulls_fractions_and_map_order(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 60_000)
    df = spark.createDataFrame([(None, {"b": 1, "a": None}, at, [None, 2], (None, at))], "z string, m map<string, int>, t timestamp, l array<int>, s struct<q: string, p: timestamp>")
    text = df.select(s.canonical_json(df)).first()[0]
    want = {"l": [None, 2], "m": {"a": None, "b": 1}, "s": {"p": "2024-01-02T03:04:05.060000Z", "q": None}, "t": "2024-01-02T03:04:05.060000Z", "z": None}
    assert text == json.dumps(want, sort_keys=True, separators=(",", ":"))


def test_shifts_of_half_an_hour_are_ambiguous(spark):
    def utc(local, zone):
        return spark.createDataFrame([(local,)], "x string").select(s.to_utc_strict(F.col("x").cast("timestamp"), zone).alias("u")).first()["u"]

    assert utc("2024-04-07 01:25:00", "Australia/Lord_Howe") == dt.datetime(2024, 4, 6, 14, 25)
    assert utc("2024-07-01 12:00:00", "Europe/Berlin") == dt.datetime(2024, 7, 1, 10, 0)
    for local, zone in (("2024-04-07 01:45:00", "Australia/Lord_Howe"), ("2024-10-27 02:30:00", "Europe/Berlin")):
        with pytest.raises(Exception, match="ambiguous"):
            utc(local, zone)
    for local, zone in (("2024-10-06 02:15:00", "Australia/Lord_Howe"), ("2024-03-31 02:30:00", "Europe/Berlin")):
        with pytest.raises(Exception, match="skipped"):
            utc(local, zone)


def test_cuts_are_exact_however_rows_are_dealt(spark):
    r = np.random.default_rng(3)
    many, few = r.normal(0, 1, 5000).round(3), r.choice([-0.0, 0.0, 1.0, 7.5], 5000, p=[0.0005, 0.0005, 0.009, 0.99])
    rows = [(float(x), float(y), None if k % 2 else float("nan"), 4.0) for k, (x, y) in enumerate(zip(many, few))] + [(None, float("nan"), None, 4.0)] * 50
    df = spark.createDataFrame(rows, "many double, few double, none double, one double")
    ordered = np.sort(many)
    want = {"many": sorted({float(ordered[-(-k * 5000 // 32) - 1]) for k in range(1, 32)}), "few": [0.0, 1.0], "none": [], "one": []}
    for dealt in (df.coalesce(1), df.repartition(7)):
        assert ranks.cuts(dealt, ["many", "few", "none", "one"]) == want
