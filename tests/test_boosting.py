"""Boosted trees against plain versions: splits, missing values, stopping, and explanations by brute force over subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import boosting as b
from riskweave.operators import fraud
from riskweave.operators import models as m
from riskweave.plans import views

NAMES = [f"f{i}" for i in range(6)]


def table(n=900, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (n, 6)).round(2)
    x[r.random((n, 6)) < 0.15] = np.nan
    odds = np.nan_to_num(x[:, 0], nan=1.5) + np.nan_to_num(x[:, 1], nan=-1) * np.nan_to_num(x[:, 2], nan=1) - 0.5
    y = (r.random(n) < 1 / (1 + np.exp(-2 * odds))).astype(int)
    return x, y, np.arange(n) % 4 == 3


def frame(spark, x, y, val):
    rows = [(k, *[None if math.isnan(v) else float(v) for v in row], int(t), bool(q)) for k, (row, t, q) in enumerate(zip(x, y, val))]
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"{c} double" for c in NAMES) + ", y int, val boolean")


def plain_trees(x, y, edges, rounds, depth, rate, seed, share=0.8):
    """The same growth in one process, recursively, by exact sums."""
    bins = np.column_stack([np.where(np.isnan(c), b.MISSING, np.searchsorted(e, c)) for c, e in zip(x.T, edges)])
    weight, margin, r, out = (y == 0).sum() / (y == 1).sum(), np.zeros(len(y)), np.random.default_rng(seed), []
    unit = b.UNIT / max(1, weight)
    for _ in range(rounds):
        allowed = sorted(r.choice(x.shape[1], max(1, round(share * x.shape[1])), replace=False).tolist())
        p, w = 1 / (1 + np.exp(-margin)), np.where(y == 1, weight, 1.0)
        g, h = np.rint(unit * w * (p - y)) / unit, np.rint(unit * w * p * (1 - p)) / unit
        step = np.zeros(len(y))

        def split(rows, level):
            best = None
            base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            if level < depth:
                for f in allowed:
                    lost = bins[rows, f] == b.MISSING
                    for missing_left in (False, True) if lost.any() else (False,):
                        for cut in range(len(edges[f])):
                            left = (bins[rows, f] <= cut) | lost & missing_left
                            hs = h[rows][left].sum(), h[rows][~left].sum()
                            if min(hs) >= 1:
                                gain = g[rows][left].sum() ** 2 / (hs[0] + 1) + g[rows][~left].sum() ** 2 / (hs[1] + 1) - base
                                if gain > (best[0] + 1e-9 if best else 1e-9):
                                    best = (gain, left)
            if best:
                split(rows[best[1]], level + 1)
                split(rows[~best[1]], level + 1)
            else:
                step[rows] = -rate * g[rows].sum() / (h[rows].sum() + 1)

        split(np.arange(len(y)), 0)
        margin = margin + step
        out.append(margin.copy())
    return out


@pytest.fixture(scope="module")
def grown(spark):
    x, y, val = table()
    rows = frame(spark, x, y, val)
    return x, y, val, rows, b.grow(rows, NAMES, "y", "val", rounds=10, depth=3, rate=0.3, patience=20)


def test_equals_a_plain_version(grown):
    x, y, val, _, model = grown
    margins = plain_trees(x[~val], y[~val], model.edges, len(model.trees), 3, 0.3, 42)
    assert len(model.trees) >= 2 and np.allclose(model.margin(x[~val]), margins[-1], atol=1e-6)


def test_stops_at_the_best_average_precision(spark, grown):
    x, y, val, rows, model = grown
    assert len(model.trees) == int(np.argmax(model.validation)) + 1
    scored = b.scores(rows.where("val"), model).select("score", F.col("y").cast("long").alias("y"))
    exact = m.average_precision(m.by_threshold(scored, "score", "y")).first()[0]
    assert abs(exact - max(model.validation)) < 1e-3 and exact > 1.3 * y[val].mean()


def test_missing_goes_where_it_has_learnt(spark):
    # missing is like 1, and unlike 2 and 3; then it is unlike all of them
    for like, sides in ((1, {True}), (0, {False})):
        rows = [(float(k % 4) if k % 4 else None, int(k % 4 <= like), k >= 300) for k in range(400)]
        df = spark.createDataFrame(rows, "f0 double, y int, val boolean")
        model = b.grow(df, ["f0"], "y", "val", rounds=4, depth=1, rate=0.5)
        p = {r["f0"]: r["score"] for r in b.scores(df, model).collect()}
        assert all((p[v or None] > 0.5) == (v <= like) for v in (0.0, 1.0, 2.0, 3.0)) and {t.missing[0] for t in model.trees} == sides
    nan = b.scores(spark.createDataFrame([(math.nan,)], "f0 double"), model).first()["score"]
    assert nan == p[None]
    flat = b.grow(df.where("y = 0"), ["f0"], "y", "val", rounds=3)
    assert not flat.trees and b.scores(df.limit(1), flat).first()["score"] == 0.5


def test_explanations_by_all_subsets(spark, grown):
    x, _, _, rows, model = grown

    def expected(t, row, known, i=0):
        f = t.feature[i]
        if f < 0:
            return t.value[i]
        if f in known:
            left = t.missing[i] if math.isnan(row[f]) else row[f] <= t.cut[i]
            return expected(t, row, known, t.left[i] if left else t.right[i])
        a, c = t.cover[t.left[i]], t.cover[t.right[i]]
        return (a * expected(t, row, known, t.left[i]) + c * expected(t, row, known, t.right[i])) / (a + c)

    found = {r["key"]: r for r in b.explained(rows, model, "key").collect()}
    assert len(found) == len(x)
    for k, r in found.items():
        assert math.isclose(sum(r["phi"]), r["margin"] - model.expected(), abs_tol=1e-9)
    for k in (0, 7, 100, 555):
        worth = {s: sum(expected(t, x[k], s) for t in model.trees) for n in range(7) for s in map(frozenset, itertools.combinations(range(6), n))}
        for f in range(6):
            phi = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / 720 * (worth[s | {f}] - worth[s]) for s in worth if f not in s)
            assert math.isclose(found[k]["phi"][f], phi, abs_tol=1e-9)
    ranked = m.ranked_importance(b.importance(b.explained(rows, model, "key"), NAMES)).orderBy("place").collect()
    mean = np.abs(np.array([r["phi"] for r in found.values()])).mean(0)
    assert [r["feature"] for r in ranked] == [NAMES[i] for i in np.argsort(-mean, kind="stable")] and math.isclose(ranked[0]["importance"], mean.max())


def test_fraud_variants_metrics_and_reasons(spark):
    assert [len(v) for v in fraud.VARIANTS.values()] == [18, 14]
    led = views.table(spark, "/root/testdata/sf0.01", "led")
    rows = fraud.split(fraud.feature_set(led)).persist()
    trained = fraud.train(rows, "full", rounds=8, depth=4, rate=0.4, patience=8)
    test = {r["part"]: r for r in fraud.evaluated(rows, trained).collect()}
    scores = b.scores(rows.where("part = 'test'"), trained.model).select("score", "isFraud").collect()
    y, p = np.array([r[1] for r in scores]), np.array([r[0] for r in scores])
    order = np.argsort(-p, kind="stable")
    hit = p >= trained.threshold
    t = test["test"]
    assert (t["rows"], t["fraud"]) == (len(y), y.sum()) and (t["tn"], t["fp"], t["fn"], t["tp"]) == (int((~hit & (y == 0)).sum()), int((hit & (y == 0)).sum()), int((~hit & (y == 1)).sum()), int((hit & (y == 1)).sum()))
    steps = [(p >= c) for c in sorted(set(p.tolist()), reverse=True)]
    recall = [0.0] + [(s & (y == 1)).sum() / y.sum() for s in steps]
    ap = sum((recall[i + 1] - recall[i]) * (s & (y == 1)).sum() / s.sum() for i, s in enumerate(steps))
    assert math.isclose(t["pr_auc"], ap, rel_tol=1e-9) and ap > 3 * y.mean() and len(order) == len(y)
    said = fraud.reasons(rows.where("part = 'test'"), trained.model, "row_id", 3).collect()
    phis = {r["row_id"]: np.array(r["phi"]) for r in b.explained(rows.where("part = 'test'"), trained.model, "row_id").collect()}
    names = trained.model.features
    for r in said[:200]:
        phi = phis[r["row_id"]]
        top = [i for i in np.argsort(-np.abs(phi), kind="stable")[:3] if phi[i]]
        assert [x["signal_name"] for x in r["reasons"]] == [names[i] for i in top]
        for x, i in zip(r["reasons"], top):
            assert x["weight"] == round(abs(phi[i]) / (np.abs(phi).sum() + 1e-12), 4)
            assert x["raw_value"].startswith(fraud.PHRASES[names[i]]) and x["raw_value"].endswith(f"{'raises' if phi[i] > 0 else 'lowers'} fraud risk")
    assert any("=n/a)" in x["raw_value"] for r in said for x in r["reasons"]) or "orig_steps_since_prev_txn" not in {x["signal_name"] for r in said for x in r["reasons"]}
    with pytest.raises(fraud.SplitError):
        fraud.split(fraud.feature_set(led.withColumn("isFraud", F.lit(0))))


def test_of_two_siblings_one_is_counted(spark, monkeypatch):
    counted, count = [], b._histograms
    monkeypatch.setattr(b, "_histograms", lambda *a, **k: counted.append(len(a[4])) or count(*a, **k))
    df = spark.createDataFrame([(float(k % 16), int(k % 16 in (1, 2, 6, 11, 12)), False) for k in range(160)], "f0 double, y int, val boolean")
    model = b.grow(df, ["f0"], "y", "val", rounds=1, depth=3, rate=0.5)
    assert counted[:2] == [1, 1] and len(model.trees[0].feature) > 3


def test_models_that_grow_side_by_side_are_those_that_grow_alone(spark, monkeypatch):
    # a pass over the rows serves both; margins are written anew in between, and one model stops before the other
    x, y, val = table()
    rows = frame(spark, x, y, val)
    variants = [NAMES, NAMES[2:]]
    growth = {"rounds": 11, "depth": 3, "rate": 0.3, "patience": 4}
    alone = [b.grow(rows, v, "y", "val", **growth) for v in variants]
    read, passed = [], b._passed
    monkeypatch.setattr(b, "_passed", lambda state, passes: read.append([p is not None for p in passes]) or passed(state, passes))
    monkeypatch.setattr(b, "REWRITE", 3)
    together = b.grow_each(b.prepared(rows, NAMES, "y", "val"), variants, **growth)
    for a, c in zip(alone, together):
        assert a.features == c.features and a.trees == c.trees and a.validation == c.validation and len(a.validation) >= 4
    assert [True, True] in read and len(read) < 1.5 * 3 * max(len(m.validation) + 1 for m in together)


def test_the_ledger_is_read_once_for_its_features(spark):
    from riskweave.plans import fraud as plans

    led = views.table(spark, "/root/testdata/sf0.001", "led").persist()
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(row):
        seen.add(1)
        return True

    rows = plans.parts(led.where("type in ('TRANSFER', 'CASH_OUT')").where(counted("row_id")))
    assert rows.where("part = 'train'").count() > 0 and seen.value == led.where("type in ('TRANSFER', 'CASH_OUT')").count()


@pytest.mark.parametrize("n", [0, 5, 20_000, 300_000])
def test_cuts_by_summaries(spark, n):
    r = np.random.default_rng(n)
    x = r.exponential(1, n).round(3)
    state = b.Summary()
    for part in np.array_split(x, 7):
        state.add(part)
    values, weights = state.weighted()
    assert weights.sum() == n and (np.diff(values) > 0).all()
    for q in np.arange(1, 64) / 64 if n else ():
        v = values[np.searchsorted(np.cumsum(weights), np.ceil(q * n))]
        assert (x < v).mean() - 4e-4 <= q <= (x <= v).mean() + 4e-4
    if n == 5:
        cuts = b.cut_points(spark.createDataFrame([(float(v), None) for v in x] + [(math.nan, None)], "a double, b double"), ["a", "b"])
        assert cuts[0].tolist() == sorted(set(x.tolist())) and not len(cuts[1])


def test_explanations_by_tables_of_several_paths(spark):
    # whatever paths share a table; 31 nodes of a tree take a few tables, not one a leaf
    x, y, val = table(3000)
    model = b.grow(frame(spark, x, y, val), NAMES, "y", "val", rounds=4, depth=5, rate=0.3)
    whole, phis = model.margin(x) - model.expected(), []
    for most in (0, 3, 8, 12):
        of = type("Some", (b.Explainer,), {"TOGETHER": most})(model)
        phis.append(of(x))
        assert np.allclose(phis[-1].sum(1), whole, atol=1e-9) and np.allclose(phis[-1], phis[0], atol=1e-12)
    assert sum(len(t) for t in b.Explainer(model).tables) < sum(f < 0 for t in model.trees for f in t.feature) / 2


def test_weights_are_rounded_as_python_rounds():
    x = np.append(np.random.default_rng(4).random(20_000), np.arange(20_000) / 20_000)
    assert fraud._rounded(x, 4).tolist() == [round(v, 4) for v in x.tolist()]
