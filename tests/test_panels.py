"""Medians by merged sketches, kill criteria, cut intervals and panels, by hand and by loop."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tapeloom.functions.stats import POISSON
from tapeloom.operators import decisions, estimators, inference, panels
from tapeloom.plans import registry

DAY = 86_400_000_000


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def weight(seed, item, draw):
    u = int(hashlib.md5(f"{seed}|{item}|{draw}".encode()).hexdigest()[:13], 16) / 16**13
    return sum(u >= p for p in POISSON)


@pytest.mark.parametrize("bins", [1, 7, 256])
def test_median_draws_by_loop(spark, bins):
    rng = np.random.default_rng(1)
    v = {1: np.round(rng.normal(size=41), 1).tolist(), 2: [3.0], 3: [1.0, 1.0, 1.0, 2.0]}  # ties, one row, few rows
    d = spark.createDataFrame([(k, i, x) for k, xs in v.items() for i, x in enumerate(xs)] + [(1, 99, None)], "k int, item long, v double")
    got = {(r["k"], r["draw"]): r["v"] for r in inference.median_draws(d, ["k"], "v", "item", 25, 4, bins).collect()}
    want = {(k, n): np.median(x) for k, xs in v.items() for n in range(1, 26) if (x := [y for i, y in enumerate(xs) for _ in range(weight(4, i, n))])}
    assert got == pytest.approx(want)


def test_compare_medians_draws_jointly(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=60)
    d = spark.createDataFrame([(1, i, float(x), float(x) - 1.0, None if i > 1 else 5.0) for i, x in enumerate(a)], "k int, day long, a double, b double, c double")
    got = {r["series"]: r for r in inference.compare_medians(d, ["k"], "day", ["a", "b", "c"], 50).collect()}
    assert set(got) == {"a", "b", "c", "a_minus_b"}  # differences over two items are left out
    one = got["a_minus_b"]
    assert (one["n"], one["excludes_0"]) == (60, True) and (one["median"], one["low"], one["high"]) == pytest.approx((1.0, 1.0, 1.0))
    assert got["a"]["low"] < np.median(a) < got["a"]["high"] and got["c"]["n"] == 2


def test_kill_criteria_by_hand(spark):
    """A rule that earns, one that loses, one with few trades, one with stops and a lifted floor."""
    data = []
    for k, n, pnl, stop in ((1, 60, lambda i: 1.0 + i % 3, False), (2, 60, lambda i: -1.0, False), (3, 5, lambda i: 1.0, False), (4, 60, lambda i: None if i % 2 else 2.0, True)):
        data += [(k, i % 10, i, pnl(i), stop) for i in range(n)]
    d = spark.createDataFrame(data, "k int, day int, seq long, pnl double, stop boolean")
    kills = lambda **more: {r["k"]: r for r in decisions.evaluate_kills(d, ["k"], "day", "pnl", "seq", F.col("day") < 5, F.col("day") >= 5, F.col("stop"), draws=60, **more).collect()}
    got = kills()
    flags = lambda r: {f for f in ("k1", "k2", "k3", "k4", "k5", "k6", "k7", "k8") if r[f]}
    assert {k: flags(r) for k, r in got.items()} == {1: set(), 2: {"k1", "k4"}, 3: set(), 4: {"k5"}}
    assert {k: r["decision"] for k, r in got.items()} == {1: "Promote_shadow", 2: "Kill", 3: "Hold", 4: "Kill"}
    assert (got[4]["n"], got[4]["stop_share"], got[4]["hit_rate"]) == (30, 1.0, 1.0)
    assert flags(kills(cost_bps=6.0, live=True, floor_on=F.col("k") != 1)[1]) == {"k6", "k7", "k8"}
    turn = spark.createDataFrame([(1, i % 10, i, 1.0 if i % 10 < 5 else -0.5, False) for i in range(60)], d.schema)
    assert decisions.evaluate_kills(turn, ["k"], "day", "pnl", "seq", F.col("day") < 5, F.col("day") >= 5, F.col("stop"), draws=60).first()["k3"]


def test_five_seconds_stand_in_for_two(spark):
    e = spark.createDataFrame([(None, None, "observe", "partial", 1.0, 1.0, False, 0.8), (None, 0.1, "observe", "partial", 1.0, 1.0, False, 0.8)], "one double, two double, tier string, kind string, mo1 double, mo5 double, nested boolean, recovery double")
    path = decisions.size_path("v_restore_confirm", F.col("one"), F.col("two"), F.col("tier"), F.col("kind"), F.col("recovery"))
    assert [tuple(r) for r in e.select(*path).collect()] == [(0.5, 0.5, 0.85, 1.0), (0.5, 0.5, 0.5, 0.5)]
    score = {r["policy"]: r["exposure"] for r in decisions.score_policies(e).collect()}
    assert score["v_restore_confirm"] == pytest.approx((2.85 / 4 + 0.5) / 2)


def test_one_long_interval_does_not_make_the_join_coarse(spark):
    """Pauses and events are cut at a fixed width; a month-long one meets what it holds."""
    rng = np.random.default_rng(3)
    spans = [(1, i, int(s), int(s) + int(w)) for i, (s, w) in enumerate(zip(rng.integers(0, DAY, 80), rng.integers(0, 5_000_000, 80)))] + [(1, 99, DAY // 2, DAY // 2 + DAY // 8)]
    at = [int(x) for x in rng.integers(0, DAY, 400)]
    pauses = spark.createDataFrame(spans, "k int, run long, start_ts long, end_ts long")
    points = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "k int, seq long, ts long")
    got = decisions.in_pause(points, pauses, ["k"])
    assert rows(got, "seq", "paused") == [(i, any(a <= t < b for _, _, a, b in spans)) for i, t in enumerate(at)]
    others = [(1, int(s), int(s) + 10) for s in rng.integers(0, DAY, 30)] + [(1, DAY // 3, DAY // 3 + DAY // 10)]
    u = estimators.unmet(pauses, spark.createDataFrame(others, "k int, start_ts long, end_ts long"), ["k"], 1_000_000).first()
    slack = 1_000_000
    assert u["unique"] == sum(not any(x - slack <= b and y + slack >= a for _, x, y in others) for _, _, a, b in spans) and u["n"] == 81


def test_survival_by_size_by_hand(spark):
    tob = spark.createDataFrame([("a", t * 10, t, 9.0, 10.0, float(1 + t % 4), 3.0) for t in range(40)], "k string, ts long, seq long, bid double, ask double, bid_sz double, ask_sz double")
    trades = spark.createDataFrame([("a", t * 10 + 5, t, 1.0, -1.0 if t % 2 else 1.0) for t in range(60)], "k string, ts long, seq long, qty double, side double")
    none = estimators.size_survival(tob, trades, ["k"], 5, 60)
    assert {r["filled"] for r in none.collect()} == {0}  # the ask never comes down to the bid
    met = estimators.size_survival(tob.withColumn("bid", F.lit(10.0)).withColumn("ask", F.lit(10.0)), trades, ["k"], 5, 60)
    got = {r["share"]: (r["size"], r["starts"], r["filled"], r["monotone"]) for r in met.collect()}
    assert got == {0.25: (1.75, 8, 8, True), 0.5: (2.5, 8, 8, True), 0.75: (3.25, 8, 0, True)}  # three sales in 60
    sells = estimators.size_survival(tob.withColumn("bid", F.lit(10.0)).withColumn("ask", F.lit(10.0)), trades, ["k"], 5, 60, "sell")
    assert {(r["size"], r["filled"]) for r in sells.collect()} == {(3.0, 8)}


def test_panels_by_hand(spark):
    q = spark.createDataFrame([(v, t, i, 10.0 + v + t / 100, 10.2 + v + t / 100, 1.0, 2.0) for i, (v, t) in enumerate([(0, 1), (1, 2), (0, 5), (1, 12), (0, 21), (1, 25), (2, 26)])], "venue int, ts long, seq long, bid double, ask double, bid_sz double, ask_sz double").withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("symbol", F.lit("x"))
    wide = panels.aligned_buckets(q, ["symbol"], "venue", [0, 1], 10)
    assert rows(wide, "bucket", "0_bid", "1_bid", "1_size") == [(0, 10.05, 11.02, 3.0), (20, 10.21, 11.25, 3.0)]
    marks = panels.mark_bars(q, ["symbol", "venue"], 10)
    assert rows(marks.where("venue = 0"), "ts", "n") == [(0, 2), (20, 1)]
    b = panels.basis(marks, ["symbol"], "venue", 0)
    assert [(r["venue"], r["ts"]) for r in b.orderBy("venue", "ts").collect()] == [(1, 0), (1, 20), (2, 20)]
    assert b.where("venue = 1 AND ts = 0").first()["basis"] == pytest.approx(np.log(11.12 / 10.15))
    with pytest.raises(ValueError, match="known only afterwards"):
        panels.design(q, ["ts"], ["bid"], {"venue": [0]}, "ask", ["bid"])
    around = panels.liquidity_around(spark.createDataFrame([("x", 0, 5), ("x", 9, 5)], "symbol string, venue int, ts long"), q, ["symbol", "venue"], 4).collect()
    assert sorted((r["venue"], r["quotes"], r["spread_post"]) for r in around) == [(0, 2, None), (9, 0, None)]
    e = spark.createDataFrame([(1, t, t, f) for t, f in ((0, True), (3, True), (4, False), (10, True), (19, True), (20, True))], "k int, ts long, seq long, fire boolean")
    assert rows(panels.first_of_nest(e, ["k"], F.col("fire"), 10), "ts") == [(0,), (4,), (10,), (20,)]


def test_occurrence_model_against_numpy(spark):
    from tapeloom.plans.panels import _occurrences

    sf = f"{DATA}/sf0.01"
    got = {r["term"]: (r["mean"], r["se"]) for r in registry.QUERIES["occurrence_model"](spark, sf).collect()}
    d = _occurrences(spark, sf).toPandas()
    z, y, beta = np.column_stack([np.ones(len(d)), d.share, d.hour, np.log(np.maximum(d.trades, 1))]), d.y.to_numpy(float), np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ beta))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(4) / 25
        beta = beta + np.linalg.solve(h, z.T @ (y - p) - beta / 25)
    assert [got[t] for t in ("intercept", "share", "hour", "log_trades")] == [pytest.approx(x) for x in zip(beta, np.sqrt(np.diag(np.linalg.inv(h))))]
