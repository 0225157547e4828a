"""Effects with their verdicts, one driver against several legs, and flow against parts of returns, by NumPy and by hand."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.stats import POISSON
from tapeloom.operators import attribution

DAY = 86_400_000_000


def effects(spark, data, least=10):
    d = spark.createDataFrame(data, "k int, day int, fire boolean, v double")
    return {r["k"]: r for r in attribution.effect_verdicts(d, ["k"], "day", F.col("fire"), "v", F.col("day") < 5, F.col("day") >= 5, 0.5, least, 80, 3).collect()}


def test_effect_verdicts_by_hand(spark):
    rng = np.random.default_rng(4)
    gain = {1: lambda d: 3.0, 2: lambda d: -3.0, 3: lambda d: 0.2, 4: lambda d: 6.0 if d < 5 else -0.1, 5: lambda d: 3.0}
    data = [(k, d, f, float(rng.normal(scale=0.05)) + f * g(d)) for k, g in gain.items() for d in range(10) for f in (True, False) for _ in range(1 if k == 5 else 4)]
    data += [(1, 3, True, None), (1, 3, False, float("nan")), (1, 4, None, 0.0), (6, 1, True, 1.0)]  # 6: no other rows
    got = effects(spark, data, 12)
    assert {k: r["verdict"] for k, r in got.items()} == {1: "Promote", 2: "Kill", 3: "Hold", 4: "Kill", 5: "Hold"}
    assert [got[k]["cleared"] for k in (1, 2, 3, 5)] == [True, False, False, True]  # 3 is off zero, not over the bar
    own = [x for x in data if x[0] == 1 and x[3] is not None and x[3] == x[3]]
    fire, rest = [x[3] for x in own if x[2]], [x[3] for x in own if not x[2]]  # a missing treatment is none
    assert (got[1]["n_treated"], got[1]["n_control"]) == (40, 41)
    assert (got[1]["treated_mean"], got[1]["control_mean"], got[1]["delta"]) == pytest.approx((np.mean(fire), np.mean(rest), np.mean(fire) - np.mean(rest)))
    early = lambda f: np.mean([x[3] for x in own if x[1] < 5 and bool(x[2]) == f])
    assert got[1]["early_delta"] == pytest.approx(early(True) - early(False))
    few = effects(spark, [x for x in data if x[0] == 2], 1000)[2]  # a sure loss, however few
    assert few["verdict"] == "Kill" and few["low"] <= few["delta"] <= few["high"] < 0
    assert effects(spark, []) == {}


def test_cost_sweep_by_hand(spark):
    e = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, -0.1), (3, 9.0, 1.0), (4, None, None)], "k int, delta double, low double")
    got = {(r["k"], r["bar"]): (r["clears"], r["break_bar"], r["survives"]) for r in attribution.cost_sweep(e, ["k"], [4.0, 1.0, 2.0], 2.0).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1.0): (True, 4.0, True), (1, 2.0): (True, 4.0, True), (1, 4.0): (False, 4.0, True)}
    assert got[2, 1.0] == (False, 1.0, False) and got[3, 4.0] == (True, None, True) and got[4, 1.0] == (False, 1.0, False)


def test_driver_by_leg_against_pandas(spark):
    rng = np.random.default_rng(5)
    g = pd.DataFrame({"k": 1, "day": range(30), "driver": np.round(rng.normal(size=30), 1)})
    v = pd.concat([pd.DataFrame({"k": 1, "day": range(30), "leg": leg, "value": a * g.driver + np.round(rng.normal(size=30), 1)}) for leg, a in (("x", 2.0), ("y", 1.5))])
    v.loc[(v.leg == "y") & (v.day < 4), "value"] = np.nan
    other = pd.DataFrame([{"k": 2, "day": d, "driver": float(d)} for d in range(3)]), pd.DataFrame([{"k": 2, "day": d, "leg": "x", "value": 1.0} for d in range(3)])
    driver, values = (spark.createDataFrame(pd.concat([a, b])) for a, b in zip((g, v), other))
    got = {(r["k"], r["leg"]): r for r in attribution.driver_by_leg(driver, values, ["k"], "day", "leg", ["x", "y"]).collect()}
    wide = g.merge(v.pivot(index="day", columns="leg", values="value"), on="day")
    both = wide.dropna()
    z = ((both[["x", "y"]] - both[["x", "y"]].mean()) / both[["x", "y"]].std(ddof=0)).mean(axis=1)
    rank = lambda a: np.argsort(np.argsort(np.asarray(a), kind="stable"))
    for leg, a, b in (("x", wide.driver, wide.x), ("y", both.driver, both.y), ("joint", both.driver, z)):
        r = got[1, leg]
        assert (r["n"], r["corr"], r["rank_corr"], r["concordant"]) == (len(a), pytest.approx(np.corrcoef(a, b)[0, 1]), pytest.approx(np.corrcoef(rank(a), rank(np.round(b, 12)))[0, 1]), True)
    assert got[2, "x"]["corr"] is None and not got[2, "x"]["concordant"] and (2, "y") not in got


def test_flow_against_parts_by_loop(spark):
    rng = np.random.default_rng(6)
    m, r = rng.normal(size=40), rng.normal(size=40)
    r = 0.5 + 2 * m + r
    trades = [(1, int(t), i, float(rng.integers(1, 5)), float(rng.choice([-1, 1]))) for i, t in enumerate(np.sort(rng.integers(3 * DAY + 5, 36 * DAY, 60)))]
    returns = spark.createDataFrame([(1, i * DAY, float(x)) for i, x in enumerate(r)] + [(1, 99 * DAY, None)], "k int, at long, r double")
    base = spark.createDataFrame([(i * DAY, float(x)) for i, x in enumerate(m)], "at long, m double")
    parts = attribution.market_model(returns, base, ["k"], "at")
    b, a = np.polyfit(m, r, 1)
    got = {x["at"] // DAY: (x["own"], x["common"]) for x in parts.collect()}
    assert got == {i: (pytest.approx(r[i] - a - b * m[i]), pytest.approx(b * m[i])) for i in range(40)}
    tape = spark.createDataFrame(trades, "k int, ts long, seq long, qty double, side double")
    t0, slots = trades[0][1], {}
    for _, t, _, q, s in trades:
        v = slots.setdefault((t - t0) // (2 * DAY), [0.0, 0.0])
        v[0], v[1] = v[0] + q, v[1] + s * q
    met = [(slots[j][1] / slots[j][0], abs(r[i] - a - b * m[i]), abs(b * m[i])) for i in range(40) if (j := (i * DAY - t0) // (2 * DAY)) in slots and j >= 0]
    rank = lambda x: np.argsort(np.argsort(x, kind="stable"))
    rho, own, common = (np.array(x) for x in zip(*met))
    out = attribution.flow_against_parts(parts, tape, ["k"], "at", 2 * DAY, 5).first()
    assert out["n"] == len(met) and (out["rho_own"], out["rho_common"], out["mean_own"]) == pytest.approx((np.corrcoef(rank(rho), rank(own))[0, 1], np.corrcoef(rank(rho), rank(common))[0, 1], own.mean()))
    assert attribution.flow_against_parts(parts, tape, ["k"], "at", 2 * DAY, 500).count() == 0
    assert attribution.market_model(returns, base.withColumn("m", F.lit(1.0)), ["k"], "at").count() == 0  # a base that does not vary


def uniform(item, draw):
    return int(hashlib.md5(f"7|{item}|{draw}".encode()).hexdigest()[:13], 16) / 16**13


def place(x):
    return np.argsort(np.argsort(x, kind="stable"))


def middle(v, w):
    order, out = np.argsort(v, kind="stable"), np.empty(len(v))
    out[order] = np.cumsum(w[order]) - (w[order] - 1) / 2
    return out


def test_rank_matrix_by_loop(spark):
    rng = np.random.default_rng(7)
    a = np.round(rng.normal(size=25), 1)
    b, c = a + rng.normal(size=25), rng.normal(size=25)
    c[:3] = np.nan
    data = [(1, i, float(a[i]), float(b[i]), float(c[i])) for i in range(25)] + [(2, i, 1.0, 2.0, None) for i in range(4)]  # 2: under five items
    rows = spark.createDataFrame(data, "k int, i long, a double, b double, c double")
    got = {(r["k"], r["x"], r["y"]): r for r in attribution.rank_matrix(rows, ["k"], "i", ["a"], ["b", "c"], 40).collect()}
    assert set(got) == {(1, "a", "b"), (1, "a", "c")}
    for y, v in (("b", b), ("c", c)):
        i = np.flatnonzero(np.isfinite(v))
        x, z, r, draws, null = a[i], np.round(v[i], 12), got[1, "a", y], [], []
        own = np.corrcoef(place(x), place(z))[0, 1]
        for d in range(1, 41):
            u = np.array([uniform(k, d) for k in i])
            w = sum((u >= p).astype(int) for p in POISSON)
            some = w > 0
            copies = np.repeat(np.arange(some.sum()), w[some])
            draws.append(np.corrcoef(middle(x[some], w[some])[copies], middle(z[some], w[some])[copies])[0, 1])
            null.append(abs(np.corrcoef(place(x), place(z)[np.argsort(u, kind="stable")])[0, 1]))
        assert (r["n"], r["rho"]) == (len(i), pytest.approx(own)) and (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])))
        assert r["p"] == pytest.approx(np.mean(np.array(null) >= abs(own) - 1e-12))


def test_regimes(spark):
    d = spark.createDataFrame([(1, float(i)) for i in range(5)] + [(1, None), (2, 1.0)], "k int, v double")
    assert sorted((r["v"], r["regime"]) for r in attribution.regimes(d, ["k"], "v", 2).collect()) == [(0.0, "low"), (1.0, "low"), (2.0, "high"), (3.0, "high"), (4.0, "high")]
