"""Scans, clustering, blocked validation, posteriors, geometric events and the event clock against loops and NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import clustering, decisions, validation, vol


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("slice_", [7, 1000])
def test_affine_scan_by_loop(spark, slice_):
    rng = np.random.default_rng(1)
    data = [(k, int(t), i, float(rng.uniform(-1, 1)), float(rng.normal())) for k in (1, 2) for i, t in enumerate(np.sort(rng.integers(0, 200, 60)))]
    d = spark.createDataFrame(data, "k int, ts long, seq long, f double, a double")
    got = clustering.affine_scan(d, ["k"], ["ts", "seq"], F.col("f"), F.col("a"), 2.0, slice_)
    x, want = {1: 2.0, 2: 2.0}, {}
    for k, t, i, f, a in data:
        want[k, i] = (x[k], f * x[k] + a)
        x[k] = want[k, i][1]
    assert {(r["k"], r["seq"]): pytest.approx((r["before"], r["after"])) for r in got.collect()} == want


def test_hawkes_fit_and_acf_against_numpy(spark, monkeypatch):
    """A hot key is many rows of counts; results are those of one pass over all bins."""
    rng = np.random.default_rng(2)
    keys = {1: np.cumsum(rng.exponential(0.7e6, 900)).astype(int), 2: np.sort(np.concatenate([c + rng.exponential(1e6, 30) for c in rng.uniform(0, 4e8, 25)])).astype(int), 3: np.arange(5)}
    d = spark.createDataFrame([(k, int(t)) for k, ts in keys.items() for t in ts], "k int, ts long")
    monkeypatch.setattr(clustering, "SLICE", 16)
    fits = {r["k"]: r for r in clustering.hawkes_fit(d, ["k"], 1_000_000).collect()}
    acfs = {(r["k"], r["lag"]): r["acf"] for r in clustering.count_acf(d, ["k"], 1_000_000, 10).collect()}
    cvs = {r["k"]: r["cv"] for r in clustering.interarrival_cv(d, ["k"], 50_000_000).collect()}
    assert set(fits) == {1, 2}
    for k in (1, 2):
        ts = keys[k]
        n = np.bincount((ts - ts[0]) // 1_000_000).astype(float)
        best = None
        for beta in clustering.BETAS:
            x, decayed = [], 0.0
            for c in n:
                x.append(decayed)
                decayed = decayed * math.exp(-beta) + c
            design = np.column_stack([np.ones(len(n)), x])
            (base, alpha), *_ = np.linalg.lstsq(design, n, rcond=None)
            rss = ((n - design @ [base, alpha]) ** 2).sum()
            if alpha >= 0 and base >= 0 and alpha / beta < 1 and (best is None or rss < best[0]):
                best = (rss, beta, alpha, base)
        r = fits[k]
        assert (r["rss"], r["beta"], r["alpha"], r["lambda0"]) == pytest.approx(best) if best else r["beta"] is None
        assert (r["n_events"], r["bins"]) == (len(ts), len(n))
        c = n - n.mean()
        for lag in range(11):
            assert acfs[k, lag] == pytest.approx(float(c[lag:] @ c[: len(c) - lag] / (c @ c)), abs=1e-9)
        gaps = np.diff(ts)
        assert cvs[k] == pytest.approx(gaps.std() / gaps.mean())
    assert fits[2]["branching"] > 0.05 and cvs[2] > 1.3  # clustered


def test_blocked_ridge_refits_nothing_and_equals_refits(spark):
    rng = np.random.default_rng(3)
    days, n = 11, 400
    x = rng.normal(size=(n, 4)) * [1, 50, 0.01, 1]
    x[:, 3] = 2.0  # constant
    day = np.sort(rng.integers(0, days, n))
    y = x[:, 0] + 0.02 * x[:, 1] + rng.normal(size=n)
    data = [(1, int(day[i]), i, *map(float, x[i]), float(y[i])) for i in range(n)] + [(1, 5, n, float("nan"), 0.0, 0.0, 0.0, 1.0), (1, 5, n + 1, None, 0.0, 0.0, 0.0, 1.0), *((2, 0, i, 1.0, 2.0, 3.0, 4.0, 5.0) for i in range(9))]
    d = spark.createDataFrame(data, "k int, day int, id long, a double, b double, c double, e double, y double")
    got = {(r["fold"], r["alpha"]): r for r in validation.blocked_ridge(d, ["k"], "day", ["a", "b", "c", "e"], "y", "id", [0.5, 30.0]).collect()}
    size = days // 4
    assert set(got) == {(f, a) for f in range(4) for a in (0.5, 30.0)}
    for (f, a), r in got.items():
        test = (day >= f * size) & (day < (f + 1) * size)
        mean, sd = x[~test].mean(axis=0), x[~test].std(axis=0)
        sd[3] = 1.0
        z, zt = (x[~test] - mean) / sd, (x[test] - mean) / sd
        w = np.linalg.solve(z.T @ z + a * np.eye(4), z.T @ (y[~test] - y[~test].mean()))
        p = y[~test].mean() + zt @ w
        ranked = lambda v: v.argsort().argsort()
        assert r["ic"] == pytest.approx(np.corrcoef(ranked(p), ranked(y[test]))[0, 1])
        assert r["r2"] == pytest.approx(1 - ((y[test] - p) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
        assert (r["n_train"], r["n_test"]) == ((~test).sum(), test.sum())


def test_logistic_posterior_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -2.0])))).astype(float)
    data = [(1, *map(float, v), float(t)) for v, t in zip(x, y)] + [(2, 1.0, float(i), 1.0) for i in range(20)] + [(1, None, 0.0, 1.0)]
    d = spark.createDataFrame(data, "k int, a double, b double, y double")
    z, beta = np.column_stack([np.ones(300), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(3) / 25
        beta = beta + np.linalg.solve(h, z.T @ (y - p) - beta / 25)
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    got = validation.logistic_posterior(d, ["k"], "y", ["a", "b"]).collect()
    assert {(r["k"], r["term"]) for r in got} == {(1, "intercept"), (1, "a"), (1, "b")} and all(r["converged"] and r["n"] == 300 for r in got)
    for r, b, s in zip(sorted(got, key=lambda r: ["intercept", "a", "b"].index(r["term"])), beta, se):
        assert (r["mean"], r["se"], r["low"]) == pytest.approx((b, s, b - 1.96 * s))
    whole = validation.logistic_posterior(d.where("k = 1"), [], "y", ["a", "b"])
    assert whole.columns[0] == "term" and sorted(r["mean"] for r in whole.collect()) == pytest.approx(sorted(beta))
    few = validation.logistic_posterior(d.where("k = 1"), ["k"], "y", ["a", "b"], most=1).collect()
    assert not any(r["converged"] for r in few)


def vshapes(ts, px, pct, most, back):
    """The greedy search, row by row."""
    out, i, n = [], 0, len(ts)
    while i < n - 2:
        window = [j for j in range(i, n) if ts[j] <= ts[i] + most]
        low, high = min(window, key=lambda j: (px[j], j)), min(window, key=lambda j: (-px[j], j))
        down, up = (px[i] - px[low]) / px[i], (px[high] - px[i]) / px[i]
        if len(window) < 2 or max(down, up) < pct:
            i += 1
            continue
        mid, shape = (low, -1) if down >= pct and down >= up else (high, 1)
        leg = [j for j in range(mid, n) if ts[j] <= ts[mid] + most]
        best = max(px[j] for j in leg) if shape < 0 else min(px[j] for j in leg)
        won = (best - px[mid]) / (px[i] - px[mid]) if px[i] != px[mid] else 0.0
        if len(leg) > 1 and won >= back:
            out.append((ts[i], ts[mid], mid, ts[leg[-1]], shape))
            i = leg[-1] + 1
        else:
            i = mid + 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_vshape_events_by_loop(spark, seed):
    rng = np.random.default_rng(seed)
    n = 500
    ts = np.sort(rng.integers(0, 4000, n)).tolist()
    px = np.round(100 + np.cumsum(rng.normal(size=n)), 0 if seed == 3 else 3).tolist()  # rounded: ties
    data = [(1, t, i, p) for i, (t, p) in enumerate(zip(ts, px))]
    d = spark.createDataFrame([*data, (1, 50, -1, None), (1, 60, -1, float("nan")), (2, 0, 0, 1.0)], "k int, ts long, seq long, px double")
    got = vol.vshape_events(d, ["k"], 2.0, 60, 0.5)
    want = vshapes(ts, px, 0.02, 60, 0.5)
    assert rows(got, "start_ts", "mid_ts", "mid_seq", "end_ts", "shape") == sorted(want) and len(want) > 5
    marks = spark.createDataFrame([(1, t) for t in range(0, 4000, 7)], "k int, ts long").withColumn("seq", F.col("ts"))
    near = vol.near_events(marks, got.withColumn("ts", F.col("mid_ts")), ["k"], 5)
    assert rows(near.where("near"), "ts") == [(t,) for t in range(0, 4000, 7) if any(abs(m - t) <= 5 for _, m, *_ in want)]


@pytest.mark.parametrize("slice_", [40, 10**6])
def test_event_clock_by_hand(spark, slice_):
    """Three holds that overlap: the highest tier rules until its own end, the class is the last event's."""
    e = [(1, 100, 1, "widen", False, "partial", 0.1, 0.2), (1, 120, 2, "halt", True, "v_recovery", 0.3, None), (1, 140, 3, "what", None, "continuation", 0.5, 0.6), (1, 0, 4, "halt", True, "x", 1.0, 1.0), (2, 120, 5, "size_cap", True, None, 0.7, 0.8)]
    events = spark.createDataFrame(e, "k int, end_ts long, seq long, tier string, nested boolean, kind string, one double, two double")
    at = [99, 100, 119, 120, 125, 130, 131, 140, 145, 150, 151, 160, 170, 180, 200, 201]
    prints = spark.createDataFrame([(1, t, t) for t in at] + [(2, 121, 1), (3, 121, 1)], "k int, ts long, seq long")
    got = {(r["k"], r["ts"]): tuple(r)[3:] for r in decisions.event_clock(prints, events, ["k"], 60, 10, 30, slice_).collect()}
    none = ("none", False, False, "unknown", None, None)
    want = {
        99: none, 100: ("widen", False, True, "partial", 0.1, 0.2), 119: ("widen", False, True, "partial", 0.1, 0.2), 120: ("halt", True, True, "v_recovery", 0.3, None), 125: ("halt", True, True, "v_recovery", 0.3, None),
        130: ("halt", True, True, "v_recovery", 0.3, None), 131: ("halt", False, True, "v_recovery", 0.3, None), **{t: ("halt", False, True, "continuation", 0.5, 0.6) for t in (140, 145, 150, 151, 160, 170)},
        180: ("halt", False, False, "unknown", None, None), 200: ("observe", False, False, "unknown", None, None), 201: none,
    }
    assert {t: got[1, t] for t in at} == want
    assert got[2, 121] == ("size_cap", True, True, "unknown", 0.7, 0.8) and got[3, 121] == none
