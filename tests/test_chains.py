"""The detector's variances and filter against NumPy, feeds of JSON, placebos by hand and by loop."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import estimators, placebo, vol
from tapeloom.sources import layout

DAY, BAR = 86_400_000_000, 3_600_000_000


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_detector_chain_against_numpy(spark):
    """Bars, diurnal factor, GARCH factor, variances by print and the filter, in one pass over arrays."""
    rng = np.random.default_rng(7)
    ts = np.sort(rng.integers(DAY, 4 * DAY, 600))
    px = np.exp(np.cumsum(rng.normal(0, 1e-3, 600)) + 4)
    d = spark.createDataFrame([(1, int(t), i, float(p)) for i, (t, p) in enumerate(zip(ts, px))] + [(1, int(ts[0]) + 1, 900, -1.0), (2, DAY, 0, 5.0), (2, DAY + 5, 1, 5.1)], "k int, ts long, seq long, px double")
    last = np.append(np.flatnonzero(np.diff(ts // BAR)), len(ts) - 1)
    at, r = ts[last][1:], np.diff(np.log(px[last]))
    h = np.array([(r[at // DAY == x // DAY] ** 2).sum() for x in at])
    slot = at % DAY // BAR % 24
    s = np.array([(r[slot == x] ** 2 / h[slot == x]).mean() for x in range(24) if (slot == x).any()])
    s = dict(zip(sorted(set(slot)), s / s.mean()))
    s = np.array([s[x] for x in slot])
    q = [1.0]
    for x in r[:-1] ** 2 / (h * s)[:-1]:
        q.append(1e-4 + 0.05 * x + 0.9 * q[-1])
    composite = h * s * np.array(q) / np.mean(q)
    bars = sorted(vol.mc_garch_bars(d, ["k"], BAR, 24).collect(), key=lambda b: b["ts"])
    assert [b["ts"] for b in bars] == at.tolist() and [b["composite"] for b in bars] == pytest.approx(composite.tolist())
    rate = composite[np.clip(np.searchsorted(at, ts, side="right") - 1, 0, None)] / 3600
    gap = np.maximum(np.diff(ts) / 1e6, 1e-9)
    process = np.maximum(rate, 1e-12) * np.append(gap[0], gap)
    dx = np.diff(np.log(px))
    measure = max(np.median(np.abs(dx - np.median(dx))) / 0.6745, 1e-4) ** 2
    y, x, p, z = np.log(px), np.log(px[0]), measure, [0.0]
    for i in range(1, len(y)):
        prior = p + process[i]
        v = prior + measure
        z.append((y[i] - x) / np.sqrt(v))
        x, p = x + prior / v * (y[i] - x), prior * (1 - prior / v)
    got = vol.kalman_by_print(estimators.detector_noise(d, ["k"], BAR, 24), ["k"])
    assert [r["z"] for r in sorted(got.where("k = 1").collect(), key=lambda r: r["seq"])] == pytest.approx(z)
    assert got.where("k = 2").count() == 2  # no bars: the floor


def test_books_from_json(spark):
    book = lambda bids, asks, **more: json.dumps({"symbol": "X", "time": 7, "orderBook": {"bids": bids, "asks": asks}, **more})
    lines = [
        book([[99, 1], ["100", "2"], [100, 9], [1, 5]], [[101, 3], [100.5, 4]]), book([[100, 2]], [[100.5, 4]], time="9"),
        book([], [[101, 3]]), book([[100, 1]], None), book([[100, 1]], [["x", 3], [101, 1]]), book([[0, 1], [-5, 1]], [[101, 1]]), book([[100, "?"]], [[101, 1]]), book([[100, 1]], [[101]]),
        book([[102, 1]], [[101, 1]]), book([[100, 1]], [[103, 1]]), book([["NaN", 1], [100, 6]], [[100.2, 7]]), book([["Infinity", 1]], [[100.2, 7]]), book([[100, 1]], [[101, 1]], time="soon"), "no json", "[]", None, '{"orderBook": 3}',
    ]
    got = layout.books_from_json(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(got, "symbol", "ts", "bid", "ask", "bid_sz", "ask_sz") == [("X", 7000, 100.0, 100.2, 6.0, 7.0), ("X", 7000, 100.0, 100.5, 2.0, 4.0), ("X", 9000, 100.0, 100.5, 2.0, 4.0)]


def test_shifts_wrap_within_the_day(spark):
    e = spark.createDataFrame([(1, d * DAY + x, d * DAY + x + w) for d in (3, 4) for x, w in ((0, 10), (DAY // 2, 0), (DAY - 1, 5))], "k int, start_ts long, end_ts long")
    got = placebo.shifted(e, "a", 3, 5).collect()
    assert sorted((r["start_ts"] // DAY, r["draw"]) for r in got) == sorted((d, k) for d in (3, 4) for k in range(3) for _ in range(3))
    for d in (3, 4):
        for k in range(3):
            own = sorted(r["start_ts"] % DAY for r in got if r["start_ts"] // DAY == d and r["draw"] == k)
            gaps = sorted((b - a) % DAY for a, b in zip(own, own[1:] + own[:1]))
            assert gaps == sorted([DAY // 2, DAY // 2 - 1, 1])  # one shift for all, round the day
    assert sorted(r["end_ts"] - r["start_ts"] for r in got) == sorted([10, 0, 5] * 6)
    assert got == placebo.shifted(e.repartition(5), "a", 3, 5).orderBy("start_ts").collect() or {tuple(r) for r in got} == {tuple(r) for r in placebo.shifted(e.repartition(5), "a", 3, 5).collect()}


def test_concordance_of_equal_sides_beats_its_placebo(spark):
    rng = np.random.default_rng(1)
    e = spark.createDataFrame([(1, int(t), int(t) + 1000) for t in rng.integers(0, 5 * DAY, 60)] , "k int, start_ts long, end_ts long")
    r = placebo.placebo_concordance(e, e, ["k"], 1_000_000, 30).first()
    assert r["observed"] == 60 and r["placebo_mean"] < 5 and r["p"] == 0.0


def test_sampled_rows_are_bounded_before_they_meet(spark):
    d = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("seq"))
    once = placebo.sampled(d, ["k"], 20, 9)
    assert rows(once, "k", "seq") == rows(placebo.sampled(d.repartition(7), ["k"], 20, 9), "k", "seq") and once.count() == 40
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_placebo_windows_by_loop(spark):
    rng = np.random.default_rng(3)
    ts, px = np.sort(rng.integers(0, 5000, 300)), 100 + rng.normal(size=300).cumsum() / 10
    d = spark.createDataFrame([(1, int(t), i, float(p)) for i, (t, p) in enumerate(zip(ts, px))] + [(2, 0, 0, 1.0)], "k int, ts long, seq long, px double")
    got = placebo.placebo_windows(d, ["k"], 25, 1, 60, 50, 200).collect()
    assert len(got) == 25
    for r in got:
        a = r["seq"]
        b = int(np.searchsorted(ts, ts[a] + 60, side="right") - 1)
        j, j2 = (int(np.searchsorted(ts, ts[b] + w, side="right") - 1) for w in (50, 200))
        assert r["dp_pct"] == pytest.approx(np.abs(px[a : b + 1] / px[a] - 1).max() * 100)
        assert r["mo_bps"] == (pytest.approx(1e4 * (px[j] / px[b] - 1)) if j > b else None)
        assert r["sub_pct"] == (pytest.approx(np.abs(px[b : j2 + 1] / px[b] - 1).max() * 100) if j2 > b else None)
