"""Small tables with known results: temporal joins, folds, files and streams."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tapeloom.functions.stats import benjamini_hochberg
from tapeloom.operators import hft, options, policy, temporal, vol
from tapeloom.plans import registry
from tapeloom.sources import layout, market
from tapeloom.sources.market import CELL
from tapeloom.streaming import jobs

SF = f"{DATA}/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def quotes(spark):
    return spark.createDataFrame([(1, 10, 1, 1.0), (1, 10, 2, 2.0), (1, 20, 3, None), (1, 95, 4, 4.0), (2, 5, 5, 5.0)], "k int, ts long, seq long, v double")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20), (1, 94), (1, 500), (2, 5), (3, 1)], "k int, ts long")


@pytest.mark.parametrize("slice_", [7, 1000])
def test_asof(quotes, asked, slice_):
    got = rows(temporal.asof(asked, quotes, ["k"], ["v"], slice_=slice_), "k", "ts", "ref_ts")
    assert got == [(1, 9, None), (1, 10, 10), (1, 19, 10), (1, 20, 20), (1, 94, 20), (1, 500, 95), (2, 5, 5), (3, 1, None)]
    values = {(r["k"], r["ts"]): r["v"] for r in temporal.asof(asked, quotes, ["k"], ["v"], slice_=slice_).collect()}
    assert values[1, 10] == 2.0 and values[1, 20] is None and values[1, 94] is None  # the last tie; a null is a value
    strict = {(r["k"], r["ts"]): r["ref_ts"] for r in temporal.asof(asked, quotes, ["k"], ["v"], strict=True, slice_=slice_).collect()}
    assert strict[1, 10] is None and strict[1, 20] == 10 and strict[2, 5] is None
    near = {(r["k"], r["ts"]): r["ref_ts"] for r in temporal.asof(asked, quotes, ["k"], ["v"], tolerance=9, slice_=slice_).collect()}
    assert near[1, 19] == 10 and near[1, 94] is None


@pytest.mark.parametrize("slice_", [7, 1000])
def test_forward_and_nearest(quotes, asked, slice_):
    got = {(r["k"], r["ts"]): r["next_ts"] for r in temporal.forward(asked, quotes, ["k"], ["v"], slice_=slice_).collect()}
    assert got[1, 9] == 10 and got[1, 10] == 20 and got[1, 500] is None and got[3, 1] is None
    got = {(r["k"], r["ts"]): r["ref_ts"] for r in temporal.nearest(asked, quotes, ["k"], ["v"]).collect()}
    assert got[1, 9] == 10 and got[1, 19] == 20 and got[1, 500] == 95


def test_range_join_is_exact_and_an_equi_join(spark, quotes, asked):
    out = temporal.range_join(asked, quotes, ["k"], F.col("ts") - 10, F.col("ts") + 1, 11)
    assert rows(out, "k", "ts", "r_seq") == [(1, 9, 1), (1, 9, 2), (1, 10, 1), (1, 10, 2), (1, 19, 1), (1, 19, 2), (1, 19, 3), (1, 20, 1), (1, 20, 2), (1, 20, 3), (1, 94, 4), (2, 5, 5)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_runs_carry_grid_and_merge(spark):
    d = spark.createDataFrame([(1, i, i, x) for i, x in enumerate([1.0, None, 3.0, 3.0, None, 5.0])], "k int, ts long, seq long, v double")
    assert [r["v"] for r in temporal.carry(d, ["k"], ["v"]).orderBy("ts").collect()] == [1.0, 1.0, 3.0, 3.0, 3.0, 5.0]
    assert rows(temporal.runs(d, ["k"], F.col("v") >= 3), "ts", "run") == [(2, 1), (3, 1), (5, 2)]
    assert [r["ts"] for r in temporal.grid(d, ["k"], 2).orderBy("ts").collect()] == [0, 2, 4]
    i = spark.createDataFrame([(1, 0, 10), (1, 5, 6), (1, 10, 12), (1, 20, 21), (1, 22, 30)], "k int, a long, b long")
    assert rows(temporal.merge_intervals(i, ["k"], "a", "b", gap=1), "a", "b", "n") == [(0, 12, 3), (20, 30, 2)]


def test_directional_runs(spark):
    px = [100, 101, 101, 102, 103, 102, 101, 90, 91]
    d = spark.createDataFrame([(1, i * 10, i, float(p)) for i, p in enumerate(px)], "k int, ts long, seq long, px double")
    got = rows(vol.directional_runs(d, ["k"], 100, 2.0, 3), "start_ts", "end_ts", "trades")
    assert got == [(0, 40, 5), (40, 70, 4)]


def greedy(a, b, slack):
    used, n = set(), 0
    for lo, hi in sorted(a):
        for j, (x, y) in enumerate(sorted(b)):
            if j not in used and x <= hi + slack and y >= lo - slack:
                used.add(j)
                n += 1
                break
    return n


def test_interval_matches(spark):
    rng = np.random.default_rng(0)
    sets = [[[(int(s), int(s + rng.integers(1, 8))) for s in np.sort(rng.choice(200, 25, replace=False))] for _ in range(2)] for _ in range(6)]
    frame = lambda side: spark.createDataFrame([(k, *x) for k, s in enumerate(sets) for x in s[side]], "k int, start_ts long, end_ts long")
    got = dict(rows(vol.interval_matches(frame(0), frame(1), ["k"], 2), "k", "n"))
    assert got == {k: greedy(a, b, 2) for k, (a, b) in enumerate(sets)}


def test_sleeve_and_overlap(spark):
    d = spark.createDataFrame([(1, 0, 0, 100.0, 3.0), (1, 5, 1, 99.0, -4.0), (1, 10, 2, 98.0, 0.0), (1, 11, 3, 98.0, -3.0), (1, 30, 4, 99.0, 0.0)], "k int, ts long, seq long, px double, z double")
    got = policy.sleeve(d, ["k"], 2.0, 10, 1.0).orderBy("entry_ts").collect()
    assert [(r["entry_ts"], r["exit_ts"], r["direction"], round(r["pnl_bps"], 6)) for r in got] == [(0, 10, -1, 198.0), (11, 30, 1, round(1e4 / 98 - 2, 6))]
    assert rows(policy.without_overlap(d, ["k"], 10), "ts") == [(0,), (10,), (30,)]


def test_deltas_against_erf(spark):
    got = registry.QUERIES["delta_shock"](spark, SF).toPandas().set_index("instrument_id").d_delta
    chain = market.chain(spark, SF).toPandas().set_index("instrument_id")

    def delta(s, k, t, v, flag):
        d = (math.log(s / k) + v * v / 2 * t) / (v * math.sqrt(t))
        n = 0.5 * (1 + math.erf(d / math.sqrt(2)))
        return n if flag == "c" else n - 1

    for i, c in chain.iterrows():
        want = delta(1212, c.strike, c.ttm_years, c.iv + 0.01, c.flag) - delta(1200, c.strike, c.ttm_years, c.iv, c.flag)
        assert abs(got[i] - want) < 2e-6


def test_component_and_information_share(spark):
    from tapeloom.plans.patterns import _gaps

    g = _gaps(spark, SF).toPandas().dropna(subset=["vloop_max", "vloop_mean", "tcost"])
    got = registry.QUERIES["constraint_component"](spark, SF).toPandas()
    for symbol, own in g.groupby("symbol"):
        m = own[["vloop_max", "vloop_mean", "tcost"]].to_numpy()
        z = (m - m.mean(axis=0)) / m.std(axis=0)
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        pc = z @ vt[0] * np.sign(vt[0, 0])
        mine = got[got.symbol == symbol].set_index("ts").pc1.loc[own.ts]
        assert np.allclose(mine, pc, atol=1e-6)
    share = registry.QUERIES["information_share"](spark, f"{DATA}/sf0.01").toPandas()
    assert len(share) and ((0 <= share.share_a_low) & (share.share_a_low <= share.share_a_high) & (share.share_a_high <= 1)).all()


def test_bootstrap_covers_and_shuffle_is_level(spark):
    b = registry.QUERIES["bootstrap_mean_markout"](spark, f"{DATA}/sf0.01").collect()
    assert all(r["low"] <= r["mean"] <= r["high"] for r in b)
    s = registry.QUERIES["sign_shuffle"](spark, f"{DATA}/sf0.01").collect()
    assert 0.1 < sum(r["p"] for r in s) / len(s) < 0.9


def test_false_discovery(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.9)], "id int, p double")
    assert rows(benjamini_hochberg(d, "p", [], "id"), "id", "q") == [(1, 0.04), (2, pytest.approx(0.16 / 3)), (3, pytest.approx(0.16 / 3)), (4, 0.9)]


def test_files(spark, tmp_path):
    t = market.tape(spark, SF)
    layout.write_days(t, f"{tmp_path}/days")
    back = layout.read_days(spark, f"{tmp_path}/days", "2024-01-03", "2024-01-05", [1])
    lo, hi = layout.day_bounds("2024-01-03")[0], layout.day_bounds("2024-01-05")[1]
    assert back.count() == t.where((F.col("ts") >= lo) & (F.col("ts") < hi) & (F.col("venue") == 1)).count() > 0
    assert "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().executedPlan().toString()
    lines = [
        '{"channel":"trades","data":[{"px":"1.5","sz":"2","time":7,"tid":9,"side":"B"},{"px":"x","sz":"2","time":7,"tid":9,"side":"B"},{"px":"-1","sz":"2","time":7,"tid":9,"side":"B"}]}',
        '{"channel":"trades","data":{"price":3.5,"qty":1,"time":"8","tid":null,"side":"buy"}}', '{"channel":"trades","data":[{"px":"1","sz":"2","time":0},{"px":"1","time":3},{"px":"2","sz":"1","time":4,"side":"A"},{"px":"2","sz":"1","time":4,"side":1}]}',
        '{"channel":"book"}', "not json", '{"channel":"trades"}', None,
    ]
    got = layout.trades_from_json(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(rows(got, "ts", "seq", "px", "qty", "side")) == [(4000, 0, 2.0, 1.0, -1.0), (4000, 0, 2.0, 1.0, 1.0), (7000, 9, 1.5, 2.0, 1.0), (8000, 0, 3.5, 1.0, 1.0)]



def test_streams_match_the_batch_operators(spark, tmp_path):
    from tapeloom.operators import flow

    t = market.tape(spark, SF)
    doubled = t.unionByName(t.where("seq % 50 = 0"))
    doubled.orderBy("ts", "seq").coalesce(1).write.option("maxRecordsPerFile", 150).parquet(f"{tmp_path}/in")
    stream = lambda: jobs.read_tape(spark, f"{tmp_path}/in")
    once = jobs.deduplicated(stream(), ["seq"], "60 days")
    jobs.drain(once, f"{tmp_path}/once", f"{tmp_path}/c0")
    assert spark.read.parquet(f"{tmp_path}/once").count() == t.count()
    t.orderBy("ts", "seq").coalesce(1).write.option("maxRecordsPerFile", 150).parquet(f"{tmp_path}/clean")
    clean = lambda: jobs.read_tape(spark, f"{tmp_path}/clean").withWatermark("event_time", "1 hour")
    jobs.drain(jobs.kalman_z(clean(), CELL, 1e-10, 1e-5), f"{tmp_path}/z", f"{tmp_path}/c1")
    want = {r["seq"]: r["z"] for r in vol.kalman(t, CELL, 1e-10, 1e-5).collect()}
    assert {r["seq"]: pytest.approx(r["z"]) for r in spark.read.parquet(f"{tmp_path}/z").collect()} == want
    scored = spark.read.parquet(f"{tmp_path}/z").orderBy("ts", "seq").coalesce(1)
    scored.write.option("maxRecordsPerFile", 150).parquet(f"{tmp_path}/scored")
    again = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/scored")
    jobs.drain(jobs.sleeve(again, CELL, 2.0, 3_600_000_000, 1.0), f"{tmp_path}/s", f"{tmp_path}/c4")
    legs = (*CELL, "entry_ts", "exit_ts", "direction", "pnl_bps")
    assert rows(spark.read.parquet(f"{tmp_path}/s"), *legs) == rows(policy.sleeve(scored, CELL, 2.0, 3_600_000_000, 1.0), *legs)
    jobs.drain_to_days(clean(), f"{tmp_path}/days", f"{tmp_path}/c5")
    assert layout.read_days(spark, f"{tmp_path}/days").count() == t.count()
    jobs.drain(jobs.volume_buckets(clean(), CELL, 20.0), f"{tmp_path}/b", f"{tmp_path}/c2")
    key = (*CELL, "bucket", "end_ts", "volume", "imbalance")
    assert rows(spark.read.parquet(f"{tmp_path}/b"), *key) == rows(flow.volume_buckets(t, CELL, 20.0), *key)
    jobs.drain(jobs.flow_windows(clean(), ["symbol"], "1 day"), f"{tmp_path}/w", f"{tmp_path}/c3")
    batch = {(r["symbol"], r["day"]): r["n"] for r in t.groupBy("symbol", F.floor(F.col("ts") / layout.DAY_US).alias("day")).agg(F.count("*").alias("n")).collect()}
    got = {(r["symbol"], r["start"].toordinal() - 719163): r["n"] for r in spark.read.parquet(f"{tmp_path}/w").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_bursts_rearm_under_the_lower_mark(spark):
    from tapeloom.operators import research

    v = [1, 10, 12, 9, 11, 7, 10, 11, 3, 10]
    s = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, bar long, v double")
    assert rows(research.bursts(s, ["k"], "v", 10.0, 8.0, 2), "bar") == [(1,), (6,), (9,)]


def test_autoregression_against_numpy(spark):
    from tapeloom.operators import research

    rng = np.random.default_rng(5)
    x = [0.0, 0.0]
    for _ in range(800):
        x.append(0.5 * x[-1] - 0.2 * x[-2] + rng.standard_normal())
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, ts long, x double")
    got = research.autoregression(d, ["k"], "x", 2, ["ts"]).first()
    y = np.array(x)
    want = np.linalg.lstsq(np.stack([y[1:-1], y[:-2]], axis=1), y[2:], rcond=None)[0]
    assert np.allclose(got["phi"], want) and got["n"] == len(x) - 2
    assert np.allclose(got["impulse"][:3], np.cumsum([1, want[0], want[0] ** 2 + want[1]]))


def test_pin_recovers_its_parameters(spark):
    from tapeloom.operators import research

    rng = np.random.default_rng(6)
    days = []
    for day in range(150):
        news, bad = rng.random() < 0.4, rng.random() < 0.5
        days.append((1, day, int(rng.poisson(100 + (60 if news and not bad else 0))), int(rng.poisson(100 + (60 if news and bad else 0)))))
    got = research.pin_fit(spark.createDataFrame(days, "k int, day long, buys long, sells long"), ["k"]).first()
    assert abs(got["pin"] - 0.4 * 60 / (0.4 * 60 + 200)) < 0.03 and abs(got["eps"] - 100) < 8


def test_two_scales_beat_all_returns(spark):
    """On made paths of constant volatility with noise."""
    rng, n = np.random.default_rng(10), 2000
    paths = [np.cumsum(rng.standard_normal(n) * 0.01 / math.sqrt(n)) + 5e-4 * rng.standard_normal(n) for _ in range(10)]
    points = spark.createDataFrame([(i, k, float(v)) for i, x in enumerate(paths) for k, v in enumerate(x)], "p int, k long, x double")
    got = vol.two_scales(points, ["p"], 20).toPandas()
    error = {c: ((got[c] - 1e-4) ** 2).mean() for c in ("all", "sparse", "tsrv_adj")}
    assert error["tsrv_adj"] < error["sparse"] < error["all"]


def test_crash_events_by_hand(spark):
    """A run of one print is a tie and counts as down; a run that comes back to where it began has no
    known recovery; else the way back is taken from the last price."""
    z = [(0, 0, 100.0, 5.0), (1, 1, 100.0, 0.0), (2, 2, 100.0, 5.0), (3, 3, 90.0, -6.0), (4, 4, 95.0, 0.0), (9, 5, 99.0, 0.0), (20, 6, 100.0, 5.0), (21, 7, 110.0, 7.0), (22, 8, 100.0, 5.0), (23, 9, 100.0, 0.0), (30, 10, 100.0, 9.0), (31, 11, 104.0, 9.0)]
    f = spark.createDataFrame([("a", *x) for x in z], "k string, ts long, seq long, px double, z double")
    e = vol.crash_events(f, ["k"], 4.0)
    assert sorted(rows(e, "start_ts", "prints", "dp_pct", "direction", "z_peak")) == [(0, 1, 0.0, -1, 5.0), (2, 2, 10.0, -1, -6.0), (20, 3, 10.0, 1, 7.0), (30, 2, 4.0, 1, 9.0)]
    got = vol.recovery(e, f.select("k", "ts", "seq", "px"), ["k"], 5)
    assert sorted(rows(got, "start_ts", "recovery", "kind"), key=str) == [(0, None, "unknown"), (2, 0.5, "v_recovery"), (20, None, "unknown"), (30, 0.0, "continuation")]
    assert vol.severity_gate(e, 1.0, 2, 6.5, 2).count() == 1


def test_storm_bars_by_hand(spark):
    """Sizes count at whatever price; one quote may add and cancel; the range is over the middle of its ends."""
    q = [(0, 10.0, 12.0, 5.0, 5.0), (1, 10.0, 12.0, 6.0, 4.0), (2, 11.0, 12.0, 7.0, 4.0), (10, 11.0, 12.0, 7.0, 4.0), (30, 8.0, 9.0, 1.0, 9.0)]
    tob = spark.createDataFrame([("a", t, i, b, a, (a + b) / 2, bs, as_) for i, (t, b, a, bs, as_) in enumerate(q)], "k string, ts long, seq long, bid double, ask double, mid double, bid_sz double, ask_sz double")
    bars = hft.storm_bars(tob, ["k"], 10)
    got = sorted(rows(bars, "bar", "updates", "adds", "cancels", "moves", "cancel_frac", "range_bps"))
    assert got[:2] == [(0, 3, 2, 1, 1, 1 / 3, 1e4 * 0.5 / 11.25), (1, 1, 0, 0, 0, None, 0.0)] and got[2] == (2, 0, 0, 0, 0, None, None) and got[3][:5] == (3, 1, 1, 1, 1)
    assert hft.storms(bars, ["k"], 1.0, 0.0, 1e9, 0.0).count() == 0  # fewer than five bars


def test_drift_burst_by_loop(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    ts, r = np.sort(rng.integers(0, 4_000_000, 300)), rng.standard_normal(300)
    d = spark.createDataFrame([("a", int(t), float(x)) for t, x in zip(ts, r)], "k string, ts long, r double")
    taus = [500_000, 1_000_000, int(ts[150]), 3_300_000]
    got = {x["tau"]: x for x in vol.drift_burst(d, ["k"], spark.createDataFrame([("a", t) for t in taus], "k string, tau long"), 200_000).collect()}
    for tau in taus:
        side = []
        for m in (ts <= tau, ts >= tau):
            w = np.exp(-np.abs(ts[m] - tau) / 200_000)
            side.append((w @ r[m]) / np.sqrt(0.5 * (w @ r[m] ** 2)))
        assert np.allclose([got[tau]["t_minus"], got[tau]["t_plus"], got[tau]["v"]], [*side, np.sqrt(0.2) * side[0] * side[1]])
    least = vol.least_burst(spark.createDataFrame([tuple(x) for x in got.values()], "k string, tau long, t_minus double, t_plus double, v double"), ["k"]).first()
    assert least["min_v"] == min(x["v"] for x in got.values())


def lagged(columns: dict, lags: int) -> dict:
    """Each series at lags 0 to lags, from the first row that has them all."""
    n = len(next(iter(columns.values())))
    return {f"{v}{k}": np.asarray(x)[lags - k : n - k] for k in range(lags + 1) for v, x in columns.items()}


def test_information_share_against_numpy(spark):
    from tapeloom.operators import xvenue

    rng, n, lags = np.random.default_rng(11), 400, 2
    common = np.cumsum(rng.standard_normal(n)) * 0.01
    mids = {0: np.exp(5 + common + 0.003 * rng.standard_normal(n)), 1: np.exp(5 + np.concatenate([[0], common[:-1]]) + 0.01 * rng.standard_normal(n))}
    panel = spark.createDataFrame([(1, v, t, float(x)) for v, m in mids.items() for t, x in enumerate(m)], "symbol int, venue int, ts long, mid double")
    got = xvenue.information_share(panel, ["symbol"], 0, 1, lags).first()
    x = lagged({"a": np.diff(np.log(mids[0])), "b": np.diff(np.log(mids[1]))}, lags)
    past = np.stack([x[f"{v}{k}"] for k in range(1, lags + 1) for v in "ab"], axis=1)
    now = np.stack([x["a0"], x["b0"]], axis=1)
    coef = np.linalg.lstsq(past, now, rcond=None)[0]
    resid = now - past @ coef
    omega = resid.T @ resid / len(now)
    psi = np.linalg.inv(np.eye(2) - sum(coef[2 * k : 2 * k + 2].T for k in range(lags))).mean(axis=0)
    total = psi @ omega @ psi
    first = (psi @ np.linalg.cholesky(omega))[0] ** 2 / total
    last = 1 - (psi[::-1] @ np.linalg.cholesky(omega[::-1, ::-1]))[0] ** 2 / total
    assert got["n"] == len(now) and np.allclose([got["share_a_low"], got["share_a_high"]], sorted([first, last]))


def test_trade_var_against_numpy(spark):
    from tapeloom.operators import flow

    rng, n, lags = np.random.default_rng(12), 500, 2
    side = np.sign(rng.standard_normal(n) + 0.3 * np.concatenate([[0], rng.standard_normal(n - 1)]))
    move = 0.5 * side + 0.2 * np.concatenate([[0], side[:-1]]) + 0.1 * rng.standard_normal(n)
    d = spark.createDataFrame([(1, t, t, float(m), float(q)) for t, (m, q) in enumerate(zip(move, side))], "k int, ts long, seq long, d_mid double, side double")
    got = flow.trade_var(d, ["k"], lags, 5).first()
    x = lagged({"m": move, "q": side}, lags)
    past = [x[f"{v}{k}"] for k in range(1, lags + 1) for v in "mq"]
    a = np.linalg.lstsq(np.stack([x["q0"], *past], axis=1), x["m0"], rcond=None)[0]
    b = np.linalg.lstsq(np.stack(past, axis=1), x["q0"], rcond=None)[0]
    m, q, path = [0.0] * lags, [0.0] * lags, []
    for h in range(5):
        before = [v for k in range(lags) for v in (m[k], q[k])]
        shock = 1.0 if h == 0 else b @ before
        step = a @ [shock, *before]
        m, q = [step, *m[:-1]], [shock, *q[:-1]]
        path.append(step)
    assert np.isclose(got["lambda"], a[0]) and np.allclose(got["impulse"], np.cumsum(path))


def test_hac_fit_against_numpy(spark):
    from tapeloom.operators import inference

    rng, n, lags = np.random.default_rng(13), 300, 3
    x = rng.standard_normal((n, 2))
    y = 1 + x @ [0.5, -2] + rng.standard_normal(n) * (1 + np.abs(x[:, 0]))
    d = spark.createDataFrame([("a", t, float(v), float(p), float(q)) for t, (v, (p, q)) in enumerate(zip(y, x))] + [("b", 0, 1.0, 1.0, 1.0)], "k string, t long, y double, p double, q double")
    got = inference.hac_ols(d, ["k"], "y", ["p", "q"], ["t"], lags).collect()
    assert [r["k"] for r in got] == ["a"]
    z = np.column_stack([np.ones(n), x])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    u = (y - z @ beta)[:, None] * z
    s = u.T @ u + sum((1 - k / (lags + 1)) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in range(1, lags + 1))
    back = np.linalg.inv(z.T @ z)
    assert np.allclose(got[0]["beta"], beta) and np.allclose(got[0]["se"], np.sqrt(np.diag(back @ s @ back)))


def test_quantiles_over_all_rows(spark):
    from tapeloom.operators import flow

    rng = np.random.default_rng(14)
    v = np.round(rng.standard_normal(1000), 2)
    d = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(7)
    assert np.allclose(flow.quantiles(d, "v", [0.0, 0.1, 0.5, 0.77, 1.0]), np.quantile(v, [0.0, 0.1, 0.5, 0.77, 1.0]))
    assert flow.quantiles(d.limit(0), "v", [0.5]) == [None]


def test_survival_pauses_and_policies_by_hand(spark):
    from tapeloom.operators import decisions, estimators

    tob = spark.createDataFrame([("a", 0, 0, 9.0, 10.0, 5.0, 5.0), ("a", 10, 1, 8.0, 9.0, 5.0, 5.0), ("a", 20, 2, 9.5, 10.5, 2.0, 2.0)], "k string, ts long, seq long, bid double, ask double, bid_sz double, ask_sz double")
    trades = spark.createDataFrame([("a", 5, 0, 4.0, -1.0), ("a", 12, 1, 3.0, -1.0), ("a", 15, 2, 2.0, -1.0), ("a", 16, 3, 9.0, 1.0)], "k string, ts long, seq long, qty double, side double")
    got = estimators.touch_survival(tob, trades, ["k"], 1.0, [0], 1, 18)
    # the bid of 9 fills when the ask has come down to it, with the second sale after that; the others never
    assert rows(got, "starts", "filled", "mean_us") == [(3, 1, 15.0)]
    events = spark.createDataFrame([("a", 1, 100, "widen"), ("a", 2, 105, "halt"), ("a", 3, 200, "observe")], "k string, run long, end_ts long, tier string")
    pauses = decisions.fire_pauses(events, 10)
    assert rows(pauses, "run", "start_ts", "end_ts") == [(1, 100, 110), (2, 105, 115)]
    at = spark.createDataFrame([("a", t, t) for t in (99, 100, 109, 114, 115)], "k string, ts long, seq long")
    assert [r["ts"] for r in decisions.in_pause(at, pauses, ["k"]).where("paused").orderBy("ts").collect()] == [100, 109, 114]
    own = events.select("k", "run", F.col("end_ts").alias("ts"), F.col("run").alias("seq"))
    assert rows(decisions.in_pause(own, pauses, ["k"], "run"), "run", "paused") == [(1, False), (2, True), (3, False)]
    acts = decisions.event_actions(events.withColumn("nested", F.col("run") == 1), F.col("nested"))
    assert rows(acts, "run", "kind", "size_mult", "pull", "action") == [(1, "ladder_fire", 0.0, True, "nest_hard_pause"), (2, "ladder_fire", 0.0, True, "halt_aggressive"), (3, "ladder_observe", 1.0, False, "observe")]


def test_fire_pause_clock_of_one_event(spark):
    """400 prints a second apart and one firing event at 50 s: sizes are full before it, nothing for five
    minutes from it on, and full again after that."""
    from tapeloom.operators import decisions

    prints = spark.range(400).select(F.lit("a").alias("k"), (F.col("id") * 1_000_000).alias("ts"), F.col("id").alias("seq"))
    events = spark.createDataFrame([("a", 1, 50_000_000, "widen")], "k string, run long, end_ts long, tier string")
    clock = decisions.in_pause(prints, decisions.fire_pauses(events, 300_000_000), ["k"])
    size = {r["seq"]: 0.0 if r["paused"] else 1.0 for r in clock.collect()}
    assert [size[t] for t in (10, 49, 50, 80, 349, 350, 360)] == [1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0]


def test_book_events_by_hand(spark):
    from tapeloom.operators import book

    q = [(10.0, 11.0, 5.0, 5.0), (10.1, 11.0, 5.0, 5.0), (10.1, 11.0, 5.25, 5.0), (10.1, 11.0, 5.25, 5.1), (10.1, 10.9, 5.25, 5.1), (10.1, 10.9, 5.25, 4.0), (10.0, 11.0, 9.0, 9.0), (10.0, 11.0, 9.0, 9.0)]
    tob = spark.createDataFrame([("a", i, i, *x) for i, x in enumerate(q)], "k string, ts long, seq long, bid double, ask double, bid_sz double, ask_sz double")
    e = book.book_events(tob, ["k"])
    assert rows(e, "ts", "code") == [(1, 1), (2, 3), (4, 2), (5, -4), (6, -1)]
    assert rows(book.event_shares(e, ["k"]), "n", "improved", "worsened") == [(5, 2, 1)]
