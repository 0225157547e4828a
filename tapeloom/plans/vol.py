"""Queries on realised variance, filters and crash events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.stats import r6
from tapeloom.operators import flow, vol
from tapeloom.operators.temporal import merge_intervals, range_join
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import ASOF, HOUR
from tapeloom.plans.flow import CAL, W
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR
LP = f", lp AS (SELECT venue, symbol, ts, seq, ln(px) AS x, row_number() OVER {W} - 1 AS k FROM tape WHERE px > 0)\n"


def _points(spark, sf):
    return vol.log_prices(market.tape(spark, sf), CELL)


@query("two_scale_variance", f"""{LP}, ra AS (SELECT venue, symbol, count(r) AS n, sum(r * r) AS al FROM (SELECT *, x - lag(x) OVER (PARTITION BY venue, symbol ORDER BY k) AS r FROM lp) GROUP BY ALL),
rs AS (SELECT venue, symbol, k % 5 AS off, count(r) AS n, sum(r * r) AS rv FROM (SELECT *, x - lag(x) OVER (PARTITION BY venue, symbol, k % 5 ORDER BY k) AS r FROM lp) GROUP BY ALL),
ss AS (SELECT venue, symbol, avg(rv) AS average, avg(n) AS n_bar, max(rv) FILTER (WHERE off = 0) AS sparse FROM rs GROUP BY ALL)
SELECT venue, symbol, n, {R("al * 1e3")} AS "all", {R("sparse * 1e3")} AS sparse, {R("average * 1e3")} AS average, {R("(average - n_bar / n * al) * 1e3")} AS tsrv,
{R("(average - n_bar / n * al) / (1 - n_bar / n) * 1e3")} AS tsrv_adj, {R("al / (2 * n) * 1e6")} AS noise FROM ra JOIN ss USING (venue, symbol)""")
def two_scale_variance(spark, sf):
    t = vol.two_scales(_points(spark, sf), CELL, 5)
    return t.select(*CELL, "n", *(r6(F.col(c) * (1e6 if c == "noise" else 1e3)).alias(c) for c in ("all", "sparse", "average", "tsrv", "tsrv_adj", "noise")))


@query("signature_curve", f"""{LP}, st AS (SELECT *, unnest([1, 2, 5, 10]) AS step FROM lp), sr AS (SELECT *, x - lag(x) OVER (PARTITION BY venue, symbol, step ORDER BY k) AS r FROM st WHERE k % step = 0)
SELECT venue, symbol, step, {R("sum(r * r) * 1e3")} AS rv FROM sr GROUP BY ALL""")
def signature_curve(spark, sf):
    return vol.signature(_points(spark, sf), CELL, [1, 2, 5, 10]).select(*CELL, "step", r6(F.col("rv") * 1e3).alias("rv"))


@query("return_acf", f"""{LP}, r AS (SELECT venue, symbol, k, x - lag(x) OVER (PARTITION BY venue, symbol ORDER BY k) AS r FROM lp), d AS (SELECT *, r - avg(r) OVER (PARTITION BY venue, symbol) AS d FROM r WHERE r IS NOT NULL),
l AS (SELECT venue, symbol, d, lag(d, 1) OVER (PARTITION BY venue, symbol ORDER BY k) AS a, lag(d, 2) OVER (PARTITION BY venue, symbol ORDER BY k) AS b FROM d)
SELECT venue, symbol, unnest([1, 2]) AS lag, unnest([{R("sum(d * a) / sum(d * d)")}, {R("sum(d * b) / sum(d * d)")}]) AS acf FROM l GROUP BY venue, symbol""")
def return_acf(spark, sf):
    return vol.return_acf(_points(spark, sf), CELL, 2).select(*CELL, "lag", r6(F.col("acf")).alias("acf"))


@query("pre_averaged_returns", f"""{LP}, r AS (SELECT venue, symbol, k, x - lag(x) OVER (PARTITION BY venue, symbol ORDER BY k) AS r FROM lp),
y AS (SELECT venue, symbol, 0.2 * r + 0.4 * lead(r, 1) OVER w + 0.4 * lead(r, 2) OVER w + 0.2 * lead(r, 3) OVER w AS y FROM r WHERE r IS NOT NULL WINDOW w AS (PARTITION BY venue, symbol ORDER BY k))
SELECT venue, symbol, count(y) AS n, {R("sum(y * y) * 1e3")} AS rv FROM y GROUP BY ALL""")
def pre_averaged_returns(spark, sf):
    y = vol.pre_averaged(_points(spark, sf), CELL, 5)
    return y.groupBy(*CELL).agg(F.count("y").alias("n"), r6(F.sum(F.col("y") * F.col("y")) * 1e3).alias("rv"))


TAU = f"{CAL}, tau AS (SELECT venue, symbol, unnest(generate_series((min(ts) // {DAY} + 1) * {DAY}, (max(ts) // {DAY}) * {DAY}, {DAY}::BIGINT)) AS tau FROM tape GROUP BY venue, symbol)"
BURST = f"""{TAU}, s AS (SELECT t.venue, t.symbol, tau, exp(-abs(r.ts - tau) / {12.0 * HOUR}) AS w, r.r, r.ts FROM tau t JOIN cr r ON r.venue = t.venue AND r.symbol = t.symbol AND r.r IS NOT NULL),
tt AS (SELECT venue, symbol, tau, sum(w * r) FILTER (WHERE ts <= tau) / nullif(sqrt(0.5 * sum(w * r * r) FILTER (WHERE ts <= tau)), 0) AS l, sum(w * r) FILTER (WHERE ts >= tau) / nullif(sqrt(0.5 * sum(w * r * r) FILTER (WHERE ts >= tau)), 0) AS g FROM s GROUP BY ALL),
vv AS (SELECT venue, symbol, tau, l, g, sqrt({12.0 * HOUR} / 1e6) * l * g AS v FROM tt)
"""


def _burst(spark, sf, of=vol.drift_burst):
    t = market.tape(spark, sf)
    r = flow.calendar_returns(t, CELL, HOUR)
    ends = t.groupBy(*CELL).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    taus = ends.select(*CELL, F.explode(F.sequence((F.floor(F.col("lo") / DAY) + 1) * DAY, F.floor(F.col("hi") / DAY) * DAY, F.lit(DAY))).alias("tau"))
    return of(r, CELL, taus, 12 * HOUR)


@query("drift_burst_path", f"{BURST} SELECT venue, symbol, tau, {R('l')} AS t_minus, {R('g')} AS t_plus, {R('v')} AS v FROM vv")
def drift_burst_path(spark, sf):
    return _burst(spark, sf).select(*CELL, "tau", *(r6(F.col(c)).alias(c) for c in ("t_minus", "t_plus", "v")))


@query("drift_burst_uniform", f"""{TAU}, s AS (SELECT t.venue, t.symbol, tau, sum(r) FILTER (WHERE r.ts <= tau) / nullif(sqrt(sum(r * r) FILTER (WHERE r.ts <= tau)), 0) AS l, sum(r) FILTER (WHERE r.ts >= tau) / nullif(sqrt(sum(r * r) FILTER (WHERE r.ts >= tau)), 0) AS g
  FROM tau t JOIN cr r ON r.venue = t.venue AND r.symbol = t.symbol AND r.r IS NOT NULL AND r.ts BETWEEN tau - {12 * HOUR} AND tau + {12 * HOUR} GROUP BY ALL)
SELECT venue, symbol, tau, {R(f"sqrt({12.0 * HOUR} / 1e6) * l * g")} AS v FROM s""")
def drift_burst_uniform(spark, sf):
    return _burst(spark, sf, vol.drift_burst_uniform).select(*CELL, "tau", r6(F.col("v")).alias("v"))


@query("drift_burst_least", f"""{BURST}, b AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY v, tau) AS k FROM vv WHERE v IS NOT NULL)
SELECT venue, symbol, {R("v")} AS min_v, tau, CASE WHEN l < 0 AND g > 0 THEN 'V' WHEN l > 0 AND g < 0 THEN 'Lambda' ELSE 'other' END AS shape FROM b WHERE k = 1""")
def drift_burst_least(spark, sf):
    return vol.least_burst(_burst(spark, sf), CELL).select(*CELL, r6(F.col("min_v")).alias("min_v"), "tau", "shape")


BAR = f""", br AS (SELECT venue, symbol, ts // {HOUR} * {HOUR} AS ts, arg_max(px, seq) AS px FROM tape GROUP BY ALL), bx AS (SELECT *, ln(px / lag(px) OVER (PARTITION BY venue, symbol ORDER BY ts)) AS r FROM br)
"""


@query("diurnal_factor", f"""{BAR}, v AS (SELECT venue, symbol, ts // {HOUR} % 24 AS slot, avg(r * r) AS v FROM bx WHERE r IS NOT NULL GROUP BY ALL), s AS (SELECT *, v / avg(v) OVER (PARTITION BY venue, symbol) AS s FROM v),
e AS (SELECT venue, symbol, unnest(range(24)) AS slot FROM (SELECT DISTINCT venue, symbol FROM tape)) SELECT venue, symbol, slot, {R("coalesce(s, 1.0)")} AS s FROM e LEFT JOIN s USING (venue, symbol, slot)""")
def diurnal_factor(spark, sf):
    return vol.diurnal(vol.bar_returns(market.tape(spark, sf), CELL, HOUR), CELL, HOUR, 24).select(*CELL, "slot", r6(F.col("s")).alias("s"))


@query("garch_forecast", f"""{BAR}, g0 AS (SELECT venue, symbol, r, row_number() OVER (PARTITION BY venue, symbol ORDER BY ts) AS k FROM bx WHERE r IS NOT NULL),
g(venue, symbol, k, h, r) AS (SELECT venue, symbol, k, (1e-6 / (1 - 0.05 - 0.9))::DOUBLE, r FROM g0 WHERE k = 1 UNION ALL SELECT g.venue, g.symbol, n.k, 1e-6 + 0.05 * g.r * g.r + 0.9 * g.h, n.r FROM g JOIN g0 n ON n.venue = g.venue AND n.symbol = g.symbol AND n.k = g.k + 1)
SELECT venue, symbol, count(*) AS n, {R("avg(h) * 1e4")} AS mean_h, {R("arg_max(h, k) * 1e4")} AS last_h FROM g GROUP BY ALL""", recursive=True)
def garch_forecast(spark, sf):
    h = vol.garch(vol.bar_returns(market.tape(spark, sf), CELL, HOUR), CELL, 1e-6, 0.05, 0.9)
    return h.groupBy(*CELL).agg(F.count("*").alias("n"), r6(F.avg("h") * 1e4).alias("mean_h"), r6(F.max_by("h", "ts") * 1e4).alias("last_h"))


KF = f""", k0 AS (SELECT venue, symbol, ts, seq, px, ln(px) AS y, row_number() OVER {W} AS k FROM tape WHERE px > 0),
kf(venue, symbol, k, ts, seq, px, x, p, z) AS (SELECT venue, symbol, k, ts, seq, px, y, 1e-5::DOUBLE, 0.0::DOUBLE FROM k0 WHERE k = 1 UNION ALL
SELECT f.venue, f.symbol, n.k, n.ts, n.seq, n.px, f.x + (f.p + 1e-10 * (n.ts - f.ts) / 1e6) / (f.p + 1e-10 * (n.ts - f.ts) / 1e6 + 1e-5) * (n.y - f.x),
 (f.p + 1e-10 * (n.ts - f.ts) / 1e6) * (1 - (f.p + 1e-10 * (n.ts - f.ts) / 1e6) / (f.p + 1e-10 * (n.ts - f.ts) / 1e6 + 1e-5)), (n.y - f.x) / sqrt(f.p + 1e-10 * (n.ts - f.ts) / 1e6 + 1e-5)
 FROM kf f JOIN k0 n ON n.venue = f.venue AND n.symbol = f.symbol AND n.k = f.k + 1),
ki AS (SELECT *, CASE WHEN abs(z) >= 2 AND coalesce(lag(abs(z)) OVER {W}, 0) < 2 THEN 1 ELSE 0 END AS st FROM kf), kr AS (SELECT *, sum(st) OVER (PARTITION BY venue, symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM ki),
ke AS (SELECT venue, symbol, run, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS prints, arg_min(px, seq) AS first, arg_max(px, seq) AS last, max(seq) AS end_seq, min(px) AS low, max(px) AS high, arg_max(z, abs(z)) AS z_peak FROM kr WHERE abs(z) >= 2 GROUP BY ALL)
"""


def _filtered(spark, sf):
    return vol.kalman(market.tape(spark, sf), CELL, 1e-10, 1e-5)


@query("kalman_innovations", f"{KF} SELECT venue, symbol, count(*) AS n, {R('sum(abs(z))')} AS total, {R('max(z)')} AS most FROM kf GROUP BY ALL", recursive=True)
def kalman_innovations(spark, sf):
    return _filtered(spark, sf).groupBy(*CELL).agg(F.count("*").alias("n"), r6(F.sum(F.abs("z"))).alias("total"), r6(F.max("z")).alias("most"))


@query("crash_events", f"""{KF} SELECT venue, symbol, run::BIGINT AS run, start_ts, end_ts, prints, {R("100 * greatest(high - first, first - low) / first")} AS dp_pct, CASE WHEN first - low >= high - first THEN -1 ELSE 1 END AS direction, {R("z_peak")} AS z_peak FROM ke""", recursive=True)
def crash_events(spark, sf):
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0)
    return e.select(*CELL, "run", "start_ts", "end_ts", "prints", r6(F.col("dp_pct")).alias("dp_pct"), "direction", r6(F.col("z_peak")).alias("z_peak"))


RECOVERY = f"""{KF}, kd AS (SELECT *, CASE WHEN first - low >= high - first THEN -1 ELSE 1 END AS direction FROM ke),
kb AS (SELECT e.venue, e.symbol, e.run, max(t.px) AS top, min(t.px) AS bottom FROM kd e JOIN tape t ON t.venue = e.venue AND t.symbol = e.symbol AND t.seq > e.end_seq AND t.ts BETWEEN e.end_ts AND e.end_ts + {4 * HOUR} GROUP BY ALL),
kx AS (SELECT kd.*, greatest(0, coalesce(CASE WHEN direction > 0 THEN last - bottom ELSE top - last END, 0)) / nullif(abs(last - first), 0) AS recovery FROM kd LEFT JOIN kb USING (venue, symbol, run))
"""


@query("recovery_classes", f"""{RECOVERY} SELECT symbol, CASE WHEN recovery IS NULL THEN 'unknown' WHEN recovery >= 0.5 THEN 'v_recovery' WHEN recovery < 0.2 THEN 'continuation' ELSE 'partial' END AS kind, count(*) AS n, {R("avg(recovery)")} AS recovery FROM kx GROUP BY ALL""", recursive=True)
def recovery_classes(spark, sf):
    t = market.tape(spark, sf)
    e = vol.recovery(vol.crash_events(_filtered(spark, sf), CELL, 2.0), t, CELL, 4 * HOUR)
    return e.groupBy("symbol", "kind").agg(F.count("*").alias("n"), r6(F.avg("recovery")).alias("recovery"))


@query("severity_gated_events", f"{KF} SELECT venue, count(*) AS events FROM ke WHERE 100 * greatest(high - first, first - low) / first >= 0.0 AND prints >= 1 AND abs(z_peak) >= 2.5 GROUP BY venue", recursive=True)
def severity_gated_events(spark, sf):
    e = vol.severity_gate(vol.crash_events(_filtered(spark, sf), CELL, 2.0), 0.0, 1, 2.5)
    return e.groupBy("venue").agg(F.count("*").alias("events"))


@query("z_mark_scan", f"""{KF}, zm AS (SELECT kf.*, unnest([1.0, 2.0, 3.0]) AS mark FROM kf), zi AS (SELECT *, CASE WHEN abs(z) >= mark AND coalesce(lag(abs(z)) OVER (PARTITION BY venue, symbol, mark ORDER BY ts, seq), 0) < mark THEN 1 ELSE 0 END AS st FROM zm)
SELECT venue, symbol, mark::DOUBLE AS mark, sum(st)::BIGINT AS events, count(*) AS prints FROM zi WHERE abs(z) >= mark GROUP BY ALL""", recursive=True)
def z_mark_scan(spark, sf):
    return vol.z_scan(_filtered(spark, sf), CELL, [1.0, 2.0, 3.0])


@query("outside_quotes", f"SELECT t.venue, count(*) AS n, count(*) FILTER (WHERE t.px > q.ask + 0.5 OR t.px < q.bid - 0.5) AS outside FROM {ASOF} GROUP BY t.venue")
def outside_quotes(spark, sf):
    o = vol.outside_quotes(market.tape(spark, sf), market.tob(spark, sf), CELL, 0.5)
    return o.groupBy("venue").agg(F.count("*").alias("n"), F.count(F.when(F.col("outside"), 1)).alias("outside"))


@query("tick_rule_accuracy", f"""{""}, m AS (SELECT *, nullif(sign(px - lag(px) OVER {W}), 0) AS m FROM tape), r AS (SELECT venue, side, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY venue, symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 1.0) AS rule FROM m)
SELECT venue, count(*) AS n, count(*) FILTER (WHERE rule = side) AS hits FROM r GROUP BY venue""")
def tick_rule_accuracy(spark, sf):
    t = vol.tick_rule(market.tape(spark, sf), CELL)
    return t.groupBy("venue").agg(F.count("*").alias("n"), F.count(F.when(F.col("rule") == F.col("side"), 1)).alias("hits"))


def _spans(rows, length):
    return rows.select("symbol", F.col("ts").alias("start_ts"), (F.col("ts") + length).alias("end_ts"))


@query("merged_activity", f""", i AS (SELECT symbol, ts AS start_ts, ts + {HOUR // 2} AS end_ts FROM tape), m AS (SELECT *, max(end_ts) OVER (PARTITION BY symbol ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT symbol, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n FROM k GROUP BY symbol, k.k""")
def merged_activity(spark, sf):
    return merge_intervals(_spans(market.tape(spark, sf), HOUR // 2), ["symbol"], "start_ts", "end_ts")


@query("interval_concordance")
def interval_concordance(spark, sf):
    """No SQL: a greedy one-to-one match; tests compare it with a plain loop."""
    e = vol.crash_events(_filtered(spark, sf), CELL, 1.5)
    a, b = e.where("venue = 0").select("symbol", "start_ts", "end_ts"), e.where("venue = 1").select("symbol", "start_ts", "end_ts")
    return vol.interval_matches(a, b, ["symbol"], HOUR)


@query("events_without_cofire", f"""{KF}, a AS (SELECT * FROM ke WHERE venue = 0), b AS (SELECT * FROM ke WHERE venue = 1)
SELECT a.symbol, count(*) AS lone FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = a.symbol AND b.start_ts BETWEEN a.start_ts - {HOUR} AND a.start_ts + {HOUR}) GROUP BY a.symbol""", recursive=True)
def events_without_cofire(spark, sf):
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0)
    a = e.where("venue = 0").select("symbol", "run", "start_ts")
    b = e.where("venue = 1").select("symbol", F.col("start_ts").alias("ts"))
    near = range_join(a, b, ["symbol"], F.col("start_ts") - HOUR, F.col("start_ts") + HOUR, 2 * HOUR).select("symbol", "run").distinct()
    return a.join(near, ["symbol", "run"], "left_anti").groupBy("symbol").agg(F.count("*").alias("lone"))


@query("events_with_cofire", f"""{KF}, a AS (SELECT * FROM ke WHERE venue = 0), b AS (SELECT * FROM ke WHERE venue = 1)
SELECT a.symbol, count(*) AS shared FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.symbol = a.symbol AND b.start_ts BETWEEN a.start_ts - {HOUR} AND a.start_ts + {HOUR}) GROUP BY a.symbol""", recursive=True)
def events_with_cofire(spark, sf):
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0)
    a = e.where("venue = 0").select("symbol", "run", "start_ts")
    b = e.where("venue = 1").select("symbol", F.col("start_ts").alias("ts"))
    near = range_join(a, b, ["symbol"], F.col("start_ts") - HOUR, F.col("start_ts") + HOUR, 2 * HOUR, "left_semi")
    return near.select("symbol", "run").distinct().groupBy("symbol").agg(F.count("*").alias("shared"))
