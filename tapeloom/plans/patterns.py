"""Queries on high-frequency patterns, venues, options and policy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import benjamini_hochberg, r6
from tapeloom.operators import flow, hft, options, policy, vol, xvenue
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import ASOF, HOUR, MARK
from tapeloom.plans.flow import W
from tapeloom.plans.vol import KF
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR
STORM = f""", s0 AS (SELECT *, row_number() OVER w AS k, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bid_sz) OVER w AS ps, lag(ask_sz) OVER w AS pz FROM tob WINDOW w AS {W}),
s1 AS (SELECT venue, symbol, ts // {8 * HOUR} AS bar, count(*) AS updates, count(*) FILTER (WHERE bid_sz > ps * 1.0000001 OR ask_sz > pz * 1.0000001) AS adds, count(*) FILTER (WHERE bid_sz < ps * 0.9999999 OR ask_sz < pz * 0.9999999) AS cancels,
 count(*) FILTER (WHERE k > 1 AND NOT (abs(bid - pb) < 1e-12 AND abs(ask - pa) < 1e-12)) AS moves, 1e4 * (max(mid) - min(mid)) / ((max(mid) + min(mid)) / 2) AS range_bps FROM s0 GROUP BY ALL),
s2 AS (SELECT venue, symbol, unnest(generate_series(min(bar), max(bar))) AS bar FROM s1 GROUP BY venue, symbol),
sb AS (SELECT venue, symbol, bar, coalesce(updates, 0) AS updates, coalesce(adds, 0) AS adds, coalesce(cancels, 0) AS cancels, coalesce(moves, 0) AS moves, range_bps, cancels / nullif(adds + cancels, 0) AS cancel_frac FROM s2 LEFT JOIN s1 USING (venue, symbol, bar)),
sz AS (SELECT *, (updates - avg(updates) OVER (PARTITION BY venue, symbol)) / stddev_pop(updates) OVER (PARTITION BY venue, symbol) AS z, (adds + cancels - avg(adds + cancels) OVER (PARTITION BY venue, symbol)) / stddev_pop(adds + cancels) OVER (PARTITION BY venue, symbol) AS size_z FROM sb)
"""


@query("quote_storm_bars", f"{STORM} SELECT venue, symbol, count(*) AS bars, sum(updates)::BIGINT AS updates, sum(adds)::BIGINT AS adds, sum(cancels)::BIGINT AS cancels, sum(moves)::BIGINT AS moves, {R('avg(range_bps)')} AS range_bps FROM sb GROUP BY ALL")
def quote_storm_bars(spark, sf):
    b = hft.storm_bars(market.tob(spark, sf), CELL, 8 * HOUR)
    return b.groupBy(*CELL).agg(F.count("*").alias("bars"), *(F.sum(c).alias(c) for c in ("updates", "adds", "cancels", "moves")), r6(F.avg("range_bps")).alias("range_bps"))


@query("quote_storms", f"{STORM} SELECT venue, symbol, bar, updates, {R('z')} AS z FROM sz WHERE z >= 1.5 AND updates >= 1e-4 * {8 * 3600} AND coalesce(cancel_frac >= 0.4, true) AND coalesce(range_bps <= 500, true)")
def quote_storms(spark, sf):
    b = hft.storm_bars(market.tob(spark, sf), CELL, 8 * HOUR)
    return hft.storms(b, CELL, 1.5, 0.4, 500.0, 1e-4).select(*CELL, "bar", "updates", r6(F.col("z")).alias("z"))


@query("size_storms", f"{STORM} SELECT venue, symbol, bar, adds, cancels, {R('size_z')} AS z FROM sz WHERE size_z >= 1.5 AND adds + cancels >= 1e-4 * {8 * 3600} AND coalesce(cancel_frac >= 0.4, true) AND coalesce(range_bps <= 500, true)")
def size_storms(spark, sf):
    b = hft.storm_bars(market.tob(spark, sf), CELL, 8 * HOUR)
    return hft.storms(b, CELL, 1.5, 0.4, 500.0, 1e-4, sizes=True).select(*CELL, "bar", "adds", "cancels", r6(F.col("z")).alias("z"))


@query("order_to_trade", f"{STORM}, c AS (SELECT venue, symbol, sum(cancels)::BIGINT AS cancels FROM sb GROUP BY ALL), t AS (SELECT venue, symbol, count(*) AS trades FROM tape GROUP BY ALL) SELECT venue, symbol, cancels, trades, {R('cancels / trades')} AS otr FROM c LEFT JOIN t USING (venue, symbol)")
def order_to_trade(spark, sf):
    o = hft.order_to_trade(hft.storm_bars(market.tob(spark, sf), CELL, 8 * HOUR), market.tape(spark, sf), CELL)
    return o.select(*CELL, "cancels", "trades", r6(F.col("otr")).alias("otr"))


@query("price_fade", f""", f0 AS (SELECT t.*, q.ts AS t0, CASE WHEN t.side > 0 THEN q.ask_sz ELSE q.bid_sz END AS size0 FROM {ASOF} WHERE q.ts IS NOT NULL), fh AS (SELECT *, unnest([{HOUR}, {4 * HOUR}]) AS horizon FROM f0),
fx AS (SELECT f.horizon, f.side, coalesce((SELECT min(CASE WHEN f.side > 0 THEN q.ask_sz ELSE q.bid_sz END) FROM tob q WHERE q.venue = f.venue AND q.symbol = f.symbol AND q.ts > f.t0 AND q.ts <= f.ts + f.horizon) <= 0.8 * f.size0, false) AS fade FROM fh f)
SELECT horizon, side, count(*) AS n, {R("avg(fade::INT)")} AS p FROM fx GROUP BY GROUPING SETS ((horizon, side), (horizon))""")
def price_fade(spark, sf):
    f = hft.fades(market.tape(spark, sf), market.tob(spark, sf), CELL, [HOUR, 4 * HOUR], 0.2)
    return f.groupingSets([[F.col("horizon"), F.col("side")], [F.col("horizon")]], "horizon", "side").agg(F.count("*").alias("n"), r6(F.avg(F.col("fade").cast("double"))).alias("p"))


@query("venue_fade", f""", h AS (SELECT *, ts + {HOUR // 60} AS then_ts FROM tape WHERE venue = 0), q1 AS (SELECT *, ts + 1 AS after FROM tob WHERE venue = 1),
n AS (SELECT h.symbol, h.side, h.then_ts, q.bid, q.ask, q.bid_sz, q.ask_sz FROM h ASOF JOIN q1 q ON h.symbol = q.symbol AND h.then_ts >= q.after),
x AS (SELECT n.symbol, EXISTS (SELECT 1 FROM q1 r WHERE r.symbol = n.symbol AND r.ts BETWEEN n.then_ts AND n.then_ts + {HOUR} AND CASE WHEN n.side > 0 THEN abs(r.ask - n.ask) > 1e-12 OR r.ask_sz <= 0.8 * n.ask_sz ELSE abs(r.bid - n.bid) > 1e-12 OR r.bid_sz <= 0.8 * n.bid_sz END) AS fade FROM n)
SELECT symbol, count(*) AS n, {R("avg(fade::INT)")} AS p FROM x GROUP BY symbol""")
def venue_fade(spark, sf):
    f = hft.venue_fades(market.tape(spark, sf), market.tob(spark, sf), ["symbol"], 0, 1, HOUR // 60, HOUR, 0.2)
    return f.groupBy("symbol").agg(F.count("*").alias("n"), r6(F.avg(F.col("fade").cast("double"))).alias("p"))


@query("clock_clusters", f""", c AS (SELECT ts % {HOUR} // {HOUR // 60} AS bin, count(*) AS n FROM tape GROUP BY ALL), f AS (SELECT r.range AS bin, coalesce(n, 0) AS n FROM range(60) r LEFT JOIN c ON c.bin = r.range)
SELECT bin, n, {R("(n - sum(n) OVER () / 60) / sqrt(sum(n) OVER () / 60)")} AS z FROM f""")
def clock_clusters(spark, sf):
    return hft.clock_clusters(market.tape(spark, sf), HOUR, HOUR // 60).select("bin", "n", r6(F.col("z")).alias("z"))


@query("funding_window_share", f""", d AS (SELECT venue, abs(ts % {DAY} - 0) AS a, abs(ts % {DAY} - {8 * HOUR}) AS b, abs(ts % {DAY} - {16 * HOUR}) AS c FROM tape)
SELECT venue, least(a, {DAY} - a) <= {HOUR} OR least(b, {DAY} - b) <= {HOUR} OR least(c, {DAY} - c) <= {HOUR} AS inside, count(*) AS n FROM d GROUP BY ALL""")
def funding_window_share(spark, sf):
    t = market.tape(spark, sf).withColumn("inside", hft.near_hours(F.col("ts"), [0, 8, 16], 60))
    return t.groupBy("venue", "inside").agg(F.count("*").alias("n"))


@query("time_of_day_map", f", c AS (SELECT ts // {HOUR} % 24 AS hour, ts % {HOUR} // {HOUR // 12} AS bin, count(*) AS n FROM tape GROUP BY ALL), e AS (SELECT h.range AS hour, b.range AS bin FROM range(24) h, range(12) b) SELECT hour, bin, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (hour, bin)")
def time_of_day_map(spark, sf):
    return hft.heat_map(market.tape(spark, sf), 12)


@query("lead_lag_cascade", f""", w AS (SELECT a.symbol, a.ts, b.ts AS nxt FROM (SELECT * FROM tape WHERE venue = 0) a ASOF LEFT JOIN (SELECT * FROM tape WHERE venue = 1) b ON a.symbol = b.symbol AND a.ts <= b.ts), x AS (SELECT nxt - ts AS wait, unnest([{HOUR}, {4 * HOUR}, {DAY}]) AS win FROM w)
SELECT win AS "window", count(*) AS n, {R("avg(coalesce(wait <= win, false)::INT)")} AS p FROM x GROUP BY win""")
def lead_lag_cascade(spark, sf):
    t = market.tape(spark, sf)
    out = hft.cascade(t.where("venue = 0"), t.where("venue = 1"), ["symbol"], [HOUR, 4 * HOUR, DAY])
    return out.select("window", "n", r6(F.col("p")).alias("p"))


@query("spread_response", f""", b AS (SELECT t.venue, t.symbol, t.ts, t.seq, avg(q.ask - q.bid) AS base FROM tape t JOIN tob q ON q.venue = t.venue AND q.symbol = t.symbol AND q.ts BETWEEN t.ts - {8 * HOUR} AND t.ts - 1 GROUP BY ALL HAVING count(*) >= 2),
l AS (SELECT *, unnest([0, {HOUR}, {4 * HOUR}]) AS lag FROM b), x AS (SELECT l.lag, q.ask - q.bid - l.base AS d FROM (SELECT *, ts + lag AS then_ts FROM l) l ASOF LEFT JOIN tob q ON l.venue = q.venue AND l.symbol = q.symbol AND l.then_ts >= q.ts)
SELECT lag::BIGINT AS lag, count(d) AS n, {R("avg(d) * 1e3")} AS change FROM x GROUP BY lag""")
def spread_response(spark, sf):
    out = hft.spread_response(market.tape(spark, sf), market.tob(spark, sf), CELL, [0, HOUR, 4 * HOUR], 8 * HOUR)
    return out.select(F.col("lag").cast("long").alias("lag"), "n", r6(F.col("change") * 1e3).alias("change"))


@query("event_window_markout", f"""{MARK}{KF.replace(', k0', ', k0', 1)}, em AS (SELECT e.venue, e.symbol, e.run, m.markout, row_number() OVER (PARTITION BY e.venue, e.symbol, e.run ORDER BY m.ts, m.seq) AS k
 FROM ke e JOIN mk m ON m.horizon = {HOUR} AND m.venue = e.venue AND m.symbol = e.symbol AND m.ts BETWEEN e.start_ts - {HOUR} AND e.start_ts + {4 * HOUR}), ea AS (SELECT avg(markout) AS m FROM em WHERE k <= 3 GROUP BY venue, symbol, run)
SELECT count(*) AS events, {R("avg(m)")} AS mean, {R("median(m)")} AS median FROM ea""", recursive=True)
def event_window_markout(spark, sf):
    t = market.tape(spark, sf)
    events = vol.crash_events(vol.kalman(t, CELL, 1e-10, 1e-5), CELL, 2.0).select(*CELL, F.col("start_ts").alias("ts"), F.col("run").alias("seq"))
    out = hft.event_markouts(events, flow.markouts(t, market.tob(spark, sf), CELL, [HOUR]), CELL, HOUR, 4 * HOUR, 3)
    return out.select("events", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"))


PANEL = f""", pg AS (SELECT symbol, unnest(generate_series(min(ts) // {4 * HOUR} * {4 * HOUR}, max(ts) // {4 * HOUR} * {4 * HOUR}, {4 * HOUR}::BIGINT)) AS ts FROM tob GROUP BY symbol), pv AS (SELECT * FROM pg JOIN (SELECT DISTINCT symbol, venue FROM tob) USING (symbol)),
pq AS (SELECT p.symbol, p.venue, p.ts, CASE WHEN p.ts - q.ts <= {8 * HOUR} THEN q.mid END AS mid, CASE WHEN p.ts - q.ts <= {8 * HOUR} THEN (q.ask - q.bid) / (2 * q.mid) END AS half FROM pv p ASOF LEFT JOIN tob q ON p.venue = q.venue AND p.symbol = q.symbol AND p.ts >= q.ts),
pl AS (SELECT a.symbol, a.ts, count(*) AS pairs, max(abs(ln(a.mid / b.mid))) AS vloop_max, avg(abs(ln(a.mid / b.mid))) AS vloop_mean FROM pq a JOIN pq b ON a.symbol = b.symbol AND a.ts = b.ts AND a.venue < b.venue WHERE a.mid IS NOT NULL AND b.mid IS NOT NULL GROUP BY ALL),
pc AS (SELECT symbol, ts, sum(coalesce(half, 0)) + 2.0 / 1e4 * count(*) AS tcost FROM pq WHERE mid IS NOT NULL GROUP BY ALL), pp AS (SELECT *, CASE WHEN vloop_max > 0 THEN vloop_max + abs(tcost) END AS pim FROM pl JOIN pc USING (symbol, ts))
"""


def _gaps(spark, sf):
    return xvenue.gaps(xvenue.aligned(market.tob(spark, sf), ["symbol"], 4 * HOUR, 8 * HOUR), ["symbol"], 2.0)


@query("law_of_one_price", f"{PANEL} SELECT symbol, count(*) AS n, sum(pairs)::BIGINT AS pairs, {R('avg(vloop_max) * 1e3')} AS vloop, {R('avg(vloop_mean) * 1e3')} AS vloop_mean, {R('avg(tcost) * 1e3')} AS tcost, {R('avg(pim) * 1e3')} AS pim FROM pp GROUP BY symbol")
def law_of_one_price(spark, sf):
    g = _gaps(spark, sf)
    return g.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs"), r6(F.avg("vloop_max") * 1e3).alias("vloop"), r6(F.avg("vloop_mean") * 1e3).alias("vloop_mean"), r6(F.avg("tcost") * 1e3).alias("tcost"), r6(F.avg("pim") * 1e3).alias("pim"))


@query("regime_split", f"""{PANEL}, q AS (SELECT symbol, quantile_cont(tcost, 0.25) AS lo, quantile_cont(tcost, 0.75) AS hi FROM pp GROUP BY symbol)
SELECT symbol, {R("CASE WHEN count(*) FILTER (WHERE tcost <= lo) >= 15 THEN corr(vloop_mean, vloop_max) FILTER (WHERE tcost <= lo) END")} AS corr_low,
{R("CASE WHEN count(*) FILTER (WHERE tcost >= hi) >= 15 THEN corr(vloop_mean, vloop_max) FILTER (WHERE tcost >= hi) END")} AS corr_high FROM pp JOIN q USING (symbol) GROUP BY symbol""")
def regime_split(spark, sf):
    r = xvenue.regime_corr(_gaps(spark, sf), ["symbol"], "vloop_mean", "vloop_max", "tcost")
    return r.select("symbol", r6(F.col("corr_low")).alias("corr_low"), r6(F.col("corr_high")).alias("corr_high"))


@query("logistic_constraint", f"{PANEL}, m AS (SELECT symbol, median(tcost) AS m FROM pp GROUP BY symbol) SELECT symbol, {R('avg(1 / (1 + exp(-2000 * (tcost - m))))')} AS g FROM pp JOIN m USING (symbol) GROUP BY symbol")
def logistic_constraint(spark, sf):
    g = _gaps(spark, sf)
    rows = g.join(g.groupBy("symbol").agg(F.median("tcost").alias("m")), "symbol")
    return rows.groupBy("symbol").agg(r6(F.avg(xvenue.logistic(F.col("tcost"), F.col("m"), 2000.0))).alias("g"))


@query("bucketed_panel", f"""{PANEL}, b AS (SELECT symbol, (ts - min(ts) OVER (PARTITION BY symbol)) // {DAY} AS bucket, pim FROM pp), t0 AS (SELECT symbol, min(ts) AS t0, (max(ts) - min(ts)) // {DAY} AS k FROM pp GROUP BY symbol),
g AS (SELECT symbol, bucket, count(*) AS n, avg(pim) AS pim FROM b GROUP BY ALL), e AS (SELECT symbol, t0, unnest(generate_series(0, k)) AS bucket FROM t0)
SELECT symbol, bucket, t0 + bucket * {DAY} + {DAY // 2} AS ts, coalesce(n, 0) AS n, {R("pim * 1e3")} AS pim FROM e LEFT JOIN g USING (symbol, bucket)""")
def bucketed_panel(spark, sf):
    b = xvenue.bucket_means(_gaps(spark, sf), ["symbol"], ["pim"], DAY)
    return b.select("symbol", "bucket", "ts", "n", r6(F.col("pim") * 1e3).alias("pim"))


@query("rolling_imbalance", f"""{""}, i AS (SELECT venue, symbol, CASE WHEN row_number() OVER {W} >= 20 THEN sum(side * qty) OVER (PARTITION BY venue, symbol ORDER BY ts, seq ROWS 19 PRECEDING) / sum(qty) OVER (PARTITION BY venue, symbol ORDER BY ts, seq ROWS 19 PRECEDING) END AS i FROM tape)
SELECT venue, symbol, count(i) AS n, {R("avg(abs(i))")} AS mean_abs FROM i GROUP BY ALL""")
def rolling_imbalance(spark, sf):
    i = xvenue.rolling_imbalance(market.tape(spark, sf), CELL, 20)
    return i.groupBy(*CELL).agg(F.count("imbalance").alias("n"), r6(F.avg(F.abs("imbalance"))).alias("mean_abs"))


@query("rolling_volatility", f"""{PANEL}, r AS (SELECT symbol, venue, ts, ln(mid / lag(mid) OVER (PARTITION BY symbol, venue ORDER BY ts)) AS r FROM pq),
v AS (SELECT symbol, venue, CASE WHEN count(r) OVER w >= 6 THEN stddev_samp(r) OVER w END AS rv FROM r WINDOW w AS (PARTITION BY symbol, venue ORDER BY ts ROWS 11 PRECEDING))
SELECT symbol, venue, count(rv) AS n, {R("avg(rv) * 1e3")} AS rv FROM v GROUP BY ALL""")
def rolling_volatility(spark, sf):
    p = xvenue.aligned(market.tob(spark, sf), ["symbol"], 4 * HOUR, 8 * HOUR)
    v = xvenue.rolling_vol(p, ["symbol", "venue"], "mid", 12)
    return v.groupBy("symbol", "venue").agg(F.count("rv").alias("n"), r6(F.avg("rv") * 1e3).alias("rv"))


@query("constraint_component")
def constraint_component(spark, sf):
    """No SQL: an eigenvector for each symbol; tests compare it with NumPy on the same rows."""
    return xvenue.first_component(_gaps(spark, sf), ["symbol"], ["vloop_max", "vloop_mean", "tcost"]).select("symbol", "ts", "pc1", "share")


@query("information_share")
def information_share(spark, sf):
    """No SQL: a vector autoregression; tests compare it with NumPy on the same rows."""
    p = xvenue.aligned(market.tob(spark, sf), ["symbol"], 4 * HOUR, 10 * DAY)
    return xvenue.information_share(p, ["symbol"], 0, 1, 2)


DDOI = ", dd AS (SELECT instrument_id, sum(CASE aggressor_side WHEN 1 THEN -1.0 WHEN 2 THEN 1.0 ELSE 0.0 END * abs(qty)) AS ddoi FROM option_trades GROUP BY ALL)"
GREEKS = f"""{DDOI}, ch AS (SELECT c.*, coalesce(ddoi, 0) AS ddoi, CASE WHEN iv > 1.5 THEN iv / 100 ELSE iv END AS v FROM chain c LEFT JOIN dd USING (instrument_id)),
g1 AS (SELECT *, (ln(1200.0 / strike) + v * v / 2 * ttm_years) / (v * sqrt(ttm_years)) AS d1 FROM ch),
g2 AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM g1), g3 AS (SELECT *, ddoi * pdf / (1200.0 * v * sqrt(ttm_years)) * 1200.0 AS gex, ddoi * (-pdf * (d1 - v * sqrt(ttm_years)) / v) * 0.01 * 1200.0 AS vex FROM g2)
"""


def _chain(spark, sf):
    d = options.dealer_position(market.option_trades(spark, sf))
    return market.chain(spark, sf).join(d, "instrument_id", "left").withColumn("ddoi", F.coalesce("ddoi", F.lit(0.0)))


@query("dealer_position", f"{DDOI} SELECT instrument_id, ddoi, CASE WHEN ddoi > 0 THEN 'long' WHEN ddoi < 0 THEN 'short' ELSE 'flat' END AS sign FROM dd")
def dealer_position(spark, sf):
    d = options.dealer_position(market.option_trades(spark, sf))
    return d.select("instrument_id", "ddoi", options.dealer_sign(F.col("ddoi")).alias("sign"))


@query("chain_exposures", f"{GREEKS} SELECT instrument_id, {R('gex')} AS gex, {R('vex')} AS vex FROM g3")
def chain_exposures(spark, sf):
    return options.exposures(_chain(spark, sf), 1200.0).select("instrument_id", r6(F.col("gex")).alias("gex"), r6(F.col("vex")).alias("vex"))


@query("gex_total", f"{GREEKS} SELECT flag, {R('sum(gex)')} AS gex, {R('sum(vex)')} AS vex, {R('greatest(0, -sum(gex)) + greatest(0, -sum(vex))')} AS squeeze FROM g3 GROUP BY flag")
def gex_total(spark, sf):
    e = options.exposures(_chain(spark, sf), 1200.0)
    return e.groupBy("flag").agg(r6(F.sum("gex")).alias("gex"), r6(F.sum("vex")).alias("vex"), r6(options.squeeze_intensity(F.sum("gex"), F.sum("vex"))).alias("squeeze"))


@query("implied_book_map", f"""{DDOI}, ch AS (SELECT c.*, coalesce(ddoi, 0) AS ddoi FROM chain c LEFT JOIN dd USING (instrument_id)),
x AS (SELECT ch.*, b.b AS spot_bps, s.s AS shock, 1200.0 * (1 + b.b / 1e4) AS sp, greatest(CASE WHEN iv > 1.5 THEN iv / 100 ELSE iv END + s.s, 1e-6) AS v FROM ch, (SELECT unnest([-100.0, 0.0, 100.0]) AS b) b, (SELECT unnest([-0.05, 0.0, 0.05]) AS s) s),
y AS (SELECT *, (ln(sp / strike) + v * v / 2 * ttm_years) / (v * sqrt(ttm_years)) AS d1 FROM x), z AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM y)
SELECT spot_bps::DOUBLE AS spot_bps, shock::DOUBLE AS shock, {R("sum(ddoi * (pdf / (v * sqrt(ttm_years)) - pdf * (d1 - v * sqrt(ttm_years)) / v * shock * sp))")} AS gex_plus FROM z GROUP BY ALL""")
def implied_book_map(spark, sf):
    m = options.book_map(_chain(spark, sf), 1200.0, [-100.0, 0.0, 100.0], [-0.05, 0.0, 0.05])
    return m.select("spot_bps", "shock", r6(F.col("gex_plus")).alias("gex_plus"))


@query("tier_ladder", f"{KF} SELECT venue, CASE WHEN abs(z) >= 3 THEN 'severe' WHEN abs(z) >= 2 THEN 'hot' WHEN abs(z) >= 1 THEN 'warm' ELSE 'none' END AS tier, count(*) AS n FROM kf GROUP BY ALL", recursive=True)
def tier_ladder(spark, sf):
    k = vol.kalman(market.tape(spark, sf), CELL, 1e-10, 1e-5)
    return k.withColumn("tier", policy.tier(F.col("z"), {"warm": 1.0, "hot": 2.0, "severe": 3.0})).groupBy("venue", "tier").agg(F.count("*").alias("n"))


@query("risk_clock", f"""{KF}, e AS (SELECT venue, symbol, end_ts AS ts FROM ke), a AS (SELECT t.venue, t.ts - e.ts AS age FROM tape t ASOF LEFT JOIN e ON t.venue = e.venue AND t.symbol = e.symbol AND t.ts >= e.ts)
SELECT venue, count(*) AS n, {R(f"avg(CASE WHEN age IS NULL OR age >= {5 * HOUR} THEN 1.0 WHEN age < {HOUR} THEN 0.0 ELSE (age - {HOUR}) / {4 * HOUR} END)")} AS risk FROM a GROUP BY venue""", recursive=True)
def risk_clock(spark, sf):
    t = market.tape(spark, sf)
    e = vol.crash_events(vol.kalman(t, CELL, 1e-10, 1e-5), CELL, 2.0).select(*CELL, F.col("end_ts").alias("ts"), F.col("run").alias("seq"))
    r = policy.risk_multiplier(t, e, CELL, HOUR, 4 * HOUR)
    return r.groupBy("venue").agg(F.count("*").alias("n"), r6(F.avg("risk")).alias("risk"))


@query("drawdown", f""", a AS (SELECT month, venue, avg(y) AS y FROM panel GROUP BY ALL), d AS (SELECT month, venue, y - lag(y) OVER (PARTITION BY venue ORDER BY month) AS pnl FROM a), e AS (SELECT venue, month, sum(pnl) OVER (PARTITION BY venue ORDER BY month ROWS UNBOUNDED PRECEDING) AS eq FROM d WHERE pnl IS NOT NULL),
x AS (SELECT venue, greatest(0, max(eq) OVER (PARTITION BY venue ORDER BY month ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM e) SELECT venue, count(*) AS n, {R("max(dd)")} AS deepest FROM x GROUP BY venue""")
def drawdown(spark, sf):
    m = market.panel(spark, sf).groupBy("venue", "month").agg(F.avg("y").alias("level"))
    pnl = F.col("level") - F.lag("level").over(Window.partitionBy("venue").orderBy("month"))
    e = policy.equity(m.withColumn("pnl", pnl).where("pnl IS NOT NULL"), ["venue"], "pnl", "month")
    return e.groupBy("venue").agg(F.count("*").alias("n"), r6(F.max("drawdown")).alias("deepest"))


@query("mutual_information", f""", c AS (SELECT venue, side, (qty)::INT AS q, count(*) AS c FROM tape GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY venue) AS n, sum(c) OVER (PARTITION BY venue, side) AS a, sum(c) OVER (PARTITION BY venue, q) AS b FROM c)
SELECT venue, max(n)::BIGINT AS n, {R("sum(c / n * ln(c * n / (a * b)))")} AS nats FROM s GROUP BY venue""")
def mutual_information(spark, sf):
    out = policy.mutual_information(market.tape(spark, sf), ["venue"], "side", "qty")
    return out.select("venue", "n", r6(F.col("nats")).alias("nats"))


@query("false_discovery", f""", p AS (SELECT venue, symbol, exp(-abs(sum(side * qty)) / sqrt(sum(qty))) AS p FROM tape GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p, venue * 10 + symbol) AS k, count(*) OVER () AS n FROM p)
SELECT venue, symbol, {R("p")} AS p, {R("least(1, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING))")} AS q FROM r""")
def false_discovery(spark, sf):
    p = market.tape(spark, sf).groupBy(*CELL).agg(F.exp(-F.abs(F.sum(F.col("side") * F.col("qty"))) / F.sqrt(F.sum("qty"))).alias("p"))
    out = benjamini_hochberg(p.withColumn("id", F.col("venue") * 10 + F.col("symbol")), "p", [], "id")
    return out.select(*CELL, r6(F.col("p")).alias("p"), r6(F.col("q")).alias("q"))


@query("json_payload", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k FROM events GROUP BY ALL")
def json_payload(spark, sf):
    e = market.read(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))
