"""Further queries on the book, trades and volatility."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import signs
from tapeloom.functions.stats import div, r6
from tapeloom.operators import book, flow, hft, vol
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import ASOF, HOUR
from tapeloom.plans.flow import BUCKETS, MOVES, W
from tapeloom.plans.patterns import KF, STORM
from tapeloom.plans.vol import LP
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR


def _refill(name, price, size, worse):
    return f"""SELECT '{name}' AS book_side, l.*, (SELECT min(q.seq) FROM tob q WHERE q.venue = l.venue AND q.symbol = l.symbol AND q.ts > l.ts AND q.ts <= l.ts + {DAY} AND abs(q.{price} - l.p0) < 0.3 AND q.{size} - l.s0 >= 0.5 * l.lost) AS back,
(SELECT min(q.seq) FROM tob q WHERE q.venue = l.venue AND q.symbol = l.symbol AND q.ts > l.ts AND q.ts <= l.ts + {DAY} AND (q.{price} - l.p0) * {worse} >= 0.3) AS bad,
(SELECT min(q.seq) FROM tob q WHERE q.venue = l.venue AND q.symbol = l.symbol AND q.ts > l.ts AND q.ts <= l.ts + {DAY} AND (q.{price} - l.p0) * {worse} <= -0.3) AS good
FROM (SELECT venue, symbol, ts, seq, {price} AS p0, {size} AS s0, lag({size}) OVER w - {size} AS lost, lag({size}) OVER w AS was, abs({price} - lag({price}) OVER w) AS d FROM tob WINDOW w AS {W}) l WHERE d < 0.3 AND lost > 0 AND lost >= 0.3 * was"""


@query("same_side_refill", f""", f AS ({_refill("bid", "bid", "bid_sz", -1)} UNION ALL {_refill("ask", "ask", "ask_sz", 1)}), z AS (SELECT book_side, coalesce(back, 1e18) AS back, coalesce(bad, 1e18) AS bad, coalesce(good, 1e18) AS good FROM f)
SELECT book_side, count(*) AS n, count(*) FILTER (WHERE back < 1e18 AND back <= least(bad, good)) AS refilled, count(*) FILTER (WHERE bad < 1e18 AND bad <= least(back, good)) AS worsened FROM z GROUP BY book_side""")
def same_side_refill(spark, sf):
    return book.refills(market.tob(spark, sf), CELL, 0.3, DAY, same=0.3)


@query("depth_before_trades", f""", d AS (SELECT t.venue, t.symbol, t.side, q.bid_sz, q.ask_sz, (t.side > 0)::INT AS buy FROM {ASOF} WHERE q.ts IS NOT NULL)
SELECT venue, symbol, count(*) AS n, {R("corr(bid_sz, buy)")} AS bid_buy, {R("corr(ask_sz, buy)")} AS ask_buy, {R("avg(ask_sz) FILTER (WHERE side < 0)")} AS ask_at_sell, {R("avg(bid_sz) FILTER (WHERE side > 0)")} AS bid_at_buy FROM d GROUP BY ALL""")
def depth_before_trades(spark, sf):
    d = book.depth_before_trades(market.tape(spark, sf), market.tob(spark, sf), CELL)
    return d.select(*CELL, "n", *(r6(F.col(c)).alias(c) for c in ("bid_buy", "ask_buy", "ask_at_sell", "bid_at_buy")))


@query("lambda_time_split", f"""{MOVES}, c AS (SELECT venue, symbol, floor(quantile_cont(ts, 0.7)) AS cut FROM tm WHERE d_mid IS NOT NULL GROUP BY ALL)
SELECT venue, symbol, ts <= cut AS train, count(*) AS n, {R("sum(side * d_mid) / sum(side * side)")} AS lambda FROM tm JOIN c USING (venue, symbol) WHERE d_mid IS NOT NULL GROUP BY ALL""")
def lambda_time_split(spark, sf):
    rows = flow.trades_with_moves(market.tape(spark, sf), market.tob(spark, sf), CELL).where("d_mid IS NOT NULL")
    return flow.time_split(rows, CELL, 0.7).groupBy(*CELL, "train").agg(F.count("*").alias("n"), r6(div(F.sum(F.col("side") * F.col("d_mid")), F.sum(F.col("side") * F.col("side")))).alias("lambda"))


@query("vpin_time_split", f"""{BUCKETS}, c AS (SELECT venue, symbol, floor(quantile_cont(end_ts, 0.5)) AS cut FROM vb GROUP BY ALL)
SELECT venue, symbol, end_ts <= cut AS train, count(*) AS n, {R("avg(imbalance)")} AS imbalance FROM vb JOIN c USING (venue, symbol) GROUP BY ALL""", recursive=True)
def vpin_time_split(spark, sf):
    b = flow.volume_buckets(market.tape(spark, sf), CELL, 20.0).withColumn("ts", F.col("end_ts"))
    return flow.time_split(b, CELL, 0.5).groupBy(*CELL, "train").agg(F.count("*").alias("n"), r6(F.avg("imbalance")).alias("imbalance"))


@query("trade_impulse_response")
def trade_impulse_response(spark, sf):
    """No SQL: a vector autoregression for each cell; tests compare it with NumPy."""
    return flow.trade_var(flow.trades_with_moves(market.tape(spark, sf), market.tob(spark, sf), CELL), CELL, 5)


@query("size_and_latency", f""", t AS (SELECT venue, symbol, quantile_cont(qty, 0.5) AS q50, quantile_cont(qty, 0.9) AS q90, count(*) AS trades, median(w) AS trade_wait FROM (SELECT *, ts - lag(ts) OVER {W} AS w FROM tape) GROUP BY ALL),
q AS (SELECT venue, symbol, count(*) AS quotes, median(w) AS quote_wait FROM (SELECT *, ts - lag(ts) OVER {W} AS w FROM tob) GROUP BY ALL) SELECT venue, symbol, q50, q90, trades, trade_wait, quotes, quote_wait FROM t LEFT JOIN q USING (venue, symbol)""")
def size_and_latency(spark, sf):
    s = hft.size_and_latency(market.tape(spark, sf), market.tob(spark, sf), CELL, [0.5, 0.9])
    return s.select(*CELL, F.col("sizes")[0].alias("q50"), F.col("sizes")[1].alias("q90"), "trades", "trade_wait", "quotes", "quote_wait")


@query("vanishing_improvements", f""", i AS (SELECT *, CASE WHEN bid > lag(bid) OVER w THEN 1.0 WHEN ask < lag(ask) OVER w THEN -1.0 END AS dir, lead(ts) OVER w AS nt, lead(bid) OVER w AS nb, lead(ask) OVER w AS na FROM tob WINDOW w AS {W}),
g AS (SELECT *, coalesce(nt - ts <= {4 * HOUR} AND CASE WHEN dir > 0 THEN nb < bid ELSE na > ask END, false) AS gone FROM i WHERE dir IS NOT NULL)
SELECT venue, symbol, count(*) AS improved, count(*) FILTER (WHERE gone AND NOT EXISTS (SELECT 1 FROM tape t WHERE t.venue = g.venue AND t.symbol = g.symbol AND t.side = -g.dir AND t.ts BETWEEN g.ts AND g.nt)) AS vanished FROM g GROUP BY ALL""")
def vanishing_improvements(spark, sf):
    return hft.vanishing_improvements(market.tape(spark, sf), market.tob(spark, sf), CELL, 4 * HOUR)


@query("size_near_events", f"""{KF}, ev AS (SELECT venue, symbol, start_ts FROM ke), q AS (SELECT quantile_cont(qty, [0.25, 0.5, 0.75]) AS e FROM tape),
n AS (SELECT t.qty, EXISTS (SELECT 1 FROM ev WHERE ev.venue = t.venue AND ev.symbol = t.symbol AND ev.start_ts BETWEEN t.ts - {4 * HOUR} AND t.ts + {4 * HOUR}) AS near FROM tape t)
SELECT (qty >= e[1])::INT + (qty >= e[2])::INT + (qty >= e[3])::INT AS bin, count(*) AS n, count(*) FILTER (WHERE near) AS near FROM n, q GROUP BY bin""", recursive=True)
def size_near_events(spark, sf):
    t = market.tape(spark, sf)
    e = vol.crash_events(vol.kalman(t, CELL, 1e-10, 1e-5), CELL, 2.0).select(*CELL, F.col("start_ts").alias("ts"))
    return hft.share_near(t, e, CELL, "qty", 4 * HOUR, 4)


@query("grid_coverage", f", k AS (SELECT venue, symbol, (ts - min(ts) OVER (PARTITION BY venue, symbol)) // {HOUR} AS k FROM tape) SELECT venue, symbol, max(k) + 1 AS points, count(DISTINCT k) AS filled FROM k GROUP BY ALL")
def grid_coverage(spark, sf):
    return vol.grid_coverage(market.tape(spark, sf), CELL, HOUR)


def _scale(step):
    return f"""SELECT a.venue, a.symbol, {step} AS step, (average - n_bar / n * al) / (1 - n_bar / n) AS v FROM (SELECT venue, symbol, count(r) AS n, sum(r * r) AS al FROM (SELECT *, x - lag(x) OVER (PARTITION BY venue, symbol ORDER BY k) AS r FROM lp) GROUP BY ALL) a
JOIN (SELECT venue, symbol, avg(rv) AS average, avg(n) AS n_bar FROM (SELECT venue, symbol, k % {step} AS o, count(r) AS n, sum(r * r) AS rv FROM (SELECT *, x - lag(x) OVER (PARTITION BY venue, symbol, k % {step} ORDER BY k) AS r FROM lp) GROUP BY ALL) GROUP BY ALL) b USING (venue, symbol)"""


@query("scale_scan", f"{LP}, s AS ({_scale(3)} UNION ALL {_scale(5)} UNION ALL {_scale(8)}), m AS (SELECT *, abs(v - median(v) OVER (PARTITION BY venue, symbol)) AS d FROM s) SELECT venue, symbol, step, {R('v * 1e3')} AS tsrv_adj, row_number() OVER (PARTITION BY venue, symbol ORDER BY d, step) = 1 AS nearest FROM m")
def scale_scan(spark, sf):
    s = vol.scale_scan(vol.log_prices(market.tape(spark, sf), CELL), CELL, [3, 5, 8])
    return s.select(*CELL, "step", r6(F.col("tsrv_adj") * 1e3).alias("tsrv_adj"), "nearest")


@query("storms_near_trades", f"""{STORM}, st AS (SELECT venue, symbol, bar * {8 * HOUR} AS ts FROM sz WHERE z >= 1.5)
SELECT venue, symbol, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM tape t WHERE t.venue = st.venue AND t.symbol = st.symbol AND t.ts BETWEEN st.ts - {HOUR} AND st.ts + {HOUR})) AS near FROM st GROUP BY ALL""")
def storms_near_trades(spark, sf):
    b = hft.storms(hft.storm_bars(market.tob(spark, sf), CELL, 8 * HOUR), CELL, 1.5, 0.0, 1e9, 0.0).withColumn("ts", F.col("bar") * 8 * HOUR)
    return hft.near_share(b, market.tape(spark, sf), CELL, HOUR)


@query("sign_scorecard", f""", o AS (SELECT CASE symbol % 2 WHEN 0 THEN 'large_abs_reduction' ELSE 'rel_tick_up' END AS regime, CASE venue WHEN 0 THEN 'liquid' ELSE 'less_liquid' END AS book, sign(sum(side * qty))::INT AS observed FROM tape GROUP BY venue, symbol),
x AS (SELECT observed, CASE WHEN regime = 'rel_tick_up' THEN -1 WHEN book = 'liquid' THEN 1 ELSE -1 END AS expected FROM o)
SELECT count(*) FILTER (WHERE observed <> 0 AND observed = expected) AS hits, count(*) FILTER (WHERE observed <> 0 AND observed <> expected) AS misses, count(*) FILTER (WHERE observed = 0) AS skips,
 count(*) FILTER (WHERE observed <> 0 AND observed = expected) / nullif(count(*) FILTER (WHERE observed <> 0), 0) AS hit_rate FROM x""")
def sign_scorecard(spark, sf):
    o = market.tape(spark, sf).groupBy(*CELL).agg(F.signum(F.sum(F.col("side") * F.col("qty"))).cast("int").alias("observed"))
    regime, kind = F.when(F.col("symbol") % 2 == 0, "large_abs_reduction").otherwise("rel_tick_up"), F.when(F.col("venue") == 0, "liquid").otherwise("less_liquid")
    return signs.scorecard(o.select(regime.alias("regime"), kind.alias("book"), F.lit("volume").alias("metric"), "observed"))
