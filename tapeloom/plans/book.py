"""Queries on spreads, ticks, depth and book events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.stats import r6
from tapeloom.operators import book, flow
from tapeloom.operators.temporal import asof, before
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.sources import market
from tapeloom.sources.market import CELL

HOUR, MINUTE = 3_600_000_000, 60_000_000
EFF = "2e4 * t.side * (t.px - q.mid) / q.mid"
ASOF = "tape t ASOF LEFT JOIN tob q ON t.venue = q.venue AND t.symbol = q.symbol AND t.ts >= q.ts"


@query("asof_effective_spread", f"SELECT t.symbol, t.side, count(*) AS n, {R(f'avg({EFF})')} AS spread_bps FROM {ASOF} GROUP BY ALL")
def asof_effective_spread(spark, sf):
    rows = asof(market.tape(spark, sf), market.tob(spark, sf), CELL, ["mid"])
    spread = book.effective_spread_bps(F.col("px"), F.col("mid"), F.col("side"))
    return rows.groupBy("symbol", "side").agg(F.count("*").alias("n"), r6(F.avg(spread)).alias("spread_bps"))


@query("asof_strict_tolerance", f"""SELECT t.venue, count(*) AS n, count(q.mid) AS matched, {R("sum(q.mid)")} AS mids
FROM tape t ASOF LEFT JOIN (SELECT *, ts + 1 AS after FROM tob) q ON t.venue = q.venue AND t.symbol = q.symbol AND t.ts >= q.after
WHERE TRUE GROUP BY t.venue""".replace("count(q.mid) AS matched", "count(CASE WHEN t.ts - q.ts <= 7200000000 THEN 1 END) AS matched").replace("sum(q.mid)", "sum(CASE WHEN t.ts - q.ts <= 7200000000 THEN q.mid END)"))
def asof_strict_tolerance(spark, sf):
    rows = asof(market.tape(spark, sf), market.tob(spark, sf), CELL, ["mid"], strict=True, tolerance=2 * HOUR)
    return rows.groupBy("venue").agg(F.count("*").alias("n"), F.count("ref_ts").alias("matched"), r6(F.sum("mid")).alias("mids"))


@query("forward_next_quote", f"""SELECT t.venue, count(q.ts) AS n, {R("avg(q.ts - t.ts)")} AS wait, {R("sum(q.mid)")} AS mids
FROM tape t ASOF LEFT JOIN tob q ON t.venue = q.venue AND t.symbol = q.symbol AND t.ts < q.ts GROUP BY t.venue""")
def forward_next_quote(spark, sf):
    from tapeloom.operators.temporal import forward

    rows = forward(market.tape(spark, sf), market.tob(spark, sf), CELL, ["mid"])
    return rows.groupBy("venue").agg(F.count("next_ts").alias("n"), r6(F.avg(F.col("next_ts") - F.col("ts"))).alias("wait"), r6(F.sum("mid")).alias("mids"))


@query("nearest_quote", f""", b AS (SELECT t.venue, t.symbol, t.seq, t.ts, q.ts AS bt, q.mid AS bm FROM {ASOF}),
f AS (SELECT b.*, q.ts AS ft, q.mid AS fm FROM b ASOF LEFT JOIN tob q ON b.venue = q.venue AND b.symbol = q.symbol AND b.ts < q.ts),
p AS (SELECT venue, CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - ts <= ts - bt) THEN fm ELSE bm END AS mid FROM f)
SELECT venue, count(mid) AS n, {R("sum(mid)")} AS mids FROM p GROUP BY venue""")
def nearest_quote(spark, sf):
    from tapeloom.operators.temporal import nearest

    rows = nearest(market.tape(spark, sf), market.tob(spark, sf), CELL, ["mid"])
    return rows.groupBy("venue").agg(F.count("mid").alias("n"), r6(F.sum("mid")).alias("mids"))


@query("realized_spread", f"""SELECT t.symbol, count(q.mid) AS n, {R(f"avg({EFF})")} AS spread_bps
FROM (SELECT *, ts + {HOUR} AS then_ts FROM tape) t ASOF LEFT JOIN tob q ON t.venue = q.venue AND t.symbol = q.symbol AND t.then_ts >= q.ts GROUP BY t.symbol""")
def realized_spread(spark, sf):
    rows = asof(market.tape(spark, sf).withColumn("then", F.col("ts") + HOUR), market.tob(spark, sf), CELL, ["mid"], at="then")
    spread = book.realized_spread_bps(F.col("px"), F.col("mid"), F.col("side"))
    return rows.groupBy("symbol").agg(F.count("mid").alias("n"), r6(F.avg(spread)).alias("spread_bps"))


HORIZONS = [HOUR // 4, HOUR, 4 * HOUR]
MARK = f""", m0 AS (SELECT t.venue, t.symbol, t.ts, t.seq, t.side, t.qty, t.px, q.mid AS mid0, q.ts AS t0 FROM {ASOF}),
mh AS (SELECT *, unnest([{HORIZONS[0]}, {HORIZONS[1]}, {HORIZONS[2]}]) AS horizon FROM m0 WHERE t0 IS NOT NULL),
mk AS (SELECT t.*, t.side * 1e4 * (q.mid - t.mid0) / t.mid0 AS markout FROM (SELECT *, ts + horizon AS then_ts FROM mh) t
       ASOF JOIN tob q ON t.venue = q.venue AND t.symbol = q.symbol AND t.then_ts >= q.ts WHERE q.ts > t.t0)
"""


@query("markout_by_horizon", f"{MARK} SELECT horizon, count(*) AS n, {R('avg(markout)')} AS mean_bps, {R('median(markout)')} AS median_bps FROM mk GROUP BY horizon")
def markout_by_horizon(spark, sf):
    rows = flow.markouts(market.tape(spark, sf), market.tob(spark, sf), CELL, HORIZONS)
    return rows.groupBy("horizon").agg(F.count("*").alias("n"), r6(F.avg("markout")).alias("mean_bps"), r6(F.median("markout")).alias("median_bps"))


@query("adverse_by_side_and_size", f"""{MARK}, o AS (SELECT *, qty * px AS notional FROM mk WHERE horizon = {HOUR}),
e AS (SELECT quantile_cont(notional, [0.25, 0.5, 0.75]) AS e FROM o),
b AS (SELECT markout, side, CASE WHEN notional < e[1] THEN 0 WHEN notional < e[2] THEN 1 WHEN notional < e[3] THEN 2 ELSE 3 END AS size_bin FROM o, e)
SELECT side, size_bin, count(*) AS n, {R("avg(markout)")} AS mean_bps FROM b GROUP BY GROUPING SETS ((side), (size_bin)) HAVING count(*) >= 8""")
def adverse_by_side_and_size(spark, sf):
    rows = flow.markouts(market.tape(spark, sf), market.tob(spark, sf), CELL, [HOUR])
    return flow.adverse_selection(rows).select("side", "size_bin", "n", r6(F.col("mean_bps")).alias("mean_bps"))


@query("quoted_spread_stats", f"""SELECT venue, symbol, count(*) AS n, {R("avg(1e4 * (ask - bid) / ((ask + bid) / 2))")} AS mean_bps, {R("median(ask - bid)")} AS median_abs,
{R("avg((bid_sz - ask_sz) / (bid_sz + ask_sz))")} AS imbalance FROM tob GROUP BY ALL""")
def quoted_spread_stats(spark, sf):
    return market.tob(spark, sf).groupBy(*CELL).agg(F.count("*").alias("n"), r6(F.avg(book.quoted_spread_bps(F.col("bid"), F.col("ask")))).alias("mean_bps"), r6(F.median(F.col("ask") - F.col("bid"))).alias("median_abs"), r6(F.avg(book.depth_imbalance(F.col("bid_sz"), F.col("ask_sz")))).alias("imbalance"))


@query("tick_inference", f""", d AS (SELECT DISTINCT venue, symbol, round(px, 10) AS p FROM tape),
g AS (SELECT venue, symbol, p - lag(p) OVER (PARTITION BY venue, symbol ORDER BY p) AS gap FROM d),
i AS (SELECT venue, symbol, min(gap) FILTER (WHERE gap > 1e-12) AS tick FROM g GROUP BY ALL),
p AS (SELECT venue, symbol, abs(px - lag(px) OVER (PARTITION BY venue, symbol ORDER BY ts, seq)) AS move FROM tape),
m AS (SELECT venue, symbol, coalesce(median(move) FILTER (WHERE move > 0), 1e-8) AS path_tick FROM p GROUP BY ALL)
SELECT venue, symbol, {R("tick")} AS tick, {R("path_tick")} AS path_tick FROM i JOIN m USING (venue, symbol)""")
def tick_inference(spark, sf):
    t = market.tape(spark, sf)
    path = book.median_tick(t, CELL, "px").withColumnRenamed("tick", "path_tick")
    return book.infer_tick(t, CELL, "px").join(path, CELL).select(*CELL, r6(F.col("tick")).alias("tick"), r6(F.col("path_tick")).alias("path_tick"))


@query("roll_spread", f""", r AS (SELECT venue, symbol, ts, seq, ln(px / lag(px) OVER w) AS r FROM tape WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts, seq)),
l AS (SELECT *, lag(r) OVER (PARTITION BY venue, symbol ORDER BY ts, seq) AS l FROM r),
g AS (SELECT venue, symbol, var_pop(r) AS g0, covar_samp(r, l) AS g1 FROM l GROUP BY ALL)
SELECT venue, symbol, {R("g0 * 1e4")} AS g0, {R("g1 * 1e4")} AS g1, {R("CASE WHEN g1 < 0 THEN 2 * sqrt(-g1) END")} AS spread FROM g""")
def roll_spread(spark, sf):
    t = flow.with_returns(market.tape(spark, sf), CELL, "px").withColumn("l", before("r", CELL))
    g = t.groupBy(*CELL).agg(*(v.alias(k) for k, v in book.roll(F.col("r"), F.col("l")).items()))
    return g.select(*CELL, r6(F.col("g0") * 1e4).alias("g0"), r6(F.col("g1") * 1e4).alias("g1"), r6(F.col("spread")).alias("spread"))


MQ = """, mq AS (SELECT venue, symbol, median(ask - bid) AS spread, median(1e4 * (ask - bid) / ((ask + bid) / 2)) AS spread_bps, median(mid) AS mid,
median((ask - bid) / 0.005) AS spread_ticks, median(bid_sz + ask_sz) AS depth FROM tob GROUP BY ALL),
mt AS (SELECT venue, symbol, sum(qty) AS volume, sum(qty * px) AS notional FROM tape GROUP BY ALL)
"""


@query("market_quality_vector", f"""{MQ} SELECT venue, symbol, {R("spread")} AS spread, {R("spread_bps")} AS spread_bps, {R("mid")} AS mid, {R("spread_ticks")} AS spread_ticks, depth, volume, {R("notional")} AS notional
FROM mq LEFT JOIN mt USING (venue, symbol)""")
def market_quality_vector(spark, sf):
    q = book.market_quality(market.tob(spark, sf), market.tape(spark, sf), CELL, 0.005)
    return q.select(*CELL, *(r6(F.col(c)).alias(c) for c in ("spread", "spread_bps", "mid", "spread_ticks")), "depth", "volume", r6(F.col("notional")).alias("notional"))


@query("liquid_book_terciles", f"""{MQ} SELECT venue, symbol, floor((row_number() OVER (ORDER BY spread_bps, venue * 10 + symbol) - 1) * 3 / count(*) OVER ())::INT AS tercile FROM mq""".replace(" - 1) * 3 /", " - 1) * 3.0 /"))
def liquid_book_terciles(spark, sf):
    q = book.market_quality(market.tob(spark, sf), market.tape(spark, sf), CELL, 0.005).withColumn("id", F.col("venue") * 10 + F.col("symbol"))
    return q.withColumn("tercile", book.terciles(q, "spread_bps", "id")).select(*CELL, "tercile")


@query("undercutting_share", f""", u AS (SELECT venue, symbol, (bid - lag(bid) OVER w) / 0.005 AS up, (lag(ask) OVER w - ask) / 0.005 AS down FROM tob WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts, seq)),
s AS (SELECT *, CASE WHEN up > 0.5 THEN up WHEN down > 0.5 THEN down END AS size FROM u WHERE up IS NOT NULL)
SELECT venue, symbol, count(*) AS n, {R("avg((size IS NOT NULL)::INT)")} AS improve, {R("avg(coalesce(size <= 200, false)::INT)")} AS undercut FROM s GROUP BY ALL""")
def undercutting_share(spark, sf):
    u = book.undercutting(market.tob(spark, sf), CELL, 0.005, 200)
    return u.select(*CELL, "n", r6(F.col("improve")).alias("improve"), r6(F.col("undercut")).alias("undercut"))


@query("grid_pressure", f""", g AS (SELECT venue, symbol, 0.01 / mid - 0.01 / first_value(mid) OVER (PARTITION BY venue, symbol ORDER BY ts, seq) AS p FROM tob)
SELECT venue, symbol, {R("avg(p) * 1e6")} AS mean, {R("stddev_pop(p) * 1e6")} AS sd, {R("(max(p) - min(p)) * 1e6")} AS span FROM g GROUP BY ALL""")
def grid_pressure(spark, sf):
    from pyspark.sql import Window

    first = F.first("mid").over(Window.partitionBy(*CELL).orderBy("ts", "seq"))
    p = market.tob(spark, sf).withColumn("p", 0.01 / F.col("mid") - 0.01 / first)
    return p.groupBy(*CELL).agg(r6(F.avg("p") * 1e6).alias("mean"), r6(F.stddev_pop("p") * 1e6).alias("sd"), r6((F.max("p") - F.min("p")) * 1e6).alias("span"))


@query("cross_venue_tick_gap", f""", m AS (SELECT venue, symbol, median(ask - bid) AS tau FROM tob GROUP BY ALL)
SELECT a.symbol, a.venue AS venue_a, b.venue AS venue_b, {R("a.tau - b.tau")} AS gap, {R("abs(a.tau - b.tau)")} AS abs_gap, {R("a.tau / b.tau")} AS ratio
FROM m a JOIN m b ON a.symbol = b.symbol AND a.venue < b.venue""")
def cross_venue_tick_gap(spark, sf):
    m = market.tob(spark, sf).groupBy(*CELL).agg(F.median(F.col("ask") - F.col("bid")).alias("tau"))
    a, b = m.withColumnsRenamed({"venue": "venue_a", "tau": "a"}), m.withColumnsRenamed({"venue": "venue_b", "tau": "b"})
    return a.join(b, "symbol").where("venue_a < venue_b").select("symbol", "venue_a", "venue_b", r6(F.col("a") - F.col("b")).alias("gap"), r6(F.abs(F.col("a") - F.col("b"))).alias("abs_gap"), r6(F.col("a") / F.col("b")).alias("ratio"))


@query("fama_macbeth_slope", f""", s AS (SELECT month, regr_slope(y, x) AS slope FROM panel GROUP BY month HAVING count(*) >= 3 AND var_pop(x) > 0)
SELECT count(*) AS groups, {R("avg(slope)")} AS mean, {R("stddev_samp(slope) / sqrt(count(*))")} AS se, {R("avg(slope) / (stddev_samp(slope) / sqrt(count(*)))")} AS t FROM s""")
def fama_macbeth_slope(spark, sf):
    out = book.fama_macbeth(market.panel(spark, sf), ["month"], "y", "x")
    return out.select("groups", *(r6(F.col(c)).alias(c) for c in ("mean", "se", "t")))


@query("panel_hour_medians", f"SELECT venue, ts // {HOUR} AS hour, count(*) AS n, {R('median(ask - bid)')} AS spread, {R('median(mid)')} AS mid FROM tob GROUP BY ALL")
def panel_hour_medians(spark, sf):
    hour = F.floor(F.col("ts") / HOUR).alias("hour")
    return market.tob(spark, sf).groupBy("venue", hour).agg(F.count("*").alias("n"), r6(F.median(F.col("ask") - F.col("bid"))).alias("spread"), r6(F.median("mid")).alias("mid"))


@query("constraint_flips", f""", c AS (SELECT *, (ask - bid) / 0.005 <= 2.5 AS c FROM tob),
w AS (SELECT *, lag(c) OVER o AS was, avg(bid_sz) OVER (o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pre, avg(bid_sz) OVER (o ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS post
      FROM c WINDOW o AS (PARTITION BY venue, symbol ORDER BY ts, seq))
SELECT venue, symbol, CASE WHEN was THEN 'relax' ELSE 'tighten' END AS kind, count(*) AS n, {R("avg(pre)")} AS pre, {R("avg(post)")} AS post FROM w WHERE was <> c GROUP BY ALL""")
def constraint_flips(spark, sf):
    c = (F.col("ask") - F.col("bid")) / 0.005 <= 2.5
    return book.constraint_flips(market.tob(spark, sf), CELL, c, "bid_sz").select(*CELL, "kind", "n", r6(F.col("pre")).alias("pre"), r6(F.col("post")).alias("post"))


@query("tercile_interaction", f""", t AS (SELECT liq, y, floor((row_number() OVER (ORDER BY x, seq) - 1) * 3.0 / count(*) OVER ())::INT AS x_tercile FROM panel)
SELECT liq, x_tercile, count(*) AS n, {R("avg(y)")} AS mean_y FROM t GROUP BY ALL""")
def tercile_interaction(spark, sf):
    p = market.panel(spark, sf)
    edges = p.select("x", "seq")
    ranked = flow.global_terciles(p, "x", "seq")
    return ranked.groupBy("liq", "x_tercile").agg(F.count("*").alias("n"), r6(F.avg("y")).alias("mean_y"))


EV = """, ev AS (SELECT * FROM (SELECT *, coalesce(CASE WHEN bid > pb + 1e-12 THEN 1 WHEN bid < pb - 1e-12 THEN -1 END, CASE WHEN ps > 0 THEN CASE WHEN (bid_sz - ps) / ps >= 0.05 THEN 3 WHEN (bid_sz - ps) / ps <= -0.05 THEN -3 END END,
  CASE WHEN ask < pa - 1e-12 THEN 2 WHEN ask > pa + 1e-12 THEN -2 END, CASE WHEN pz > 0 THEN CASE WHEN (ask_sz - pz) / pz >= 0.05 THEN 4 WHEN (ask_sz - pz) / pz <= -0.05 THEN -4 END END) AS code FROM (
  SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bid_sz) OVER w AS ps, lag(ask_sz) OVER w AS pz FROM tob WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts, seq))) WHERE code IS NOT NULL)
"""


@query("lob_event_codes", f"{EV} SELECT venue, code, count(*) AS n FROM ev GROUP BY ALL")
def lob_event_codes(spark, sf):
    return book.book_events(market.tob(spark, sf), CELL).groupBy("venue", "code").agg(F.count("*").alias("n"))


@query("lob_event_acf", f"{EV}, el AS (SELECT venue, symbol, code, lag(code) OVER (PARTITION BY venue, symbol ORDER BY ts, seq) AS l FROM ev) SELECT venue, symbol, {R('corr(code, l)')} AS acf FROM el GROUP BY ALL")
def lob_event_acf(spark, sf):
    e = book.book_events(market.tob(spark, sf), CELL).withColumn("l", before("code", CELL))
    return e.groupBy(*CELL).agg(r6(F.corr("code", "l")).alias("acf"))


@query("tob_resilience", f""", e0 AS (SELECT t.venue, t.symbol, t.ts, t.seq, q.ts AS t0, q.mid AS mid0, q.bid_sz + q.ask_sz AS depth0 FROM {ASOF}),
eh AS (SELECT *, unnest([{HOUR}, {4 * HOUR}]) AS horizon FROM e0),
el AS (SELECT e.*, q.ts AS t1, q.mid AS mid1, q.bid_sz + q.ask_sz AS depth1 FROM (SELECT *, ts + horizon AS then_ts FROM eh) e ASOF JOIN tob q ON e.venue = q.venue AND e.symbol = q.symbol AND e.then_ts >= q.ts)
SELECT horizon, count(*) AS n, {R("avg(depth1 / depth0)")} AS depth_ratio, {R("avg(1e4 * abs(mid1 - mid0) / mid0)")} AS move_bps FROM el WHERE t1 > t0 AND t1 > ts GROUP BY horizon""")
def tob_resilience(spark, sf):
    out = book.resilience(market.tob(spark, sf), market.tape(spark, sf), CELL, [HOUR, 4 * HOUR])
    return out.select("horizon", "n", r6(F.col("depth_ratio")).alias("depth_ratio"), r6(F.col("move_bps")).alias("move_bps"))


@query("improve_adverse_markout", f""", i AS (SELECT * FROM (SELECT *, CASE WHEN bid > lag(bid) OVER w THEN 1.0 WHEN ask < lag(ask) OVER w THEN -1.0 END AS dir, ts + {HOUR} AS then_ts FROM tob WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts, seq)) WHERE dir IS NOT NULL)
SELECT i.venue, i.symbol, count(*) AS n, {R("avg(-i.dir * 1e4 * (q.mid - i.mid) / i.mid)")} AS adverse_bps FROM i ASOF JOIN tob q ON i.venue = q.venue AND i.symbol = q.symbol AND i.then_ts >= q.ts WHERE q.ts > i.ts GROUP BY ALL""")
def improve_adverse_markout(spark, sf):
    out = book.improve_markout(market.tob(spark, sf), CELL, HOUR)
    return out.select(*CELL, "n", r6(F.col("adverse_bps")).alias("adverse_bps"))


@query("depletion_cancel_proxy", f""", b AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bid_sz) OVER w AS ps, lag(ask_sz) OVER w AS pz FROM tob WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts, seq)),
d AS (SELECT venue, symbol, ts, seq, 'bid' AS book_side, -1.0 AS against, ps - bid_sz AS lost FROM b WHERE abs(bid - pb) < 0.5 AND ps > bid_sz AND ps - bid_sz >= 0.2 * ps
  UNION ALL SELECT venue, symbol, ts, seq, 'ask', 1.0, pz - ask_sz FROM b WHERE abs(ask - pa) < 0.5 AND pz > ask_sz AND pz - ask_sz >= 0.2 * pz),
f AS (SELECT d.*, coalesce((SELECT sum(qty) FROM tape t WHERE t.venue = d.venue AND t.symbol = d.symbol AND t.side = d.against AND t.ts BETWEEN d.ts - {HOUR} AND d.ts + {HOUR}), 0) AS filled FROM d),
k AS (SELECT book_side, lost, CASE WHEN filled = 0 THEN 'cancel' WHEN filled >= 0.5 * lost THEN 'fill' ELSE 'mixed' END AS kind FROM f)
SELECT book_side, kind, count(*) AS n, sum(lost) AS lost FROM k GROUP BY GROUPING SETS ((book_side, kind), ())""")
def depletion_cancel_proxy(spark, sf):
    coarse = market.tob(spark, sf)
    return book.cancel_proxy(coarse, market.tape(spark, sf), CELL, 0.2, HOUR, same=0.5)


@query("time_to_touch", f""", s AS (SELECT venue, symbol, ts, bid, row_number() OVER (PARTITION BY venue, symbol ORDER BY ts, seq) - 1 AS k FROM tob),
o AS (SELECT *, unnest([0.0, 50.0, 100.0]) AS off FROM s WHERE k % 5 = 0),
w AS (SELECT o.*, (SELECT min(q.ts) FROM tob q WHERE q.venue = o.venue AND q.symbol = o.symbol AND q.ts > o.ts AND q.ts <= o.ts + {8 * HOUR} AND q.ask <= o.bid - o.off * 0.005) - o.ts AS wait FROM o)
SELECT off::DOUBLE AS "offset", count(*) AS n, count(wait) AS touched, median(wait) AS wait FROM w GROUP BY off""")
def time_to_touch(spark, sf):
    return book.time_to_touch(market.tob(spark, sf), CELL, [0.0, 50.0, 100.0], 0.005, 8 * HOUR, 5)


@query("time_to_touch_sells", f""", s AS (SELECT venue, symbol, ts, ask, row_number() OVER (PARTITION BY venue, symbol ORDER BY ts, seq) - 1 AS k FROM tob),
o AS (SELECT *, unnest([0.0, 50.0, 100.0]) AS off FROM s WHERE k % 5 = 0),
w AS (SELECT o.*, (SELECT min(q.ts) FROM tob q WHERE q.venue = o.venue AND q.symbol = o.symbol AND q.ts > o.ts AND q.ts <= o.ts + {8 * HOUR} AND q.bid >= o.ask + o.off * 0.005) - o.ts AS wait FROM o)
SELECT off::DOUBLE AS "offset", count(*) AS n, count(wait) AS touched, median(wait) AS wait FROM w GROUP BY off""")
def time_to_touch_sells(spark, sf):
    return book.time_to_touch(market.tob(spark, sf), CELL, [0.0, 50.0, 100.0], 0.005, 8 * HOUR, 5, sells=True)


@query("lob_event_shares", f"{EV} SELECT venue, symbol, count(*) AS n, count(*) FILTER (WHERE code IN (1, 2)) AS improved, count(*) FILTER (WHERE code IN (-1, -2)) AS worsened, {R('count(*) FILTER (WHERE code IN (1, 2)) / count(*)')} AS improve_share FROM ev GROUP BY ALL")
def lob_event_shares(spark, sf):
    e = book.event_shares(book.book_events(market.tob(spark, sf), CELL), CELL)
    return e.select(*CELL, "n", "improved", "worsened", r6(F.col("improve_share")).alias("improve_share"))


@query("lob_event_intensity", f"""{EV}, eb AS (SELECT venue, symbol, min(ts) AS lo, unnest(range(((max(ts) - min(ts)) // {12 * HOUR})::BIGINT)) AS bar FROM ev GROUP BY venue, symbol), ec AS (SELECT e.venue, e.symbol, (e.ts - x.lo) // {12 * HOUR} AS bar, count(*) AS n FROM ev e JOIN (SELECT venue, symbol, min(ts) AS lo FROM ev GROUP BY ALL) x USING (venue, symbol) GROUP BY ALL),
ef AS (SELECT b.venue, b.symbol, b.bar, coalesce(n, 0)::DOUBLE AS n FROM eb b LEFT JOIN ec USING (venue, symbol, bar)), eg AS (SELECT *, lag(n) OVER (PARTITION BY venue, symbol ORDER BY bar) AS l FROM ef)
SELECT venue, symbol, count(*) AS bars, {R(f"avg(n) / {12 * 3600.0} * 1e3")} AS rate, {R("corr(n, l)")} AS acf1 FROM eg GROUP BY ALL""")
def lob_event_intensity(spark, sf):
    i = flow.intensity(book.book_events(market.tob(spark, sf), CELL), CELL, 12 * HOUR)
    return i.select(*CELL, "bars", r6(F.col("rate") * 1e3).alias("rate"), r6(F.col("acf1")).alias("acf1"))


@query("l2_depth_moments", f"SELECT side, level, count(*) AS n, {R('avg(qty)')} AS mean FROM l2 WHERE level < 5 GROUP BY ALL")
def l2_depth_moments(spark, sf):
    out = book.depth_moments(market.l2(spark, sf))
    return out.select("side", "level", "n", r6(F.col("mean")).alias("mean"))


@query("qty_moment_ceiling", f""", e AS (SELECT quantile_cont(qty, 0.9) AS a, quantile_cont(qty, 0.95) AS b, quantile_cont(qty, 0.99) AS c FROM l2)
SELECT {R("avg(qty)")} AS m1_0, {R("pow(avg(pow(qty, 2)), 1 / 2.0)")} AS m2_0, {R("pow(avg(pow(qty, 4)), 1 / 4.0)")} AS m4_0,
{R("var_pop(qty) FILTER (WHERE qty <= b) / var_pop(qty) FILTER (WHERE qty <= a)")} AS v1, {R("var_pop(qty) FILTER (WHERE qty <= c) / var_pop(qty) FILTER (WHERE qty <= a)")} AS v2 FROM l2, e""")
def qty_moment_ceiling(spark, sf):
    out = book.quantity_moments(market.l2(spark, sf), "qty", [1.0, 2.0, 4.0], [0.95, 0.99])
    return out.select(*(r6(F.col(c)).alias(c) for c in out.columns))


@query("nbbo_crossed", f""", q AS (SELECT symbol, venue, ts // {HOUR} * {HOUR} AS bar, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask FROM tob GROUP BY ALL),
n AS (SELECT symbol, bar, max(bid) AS bid, min(ask) AS ask, count(*) AS venues FROM q GROUP BY ALL)
SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE bid > ask) AS crossed, {R("avg(venues)")} AS venues FROM n GROUP BY symbol""")
def nbbo_crossed(spark, sf):
    bars = book.crossed(market.tob(spark, sf), "symbol", HOUR)
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.count(F.when(F.col("crossed"), 1)).alias("crossed"), r6(F.avg("venues")).alias("venues"))
