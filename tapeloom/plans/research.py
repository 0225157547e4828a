"""Queries on panels, curves, event studies and regressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import corr_or_null, div, ordinal_rank, r6
from tapeloom.operators import flow, research, vol, xvenue
from tapeloom.operators.temporal import asof
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import HOUR
from tapeloom.plans.flow import BUCKETS, CAL, DAYS, W
from tapeloom.plans.vol import KF
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR


def r6s(df, *columns, keep=()):
    return df.select(*keep, *(r6(F.col(c)).alias(c) for c in columns))


@query("day_completeness", f""", d AS (SELECT venue, symbol, ts // {DAY} AS day, count(*) AS n, max(ts) - min(ts) AS span, count(DISTINCT ts // {HOUR}) / 24 AS cover FROM tape GROUP BY ALL)
SELECT venue, symbol, day, n, span, {R("cover")} AS cover, concat_ws(',', CASE WHEN n < 8 THEN 'few' END, CASE WHEN span < {12 * HOUR} THEN 'short' END, CASE WHEN cover < 0.25 THEN 'sparse' END) AS reasons FROM d""")
def day_completeness(spark, sf):
    d = research.completeness(market.tape(spark, sf), CELL, DAY, 8, 12 * HOUR, 0.25)
    return d.select(*CELL, "day", "n", "span", r6(F.col("cover")).alias("cover"), F.array_join("reasons", ",").alias("reasons"))


@query("volume_curve_by_hour", f""", h AS (SELECT symbol, ts // {HOUR} % 24 AS hour, count(*) AS n, sum(px * qty) AS value FROM tape GROUP BY ALL), e AS (SELECT symbol, unnest(range(24)) AS hour FROM (SELECT DISTINCT symbol FROM tape))
SELECT symbol, hour, coalesce(n, 0) AS n, {R("coalesce(value, 0) / sum(coalesce(value, 0)) OVER (PARTITION BY symbol)")} AS share FROM e LEFT JOIN h USING (symbol, hour)""")
def volume_curve_by_hour(spark, sf):
    c = research.hour_curve(market.tape(spark, sf), ["symbol"])
    return c.select("symbol", "hour", "n", r6(F.col("share")).alias("share"))


@query("session_effects", f""", s AS (SELECT *, CASE WHEN ts // {HOUR} % 24 < 8 THEN 'asia' WHEN ts // {HOUR} % 24 < 16 THEN 'eu' ELSE 'us' END AS session FROM tape)
SELECT symbol, session, count(*) AS n, {R("sum(px * qty) / sum(sum(px * qty)) OVER (PARTITION BY symbol)")} AS share FROM s GROUP BY symbol, session""")
def session_effects(spark, sf):
    hour = F.floor(F.col("ts") / HOUR) % 24
    s = market.tape(spark, sf).withColumn("session", F.when(hour < 8, "asia").when(hour < 16, "eu").otherwise("us")).groupBy("symbol", "session").agg(F.count("*").alias("n"), F.sum(F.col("px") * F.col("qty")).alias("v"))
    return s.select("symbol", "session", "n", r6(F.col("v") / F.sum("v").over(Window.partitionBy("symbol"))).alias("share"))


@query("spread_histogram", "SELECT venue, round((ask - bid) / 0.005)::BIGINT AS ticks, count(*) AS n FROM tob GROUP BY ALL")
def spread_histogram(spark, sf):
    ticks = F.round((F.col("ask") - F.col("bid")) / 0.005).cast("long").alias("ticks")
    return market.tob(spark, sf).groupBy("venue", ticks).agg(F.count("*").alias("n"))


SL = f""", s0 AS (SELECT *, (ts - min(ts) OVER (PARTITION BY venue, symbol)) // {12 * HOUR} AS sl FROM tape),
s1 AS (SELECT venue, symbol, sl, count(*) AS n, sum(qty) AS volume, sum(side * qty) AS net, sum(px * qty) / sum(qty) AS vwap, arg_min(px, seq) AS first, arg_max(px, seq) AS last FROM s0 GROUP BY ALL),
iw AS (SELECT a.*, abs(a.net) / a.volume AS rho, 1e4 * (a.last - a.first) / a.first * sign(a.net) AS during, 1e4 * (b.last - a.first) / a.first * sign(a.net) AS kept FROM s1 a JOIN s1 b ON a.venue = b.venue AND a.symbol = b.symbol AND b.sl = a.sl + 1 WHERE a.n >= 3)
"""


def _impact(spark, sf):
    return research.impact_windows(market.tape(spark, sf), CELL, 12 * HOUR, 3)


@query("impact_windows", f"{SL} SELECT venue, symbol, count(*) AS windows, {R('avg(rho)')} AS rho, {R('avg(during)')} AS during, {R('avg(kept)')} AS kept, {R('avg(during - kept)')} AS temporary FROM iw GROUP BY ALL")
def impact_windows(spark, sf):
    w = _impact(spark, sf)
    return w.groupBy(*CELL).agg(F.count("*").alias("windows"), *(r6(F.avg(c)).alias(c) for c in ("rho", "during", "kept", "temporary")))


@query("impact_by_participation", f"{SL} SELECT (rho >= 0.25)::INT + (rho >= 0.5)::INT + (rho >= 0.75)::INT AS bin, count(*) AS n, {R('avg(during)')} AS during, {R('regr_slope(ln(abs(during)), ln(rho)) FILTER (WHERE during <> 0 AND rho > 0.05)')} AS slope FROM iw GROUP BY bin")
def impact_by_participation(spark, sf):
    w = _impact(spark, sf).withColumn("bin", research.bins(F.col("rho"), [0.25, 0.5, 0.75]))
    ok = (F.col("during") != 0) & (F.col("rho") > 0.05)
    slope = F.regr_slope(F.when(ok, F.ln(F.abs("during"))), F.when(ok, F.ln("rho")))
    return w.groupBy("bin").agg(F.count("*").alias("n"), r6(F.avg("during")).alias("during"), r6(slope).alias("slope"))


@query("parent_orders", f"""{SL}, p AS (SELECT venue, symbol, sl AS start, first AS arrival FROM s1 WHERE sl % 4 = 0), r AS (SELECT p.*, unnest([0.05, 0.2]) AS rate FROM p)
SELECT rate::DOUBLE AS rate, count(*) AS parents, {R("avg(filled)")} AS filled, {R("avg(cost)")} AS cost_bps FROM (
 SELECT r.rate, sum(s.volume * r.rate) AS filled, 1e4 * (sum(s.volume * r.rate * s.vwap) / sum(s.volume * r.rate) - any_value(r.arrival)) / any_value(r.arrival) AS cost
 FROM r JOIN s1 s ON s.venue = r.venue AND s.symbol = r.symbol AND s.sl BETWEEN r.start AND r.start + 5 GROUP BY r.venue, r.symbol, r.start, r.rate) GROUP BY rate""")
def parent_orders(spark, sf):
    p = research.parent_orders(market.tape(spark, sf), CELL, 12 * HOUR, [0.05, 0.2], 6, 4)
    return p.groupBy("rate").agg(F.count("*").alias("parents"), r6(F.avg("filled")).alias("filled"), r6(F.avg("cost_bps")).alias("cost_bps"))


@query("event_lookback", f"""{KF}, lb AS (SELECT e.venue, e.symbol, e.run, (SELECT count(*) FROM tape t WHERE t.venue = e.venue AND t.symbol = e.symbol AND t.ts BETWEEN e.start_ts - {DAY} AND e.start_ts - 1) AS pre_n,
 (SELECT sum(px * qty) FROM tape t WHERE t.venue = e.venue AND t.symbol = e.symbol AND t.ts BETWEEN e.start_ts - {DAY} AND e.start_ts - 1) AS pre_value FROM ke e)
SELECT venue, count(*) AS events, sum(pre_n)::BIGINT AS pre_n, {R("avg(pre_value)")} AS pre_value FROM lb GROUP BY venue""", recursive=True)
def event_lookback(spark, sf):
    t = market.tape(spark, sf)
    e = vol.crash_events(vol.kalman(t, CELL, 1e-10, 1e-5), CELL, 2.0).select(*CELL, F.col("start_ts").alias("ts"), F.col("run").alias("seq"))
    b = research.lookback(e, t, CELL, DAY)
    return b.groupBy("venue").agg(F.count("*").alias("events"), F.sum("pre_n").alias("pre_n"), r6(F.avg("pre_value")).alias("pre_value"))


@query("gated_intensity", f"{KF}, c AS (SELECT venue, symbol, count(*) OVER (PARTITION BY venue, symbol ORDER BY start_ts RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS n FROM ke) SELECT venue, max(n) AS most, {R('avg(n)')} AS mean FROM c GROUP BY venue", recursive=True)
def gated_intensity(spark, sf):
    e = vol.crash_events(vol.kalman(market.tape(spark, sf), CELL, 1e-10, 1e-5), CELL, 2.0).withColumn("ts", F.col("start_ts"))
    return e.withColumn("n", research.recent_count(e, CELL, DAY)).groupBy("venue").agg(F.max("n").alias("most"), r6(F.avg("n")).alias("mean"))


@query("early_late_cohorts", f"{DAYS}, k AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY venue, symbol) AS m FROM dc) SELECT venue, symbol, CASE WHEN k < m // 2 THEN 'early' ELSE 'late' END AS cohort, count(*) AS days, {R('avg((buys - sells) / n)')} AS imbalance FROM k GROUP BY ALL")
def early_late_cohorts(spark, sf):
    d = flow.daily_counts(market.tape(spark, sf), CELL)
    w = Window.partitionBy(*CELL)
    k = F.row_number().over(w.orderBy("day")) - 1
    d = d.withColumn("cohort", F.when(k < F.floor(F.count("*").over(w) / 2), "early").otherwise("late"))
    return d.groupBy(*CELL, "cohort").agg(F.count("*").alias("days"), r6(F.avg("imbalance")).alias("imbalance"))


@query("resampled_tapes", f""", k AS (SELECT *, row_number() OVER {W} AS k, sum(px * qty) OVER (PARTITION BY venue, symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS v FROM tape)
SELECT venue, symbol, count(*) FILTER (WHERE k % 5 = 0) AS nth, {R("sum(px) FILTER (WHERE k % 5 = 0)")} AS nth_px, count(*) FILTER (WHERE floor(v / 2000) > floor((v - px * qty) / 2000)) AS by_value FROM k GROUP BY ALL""")
def resampled_tapes(spark, sf):
    t = market.tape(spark, sf)
    a = research.every_nth(t, CELL, 5).groupBy(*CELL).agg(F.count("*").alias("nth"), r6(F.sum("px")).alias("nth_px"))
    return a.join(research.value_bars(t, CELL, 2000.0).groupBy(*CELL).agg(F.count("*").alias("by_value")), CELL)


@query("extreme_bars", f""", k AS (SELECT *, (row_number() OVER {W} - 1) // 10 AS bar FROM tape), b AS (SELECT venue, symbol, bar, arg_min(px, seq) AS o, max(px) AS h, min(px) AS l, arg_max(px, seq) AS c FROM k GROUP BY ALL)
SELECT venue, symbol, count(*) * 3 AS n, {R("sum(o + c + CASE WHEN h - o >= o - l THEN h ELSE l END)")} AS total FROM b GROUP BY ALL""")
def extreme_bars(spark, sf):
    b = research.extreme_bars(market.tape(spark, sf), CELL, 10)
    return b.groupBy(*CELL).agg(F.count("*").alias("n"), r6(F.sum("px")).alias("total"))


@query("quintile_table", f""", e AS (SELECT venue, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e FROM panel GROUP BY venue)
SELECT p.venue, len(list_filter(e.e, lambda v: v <= p.x))::INT AS bin, count(*) AS n, {R("avg(y)")} AS mean FROM panel p JOIN e USING (venue) GROUP BY ALL""")
def quintile_table(spark, sf):
    q = research.quantile_table(market.panel(spark, sf), ["venue"], "x", "y", 5)
    return q.select("venue", "bin", "n", r6(F.col("mean")).alias("mean"))


@query("exante_vpin_markout", f"""{BUCKETS}, vr AS (SELECT *, end_ts + 1 AS after, CASE WHEN bucket >= 10 THEN avg(imbalance) OVER (PARTITION BY venue, symbol ORDER BY bucket ROWS 9 PRECEDING) END AS vpin FROM vb),
k AS (SELECT *, row_number() OVER {W} AS k, lead(px) OVER {W} AS nxt FROM tape), x AS (SELECT k.venue, k.symbol, v.vpin, abs(k.nxt - k.px) AS m FROM k ASOF JOIN vr v ON k.venue = v.venue AND k.symbol = v.symbol AND k.ts >= v.after WHERE k % 3 = 1)
SELECT venue, count(vpin) AS n, {R("corr(vpin, m)")} AS corr FROM x WHERE vpin IS NOT NULL AND m IS NOT NULL GROUP BY venue""", recursive=True)
def exante_vpin_markout(spark, sf):
    t = market.tape(spark, sf)
    b = flow.rolling_vpin(flow.volume_buckets(t, CELL, 20.0), CELL, 10).select(*CELL, F.col("end_ts").alias("ts"), F.col("bucket").alias("seq"), "vpin")
    w = Window.partitionBy(*CELL).orderBy("ts", "seq")
    k = t.withColumns({"k": F.row_number().over(w), "m": F.abs(F.lead("px").over(w) - F.col("px"))}).where("k % 3 = 1")
    x = asof(k, b, CELL, ["vpin"], strict=True).where("vpin IS NOT NULL AND m IS NOT NULL")
    return x.groupBy("venue").agg(F.count("vpin").alias("n"), r6(F.corr("vpin", "m")).alias("corr"))


@query("spearman_panel", f", k AS (SELECT venue, row_number() OVER (PARTITION BY venue ORDER BY x, seq) AS a, row_number() OVER (PARTITION BY venue ORDER BY y, seq) AS b FROM panel) SELECT venue, count(*) AS n, {R('corr(a, b)')} AS rho FROM k GROUP BY venue")
def spearman_panel(spark, sf):
    p = market.panel(spark, sf)
    k = p.select("venue", ordinal_rank("x", "seq", by=["venue"]).alias("a"), ordinal_rank("y", "seq", by=["venue"]).alias("b"))
    return k.groupBy("venue").agg(F.count("*").alias("n"), r6(F.corr("a", "b")).alias("rho"))


@query("moments", f"SELECT venue, count(y) AS n, {R('avg(y)')} AS mean, {R('stddev_samp(y)')} AS sd, {R('skewness(y)')} AS skew, {R('kurtosis(y)')} AS kurt FROM panel GROUP BY venue")
def moments(spark, sf):
    m = market.panel(spark, sf).groupBy("venue").agg(*(v.alias(k) for k, v in research.moments("y").items()))
    return r6s(m, "mean", "sd", "skew", "kurt", keep=("venue", "n"))


@query("partial_correlation", f", c AS (SELECT venue, corr(x, y) AS a, corr(x, month) AS b, corr(y, month) AS c FROM panel GROUP BY venue) SELECT venue, {R('(a - b * c) / sqrt((1 - b * b) * (1 - c * c))')} AS r FROM c")
def partial_correlation(spark, sf):
    return market.panel(spark, sf).groupBy("venue").agg(r6(research.partial_corr(F.col("x"), F.col("y"), F.col("month"))).alias("r"))


LL = f""", m AS (SELECT venue, symbol, day, (buys - sells) / n AS i, n FROM dc)
"""


@query("lead_lag_correlation", f"{DAYS}{LL}" + " UNION ALL ".join(f"SELECT symbol, {k} AS lag, count(y) AS n, {R('CASE WHEN count(y) >= 8 THEN corr(i, y) END')} AS corr FROM (SELECT symbol, i, {'lead' if k >= 0 else 'lag'}(n::DOUBLE, {abs(k)}) OVER (PARTITION BY symbol ORDER BY venue * 100000 + day) AS y FROM m) WHERE y IS NOT NULL GROUP BY symbol" for k in (-1, 0, 1)))
def lead_lag_correlation(spark, sf):
    d = flow.daily_counts(market.tape(spark, sf), CELL).withColumns({"at": F.col("venue") * 100000 + F.col("day"), "n": F.col("n").cast("double")})
    out = research.lead_lag(d, ["symbol"], "imbalance", "n", "at", [-1, 0, 1])
    return out.select("symbol", "lag", "n", r6(F.col("corr")).alias("corr"))


@query("event_study", f"""{DAYS}, s AS (SELECT venue, symbol, row_number() OVER (PARTITION BY venue, symbol ORDER BY day) AS bar, n FROM dc), e AS (SELECT venue, symbol, bar AS event FROM s WHERE n >= 10),
x AS (SELECT e.*, l.l AS lag, s.n FROM e, (SELECT unnest([-2, -1, 0, 1, 2]) AS l) l, s WHERE s.venue = e.venue AND s.symbol = e.symbol AND s.bar = e.event + l.l), f AS (SELECT *, count(*) OVER (PARTITION BY venue, symbol, event) AS c FROM x)
SELECT lag, count(*) AS n, {R("avg(n)")} AS mean FROM f WHERE c = 5 GROUP BY lag""")
def event_study(spark, sf):
    d = flow.daily_counts(market.tape(spark, sf), CELL)
    s = d.select(*CELL, F.row_number().over(Window.partitionBy(*CELL).orderBy("day")).alias("bar"), "n")
    return r6s(research.event_study(s, s.where("n >= 10"), CELL, "n", 2), "mean", keep=("lag", "n"))


@query("leave_one_out", f"""{DAYS}, m AS (SELECT symbol, day * 10 + venue AS id, (buys - sells) / n AS i, n FROM dc), x AS (SELECT a.symbol, a.id, corr(b.i, b.n) AS r FROM m a JOIN m b ON a.symbol = b.symbol AND a.id <> b.id GROUP BY ALL)
SELECT symbol, {R("min(r)")} AS low, {R("max(r)")} AS high FROM x GROUP BY symbol""")
def leave_one_out(spark, sf):
    d = flow.daily_counts(market.tape(spark, sf), CELL).withColumn("n", F.col("n").cast("double"))
    return r6s(research.leave_one_out(d, ["symbol"], "imbalance", "n"), "low", "high", keep=("symbol",))


@query("beta_shrinkage", f""", b AS (SELECT venue, symbol, count(*) FILTER (WHERE side > 0) AS hits, count(*) AS trials FROM tape GROUP BY ALL), m AS (SELECT avg(hits / trials) AS m, var_samp(hits / trials) AS v FROM b), k AS (SELECT m, greatest(0, m * (1 - m) / v - 1) AS k FROM m)
SELECT venue, symbol, {R("(hits + 1) / (trials + 2)")} AS posterior, {R("(hits + m * k) / (trials + k)")} AS shrunk FROM b, k""")
def beta_shrinkage(spark, sf):
    b = market.tape(spark, sf).groupBy(*CELL).agg(F.count(F.when(F.col("side") > 0, 1)).alias("hits"), F.count("*").alias("trials"))
    return r6s(research.beta_shrinkage(b, "hits", "trials"), "posterior", "shrunk", keep=CELL)


@query("hac_slope", f""", f AS (SELECT venue, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM panel GROUP BY venue),
g AS (SELECT p.venue, p.seq, (x - mx) * (y - a - b * x) AS g FROM panel p JOIN f USING (venue)), l AS (SELECT venue, g, lag(g, 1) OVER w AS g1, lag(g, 2) OVER w AS g2 FROM g WINDOW w AS (PARTITION BY venue ORDER BY seq)),
s AS (SELECT venue, sum(g * g) + 2 * (2 / 3) * coalesce(sum(g * g1), 0) + 2 * (1 / 3) * coalesce(sum(g * g2), 0) AS s FROM l GROUP BY venue) SELECT venue, n, {R("b")} AS slope, {R("sqrt(greatest(s, 0)) / sxx")} AS se FROM f JOIN s USING (venue)""")
def hac_slope(spark, sf):
    return r6s(research.hac_slope(market.panel(spark, sf), ["venue"], "y", "x", ["seq"], 2), "slope", "se", keep=("venue", "n"))


@query("next_day_prediction", f"""{DAYS}, p AS (SELECT a.venue, a.symbol, a.n AS x, b.n AS y FROM dc a JOIN dc b ON a.venue = b.venue AND a.symbol = b.symbol AND b.day = a.day + 1) SELECT venue, count(*) AS n, {R("corr(x, y)")} AS ic FROM p GROUP BY venue""")
def next_day_prediction(spark, sf):
    d = flow.daily_counts(market.tape(spark, sf), CELL).select(*CELL, "day", "n")
    nxt = d.select(*CELL, (F.col("day") - 1).alias("day"), F.col("n").alias("y"))
    return d.join(nxt, [*CELL, "day"]).groupBy("venue").agg(F.count("*").alias("n"), r6(F.corr("n", "y")).alias("ic"))


@query("minute_joint_bars", f""", q AS (SELECT venue, symbol, ts // {12 * HOUR} AS bar, count(*) AS quotes, median(ask - bid) AS spread FROM tob GROUP BY ALL), t AS (SELECT venue, symbol, ts // {12 * HOUR} AS bar, count(*) AS trades, sum(side * qty) AS net FROM tape GROUP BY ALL)
SELECT venue, count(*) AS bars, count(quotes) AS quoted, count(trades) AS traded, {R("corr(spread, net)")} AS corr FROM q FULL JOIN t USING (venue, symbol, bar) GROUP BY venue""")
def minute_joint_bars(spark, sf):
    bar = F.floor(F.col("ts") / (12 * HOUR)).alias("bar")
    q = market.tob(spark, sf).groupBy(*CELL, bar).agg(F.count("*").alias("quotes"), F.median(F.col("ask") - F.col("bid")).alias("spread"))
    t = market.tape(spark, sf).groupBy(*CELL, bar).agg(F.count("*").alias("trades"), F.sum(F.col("side") * F.col("qty")).alias("net"))
    pairs = F.count(F.when(F.col("spread").isNotNull() & F.col("net").isNotNull(), 1))
    out = q.join(t, [*CELL, "bar"], "full").groupBy("venue").agg(F.count("*").alias("bars"), F.count("quotes").alias("quoted"), F.count("trades").alias("traded"), pairs.alias("pairs"), corr_or_null(F.col("spread"), F.col("net"), 1).alias("corr"))
    # bars of one spread have no correlation, which is NaN as in SQL
    return out.select("venue", "bars", "quoted", "traded", F.when(F.col("pairs") > 0, F.coalesce(r6(F.col("corr")), F.lit(float("nan")))).alias("corr"))


@query("common_bar_betas", f"""{CAL}, d AS (SELECT symbol, venue, ts // {DAY} AS bar, sum(r) AS r FROM cr GROUP BY ALL), v AS (SELECT symbol, count(DISTINCT venue) AS venues FROM d GROUP BY symbol),
f AS (SELECT d.* FROM d JOIN v USING (symbol) WHERE (SELECT count(*) FROM d x WHERE x.symbol = d.symbol AND x.bar = d.bar) = venues),
m AS (SELECT *, avg(r) OVER (PARTITION BY symbol, bar) AS m FROM f WHERE r IS NOT NULL) SELECT symbol, venue, count(*) AS n, {R("regr_slope(r, m)")} AS beta, {R("regr_r2(r, m)")} AS r2 FROM m GROUP BY ALL""")
def common_bar_betas(spark, sf):
    r = flow.calendar_returns(market.tape(spark, sf), CELL, HOUR)
    d = r.groupBy("symbol", "venue", F.floor(F.col("ts") / DAY).alias("bar")).agg(F.sum("r").alias("r"))
    venues = d.groupBy("symbol").agg(F.countDistinct("venue").alias("venues"))
    w = Window.partitionBy("symbol", "bar")
    f = d.withColumn("c", F.count("*").over(w)).join(venues, "symbol").where("c = venues AND r IS NOT NULL").withColumn("m", F.avg("r").over(w))
    return f.groupBy("symbol", "venue").agg(F.count("*").alias("n"), r6(F.regr_slope("r", "m")).alias("beta"), r6(F.regr_r2("r", "m")).alias("r2"))


@query("funding_proxy", f"""{CAL}, a AS (SELECT venue, symbol, CASE WHEN row_number() OVER w >= 24 AND count(r) OVER (w ROWS 23 PRECEDING) >= 12 THEN avg(abs(r)) OVER (w ROWS 23 PRECEDING) END AS f FROM cr WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts))
SELECT venue, symbol, count(f) AS n, {R("avg(f) * 1e4")} AS funding FROM a GROUP BY ALL""")
def funding_proxy(spark, sf):
    w = Window.partitionBy(*CELL).orderBy("ts")
    own = w.rowsBetween(-23, 0)
    r = flow.calendar_returns(market.tape(spark, sf), CELL, HOUR)
    f = r.withColumn("f", F.when((F.row_number().over(w) >= 24) & (F.count("r").over(own) >= 12), F.avg(F.abs("r")).over(own)))
    return f.groupBy(*CELL).agg(F.count("f").alias("n"), r6(F.avg("f") * 1e4).alias("funding"))


@query("post_event_markout", f"""{KF}, kd AS (SELECT *, CASE WHEN first - low >= high - first THEN -1 ELSE 1 END AS direction FROM ke), a AS (SELECT e.direction, e.end_ts, t.px AS p0, e.venue, e.symbol, e.end_ts + {DAY} AS then_ts FROM kd e ASOF JOIN tape t ON t.venue = e.venue AND t.symbol = e.symbol AND e.end_ts >= t.ts)
SELECT a.venue, count(*) AS n, {R("avg(a.direction * 1e4 * (t.px - a.p0) / a.p0)")} AS mean_bps FROM a ASOF JOIN tape t ON t.venue = a.venue AND t.symbol = a.symbol AND a.then_ts >= t.ts WHERE t.ts > a.end_ts GROUP BY a.venue""", recursive=True)
def post_event_markout(spark, sf):
    t = market.tape(spark, sf)
    e = vol.crash_events(vol.kalman(t, CELL, 1e-10, 1e-5), CELL, 2.0).select(*CELL, F.col("end_ts").alias("ts"), F.col("run").alias("seq"), "direction")
    at = asof(e, t, CELL, ["px"]).withColumnsRenamed({"px": "p0", "ref_ts": "t0"}).withColumn("then", F.col("ts") + DAY)
    later = asof(at, t, CELL, ["px"], at="then").where(F.col("ref_ts") > F.col("ts"))
    return later.groupBy("venue").agg(F.count("*").alias("n"), r6(F.avg(F.col("direction") * 1e4 * div(F.col("px") - F.col("p0"), F.col("p0")))).alias("mean_bps"))


@query("autoregression")
def autoregression(spark, sf):
    """No SQL: a linear system for each cell; tests compare it with NumPy."""
    r = flow.with_returns(market.tape(spark, sf), CELL, "px")
    return research.autoregression(r, CELL, "r", 5, ["ts", "seq"])


@query("pin_maximum_likelihood")
def pin_maximum_likelihood(spark, sf):
    """No SQL: an optimiser; tests recover known parameters from simulated days."""
    return research.pin_fit(flow.daily_counts(market.tape(spark, sf), CELL), CELL)
