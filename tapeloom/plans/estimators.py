"""Queries on further estimators of tapes and books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import names
from tapeloom.functions.stats import r6
from tapeloom.operators import estimators as est
from tapeloom.operators import options, vol
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import HOUR
from tapeloom.plans.flow import W
from tapeloom.plans.inference import uniform
from tapeloom.plans.patterns import DDOI, _chain
from tapeloom.plans.vol import BAR, KF, LP, _filtered, _points
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR


def r6s(rows, *columns, keep=()):
    return rows.select(*keep, *(r6(F.col(c)).alias(c) for c in columns))


@query("bucket_sizes", f""", m AS (SELECT venue, symbol, greatest(median(qty) * 50.0, 1e-8) AS m, sum(qty) / 20.0 AS t FROM tape WHERE qty > 0 GROUP BY ALL)
SELECT venue, symbol, {R('m')} AS by_median, 'median_x_scale' AS method, {R('t')} AS by_total, 'target_buckets' AS target_method FROM m""")
def bucket_sizes(spark, sf):
    t = market.tape(spark, sf)
    one = est.bucket_volume(t, CELL).select(*CELL, r6(F.col("bucket_volume")).alias("by_median"), "method")
    return one.join(est.bucket_volume(t, CELL, buckets=20).select(*CELL, r6(F.col("bucket_volume")).alias("by_total"), F.col("method").alias("target_method")), CELL)


@query("vpin_day_features", f""", v0 AS (SELECT venue, symbol, ts // {DAY} AS day, ts, seq, side, qty, greatest(median(qty) OVER (PARTITION BY venue, symbol, ts // {DAY}) * 3.0, 1e-8) AS bv, row_number() OVER (PARTITION BY venue, symbol, ts // {DAY} ORDER BY ts, seq) AS k FROM tape),
v(venue, symbol, day, k, p, n, bucket, imb) AS (SELECT venue, symbol, day, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0, NULL::DOUBLE FROM v0 WHERE k = 1 UNION ALL
 SELECT a.venue, a.symbol, a.day, b.k, CASE WHEN a.p + a.n + b.qty >= b.bv THEN 0.0 ELSE a.p + CASE WHEN b.side < 0 THEN 0 ELSE b.qty END END, CASE WHEN a.p + a.n + b.qty >= b.bv THEN 0.0 ELSE a.n + CASE WHEN b.side < 0 THEN b.qty ELSE 0 END END,
  CASE WHEN a.p + a.n + b.qty >= b.bv THEN a.bucket + 1 ELSE a.bucket END, CASE WHEN a.p + a.n + b.qty >= b.bv THEN abs(a.p - a.n + CASE WHEN b.side < 0 THEN -b.qty ELSE b.qty END) / (a.p + a.n + b.qty) END
 FROM v a JOIN v0 b ON a.venue = b.venue AND a.symbol = b.symbol AND a.day = b.day AND b.k = a.k + 1),
c AS (SELECT *, row_number() OVER w AS i, avg(imb) OVER (w ROWS 1 PRECEDING) AS roll FROM v WHERE imb IS NOT NULL WINDOW w AS (PARTITION BY venue, symbol, day ORDER BY bucket)),
s AS (SELECT venue, symbol, day, any_value(bv) AS bv FROM v0 GROUP BY ALL), f AS (SELECT venue, symbol, day, count(*) AS buckets, avg(imb) AS mean_imbalance, count(*) FILTER (WHERE i >= 2) AS path, arg_max(CASE WHEN i >= 2 THEN roll END, bucket) FILTER (WHERE i >= 2) AS last_vpin FROM c GROUP BY ALL)
SELECT venue, symbol, day, {R('bv')} AS bucket_volume, coalesce(buckets, 0) AS buckets, {R('mean_imbalance')} AS mean_imbalance, coalesce(path, 0) AS path, {R('last_vpin')} AS last_vpin FROM s LEFT JOIN f USING (venue, symbol, day)""", recursive=True)
def vpin_day_features(spark, sf):
    v = est.vpin_days(market.tape(spark, sf), CELL, DAY, 3.0, 2)
    return v.select(*CELL, "day", r6(F.col("bucket_volume")).alias("bucket_volume"), "buckets", r6(F.col("mean_imbalance")).alias("mean_imbalance"), "path", r6(F.col("last_vpin")).alias("last_vpin"))


QUARTIC = f"""{LP}, rr AS (SELECT venue, symbol, k, x, x - lag(x) OVER (PARTITION BY venue, symbol ORDER BY k) AS r FROM lp), q AS (SELECT venue, symbol, count(r) AS n, sum(r * r) / (2 * count(r)) AS noise, count(r) / 3.0 * sum(r * r * r * r) AS iq FROM rr GROUP BY ALL),
o AS (SELECT venue, symbol, n, pow(1.0 / (4 * noise * noise) * iq, 1 / 3) AS best FROM q)"""


@query("best_sparse_returns", f"""{QUARTIC}, s AS (SELECT lp.*, greatest(1, floor(n / greatest(floor(best), 1)))::INT AS step FROM lp JOIN o USING (venue, symbol)), d AS (SELECT venue, symbol, step, x - lag(x) OVER (PARTITION BY venue, symbol ORDER BY k) AS r FROM s WHERE k % step = 0)
SELECT venue, symbol, any_value(best_r) AS best, d.step, count(r) AS n, {R('sum(r * r) * 1e3')} AS rv FROM d JOIN (SELECT venue, symbol, {R('best')} AS best_r FROM o) USING (venue, symbol) GROUP BY venue, symbol, d.step""")
def best_sparse_returns(spark, sf):
    p = _points(spark, sf)
    r = F.col("x") - F.lag("x").over(Window.partitionBy(*CELL).orderBy("k"))
    q = p.withColumn("r", r).groupBy(*CELL).agg((F.sum(F.col("r") * F.col("r")) / (2 * F.count("r"))).alias("noise"), (F.count("r") / 3.0 * F.sum(F.pow("r", F.lit(4)))).alias("iq"))
    o = q.select(*CELL, est.optimal_returns(F.lit(1.0), F.col("noise"), F.col("iq")).alias("best"))
    s = est.sparse_points(p.join(o, CELL), [*CELL, "best"], F.col("best"))
    return s.select(*CELL, r6(F.col("best")).alias("best"), "step", "n", r6(F.col("rv") * 1e3).alias("rv"))


def _grids(grids, step):
    return f"""SELECT venue, symbol, {grids} AS grids, {step} AS step, avg(rv) AS average, avg(n) AS n_bar FROM (SELECT venue, symbol, o, count(r) AS n, sum(r * r) AS rv FROM
(SELECT venue, symbol, o, x - lag(x) OVER (PARTITION BY venue, symbol, o ORDER BY k) AS r FROM (SELECT lp.*, unnest(range({grids})) AS o FROM lp) WHERE k >= o AND (k - o) % {step} = 0) GROUP BY ALL HAVING count(r) > 0) GROUP BY venue, symbol"""


SETTINGS = [(3, 5), (5, 5), (7, 5), (5, 8)]
ABLATION = f"""{LP}, al AS (SELECT venue, symbol, count(r) AS n, sum(r * r) AS al FROM (SELECT *, x - lag(x) OVER (PARTITION BY venue, symbol ORDER BY k) AS r FROM lp) GROUP BY ALL), gr AS ({' UNION ALL '.join(_grids(*x) for x in SETTINGS)}),
ab AS (SELECT venue, symbol, grids, step, (average - n_bar / n * al) / (1 - n_bar / n) AS v FROM gr JOIN al USING (venue, symbol))"""


def _ablation(spark, sf):
    p, out = _points(spark, sf), None
    for grids, step in SETTINGS:
        one = est.two_scales_at(p, CELL, grids, step).select(*CELL, F.lit(grids).alias("grids"), F.lit(step).alias("step"), F.col("tsrv_adj").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@query("grid_step_ablation", f"{ABLATION} SELECT venue, symbol, grids, step, {R('v * 1e3')} AS tsrv_adj FROM ab")
def grid_step_ablation(spark, sf):
    return _ablation(spark, sf).select(*CELL, "grids", "step", r6(F.col("v") * 1e3).alias("tsrv_adj"))


@query("ablation_fragility", f"{ABLATION}, f AS (SELECT venue, symbol, count(v) AS n, min(v) AS low, max(v) AS high, stddev_pop(v) / abs(avg(v)) AS cv FROM ab GROUP BY ALL) SELECT venue, symbol, n, {R('low * 1e3')} AS low, {R('high * 1e3')} AS high, {R('cv')} AS cv, cv > 0.5 AS fragile FROM f")
def ablation_fragility(spark, sf):
    f = est.fragility(_ablation(spark, sf), CELL, "v")
    return f.select(*CELL, "n", r6(F.col("low") * 1e3).alias("low"), r6(F.col("high") * 1e3).alias("high"), r6(F.col("cv")).alias("cv"), "fragile")


def _roll(where="TRUE", step=1):
    return f"""(SELECT venue, symbol, count(d) AS n, var_pop(d) AS g0, covar_samp(d, l) AS g1, avg(mid) AS m FROM (SELECT *, lag(d) OVER {W} AS l FROM (SELECT *, mid - lag(mid) OVER {W} AS d FROM (SELECT *, row_number() OVER {W} - 1 AS k FROM tob WHERE mid > 0 AND {where}) WHERE k % {step} = 0)) GROUP BY ALL)"""


ROLLED = f"""n, {R('g0')} AS g0, {R('g1')} AS g1, {R('CASE WHEN n >= 8 AND g1 < 0 THEN 2e4 * sqrt(-g1) / m END')} AS spread_bps, {R('CASE WHEN n >= 8 AND g1 < 0 THEN g0 + 2 * g1 END')} AS sigma_u2"""


@query("roll_mid_spread", f"SELECT venue, symbol, {ROLLED} FROM {_roll(step=2)}")
def roll_mid_spread(spark, sf):
    return r6s(est.roll_mid(market.tob(spark, sf), CELL, 2), "g0", "g1", "spread_bps", "sigma_u2", keep=(*CELL, "n"))


@query("roll_time_split", f""", c AS (SELECT venue, symbol, floor(quantile_cont(ts, 0.7)) AS cut FROM tob GROUP BY ALL), s AS (SELECT tob.*, ts <= cut AS train FROM tob JOIN c USING (venue, symbol)),
d AS (SELECT *, mid - lag(mid) OVER w AS d FROM s WINDOW w AS (PARTITION BY venue, symbol, train ORDER BY ts, seq)), l AS (SELECT *, lag(d) OVER (PARTITION BY venue, symbol, train ORDER BY ts, seq) AS l FROM d),
g AS (SELECT venue, symbol, train, count(d) AS n, var_pop(d) AS g0, covar_samp(d, l) AS g1, avg(mid) AS m FROM l GROUP BY ALL) SELECT venue, symbol, train, {ROLLED} FROM g""")
def roll_time_split(spark, sf):
    from tapeloom.operators.flow import time_split

    s = time_split(market.tob(spark, sf), CELL, 0.7)
    return r6s(est.roll_mid(s, [*CELL, "train"]), "g0", "g1", "spread_bps", "sigma_u2", keep=(*CELL, "train", "n"))


@query("tick_profile", f""", t AS (SELECT venue, symbol, (ask - bid) / 0.01 AS t, 1e4 * 0.01 / ((ask + bid) / 2) AS rel FROM tob WHERE ask >= bid)
SELECT venue, symbol, count(*) AS n, {R('avg(t)')} AS mean_ticks, {R('avg((abs(t - 1) <= 0.05)::INT)')} AS one_tick, {R('avg(t - 1)')} AS leeway, {R('quantile_cont(t - 1, 0.9)')} AS leeway_p90, {R('avg(rel)')} AS rel_tick_bps, {R('avg(CASE WHEN t <= 1 + 1e-9 THEN 0 ELSE (t - 1) * rel END)')} AS excess_bps FROM t GROUP BY ALL""")
def tick_profile(spark, sf):
    return r6s(est.tick_profile(market.tob(spark, sf), CELL, 0.01), "mean_ticks", "one_tick", "leeway", "leeway_p90", "rel_tick_bps", "excess_bps", keep=(*CELL, "n"))


@query("touch_survival", f""", s AS (SELECT * FROM (SELECT *, row_number() OVER {W} - 1 AS k FROM tob) WHERE k % 10 = 0 AND bid_sz > 0), o AS (SELECT venue, symbol, ts, seq AS start, unnest([0, 1]) AS off, bid, bid_sz FROM s),
h AS (SELECT t.venue, t.symbol, t.ts, t.seq, t.qty, q.ask FROM (SELECT * FROM tape WHERE side < 0) t ASOF JOIN tob q ON t.venue = q.venue AND t.symbol = q.symbol AND t.ts >= q.ts),
m AS (SELECT o.venue, o.symbol, start, off, o.ts, bid_sz, h.ts AS hts, sum(qty) OVER (PARTITION BY o.venue, o.symbol, start, off ORDER BY h.ts, h.seq ROWS UNBOUNDED PRECEDING) AS q FROM o JOIN h ON h.venue = o.venue AND h.symbol = o.symbol AND h.ts BETWEEN o.ts + 1 AND o.ts + {DAY} AND h.ask <= o.bid - off * 0.01::DOUBLE + 1e-12),
f AS (SELECT venue, symbol, start, off, min(hts - ts) AS wait FROM m WHERE q >= bid_sz GROUP BY ALL)
SELECT o.venue, o.symbol, o.off AS "offset", count(*) AS starts, count(wait) AS filled, {R('avg(wait) / 1e6')} AS mean_s, {R('median(wait) / 1e6')} AS median_s, {R('count(wait) / count(*)')} AS rate FROM o LEFT JOIN f USING (venue, symbol, start, off) GROUP BY ALL""")
def touch_survival(spark, sf):
    s = est.touch_survival(market.tob(spark, sf), market.tape(spark, sf), CELL, 0.01, [0, 1], 10, DAY)
    return s.select(*CELL, "offset", "starts", "filled", r6(F.col("mean_us") / 1e6).alias("mean_s"), r6(F.col("median_us") / 1e6).alias("median_s"), r6(F.col("rate")).alias("rate"))


@query("implied_book_levels", f"""{DDOI}, ch AS (SELECT c.*, coalesce(ddoi, 0) AS ddoi FROM chain c LEFT JOIN dd USING (instrument_id)), x AS (SELECT ch.*, b.b AS spot_bps, 1200.0 * (1 + b.b / 1e4) AS sp, greatest(CASE WHEN iv > 1.5 THEN iv / 100 ELSE iv END + s.s, 1e-6) AS v, s.s AS shock FROM ch, (SELECT unnest([-100.0, -50.0, 0.0, 50.0, 100.0]) AS b) b, (SELECT unnest([-0.05, 0.0, 0.05]) AS s) s),
y AS (SELECT *, (ln(sp / strike) + v * v / 2 * ttm_years) / (v * sqrt(ttm_years)) AS d1 FROM x), z AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM y)
SELECT spot_bps::DOUBLE AS spot_bps, shock::DOUBLE AS shock, {R("sum(ddoi * (pdf / (v * sqrt(ttm_years)) - pdf * (d1 - v * sqrt(ttm_years)) / v * shock * sp))")} AS gex_plus FROM z GROUP BY ALL""")
def implied_book_levels(spark, sf):
    m = options.book_map(_chain(spark, sf), 1200.0, [50.0 * k for k in range(-2, 3)], [-0.05, 0.0, 0.05])
    return m.select("spot_bps", "shock", r6(F.col("gex_plus")).alias("gex_plus"))


@query("unmet_events", f"""{KF}, a AS (SELECT * FROM ke WHERE venue = 0), b AS (SELECT * FROM ke WHERE venue = 1), u AS (SELECT a.symbol, EXISTS (SELECT 1 FROM b WHERE b.symbol = a.symbol AND b.start_ts <= a.end_ts + {HOUR} AND b.end_ts >= a.start_ts - {HOUR}) AS hit FROM a)
SELECT symbol, count(*) AS n, count(*) FILTER (WHERE NOT hit) AS "unique", {R('count(*) FILTER (WHERE NOT hit) / count(*)')} AS unique_share, CASE WHEN count(*) FILTER (WHERE hit) / count(*) >= 0.85 AND count(*) FILTER (WHERE hit) >= 3 THEN 'kill_rename' WHEN count(*) FILTER (WHERE hit) / count(*) >= 0.5 THEN 'hold' ELSE 'pass' END AS gate FROM u GROUP BY symbol""", recursive=True)
def unmet_events(spark, sf):
    from tapeloom.operators.decisions import rename_gate

    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0)
    u = est.unmet(e.where("venue = 0"), e.where("venue = 1"), ["symbol"], HOUR)
    met = F.col("n") - F.col("unique")
    return u.select("symbol", "n", "unique", r6(F.col("unique_share")).alias("unique_share"), rename_gate(met / F.col("n"), met).alias("gate"))


@query("filter_noise", f"""{BAR}, h AS (SELECT venue, symbol, ts, r * r AS h FROM bx WHERE r IS NOT NULL), j AS (SELECT t.venue, t.symbol, t.ts, t.seq, t.px, h.h FROM tape t ASOF LEFT JOIN h ON t.venue = h.venue AND t.symbol = h.symbol AND t.ts >= h.ts),
d AS (SELECT *, ln(px) - ln(lag(px) OVER {W}) AS r, coalesce(greatest((ts - lag(ts) OVER {W}) / 1e6, 1e-9), greatest((lead(ts) OVER {W} - ts) / 1e6, 1e-9), 1.0) AS dt FROM j), m AS (SELECT *, abs(r - median(r) OVER (PARTITION BY venue, symbol)) AS a FROM d),
q AS (SELECT venue, symbol, CASE WHEN count(r) > 10 THEN greatest(median(a) / 0.6745, 1e-4) ELSE 1e-4 END AS noise FROM m GROUP BY ALL)
SELECT venue, symbol, {R('sum(greatest(coalesce(h / 3600.0, 1e-12), 1e-12) * dt)')} AS process, {R('any_value(greatest(noise * noise, 1e-12)) * 1e3')} AS measure FROM m JOIN q USING (venue, symbol) GROUP BY ALL""")
def filter_noise(spark, sf):
    t = market.tape(spark, sf)
    b = vol.bar_returns(t, CELL, HOUR).where("r IS NOT NULL").withColumn("h", F.col("r") * F.col("r"))
    n = est.filter_noise(t, b, CELL, 3600.0)
    return n.groupBy(*CELL).agg(r6(F.sum("process")).alias("process"), r6(F.max("measure") * 1e3).alias("measure"))


@query("forward_returns", f""", p AS (SELECT *, lead(px, 5) OVER {W} AS later, floor(sum(qty) OVER (PARTITION BY venue, symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / 50.0) AS bar, floor((sum(qty) OVER (PARTITION BY venue, symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) - qty) / 50.0) AS was FROM tape),
c AS (SELECT venue, symbol, ts, px AS close FROM p WHERE bar > was), e AS (SELECT venue, symbol, max(ts) AS e FROM tape GROUP BY ALL), d AS (SELECT venue, symbol, ts, seq FROM tob WHERE seq % 5 = 0), a AS (SELECT d.*, d.ts + {DAY} AS then_ts, p.px AS p0, p.later FROM d ASOF LEFT JOIN p ON d.venue = p.venue AND d.symbol = p.symbol AND d.ts >= p.ts),
b AS (SELECT a.*, t.px AS p1 FROM a ASOF LEFT JOIN tape t ON a.venue = t.venue AND a.symbol = t.symbol AND a.then_ts >= t.ts), g AS (SELECT b.*, c.close FROM b ASOF LEFT JOIN c ON b.venue = c.venue AND b.symbol = c.symbol AND b.ts < c.ts)
SELECT venue, symbol, count(*) AS n, {R('sum(ln(later / p0))')} AS r_prints, {R('sum(CASE WHEN then_ts <= e THEN ln(p1 / p0) END)')} AS r_time, {R('sum(ln(close / p0))')} AS r_volume FROM g JOIN e USING (venue, symbol) GROUP BY ALL""")
def forward_returns(spark, sf):
    d = market.tob(spark, sf).where("seq % 5 = 0").select(*CELL, "ts", "seq")
    r = est.forward_returns(d, market.tape(spark, sf), CELL, 5, DAY, 50.0)
    return r.groupBy(*CELL).agg(F.count("*").alias("n"), *(r6(F.sum(c)).alias(c) for c in ("r_prints", "r_time", "r_volume")))


@query("paths_after_events", f"""{KF}, h AS (SELECT *, unnest([{HOUR}, {12 * HOUR}]) AS horizon FROM ke), a AS (SELECT h.*, (SELECT arg_max(t.px, t.seq) FROM tape t WHERE t.venue = h.venue AND t.symbol = h.symbol AND t.seq > h.end_seq AND t.ts <= h.end_ts + h.horizon) AS p,
 (SELECT max(100 * abs(t.px - h.last) / h.last) FROM tape t WHERE t.venue = h.venue AND t.symbol = h.symbol AND t.seq > h.end_seq AND t.ts <= h.end_ts + {4 * HOUR}) AS most FROM h)
SELECT venue, horizon, count(*) AS n, count(p) AS moved, {R('avg(1e4 * (p - last) / last)')} AS path_bps, {R('avg(coalesce(most, 0))')} AS most_pct FROM a GROUP BY ALL""", recursive=True)
def paths_after_events(spark, sf):
    p = est.paths_after(vol.crash_events(_filtered(spark, sf), CELL, 2.0), market.tape(spark, sf), CELL, [HOUR, 12 * HOUR], 4 * HOUR)
    return p.groupBy("venue", "horizon").agg(F.count("*").alias("n"), F.count("path_bps").alias("moved"), r6(F.avg("path_bps")).alias("path_bps"), r6(F.avg("most_pct")).alias("most_pct"))


@query("size_summary", f"SELECT venue, count(*) AS n, {R('avg(px)')} AS mean, {R('median(px)')} AS median, {R('stddev_samp(px)')} AS sd, {R('quantile_cont(px, 0.25)')} AS p25, {R('quantile_cont(px, 0.75)')} AS p75 FROM tape GROUP BY venue")
def size_summary(spark, sf):
    return r6s(est.summary(market.tape(spark, sf), ["venue"], "px"), "mean", "median", "sd", "p25", "p75", keep=("venue", "n"))


@query("innovation_lead", f"""{KF}, i AS (SELECT a.venue, a.symbol, {HOUR} AS lag, a.z, ln(b.px / a.px) AS r, a.seq AS s, b.seq AS o FROM (SELECT *, ts + {HOUR} AS at FROM kf) a ASOF JOIN kf b ON a.venue = b.venue AND a.symbol = b.symbol AND a.at <= b.ts
UNION ALL SELECT a.venue, a.symbol, {-HOUR}, a.z, ln(b.px / a.px), a.seq, b.seq FROM (SELECT *, ts - {HOUR} AS at FROM kf) a ASOF JOIN kf b ON a.venue = b.venue AND a.symbol = b.symbol AND a.at <= b.ts
UNION ALL SELECT venue, symbol, 0, z, ln(lead(px) OVER {W} / px), seq, -1 FROM kf) SELECT venue, symbol, lag::INT AS lag, count(r) AS n, {R('CASE WHEN count(r) >= 20 THEN corr(z, r) END')} AS corr FROM i WHERE s <> o AND r IS NOT NULL GROUP BY ALL""".replace("lag::INT", "lag::BIGINT"), recursive=True)
def innovation_lead(spark, sf):
    out = est.innovation_lead(_filtered(spark, sf), CELL, [HOUR, -HOUR, 0], 20)
    return out.select(*CELL, F.col("lag").cast("long").alias("lag"), "n", r6(F.col("corr")).alias("corr"))


@query("shifted_runs", f"""{KF}, f AS (SELECT *, abs(z) >= 1.5 AS f, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY venue, symbol) AS n FROM kf), g AS (SELECT *, f AND coalesce(lag(f) OVER {W}, false) AS cut, f AND NOT coalesce(lag(f) OVER {W}, false) AS st FROM f),
e AS (SELECT venue, symbol, any_value(n) AS n, bool_and(f) FILTER (WHERE i = 0 OR i = n - 1) AS wraps, sum(st::INT)::BIGINT AS observed FROM g GROUP BY ALL), a AS (SELECT *, unnest(range(1, 51)) AS draw FROM e),
s AS (SELECT *, (n - 1 - floor({uniform('21', 'draw')} * greatest(n - 2, 1)))::BIGINT AS at FROM a), m AS (SELECT s.venue, s.symbol, s.observed, s.observed + g.cut::INT - s.wraps::INT AS p FROM s JOIN g ON g.venue = s.venue AND g.symbol = s.symbol AND g.i = s.at)
SELECT venue, symbol, any_value(observed) AS observed, {R('avg(p)')} AS placebo_mean, avg((p >= observed)::INT) AS p FROM m GROUP BY ALL""", recursive=True)
def shifted_runs(spark, sf):
    s = est.shifted_runs(_filtered(spark, sf), CELL, 1.5, 50, 21)
    return s.select(*CELL, "observed", r6(F.col("placebo_mean")).alias("placebo_mean"), "p")


@query("event_window_imbalance", f"""{KF}, i AS (SELECT venue, symbol, ts, abs(sum(side * qty) OVER w / sum(qty) OVER w) AS imb FROM tape WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts, seq ROWS 4 PRECEDING)),
e AS (SELECT k.venue, k.symbol, k.run, avg(imb) FILTER (WHERE i.ts < start_ts) AS b, avg(imb) FILTER (WHERE i.ts BETWEEN start_ts AND end_ts) AS d, avg(imb) FILTER (WHERE i.ts > end_ts) AS a FROM ke k LEFT JOIN i ON i.venue = k.venue AND i.symbol = k.symbol AND i.ts BETWEEN start_ts - {4 * HOUR} AND end_ts + {4 * HOUR} GROUP BY ALL)
SELECT venue, count(*) AS events, {R('avg(b)')} AS before, {R('avg(d)')} AS during, {R('avg(a)')} AS after FROM e GROUP BY venue""", recursive=True)
def event_window_imbalance(spark, sf):
    w = est.window_imbalance(vol.crash_events(_filtered(spark, sf), CELL, 2.0), market.tape(spark, sf), CELL, 4 * HOUR, 5)
    return w.groupBy("venue").agg(F.count("*").alias("events"), *(r6(F.avg(c)).alias(c) for c in ("before", "during", "after")))


@query("noise_concordance", f""", r AS (SELECT venue, symbol, ts // {DAY} AS day, ln(px / lag(px) OVER {W}) AS r FROM tape), n AS (SELECT venue, symbol, day, stddev_pop(r) AS v FROM r GROUP BY ALL), c AS (SELECT symbol, day, count(DISTINCT venue) AS legs, (max(v) - min(v)) / greatest(median(v), 1e-12) AS rel FROM n WHERE v IS NOT NULL GROUP BY ALL HAVING count(DISTINCT venue) >= 2)
SELECT symbol, count(*) AS days, {R('avg(rel)')} AS rel_range, count(*) FILTER (WHERE rel < 0.35) AS close FROM c GROUP BY symbol""")
def noise_concordance(spark, sf):
    from tapeloom.functions.stats import log_change

    r = market.tape(spark, sf).withColumn("r", log_change("px", CELL)).groupBy(*CELL, F.floor(F.col("ts") / DAY).alias("day")).agg(F.stddev_pop("r").alias("v"))
    c = est.concordance(r, ["symbol", "day"], "venue", "v")
    return c.groupBy("symbol").agg(F.count("*").alias("days"), r6(F.avg("rel_range")).alias("rel_range"), F.count(F.when(F.col("close"), 1)).alias("close"))


@query("spread_on_volatility", f""", q AS (SELECT venue, symbol, ts // {12 * HOUR} AS bar, avg(1e4 * (ask - bid) / ((ask + bid) / 2)) AS spread, arg_max(mid, seq) AS mid FROM tob WHERE ask >= bid GROUP BY ALL), t AS (SELECT venue, symbol, ts // {12 * HOUR} AS bar, sum(px * qty) AS notional FROM tape GROUP BY ALL),
v AS (SELECT *, abs(ln(mid) - ln(lag(mid) OVER (PARTITION BY venue, symbol ORDER BY bar))) AS vol FROM q LEFT JOIN t USING (venue, symbol, bar)) SELECT venue, symbol, count(*) AS bars, {R('regr_slope(spread, vol)')} AS slope, {R('regr_r2(spread, vol)')} AS r2, {R('corr(spread, notional)')} AS corr FROM v WHERE vol IS NOT NULL GROUP BY ALL""")
def spread_on_volatility(spark, sf):
    return r6s(est.spread_on_volatility(market.tob(spark, sf), market.tape(spark, sf), CELL, 12 * HOUR), "slope", "r2", "corr", keep=(*CELL, "bars"))


@query("role_blur", f""", a AS (SELECT symbol, venue, count(*) AS u, avg(bid_sz + ask_sz) AS s FROM tob GROUP BY ALL), b AS (SELECT *, u / sum(u) OVER (PARTITION BY symbol) AS pu, s / sum(s) OVER (PARTITION BY symbol) AS ps FROM a) SELECT symbol, venue, {R('pu')} AS update_share, {R('ps')} AS size_share, {R('abs(pu - ps)')} AS blur FROM b""")
def role_blur(spark, sf):
    return r6s(est.role_blur(market.tob(spark, sf), ["symbol"], "venue"), "update_share", "size_share", "blur", keep=("symbol", "venue"))


@query("curve_over_days", f""", s AS (SELECT venue, ts // {DAY} AS d, (ts % {DAY}) * 24 // {DAY} AS slot, sum(px * qty) AS v FROM tape GROUP BY ALL), t AS (SELECT venue, d, sum(v) AS t FROM s GROUP BY ALL), e AS (SELECT *, unnest(range(24)) AS slot FROM t), p AS (SELECT e.venue, e.slot, coalesce(v, 0) / t AS p FROM e LEFT JOIN s USING (venue, d, slot))
SELECT venue, slot, count(*) AS days, {R('avg(p)')} AS mean, {R('stddev_pop(p)')} AS sd FROM p GROUP BY ALL""")
def curve_over_days(spark, sf):
    return r6s(est.curve_days(market.tape(spark, sf), ["venue"], DAY, 24), "mean", "sd", keep=("venue", "slot", "days"))


@query("count_lead_lag", f""", e AS (SELECT symbol, ts // {6 * HOUR} AS bar, (venue = 0)::INT AS a, (venue = 1)::INT AS b FROM tape WHERE venue < 2), c AS (SELECT symbol, bar, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM e GROUP BY ALL), g AS (SELECT symbol, unnest(generate_series(min(bar), max(bar))) AS bar FROM c GROUP BY symbol),
f AS (SELECT symbol, bar, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM g LEFT JOIN c USING (symbol, bar)), d AS (SELECT symbol, bar, a - avg(a) OVER (PARTITION BY symbol) AS a, b - avg(b) OVER (PARTITION BY symbol) AS b FROM f),
l AS (SELECT symbol, a, b, lag(b, 2) OVER w AS m, lead(b, 1) OVER w AS p FROM d WINDOW w AS (PARTITION BY symbol ORDER BY bar)), s AS (SELECT symbol, count(*) AS bars, sqrt(sum(a * a) * sum(b * b)) AS dd, coalesce(sum(a * m), 0) AS m, sum(a * b) AS z, coalesce(sum(a * p), 0) AS p FROM l GROUP BY symbol)
SELECT symbol, bars, unnest([-2, 0, 1]) AS lag, unnest([{R('m / dd')}, {R('z / dd')}, {R('p / dd')}]) AS corr FROM s""")
def count_lead_lag(spark, sf):
    t = market.tape(spark, sf)
    c = est.count_lead_lag(t.where("venue = 0"), t.where("venue = 1"), ["symbol"], 6 * HOUR, [-2, 0, 1])
    return c.select("symbol", "bars", "lag", r6(F.col("corr")).alias("corr"))


@query("quoted_trades", f""", e AS (SELECT venue, symbol, min(ts) AS lo, max(ts) AS hi FROM tob GROUP BY ALL), i AS (SELECT t.*, t.ts BETWEEN lo AND hi AS ok FROM tape t JOIN e USING (venue, symbol)), k AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY venue, symbol) AS n FROM i), o AS (SELECT * FROM k WHERE ok OR n < 20),
a AS (SELECT o.venue, o.symbol, o.px * o.qty AS v, q.mid FROM o ASOF LEFT JOIN tob q ON o.venue = q.venue AND o.symbol = q.symbol AND o.ts >= q.ts) SELECT venue, symbol, count(*) AS n, {R('sum(v)')} AS notional, count(mid) AS quoted, {R('sum(mid)')} AS mids FROM a GROUP BY ALL""")
def quoted_trades(spark, sf):
    q = est.quoted_trades(market.tape(spark, sf), market.tob(spark, sf), CELL, 20)
    return q.groupBy(*CELL).agg(F.count("*").alias("n"), r6(F.sum("notional")).alias("notional"), F.count("mid").alias("quoted"), r6(F.sum("mid")).alias("mids"))


@query("order_schedules", f""", s AS (SELECT venue, symbol, ts // {DAY} AS k, sum(qty) AS v, coalesce(stddev_samp(px), 0) AS sd FROM tape GROUP BY ALL), w AS (SELECT *, v / greatest(sd, 1e-12) AS w FROM s) SELECT venue, symbol, k, {R('100 * w / sum(w) OVER (PARTITION BY venue, symbol)')} AS child FROM w""")
def order_schedules(spark, sf):
    s = market.tape(spark, sf).groupBy(*CELL, F.floor(F.col("ts") / DAY).alias("k")).agg(F.sum("qty").alias("v"), F.coalesce(F.stddev_samp("px"), F.lit(0.0)).alias("sd"))
    return r6s(est.expected_schedule(s, CELL, "v", "sd", 100.0), "child", keep=(*CELL, "k"))


@query("unwind_path", f""", x(k, a, b) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, b, (2 + 0.01) * b - a FROM x WHERE k < 20), t AS (SELECT a AS total FROM x WHERE k = 20), p AS (SELECT venue, symbol, sum(side * qty) AS held FROM tape GROUP BY ALL)
SELECT venue, symbol, held, 20 - k AS k, {R('held * a / total')} AS "left" FROM p, x, t""", recursive=True)
def unwind_path(spark, sf):
    held = market.tape(spark, sf).groupBy(*CELL).agg(F.sum(F.col("side") * F.col("qty")).alias("held"))
    return r6s(est.unwind_path(held, "held", 20, 0.01), "left", keep=(*CELL, "held", "k"))


@query("synthetic_quotes", f""", w AS (SELECT *, last_value(CASE WHEN side < 0 THEN px END IGNORE NULLS) OVER o AS b, last_value(CASE WHEN side > 0 THEN px END IGNORE NULLS) OVER o AS a FROM tape WHERE px > 0 WINDOW o AS (PARTITION BY venue, symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
l AS (SELECT venue, symbol, ts // {12 * HOUR} AS k, arg_max({{'b': b, 'a': a}}, seq) AS x FROM w GROUP BY ALL) SELECT venue, symbol, (k + 1) * {12 * HOUR} AS ts, least(x.b, x.a) AS bid, greatest(x.b, x.a) AS ask FROM l WHERE x.b IS NOT NULL AND x.a IS NOT NULL""")
def synthetic_quotes(spark, sf):
    return est.synthetic_quotes(market.tape(spark, sf), CELL, 12 * HOUR).select(*CELL, "ts", "bid", "ask")


@query("spread_proxy", f""", a AS (SELECT t.*, 2e4 * t.side * (t.px - q.mid) / q.mid AS es, ln(t.px / lag(t.px) OVER (PARTITION BY t.venue, t.symbol ORDER BY t.ts, t.seq)) AS r FROM tape t ASOF LEFT JOIN tob q ON t.venue = q.venue AND t.symbol = q.symbol AND t.ts >= q.ts), l AS (SELECT *, lag(r) OVER {W} AS l FROM a),
s AS (SELECT venue, symbol, avg(es) AS e, CASE WHEN covar_samp(r, l) < 0 THEN 2e4 * sqrt(-covar_samp(r, l)) END AS roll FROM l GROUP BY ALL) SELECT venue, symbol, {R('CASE WHEN e > 0 AND e < 500 THEN e ELSE roll END')} AS spread_bps, CASE WHEN e > 0 AND e < 500 THEN 'effective_vs_mark' WHEN roll IS NOT NULL THEN 'roll' ELSE 'none' END AS kind FROM s""")
def spread_proxy(spark, sf):
    return r6s(est.spread_proxy(market.tape(spark, sf), market.tob(spark, sf), CELL), "spread_bps", keep=(*CELL, "kind"))


@query("option_names", ", n AS (SELECT instrument_id, CASE WHEN instrument_id % 5 = 0 THEN 'ETH-PERPETUAL' ELSE 'ETH-27SEP26-' || (strike::BIGINT)::VARCHAR || '-' || upper(flag) END AS name FROM chain) SELECT instrument_id, nullif(regexp_extract(name, '^([A-Z_]+)-(\\d{1,2}[A-Z]{3}\\d{2})-(\\d+)-([CP])$', 1), '') AS underlying, nullif(regexp_extract(name, '^([A-Z_]+)-(\\d{1,2}[A-Z]{3}\\d{2})-(\\d+)-([CP])$', 2), '') AS expiry, nullif(regexp_extract(name, '^([A-Z_]+)-(\\d{1,2}[A-Z]{3}\\d{2})-(\\d+)-([CP])$', 3), '')::DOUBLE AS strike, lower(nullif(regexp_extract(name, '^([A-Z_]+)-(\\d{1,2}[A-Z]{3}\\d{2})-(\\d+)-([CP])$', 4), '')) AS flag FROM n")
def option_names(spark, sf):
    name = F.when(F.col("instrument_id") % 5 == 0, "ETH-PERPETUAL").otherwise(F.concat(F.lit("ETH-27SEP26-"), F.round("strike").cast("long").cast("string"), F.lit("-"), F.upper("flag")))
    return market.chain(spark, sf).select("instrument_id", *(v.alias(k) for k, v in est.option_name(name).items()))


SPOKEN = ["xbt", "ETH/USD", " sol-perpetual", "DOGE-USD", "PF_XBTUSD", "eth/usdc", "SOL_USDC-PERPETUAL", "BTC-USDC"]
PLACES = ["HL", "db", "Kraken", "risex", "nowhere"]


@query("normalized_names", f""", s AS (SELECT DISTINCT symbol, venue, [{', '.join(f"'{x}'" for x in SPOKEN)}][1 + (symbol + 2 * venue) % {len(SPOKEN)}] AS name, [{', '.join(f"'{x}'" for x in PLACES)}][1 + (symbol + venue) % {len(PLACES)}] AS place FROM tape),
u AS (SELECT *, CASE upper(trim(name)) WHEN 'XBT' THEN 'BTC' WHEN 'ETH/USD' THEN 'ETH' WHEN 'SOL-PERPETUAL' THEN 'SOL' WHEN 'PF_XBTUSD' THEN 'BTC' WHEN 'ETH/USDC' THEN 'ETH' WHEN 'SOL_USDC-PERPETUAL' THEN 'SOL' WHEN 'BTC-USDC' THEN 'BTC' ELSE upper(trim(name)) END AS underlying, CASE lower(place) WHEN 'hl' THEN 'hyperliquid' WHEN 'db' THEN 'deribit' ELSE lower(place) END AS spot FROM s)
SELECT symbol, venue, underlying, spot, CASE underlying || '@' || spot WHEN 'BTC@hyperliquid' THEN 'BTC' WHEN 'ETH@hyperliquid' THEN 'ETH' WHEN 'SOL@hyperliquid' THEN 'SOL' WHEN 'BTC@deribit' THEN 'BTC-PERPETUAL' WHEN 'ETH@deribit' THEN 'ETH-PERPETUAL' WHEN 'SOL@deribit' THEN 'SOL_USDC-PERPETUAL' WHEN 'BTC@kraken' THEN 'PF_XBTUSD' WHEN 'ETH@kraken' THEN 'PF_ETHUSD' WHEN 'SOL@kraken' THEN 'PF_SOLUSD' WHEN 'BTC@risex' THEN 'BTC/USDC' WHEN 'ETH@risex' THEN 'ETH/USDC' WHEN 'SOL@risex' THEN 'SOL/USDC' ELSE trim(name) END AS instrument,
 regexp_replace(regexp_replace(split_part(upper(trim(name)), '/', 1), '(USDT|USDC)$', ''), '-PERPETUAL$', '') AS base FROM u""")
def normalized_names(spark, sf):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), 1 + k % len(values))
    s = market.tape(spark, sf).select("symbol", "venue").distinct()
    s = s.withColumns({"name": pick(SPOKEN, F.col("symbol") + 2 * F.col("venue")), "place": pick(PLACES, F.col("symbol") + F.col("venue"))})
    return s.select("symbol", "venue", names.underlying(F.col("name")).alias("underlying"), names.venue(F.col("place")).alias("spot"), names.instrument(F.col("name"), F.col("place")).alias("instrument"), names.base_symbol(F.col("name")).alias("base"))


def _survival_sql(own: str, other: str, sign: str, through: str) -> str:
    return f""", q AS (SELECT *, row_number() OVER {W} - 1 AS k, count(*) OVER (PARTITION BY venue, symbol) AS n, lead(ts) OVER {W} AS nx FROM tob), b AS (SELECT venue, symbol FROM tape GROUP BY ALL HAVING count(*) >= 50),
c AS (SELECT venue, symbol, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS share, unnest(quantile_cont({own}_sz, [0.25, 0.5, 0.75])) AS size FROM q JOIN b USING (venue, symbol) WHERE n >= 15 AND {own}_sz > 0 GROUP BY venue, symbol HAVING count(*) >= 20),
s AS (SELECT q.venue, q.symbol, seq AS start, ts, {own} AS level, coalesce(nx <= ts + {DAY}, false) AS live FROM q JOIN b USING (venue, symbol) WHERE n >= 15 AND k % 10 = 0 AND k < n - 2),
h AS (SELECT t.venue, t.symbol, t.ts, t.seq, t.qty, o.{other} FROM (SELECT * FROM tape WHERE side {sign} 0) t ASOF JOIN tob o ON t.venue = o.venue AND t.symbol = o.symbol AND t.ts >= o.ts),
m AS (SELECT s.venue, s.symbol, start, h.ts - s.ts AS wait, sum(qty) OVER (PARTITION BY s.venue, s.symbol, start ORDER BY h.ts, h.seq ROWS UNBOUNDED PRECEDING) AS taken FROM s JOIN h ON h.venue = s.venue AND h.symbol = s.symbol AND h.ts BETWEEN s.ts + 1 AND s.ts + {DAY} AND {through} WHERE live),
f AS (SELECT m.venue, m.symbol, start, share, min(wait) AS wait FROM m JOIN c ON c.venue = m.venue AND c.symbol = m.symbol AND taken >= size GROUP BY ALL),
r AS (SELECT s.venue, s.symbol, c.share, c.size, count(*) AS starts, count(wait) AS filled, avg(wait) AS mean_us, median(wait) AS median_us, count(wait) / count(*) AS rate FROM s JOIN c ON c.venue = s.venue AND c.symbol = s.symbol LEFT JOIN f ON f.venue = s.venue AND f.symbol = s.symbol AND f.start = s.start AND f.share = c.share GROUP BY ALL),
e AS (SELECT *, coalesce(rate <= lag(rate) OVER (PARTITION BY venue, symbol ORDER BY share) + 1e-9, true) AS falls FROM r)
SELECT venue, symbol, share, size, starts, filled, {R('mean_us / 1e6')} AS mean_s, {R('median_us / 1e6')} AS median_s, {R('rate')} AS rate, bool_and(falls) OVER (PARTITION BY venue, symbol) AS monotone FROM e"""


def _size_survival(spark, sf, side):
    s = est.size_survival(market.tob(spark, sf), market.tape(spark, sf), CELL, 10, DAY, side)
    return s.select(*CELL, "share", "size", "starts", "filled", r6(F.col("mean_us") / 1e6).alias("mean_s"), r6(F.col("median_us") / 1e6).alias("median_s"), r6(F.col("rate")).alias("rate"), "monotone")


@query("size_survival_bids", _survival_sql("bid", "ask", "<", "h.ask <= s.level + 1e-12"))
def size_survival_bids(spark, sf):
    return _size_survival(spark, sf, "buy")


@query("size_survival_asks", _survival_sql("ask", "bid", ">", "h.bid >= s.level - 1e-12"))
def size_survival_asks(spark, sf):
    return _size_survival(spark, sf, "sell")
