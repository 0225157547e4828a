"""Queries on clustering of arrivals, models judged out of sample, geometric events and the event clock."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import r6
from tapeloom.operators import clustering, validation, vol
from tapeloom.operators import decisions as act
from tapeloom.operators.clustering import BETAS
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import HOUR
from tapeloom.plans.decisions import EV, _events
from tapeloom.plans.flow import W
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR
BINS = f""", sp AS (SELECT venue, symbol, min(ts) AS t0, count(*) AS n, greatest((max(ts) - min(ts)) // {HOUR} + 1, 2) AS bins FROM tape GROUP BY ALL),
ct AS (SELECT t.venue, t.symbol, (t.ts - t0) // {HOUR} AS bin, count(*)::DOUBLE AS n FROM tape t JOIN sp USING (venue, symbol) GROUP BY ALL),
al AS (SELECT venue, symbol, bins, unnest(range(bins)) AS bin FROM sp), gr AS (SELECT al.*, coalesce(ct.n, 0) AS n FROM al LEFT JOIN ct USING (venue, symbol, bin))"""


@query("hawkes_fit", f"""{BINS}, kk AS (SELECT g.venue, g.symbol, g.bin, g.n, b.beta, coalesce(sum(c.n * exp(-b.beta * (g.bin - 1 - c.bin))), 0) AS k FROM gr g JOIN (SELECT unnest({BETAS}::DOUBLE[]) AS beta) b ON true
 LEFT JOIN ct c ON c.venue = g.venue AND c.symbol = g.symbol AND c.bin < g.bin GROUP BY ALL),
f AS (SELECT venue, symbol, beta, regr_slope(n, k) AS alpha, regr_intercept(n, k) AS lambda0, regr_syy(n, k) - regr_slope(n, k) * regr_sxy(n, k) AS rss FROM kk GROUP BY ALL),
x AS (SELECT venue, symbol, min({{'rss': rss, 'beta': beta, 'alpha': alpha, 'lambda0': lambda0}}) FILTER (WHERE alpha >= 0 AND lambda0 >= 0 AND alpha / beta < 1) AS x FROM f GROUP BY ALL)
SELECT venue, symbol, sp.n AS n_events, bins, {R("sp.n / bins")} AS mean_count, {R("x.rss")} AS rss, x.beta AS beta, {R("x.alpha")} AS alpha, {R("x.lambda0")} AS lambda0, {R("x.alpha / x.beta")} AS branching, {R("x.lambda0 / (1 - x.alpha / x.beta)")} AS e_lambda
FROM sp JOIN x USING (venue, symbol) WHERE sp.n >= 10""")
def hawkes_fit(spark, sf):
    h = clustering.hawkes_fit(market.tape(spark, sf), CELL, HOUR, HOUR)
    return h.select(*CELL, "n_events", "bins", "beta", *(r6(F.col(c)).alias(c) for c in ("mean_count", "rss", "alpha", "lambda0", "branching", "e_lambda")))


@query("count_acf", f"""{BINS}, ce AS (SELECT venue, symbol, bin, bins, n - avg(n) OVER (PARTITION BY venue, symbol) AS c FROM gr), v AS (SELECT venue, symbol, sum(c * c) AS var FROM ce GROUP BY ALL)
SELECT a.venue, a.symbol, l.lag::INT AS lag, CASE WHEN any_value(var) > 1e-12 THEN {R("sum(a.c * b.c) / any_value(var)")} END AS acf
FROM ce a JOIN (SELECT unnest(range(13)) AS lag) l ON true JOIN ce b ON b.venue = a.venue AND b.symbol = a.symbol AND b.bin = a.bin - l.lag JOIN v ON v.venue = a.venue AND v.symbol = a.symbol GROUP BY ALL""")
def count_acf(spark, sf):
    a = clustering.count_acf(market.tape(spark, sf), CELL, HOUR, 12)
    return a.select(*CELL, "lag", r6(F.col("acf")).alias("acf"))


@query("interarrival_cv", f"""SELECT venue, symbol, count(*) AS n, {R("stddev_pop(g) / avg(g)")} AS cv FROM (SELECT venue, symbol, ts - lag(ts) OVER {W} AS g FROM tape) GROUP BY ALL""")
def interarrival_cv(spark, sf):
    return clustering.interarrival_cv(market.tape(spark, sf), CELL).withColumn("cv", r6(F.col("cv")))


PANEL = f""", pw AS (SELECT venue, symbol, ts, seq, ts // {DAY} AS day, qty, side, 1e4 * ln(px / lag(px) OVER {W}) AS was, 1e4 * ln(lead(px) OVER {W} / px) AS next FROM tape WHERE px > 0),
pn AS (SELECT * FROM pw WHERE was IS NOT NULL AND next IS NOT NULL)"""


def _panel(spark, sf):
    w = Window.partitionBy(*CELL).orderBy("ts", "seq")
    t = market.tape(spark, sf).where("px > 0")
    return t.select(*CELL, "ts", "seq", F.floor(F.col("ts") / DAY).alias("day"), "qty", "side", (1e4 * F.ln(F.col("px") / F.lag("px").over(w))).alias("was"), (1e4 * F.ln(F.lead("px").over(w) / F.col("px"))).alias("next"))


ALPHAS = [0.1, 10.0, 1000.0]
RIDGE = f"""{PANEL}, dd AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT symbol, day FROM pn)),
dg AS (SELECT *, CASE WHEN n < 5 THEN greatest(2, n - 1) ELSE 4 END AS folds FROM dd), df AS (SELECT symbol, day, k // greatest(1, n // folds) AS fold, folds FROM dg),
pf AS (SELECT pn.*, CASE WHEN fold < folds THEN fold END AS fold FROM pn JOIN df USING (symbol, day)),
fo AS (SELECT DISTINCT symbol, fold AS f FROM pf WHERE fold IS NOT NULL),
tr AS (SELECT fo.symbol, f, count(*) AS n, avg(qty) AS ma, avg(was) AS mb, avg(next) AS my, nullif(stddev_pop(qty), 0) AS sa, nullif(stddev_pop(was), 0) AS sb, corr(qty, was) AS r, covar_pop(qty, next) AS ca, covar_pop(was, next) AS cb FROM fo JOIN pf ON pf.symbol = fo.symbol AND (pf.fold IS NULL OR pf.fold <> f) GROUP BY ALL),
tw AS (SELECT *, n * ca / sa AS p, n * cb / sb AS q, n + alpha AS u, n * r AS v FROM tr JOIN (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha) ON true),
co AS (SELECT symbol, f, alpha, n, ma, mb, my, (p * u - q * v) / (u * u - v * v) / sa AS ba, (q * u - p * v) / (u * u - v * v) / sb AS bb FROM tw),
pr AS (SELECT pf.symbol, f AS fold, alpha, n AS n_train, seq, next, my + ba * (qty - ma) + bb * (was - mb) AS p FROM pf JOIN co ON co.symbol = pf.symbol AND co.f = pf.fold),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold, alpha ORDER BY p, seq) AS rp, row_number() OVER (PARTITION BY symbol, fold, alpha ORDER BY next, seq) AS ry FROM pr),
sc AS (SELECT symbol, fold, alpha, any_value(n_train) AS n_train, count(*) AS n_test, 1 - sum((next - p) ** 2) / nullif(var_pop(next) * count(*), 0) AS r2, corr(rp, ry) AS ic FROM rk GROUP BY ALL HAVING any_value(n_train) >= 30 AND count(*) >= 15)"""


def _ridge(spark, sf):
    return validation.blocked_ridge(_panel(spark, sf), ["symbol"], "day", ["qty", "was"], "next", "seq", ALPHAS)


@query("blocked_ridge_scores", f"{RIDGE} SELECT symbol, fold, alpha, n_train, n_test, {R('r2')} AS r2, {R('ic')} AS ic FROM sc")
def blocked_ridge_scores(spark, sf):
    return _ridge(spark, sf).select("symbol", "fold", "alpha", "n_train", "n_test", r6(F.col("r2")).alias("r2"), r6(F.col("ic")).alias("ic"))


@query("ridge_penalty_path", f"""{RIDGE}, pa AS (SELECT symbol, alpha, count(*) AS folds, avg(ic) AS ic_mean, avg(r2) AS r2_mean FROM sc GROUP BY ALL)
SELECT symbol, alpha, folds, {R('ic_mean')} AS ic_mean, {R('r2_mean')} AS r2_mean, row_number() OVER (PARTITION BY symbol ORDER BY round(ic_mean, 9) DESC, alpha) = 1 AS best FROM pa""")
def ridge_penalty_path(spark, sf):
    path = validation.penalty_path(_ridge(spark, sf).withColumn("ic", F.round("ic", 9)), ["symbol"])
    return path.select("symbol", "alpha", "folds", r6(F.col("ic_mean")).alias("ic_mean"), r6(F.col("r2_mean")).alias("r2_mean"), "best")


def _newton(steps: int) -> str:
    out = ", b0 AS (SELECT symbol, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM lg GROUP BY symbol HAVING count(*) >= 6 AND min(y) < max(y))"
    for k in range(steps):
        out += f""", s{k} AS (SELECT symbol, a, b, sum(y - p) - a / 25 AS g0, sum(x * (y - p)) - b / 25 AS g1, sum(p * (1 - p)) + 0.04::DOUBLE AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) + 0.04::DOUBLE AS h2, count(*) AS n, avg(((p >= 0.5) = (y >= 0.5))::INT) AS accuracy
 FROM (SELECT lg.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM lg JOIN b{k} USING (symbol)) GROUP BY symbol, a, b),
b{k + 1} AS (SELECT symbol, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM s{k})"""
    return out


@query("logistic_posterior", f"""{PANEL}, lg AS (SELECT symbol, side * qty / 7 AS x, (next > 0)::INT::DOUBLE AS y FROM pn){_newton(12)},
po AS (SELECT symbol, n, accuracy, unnest([{{'term': 'intercept', 'mean': a, 'se': sqrt(h2 / (h0 * h2 - h1 * h1))}}, {{'term': 'x', 'mean': b, 'se': sqrt(h0 / (h0 * h2 - h1 * h1))}}]) AS t FROM s11)
SELECT symbol, t.term AS term, {R("t.mean")} AS mean, {R("t.se")} AS se, {R("t.mean - 1.96 * t.se")} AS low, {R("t.mean + 1.96 * t.se")} AS high, n, true AS converged, {R("accuracy")} AS accuracy FROM po""")
def logistic_posterior(spark, sf):
    p = _panel(spark, sf).where("was IS NOT NULL AND next IS NOT NULL").select("symbol", (F.col("side") * F.col("qty") / 7).alias("x"), (F.col("next") > 0).cast("double").alias("y"))
    out = validation.logistic_posterior(p, ["symbol"], "y", ["x"])
    return out.select("symbol", "term", "n", "converged", *(r6(F.col(c)).alias(c) for c in ("mean", "se", "low", "high", "accuracy")))


V_PCT, V_US, V_BACK = 0.2, 6 * HOUR, 0.5
VSHAPE = f""", v0 AS (SELECT venue, symbol, ts, seq, px, row_number() OVER {W} AS k, count(*) OVER (PARTITION BY venue, symbol) AS n FROM tape WHERE px IS NOT NULL),
v1 AS (SELECT i.venue, i.symbol, i.k, i.n, i.ts, i.px, max(x.k) AS j, min({{'p': x.px, 'k': x.k}}) AS lo, min({{'p': -x.px, 'k': x.k}}) AS hi FROM v0 i JOIN v0 x ON x.venue = i.venue AND x.symbol = i.symbol AND x.k >= i.k AND x.ts <= i.ts + {V_US} GROUP BY ALL),
v2 AS (SELECT *, (px - lo.p) / px AS down, (-hi.p - px) / px AS up FROM v1),
v3 AS (SELECT *, CASE WHEN down >= {V_PCT / 100}::DOUBLE AND down >= up THEN -1 ELSE 1 END AS shape, CASE WHEN j > k AND px > 0 AND greatest(down, up) >= {V_PCT / 100}::DOUBLE THEN CASE WHEN down >= {V_PCT / 100}::DOUBLE AND down >= up THEN lo.k ELSE hi.k END END AS mid FROM v2),
v4 AS (SELECT v3.venue, v3.symbol, v3.k, v3.n, v3.ts, v3.px, shape, mid, m.ts AS mid_ts, m.seq AS mid_seq, m.px AS way, max(y.k) AS kk, max(y.ts) AS end_ts, max(y.px) AS top, min(y.px) AS bottom
 FROM v3 LEFT JOIN v0 m ON m.venue = v3.venue AND m.symbol = v3.symbol AND m.k = mid LEFT JOIN v0 y ON y.venue = v3.venue AND y.symbol = v3.symbol AND y.k >= mid AND y.ts <= m.ts + {V_US} GROUP BY ALL),
v5 AS (SELECT *, (CASE WHEN shape < 0 THEN top ELSE bottom END - way) / nullif(px - way, 0) AS back, coalesce(kk > mid AND (CASE WHEN shape < 0 THEN top ELSE bottom END - way) / nullif(px - way, 0) >= {V_BACK}, false) AS hit FROM v4),
vw(venue, symbol, k) AS (SELECT venue, symbol, 1::BIGINT FROM v0 WHERE k = 1 UNION ALL SELECT v.venue, v.symbol, CASE WHEN v.mid IS NULL THEN v.k + 1 WHEN hit THEN v.kk + 1 ELSE v.mid + 1 END FROM vw JOIN v5 v ON v.venue = vw.venue AND v.symbol = vw.symbol AND v.k = vw.k WHERE vw.k <= v.n - 2),
ve AS (SELECT v.venue, v.symbol, ts AS start_ts, mid_ts, mid_seq, end_ts, shape, 100 * abs(way - px) / px AS dp_pct, back AS recovery FROM vw JOIN v5 v ON v.venue = vw.venue AND v.symbol = vw.symbol AND v.k = vw.k WHERE hit AND v.k <= v.n - 2)"""


def _vshapes(spark, sf):
    return vol.vshape_events(market.tape(spark, sf), CELL, V_PCT, V_US, V_BACK)


@query("vshape_events", f"{VSHAPE} SELECT venue, symbol, start_ts, mid_ts, mid_seq, end_ts, shape, {R('dp_pct')} AS dp_pct, {R('recovery')} AS recovery FROM ve", recursive=True)
def vshape_events(spark, sf):
    return _vshapes(spark, sf).withColumns({c: r6(F.col(c)) for c in ("dp_pct", "recovery")})


@query("quotes_near_vshapes", f"""{VSHAPE} SELECT q.venue, q.symbol, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ve WHERE ve.venue = q.venue AND ve.symbol = q.symbol AND abs(ve.mid_ts - q.ts) <= {HOUR})) AS near FROM tob q GROUP BY ALL""", recursive=True)
def quotes_near_vshapes(spark, sf):
    near = vol.near_events(market.tob(spark, sf), _vshapes(spark, sf).withColumn("ts", F.col("mid_ts")), CELL, HOUR)
    return near.groupBy(*CELL).agg(F.count("*").alias("n"), F.count(F.when(F.col("near"), 1)).alias("near"))


HOLD, PULL, MANAGE = 30 * HOUR, 8 * HOUR, 4 * HOUR
RANK = "CASE tier WHEN 'halt' THEN 4 WHEN 'size_cap' THEN 3 WHEN 'widen' THEN 2 ELSE 1 END"


@query("event_clock", f"""{EV}, c AS (SELECT t.venue, t.symbol, t.ts, t.seq, max({RANK}) FILTER (WHERE t.ts <= e.end_ts + {HOLD}) AS rank, coalesce(bool_or(e.nested AND t.ts <= e.end_ts + {PULL}), false) AS nested,
 max({{'at': e.end_ts, 'seq': e.end_seq, 'kind': e.kind, 'one': e.one, 'two': e.two}}) FILTER (WHERE t.ts <= e.end_ts + {MANAGE}) AS x FROM tape t LEFT JOIN ev e ON e.venue = t.venue AND e.symbol = t.symbol AND e.end_ts > 0 AND e.end_ts <= t.ts AND t.ts <= e.end_ts + {HOLD} GROUP BY ALL)
SELECT venue, symbol, ts, seq, CASE rank WHEN 4 THEN 'halt' WHEN 3 THEN 'size_cap' WHEN 2 THEN 'widen' WHEN 1 THEN 'observe' ELSE 'none' END AS tier, nested, x IS NOT NULL AS managed, coalesce(x.kind, 'unknown') AS kind, x.one::DOUBLE AS one, x.two::DOUBLE AS two FROM c""", recursive=True)
def event_clock(spark, sf):
    prints = market.tape(spark, sf).select(*CELL, "ts", "seq")
    return act.event_clock(prints, _events(spark, sf).withColumn("seq", F.col("end_seq")), CELL, HOLD, PULL, MANAGE)
