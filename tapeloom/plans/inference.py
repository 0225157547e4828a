"""Queries on inference: block bootstraps, shuffles, robust least squares, posteriors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.stats import POISSON, r6
from tapeloom.operators import flow, inference, options
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import HOUR
from tapeloom.plans.flow import CAL, DAYS
from tapeloom.plans.patterns import _chain
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR


def uniform(*keys: str) -> str:
    """SQL of functions.stats.draw."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13))::BIGINT / {float(16**13)})"


def poisson(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {p})::INT" for p in POISSON) + ")"


def boot(blocks: str, by: str, block: str, stat: str, draws: int, seed: int) -> str:
    """SQL of inference.block_bootstrap over `blocks`; stat names sums as {c}."""
    sums = lambda w: stat.replace("{", f"sum({w}").replace("}", ")")
    return f""", bd AS (SELECT *, unnest(range(1, {draws} + 1)) AS draw FROM {blocks}), bw AS (SELECT *, {poisson(uniform(str(seed), block, 'draw'))} AS w FROM bd),
be AS (SELECT {by}, draw, {sums('w * ')} AS v FROM bw GROUP BY {by}, draw), bq AS (SELECT {by}, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM be GROUP BY {by}),
bp AS (SELECT {by}, count(*) AS blocks, {sums('')} AS point FROM {blocks} GROUP BY {by})
SELECT {by}, blocks, {R('point')} AS point, {R('low')} AS low, {R('high')} AS high FROM bp JOIN bq USING ({by})"""


MEAN = "{x} / nullif({n}, 0)"
CORR = "CASE WHEN {n} * {xx} - {x} * {x} > 0 AND {n} * {yy} - {y} * {y} > 0 THEN ({n} * {xy} - {x} * {y}) / sqrt(({n} * {xx} - {x} * {x}) * ({n} * {yy} - {y} * {y})) END"


def _interval(rows, *by):
    return rows.select(*by, "blocks", *(r6(F.col(c)).alias(c) for c in ("point", "low", "high")))


def _days(spark, sf):
    return market.tape(spark, sf).withColumn("day", F.floor(F.col("ts") / DAY))


@query("bootstrap_mean_days", f", b AS (SELECT symbol, ts // {DAY} AS day, count(*)::DOUBLE AS n, sum(side * qty) AS x FROM tape GROUP BY ALL)" + boot("b", "symbol", "day", MEAN, 100, 7))
def bootstrap_mean_days(spark, sf):
    b = _days(spark, sf).groupBy("symbol", "day").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("side") * F.col("qty")).alias("x"))
    return _interval(inference.block_bootstrap(b, ["symbol"], "day", ["n", "x"], inference.mean_stat, 100, 7), "symbol")


@query("bootstrap_correlation_days", f", b AS (SELECT symbol, ts // {DAY} AS day, count(*)::DOUBLE AS n, sum(qty) AS x, sum(px) AS y, sum(qty * qty) AS xx, sum(px * px) AS yy, sum(qty * px) AS xy FROM tape GROUP BY ALL)" + boot("b", "symbol", "day", CORR, 100, 3))
def bootstrap_correlation_days(spark, sf):
    b = inference.pair_sums(_days(spark, sf), ["symbol", "day"], "qty", "px")
    return _interval(inference.block_bootstrap(b, ["symbol"], "day", inference.PAIR, inference.corr_stat, 100, 3), "symbol")


@query("effect_interval", f", b AS (SELECT symbol, ts // {DAY} AS day, count(*) FILTER (WHERE qty >= 4)::DOUBLE AS nt, coalesce(sum(px) FILTER (WHERE qty >= 4), 0) AS xt, count(*) FILTER (WHERE qty < 4)::DOUBLE AS nc, coalesce(sum(px) FILTER (WHERE qty < 4), 0) AS xc FROM tape GROUP BY ALL)" + boot("b", "symbol", "day", "{xt} / nullif({nt}, 0) - {xc} / nullif({nc}, 0)", 100, 5))
def effect_interval(spark, sf):
    b = inference.effect_sums(_days(spark, sf), ["symbol", "day"], F.col("qty") >= 4, "px")
    return _interval(inference.block_bootstrap(b, ["symbol"], "day", ["nt", "xt", "nc", "xc"], inference.effect_stat, 100, 5), "symbol")


@query("paired_lift_interval", f", b AS (SELECT symbol, ts // {DAY} AS day, count(*)::DOUBLE AS n, sum(side * px * greatest(0, 2 * (qty / 8) - 1) - side * px) AS x FROM tape GROUP BY ALL)" + boot("b", "symbol", "day", MEAN, 100, 9))
def paired_lift_interval(spark, sf):
    lift = F.col("side") * F.col("px") * F.greatest(F.lit(0.0), 2 * (F.col("qty") / 8) - 1) - F.col("side") * F.col("px")
    b = _days(spark, sf).groupBy("symbol", "day").agg(F.count("*").cast("double").alias("n"), F.sum(lift).alias("x"))
    return _interval(inference.block_bootstrap(b, ["symbol"], "day", ["n", "x"], inference.mean_stat, 100, 9), "symbol")


@query("noise_ratio_interval", f"""{CAL}, ck AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY ts) - 1 AS k, ln(px / lag(px, 4) OVER (PARTITION BY venue, symbol ORDER BY ts)) AS r4 FROM cr),
b AS (SELECT symbol, ts // {3 * DAY} AS day, sum(r * r) AS f, sum(r4 * r4) FILTER (WHERE k % 4 = 0) AS c FROM ck GROUP BY ALL)""" + boot("b", "symbol", "day", "{f} / nullif({c}, 0)", 100, 19))
def noise_ratio_interval(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(*CELL).orderBy("ts")
    r = flow.calendar_returns(market.tape(spark, sf), CELL, HOUR).withColumns({"k": F.row_number().over(w) - 1, "r4": F.ln(F.col("px") / F.lag("px", 4).over(w))})
    b = r.groupBy("symbol", F.floor(F.col("ts") / (3 * DAY)).alias("day")).agg(F.sum(F.col("r") * F.col("r")).alias("f"), F.sum(F.when(F.col("k") % 4 == 0, F.col("r4") * F.col("r4"))).alias("c"))
    return _interval(inference.block_bootstrap(b, ["symbol"], "day", ["f", "c"], lambda s: s["f"] / F.nullif(s["c"], F.lit(0.0)), 100, 19), "symbol")


@query("median_interval", f"""{DAYS}, i AS (SELECT venue, (buys - sells) / n AS v, symbol * 100000 + day AS item FROM dc), d AS (SELECT *, unnest(range(1, 101)) AS draw FROM i), w AS (SELECT *, {poisson(uniform('11', 'item', 'draw'))} AS w FROM d),
x AS (SELECT venue, draw, v, unnest(range(w)) AS c FROM w WHERE w > 0), m AS (SELECT venue, draw, median(v) AS v FROM x GROUP BY ALL), q AS (SELECT venue, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM m GROUP BY venue),
p AS (SELECT venue, count(*) AS n, median(v) AS median FROM i GROUP BY venue) SELECT venue, n, {R('median')} AS median, {R('low')} AS low, {R('high')} AS high FROM p JOIN q USING (venue)""")
def median_interval(spark, sf):
    d = flow.daily_counts(market.tape(spark, sf), CELL).withColumn("item", F.col("symbol") * 100000 + F.col("day"))
    m = inference.bootstrap_median(d, ["venue"], "imbalance", "item", 100, 11)
    return m.select("venue", "n", *(r6(F.col(c)).alias(c) for c in ("median", "low", "high")))


def shuffled(block: str, ranks: bool, seed: int) -> str:
    x, y = ("row_number() OVER (PARTITION BY venue ORDER BY x, item)::DOUBLE", "row_number() OVER (PARTITION BY venue ORDER BY y, item)::DOUBLE") if ranks else ("x", "y")
    return f"""{DAYS}, i AS (SELECT venue, symbol, n::DOUBLE AS x, (buys - sells) / n AS y, symbol * 100000 + day AS item FROM dc), k AS (SELECT venue, symbol, item, {x} AS x, {y} AS y FROM i),
s AS (SELECT venue, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM k GROUP BY venue),
o AS (SELECT *, abs((n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y))) AS observed FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY {block} ORDER BY item) AS i FROM k),
d AS (SELECT *, unnest(range(1, 101)) AS draw FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY {block}, draw ORDER BY {uniform(str(seed), 'item', 'draw')}, item) AS j FROM d),
c AS (SELECT a.venue, a.draw, sum(a.x * b.y) AS xy FROM d a JOIN r b ON {' AND '.join(f'a.{c} = b.{c}' for c in block.split(', '))} AND a.draw = b.draw AND a.i = b.j GROUP BY a.venue, a.draw),
z AS (SELECT c.venue, abs((o.n * c.xy - o.x * o.y) / sqrt((o.n * o.xx - o.x * o.x) * (o.n * o.yy - o.y * o.y))) AS v, o.observed, o.n FROM c JOIN o USING (venue))
SELECT venue, any_value(n) AS n, {R('any_value(observed)')} AS observed, {R('median(v)')} AS null_median, avg((v >= observed - 1e-12)::INT) AS p FROM z GROUP BY venue"""


def _shuffle(spark, sf, block, ranks, seed):
    d = flow.daily_counts(market.tape(spark, sf), CELL).withColumn("item", F.col("symbol") * 100000 + F.col("day"))
    out = inference.shuffle_test(d, ["venue"], block, "n", "imbalance", "item", 100, seed, ranks)
    return out.select("venue", "n", r6(F.col("observed")).alias("observed"), r6(F.col("null_median")).alias("null_median"), "p")


@query("shuffle_ranks", shuffled("venue", True, 1))
def shuffle_ranks(spark, sf):
    return _shuffle(spark, sf, [], True, 1)


@query("shuffle_ranks_within_blocks", shuffled("venue, symbol", True, 2))
def shuffle_ranks_within_blocks(spark, sf):
    return _shuffle(spark, sf, ["symbol"], True, 2)


@query("shuffle_values_within_blocks", shuffled("venue, symbol", False, 4))
def shuffle_values_within_blocks(spark, sf):
    return _shuffle(spark, sf, ["symbol"], False, 4)


@query("incremental_fit", f""", c AS (SELECT venue, count(*) AS n, corr(px, qty) AS a, corr(px, side) AS b, corr(qty, side) AS ab, regr_slope(px, qty) AS s, stddev_samp(qty) AS sq, stddev_samp(side) AS ss, stddev_samp(px) AS sp FROM tape GROUP BY venue)
SELECT venue, n, {R('a * a')} AS r2_one, {R('(a * a + b * b - 2 * a * b * ab) / (1 - ab * ab)')} AS r2_two, {R('s')} AS slope_one, {R('(a - b * ab) / (1 - ab * ab) * sp / sq')} AS beta_qty, {R('(b - a * ab) / (1 - ab * ab) * sp / ss')} AS beta_side,
 {R('sqrt((1 - (a * a + b * b - 2 * a * b * ab) / (1 - ab * ab)) * sp * sp * (n - 1) / (n - 3))')} AS resid_sd FROM c""")
def incremental_fit(spark, sf):
    t = market.tape(spark, sf)
    one, two = inference.ols(t, ["venue"], "px", ["qty"]), inference.ols(t, ["venue"], "px", ["qty", "side"])
    both = one.select("venue", F.col("r2").alias("r2_one"), F.element_at("beta", 2).alias("slope_one")).join(two, "venue")
    return both.select("venue", "n", r6(F.col("r2_one")).alias("r2_one"), r6(F.col("r2")).alias("r2_two"), r6(F.col("slope_one")).alias("slope_one"), r6(F.element_at("beta", 2)).alias("beta_qty"), r6(F.element_at("beta", 3)).alias("beta_side"), r6(F.col("resid_sd")).alias("resid_sd"))


def hac_sql() -> str:
    """Two regressors by demeaned sums; lags floor(4 (n / 100) ** (2 / 9)), written out up to 40."""
    terms = lambda p, q: f"sum({p} * {q})" + "".join(f" + sum(greatest(0, 1 - {l} / (lags + 1.0)) * coalesce({p} * lag_{q}_{l} + {q} * lag_{p}_{l}, 0))" for l in range(1, 21))
    lagged = ", ".join(f"lag({g}, {l}) OVER w AS lag_{g}_{l}" for g in ("ga", "gb") for l in range(1, 21))
    return f""", f AS (SELECT venue, count(*) AS n, avg(px) AS my, avg(qty) AS ma, avg(side) AS mb, regr_sxx(px, qty) AS aa, regr_sxx(px, side) AS bb, regr_sxy(side, qty) AS ab, regr_sxy(px, qty) AS ay, regr_sxy(px, side) AS yb, regr_syy(px, qty) AS yy FROM tape GROUP BY venue),
g AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS bb_, greatest(0, floor(4 * pow(n / 100, 2 / 9)))::INT AS lags FROM f),
u AS (SELECT t.venue, t.ts, t.seq, lags, (qty - ma) * (px - my - ba * (qty - ma) - bb_ * (side - mb)) AS ga, (side - mb) * (px - my - ba * (qty - ma) - bb_ * (side - mb)) AS gb FROM tape t JOIN g USING (venue)),
l AS (SELECT *, {lagged} FROM u WINDOW w AS (PARTITION BY venue ORDER BY ts, seq)),
s AS (SELECT venue, {terms('ga', 'ga')} AS saa, {terms('ga', 'gb')} AS sab, {terms('gb', 'gb')} AS sbb FROM l GROUP BY venue),
v AS (SELECT *, bb / (aa * bb - ab * ab) AS i, -ab / (aa * bb - ab * ab) AS j, aa / (aa * bb - ab * ab) AS k FROM g JOIN s USING (venue))
SELECT venue, n, {R('ba')} AS beta_qty, {R('bb_')} AS beta_side, {R('sqrt(i * i * saa + 2 * i * j * sab + j * j * sbb)')} AS se_qty, {R('sqrt(j * j * saa + 2 * j * k * sab + k * k * sbb)')} AS se_side, {R('(ba * ay + bb_ * yb) / yy')} AS r2, lags FROM v"""


@query("hac_two_regressors", hac_sql())
def hac_two_regressors(spark, sf):
    out = inference.hac_ols(market.tape(spark, sf), ["venue"], "px", ["qty", "side"], ["ts", "seq"])
    at = lambda c, k: r6(F.element_at(c, k))
    return out.select("venue", "n", at("beta", 2).alias("beta_qty"), at("beta", 3).alias("beta_side"), at("se", 2).alias("se_qty"), at("se", 3).alias("se_side"), r6(F.col("r2")).alias("r2"), "lags")


@query("slope_interval", f""", s AS (SELECT venue, month, regr_slope(y, x) AS v FROM panel GROUP BY ALL), m AS (SELECT venue, count(v) AS n, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS se FROM s WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY venue)
SELECT venue, n, {R('mean')} AS mean, {R('se')} AS se, {R('mean - 1.959963984540054 * se')} AS low, {R('mean + 1.959963984540054 * se')} AS high FROM m""")
def slope_interval(spark, sf):
    s = market.panel(spark, sf).groupBy("venue", "month").agg(F.regr_slope("y", "x").alias("v"))
    return inference.mean_interval(s, ["venue"], "v").select("venue", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "se", "low", "high")))


@query("correlation_posterior", f""", c AS (SELECT venue, count(*) AS n, corr(x, y) AS r FROM panel GROUP BY venue), z AS (SELECT *, (2.0 * 0.1 + (n - 3) * ln((1 + r) / (1 - r)) / 2) / (2.0 + n - 3) AS z, 1 / sqrt(2.0 + n - 3) AS sd FROM c)
SELECT venue, n, {R('(exp(2 * z) - 1) / (exp(2 * z) + 1)')} AS mean_r, {R('(exp(2 * (z - 1.96 * sd)) - 1) / (exp(2 * (z - 1.96 * sd)) + 1)')} AS low_r, {R('(exp(2 * (z + 1.96 * sd)) - 1) / (exp(2 * (z + 1.96 * sd)) + 1)')} AS high_r FROM z""")
def correlation_posterior(spark, sf):
    c = market.panel(spark, sf).groupBy("venue").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return c.select("venue", "n", *(r6(v).alias(k) for k, v in inference.correlation_posterior(F.col("r"), F.col("n"), 0.1, 2.0).items()))


def cdf(x: str) -> str:
    """SQL of options.norm_cdf: the same polynomial."""
    t = f"(1 / (1 + {options._ERF_P} * abs({x}) / sqrt(2.0)))"
    poly = "0"
    for c in reversed(options._ERF):
        poly = f"(({poly}) + {c}) * {t}"
    return f"(0.5 + sign({x}) * (1 - ({poly}) * exp(-({x}) * ({x}) / 2)) / 2)"


@query("p_from_interval", f""", s AS (SELECT venue, symbol, avg(side * qty) AS m, stddev_samp(side * qty) / sqrt(count(*)) AS se FROM tape GROUP BY ALL), h AS (SELECT *, m - 2 * se AS low, m + 2 * se AS high, 2 * (1 - {cdf('(abs(m) / (2 * se))')}) AS tail FROM s)
SELECT venue, symbol, {R('CASE WHEN low > 0 OR high < 0 THEN greatest(0.001, least(0.2, tail)) ELSE greatest(0.2, least(1.0, tail)) END')} AS p FROM h""")
def p_from_interval(spark, sf):
    v = F.col("side") * F.col("qty")
    s = market.tape(spark, sf).groupBy(*CELL).agg(F.avg(v).alias("m"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("se"))
    return s.select(*CELL, r6(inference.p_from_interval(F.col("m"), F.col("m") - 2 * F.col("se"), F.col("m") + 2 * F.col("se"))).alias("p"))


@query("delta_shock", f""", c AS (SELECT *, CASE WHEN iv > 1.5 THEN iv / 100 ELSE iv END AS v FROM chain), d AS (SELECT instrument_id, flag, (ln(1200.0 / strike) + iv * iv / 2 * ttm_years) / (iv * sqrt(ttm_years)) AS a, (ln(1212.0 / strike) + (iv + 0.01) * (iv + 0.01) / 2 * ttm_years) / ((iv + 0.01) * sqrt(ttm_years)) AS b FROM chain)
SELECT instrument_id, {R(f"{cdf('b')} - {cdf('a')}")} AS d_delta FROM d""")
def delta_shock(spark, sf):
    d = options.delta_shock(F.col("flag"), F.lit(1200.0), F.col("strike"), F.col("ttm_years"), 0.0, F.col("iv"), 12.0, 0.01)
    return _chain(spark, sf).select("instrument_id", r6(d).alias("d_delta"))


@query("poisson_rates", f""", c AS (SELECT venue, symbol, count(*) AS k, (max(ts) - min(ts)) / {float(DAY)} AS e FROM tape GROUP BY ALL), m AS (SELECT avg(k / e) AS mu, var_samp(k / e) AS v FROM c), h AS (SELECT 0.5 * greatest(0.5, mu * mu / v) + 0.5 AS a, 0.5 * greatest(0.5, mu / v) + 0.5 AS b FROM m)
SELECT venue, symbol, {R('k / e')} AS rate, {R('(k + 1) / (e + 1)')} AS posterior, {R('(k + a) / (e + b)')} AS shrunk, {R('(k + 1) / (e + 1) * pow(greatest(0, 1 - 1 / (9.0 * (k + 1)) - 1.959963984540054 / (3 * sqrt(k + 1))), 3)')} AS low FROM c, h""")
def poisson_rates(spark, sf):
    c = market.tape(spark, sf).groupBy(*CELL).agg(F.count("*").alias("k"), ((F.max("ts") - F.min("ts")) / float(DAY)).alias("e"))
    out = inference.poisson_shrinkage(c, "k", "e").withColumn("low", inference.gamma_posterior(F.col("k"), F.col("e"))["low"])
    return out.select(*CELL, *(r6(F.col(v)).alias(v) for v in ("rate", "posterior", "shrunk", "low")))


@query("prior_sensitivity", f""", b AS (SELECT venue, count(*) FILTER (WHERE side > 0) AS hits, count(*) AS trials FROM tape GROUP BY venue), p AS (SELECT * FROM (VALUES (1.0, 1.0, 'uniform'), (0.5, 0.5, 'jeffreys'), (2.0, 2.0, 'weak_shrink_0.5'), (1.0, 19.0, 'skeptical_p05'), (1.0, 99.0, 'skeptical_p01')) v(a0, b0, prior))
SELECT venue, prior, {R('(a0 + hits)::DOUBLE / (a0 + b0 + trials)')} AS mean FROM b, p""")
def prior_sensitivity(spark, sf):
    b = market.tape(spark, sf).groupBy("venue").agg(F.count(F.when(F.col("side") > 0, 1)).alias("hits"), F.count("*").alias("trials"))
    return inference.prior_sensitivity(b, "hits", "trials").select("venue", "prior", r6(F.col("mean")).alias("mean"))


@query("split_signs", f"""{DAYS}, k AS (SELECT *, (buys - sells) / n AS v, row_number() OVER (PARTITION BY venue, symbol ORDER BY day) <= greatest(1, count(*) OVER (PARTITION BY venue, symbol) // 2) AS early FROM dc),
s AS (SELECT venue, symbol, avg(v) FILTER (WHERE early) AS e, avg(v) FILTER (WHERE NOT early) AS l FROM k GROUP BY ALL) SELECT venue, symbol, {R('e')} AS early, {R('l')} AS late, coalesce(e * l > 1e-15, false) AS same_sign FROM s""")
def split_signs(spark, sf):
    s = inference.split_signs(flow.daily_counts(market.tape(spark, sf), CELL), CELL, "day", "imbalance")
    return s.select(*CELL, r6(F.col("early")).alias("early"), r6(F.col("late")).alias("late"), "same_sign")


@query("markout_by_tick_quartile", f""", h AS (SELECT venue, symbol, ts // {12 * HOUR} AS hour, 0.01 / median(mid) AS x, count(*) AS quotes FROM tob GROUP BY ALL), t AS (SELECT venue, symbol, ts // {12 * HOUR} AS hour, avg(side * (px - 100)) AS y, count(*) AS trades FROM tape GROUP BY ALL),
j AS (SELECT * FROM h JOIN t USING (venue, symbol, hour) WHERE quotes >= 2 AND trades >= 2), e AS (SELECT venue, quantile_cont(x, [0.25, 0.5, 0.75]) AS e FROM j GROUP BY venue)
SELECT venue, 1 + (x >= e[1])::INT + (x >= e[2])::INT + (x >= e[3])::INT AS quartile, count(*) AS n, {R('avg(y)')} AS mean FROM j JOIN e USING (venue) GROUP BY venue, quartile""")
def markout_by_tick_quartile(spark, sf):
    hour = F.floor(F.col("ts") / (12 * HOUR)).alias("hour")
    h = market.tob(spark, sf).groupBy(*CELL, hour).agg((0.01 / F.median("mid")).alias("x"), F.count("*").alias("quotes"))
    t = market.tape(spark, sf).groupBy(*CELL, hour).agg(F.avg(F.col("side") * (F.col("px") - 100)).alias("y"), F.count("*").alias("trades"))
    q = inference.quartile_means(h.join(t, [*CELL, "hour"]).where("quotes >= 2 AND trades >= 2"), ["venue"], "x", "y")
    return q.select("venue", "quartile", "n", r6(F.col("mean")).alias("mean"))


@query("calibration", f""", p AS (SELECT venue, (side > 0)::INT::DOUBLE AS y, 1 / (1 + exp(-(px - 100) / 2)) AS p, seq FROM tape), b AS (SELECT *, floor((row_number() OVER (PARTITION BY venue ORDER BY p, seq) - 1) * 5 / count(*) OVER (PARTITION BY venue))::INT AS bin FROM p)
SELECT venue, bin, count(*) AS n, {R('avg(p)')} AS predicted, {R('avg(y)')} AS seen FROM b GROUP BY ALL""")
def calibration(spark, sf):
    p = market.tape(spark, sf).select("venue", "seq", (F.col("side") > 0).cast("double").alias("y"), (1 / (1 + F.exp(-(F.col("px") - 100) / 2))).alias("p"))
    return inference.calibration_bins(p, ["venue"], "y", "p", "seq").select("venue", "bin", "n", r6(F.col("predicted")).alias("predicted"), r6(F.col("seen")).alias("seen"))


@query("brier_score", f", p AS (SELECT venue, (side > 0)::INT::DOUBLE AS y, 1 / (1 + exp(-(px - 100) / 2)) AS p FROM tape) SELECT venue, {R('avg((y - p) * (y - p))')} AS brier, {R('avg(y) * (1 - avg(y))')} AS base FROM p GROUP BY venue")
def brier_score(spark, sf):
    p = market.tape(spark, sf).select("venue", (F.col("side") > 0).cast("double").alias("y"), (1 / (1 + F.exp(-(F.col("px") - 100) / 2))).alias("p"))
    return p.groupBy("venue").agg(*(r6(v).alias(k) for k, v in inference.brier(F.col("y"), F.col("p")).items()))
