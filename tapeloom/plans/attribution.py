"""Queries on what effects are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.stats import log_change, r6
from tapeloom.operators import attribution, flow
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import HOUR
from tapeloom.plans.decisions import EV, _events
from tapeloom.plans.flow import CAL, W
from tapeloom.plans.inference import boot, poisson, uniform
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR
BAR, BARS = 0.05, [0.01, 0.05, 0.25, 1.0, 4.0]
DELTA = "{xt} / nullif({nt}, 0) - {xc} / nullif({nc}, 0)"
_half = lambda d: DELTA.replace("{", "sum(").replace("}", f") FILTER (WHERE day % 2 = {d})")
FX = f"""{EV}, dv AS (SELECT venue, start_ts // {DAY} AS day, abs(mo5) AS hold, tier <> 'observe' AS fire FROM ev), db AS (SELECT venue, day, count(*) FILTER (WHERE fire)::DOUBLE AS nt, coalesce(sum(hold) FILTER (WHERE fire), 0) AS xt, count(*) FILTER (WHERE NOT fire)::DOUBLE AS nc, coalesce(sum(hold) FILTER (WHERE NOT fire), 0) AS xc FROM dv GROUP BY ALL)
{boot('db', 'venue', 'day', DELTA, 80, 55).rsplit('SELECT', 1)[0]}, dh AS (SELECT venue, sum(nt)::BIGINT AS n_treated, sum(nc)::BIGINT AS n_control, sum(xt) / nullif(sum(nt), 0) AS treated_mean, sum(xc) / nullif(sum(nc), 0) AS control_mean, {_half(0)} AS e, {_half(1)} AS l FROM db GROUP BY venue),
dx AS (SELECT *, coalesce(low > 0 OR high < 0, false) AS o, coalesce((low > 0 OR high < 0) AND point > {BAR}, false) AS cleared, coalesce(e <> 0 AND l <> 0 AND (e > 0) = (l > 0), false) AS s FROM dh JOIN bq USING (venue) JOIN bp USING (venue) WHERE low IS NOT NULL)"""


def _effects(spark, sf):
    e = _events(spark, sf).select("venue", F.floor(F.col("start_ts") / DAY).alias("day"), F.abs("mo5").alias("hold"), (F.col("tier") != "observe").alias("fire"))
    return attribution.effect_verdicts(e, ["venue"], "day", F.col("fire"), "hold", F.col("day") % 2 == 0, F.col("day") % 2 == 1, BAR, 10, 80, 55)


@query("effect_verdicts", f"""{FX} SELECT venue, n_treated, n_control, {R('treated_mean')} AS treated_mean, {R('control_mean')} AS control_mean, {R('point')} AS delta, {R('low')} AS low, {R('high')} AS high, {R('e')} AS early_delta, {R('l')} AS late_delta, cleared,
CASE WHEN high < 0 AND point < 0 THEN 'Kill' WHEN n_treated < 10 THEN 'Hold' WHEN point <= 0 THEN 'Kill' WHEN NOT o THEN 'Hold' WHEN NOT s THEN 'Kill' WHEN NOT cleared THEN 'Hold' ELSE 'Promote' END AS verdict FROM dx""", recursive=True)
def effect_verdicts(spark, sf):
    return _effects(spark, sf).withColumns({c: r6(F.col(c)) for c in ("treated_mean", "control_mean", "delta", "low", "high", "early_delta", "late_delta")})


@query("cost_sweep", f"""{FX}, ds AS (SELECT venue, point, low, unnest({BARS}::DOUBLE[]) AS bar FROM dx), dc AS (SELECT *, low > 0 AND point > bar AS clears, min(bar) FILTER (WHERE NOT (low > 0 AND point > bar)) OVER (PARTITION BY venue) AS break_bar FROM ds)
SELECT venue, bar, {R('point')} AS delta, {R('low')} AS low, clears, break_bar, coalesce(break_bar > {BAR}, true) AS survives FROM dc""", recursive=True)
def cost_sweep(spark, sf):
    return attribution.cost_sweep(_effects(spark, sf), ["venue"], BARS, BAR).withColumns({c: r6(F.col(c)) for c in ("delta", "low")})


@query("driver_by_venue", f""", gd AS (SELECT symbol, ts // {DAY} AS day, sum(side * qty) AS g FROM tape GROUP BY ALL), gl AS (SELECT symbol, venue, ts // {DAY} AS day, ln(px / lag(px) OVER {W}) AS c FROM tape WHERE px > 0),
gv AS (SELECT symbol, venue, day, sum(c * c) AS rv FROM gl GROUP BY ALL), gw AS (SELECT symbol, day, max(rv) FILTER (WHERE venue = 0) AS v0, max(rv) FILTER (WHERE venue = 1) AS v1 FROM gv WHERE venue < 2 GROUP BY ALL),
gj AS (SELECT symbol, day, g, v0, v1, CASE WHEN v1 IS NOT NULL THEN v0 END AS b0, CASE WHEN v0 IS NOT NULL THEN v1 END AS b1 FROM gd JOIN gw USING (symbol, day)),
gz AS (SELECT *, ((b0 - avg(b0) OVER s) / (stddev_pop(b0) OVER s + 1e-12) + (b1 - avg(b1) OVER s) / (stddev_pop(b1) OVER s + 1e-12)) / 2 AS j FROM gj WINDOW s AS (PARTITION BY symbol)),
gn AS (SELECT symbol, day, g, unnest([{{'leg': '0', 'v': v0}}, {{'leg': '1', 'v': v1}}, {{'leg': 'joint', 'v': j}}]) AS q FROM gz),
gr AS (SELECT symbol, q.leg AS leg, g, q.v AS v, row_number() OVER (PARTITION BY symbol, q.leg ORDER BY g, day) AS a, row_number() OVER (PARTITION BY symbol, q.leg ORDER BY round(q.v, 12), day) AS b FROM gn WHERE q.v IS NOT NULL),
gc AS (SELECT symbol, leg, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(g) > 0 AND stddev_pop(v) > 0 THEN corr(g, v) END AS corr, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS rank_corr FROM gr GROUP BY ALL)
SELECT symbol, leg, n, {R('corr')} AS corr, {R('rank_corr')} AS rank_corr, coalesce(sign(max(corr) FILTER (WHERE leg = '0') OVER k) = sign(max(corr) FILTER (WHERE leg = '1') OVER k), false) AS concordant FROM gc WINDOW k AS (PARTITION BY symbol)""")
def driver_by_venue(spark, sf):
    t, day = market.tape(spark, sf), F.floor(F.col("ts") / DAY).alias("day")
    driver = t.groupBy("symbol", day).agg(F.sum(F.col("side") * F.col("qty")).alias("driver"))
    value = t.where("px > 0").withColumn("c", log_change("px", CELL)).groupBy("symbol", "venue", day).agg(F.sum(F.col("c") * F.col("c")).alias("value"))
    out = attribution.driver_by_leg(driver, value, ["symbol"], "day", "venue", [0, 1])
    return out.withColumns({c: r6(F.col(c)) for c in ("corr", "rank_corr")})


@query("flow_against_parts", f"""{CAL}, lk AS (SELECT venue, symbol, ts // {DAY} * {DAY} AS bar, sum(r) AS r FROM cr GROUP BY ALL HAVING sum(r) IS NOT NULL), lm AS (SELECT o.*, b.r AS m FROM lk o JOIN lk b ON b.venue = o.venue AND b.bar = o.bar AND b.symbol = 0 WHERE o.symbol <> 0),
lf AS (SELECT venue, symbol, regr_slope(r, m) AS beta, regr_intercept(r, m) AS alpha FROM lm GROUP BY ALL), lt AS (SELECT venue, symbol, min(ts) AS t0 FROM tape GROUP BY ALL),
ls AS (SELECT venue, symbol, (ts - t0) // {4 * DAY} AS slot, sum(side * qty) / sum(qty) AS rho FROM tape JOIN lt USING (venue, symbol) GROUP BY ALL),
lx AS (SELECT m.venue, m.symbol, m.bar, s.rho, round(abs(m.r - alpha - beta * m.m), 12) AS own, round(abs(beta * m.m), 12) AS common FROM lm m JOIN lf f ON f.venue = m.venue AND f.symbol = m.symbol JOIN lt t ON t.venue = m.venue AND t.symbol = m.symbol JOIN ls s ON s.venue = m.venue AND s.symbol = m.symbol AND s.slot = floor((m.bar - t0) / {float(4 * DAY)})),
lr AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY rho, bar) AS a, row_number() OVER (PARTITION BY venue, symbol ORDER BY own, bar) AS b, row_number() OVER (PARTITION BY venue, symbol ORDER BY common, bar) AS c FROM lx)
SELECT venue, symbol, count(*) AS n, {R('corr(a, b)')} AS rho_own, {R('corr(a, c)')} AS rho_common, {R('1e4 * avg(own)')} AS mean_own, {R('1e4 * avg(common)')} AS mean_common FROM lr GROUP BY ALL HAVING count(*) >= 10""")
def flow_against_parts(spark, sf):
    t = market.tape(spark, sf)
    r = flow.calendar_returns(t, CELL, HOUR).groupBy(*CELL, (F.floor(F.col("ts") / DAY) * DAY).alias("bar")).agg(F.sum("r").alias("r"))
    base = r.where("symbol = 0").select("venue", "bar", F.col("r").alias("m"))
    out = attribution.flow_against_parts(attribution.market_model(r.where("symbol <> 0"), base, CELL, "bar"), t, CELL, "bar", 4 * DAY, 10)
    return out.select(*CELL, "n", r6(F.col("rho_own")).alias("rho_own"), r6(F.col("rho_common")).alias("rho_common"), r6(1e4 * F.col("mean_own")).alias("mean_own"), r6(1e4 * F.col("mean_common")).alias("mean_common"))


INFO = f""", ia AS (SELECT venue, symbol, ts // {DAY} AS day, ln(px / lag(px) OVER {W}) AS c, qty FROM tape WHERE px > 0), ib AS (SELECT venue, symbol, day, sqrt(sum(c * c) / (2 * count(c))) AS noise, sum(qty) AS volume, count(*)::DOUBLE AS trades FROM ia GROUP BY ALL HAVING count(c) > 0),
ic AS (SELECT venue, symbol, ts // {DAY} AS day, avg(1e4 * (ask - bid) / mid) AS spread FROM tob GROUP BY ALL), ip AS (SELECT venue, symbol, day * 3 + venue AS item, noise, volume, trades, spread FROM ib LEFT JOIN ic USING (venue, symbol, day))"""


def ranked(pairs: str, keys: str, draws: int) -> str:
    """SQL of attribution.rank_matrix over `pairs` of keys, item, a and b."""
    names = keys.split(", ")
    same = " AND ".join(f"p.{c} = q.{c}" for c in names)
    w = f"PARTITION BY {keys}, draw ORDER BY"
    n, a, b = "sum(w)", "sum(w * ra)", "sum(w * rb)"
    corr = f"({n} * sum(w * ra * rb) - {a} * {b}) / sqrt(({n} * sum(w * ra * ra) - {a} * {a}) * ({n} * sum(w * rb * rb) - {b} * {b}))"
    return f""", ra AS (SELECT * FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL QUALIFY count(*) OVER (PARTITION BY {keys}) >= 5), rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY a, item) AS i, row_number() OVER (PARTITION BY {keys} ORDER BY b, item) AS j, row_number() OVER (PARTITION BY {keys} ORDER BY item) AS k FROM ra),
rp AS (SELECT {keys}, count(*) AS n, corr(i, j) AS rho FROM rk GROUP BY {keys}), rd AS (SELECT *, unnest(range(1, {draws + 1})) AS draw FROM rk),
rw AS (SELECT *, {poisson(uniform('7', 'item', 'draw'))} AS w FROM rd), rm AS (SELECT *, (sum(w) OVER ({w} a, item ROWS UNBOUNDED PRECEDING) - (w - 1) / 2.0)::DOUBLE AS ra, (sum(w) OVER ({w} b, item ROWS UNBOUNDED PRECEDING) - (w - 1) / 2.0)::DOUBLE AS rb FROM rw WHERE w > 0),
re AS (SELECT {keys}, draw, {corr} AS v FROM rm GROUP BY {keys}, draw), rq AS (SELECT {keys}, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM re GROUP BY {keys}),
rs AS (SELECT *, row_number() OVER ({w} {uniform('7', 'item', 'draw')}, item) AS l FROM rd), rn AS (SELECT {', '.join(f'p.{c}' for c in names)}, p.draw, corr(p.i, q.j) AS v FROM rd p JOIN rs q ON {same} AND p.draw = q.draw AND p.k = q.l GROUP BY ALL),
rz AS (SELECT {keys}, avg((abs(v) >= abs(rho) - 1e-12)::INT) AS p FROM rn JOIN rp USING ({keys}) GROUP BY {keys})
SELECT {keys}, n, {R('rho')} AS rho, {R('low')} AS low, {R('high')} AS high, p FROM rp JOIN rq USING ({keys}) JOIN rz USING ({keys})"""


def _information(spark, sf):
    t, day = market.tape(spark, sf).where("px > 0").withColumn("c", log_change("px", CELL)), F.floor(F.col("ts") / DAY).alias("day")
    b = t.groupBy(*CELL, day).agg(F.sqrt(F.sum(F.col("c") * F.col("c")) / (2 * F.nullif(F.count("c"), F.lit(0)))).alias("noise"), F.sum("qty").alias("volume"), F.count("*").cast("double").alias("trades"))
    q = market.tob(spark, sf).groupBy(*CELL, day).agg(F.avg(1e4 * (F.col("ask") - F.col("bid")) / F.col("mid")).alias("spread"))
    return b.where("noise IS NOT NULL").join(q, [*CELL, "day"], "left").withColumn("item", F.col("day") * 3 + F.col("venue"))


def _matrix(rows):
    return rows.withColumns({c: r6(F.col(c)) for c in ("rho", "low", "high")})


PAIRS = ", ".join(f"{{'x': '{x}', 'y': '{y}', 'a': {x}, 'b': {y}}}" for x in ("noise", "volume") for y in ("spread", "trades"))


@query("information_content", f"{INFO}, ij AS (SELECT symbol, item, q.x AS x, q.y AS y, round(q.a, 12) AS a, round(q.b, 12) AS b FROM (SELECT symbol, item, unnest([{PAIRS}]) AS q FROM ip))" + ranked("ij", "symbol, x, y", 30))
def information_content(spark, sf):
    return _matrix(attribution.rank_matrix(_information(spark, sf), ["symbol"], "item", ["noise", "volume"], ["spread", "trades"], 30))


@query("information_regimes", f"{INFO}, im AS (SELECT symbol, median(trades) AS m FROM ip GROUP BY symbol HAVING count(*) >= 20), ij AS (SELECT symbol, CASE WHEN trades >= m THEN 'high' ELSE 'low' END AS regime, item, 'noise' AS x, 'spread' AS y, round(noise, 12) AS a, round(spread, 12) AS b FROM ip JOIN im USING (symbol))" + ranked("ij", "symbol, regime, x, y", 30))
def information_regimes(spark, sf):
    return _matrix(attribution.rank_matrix(attribution.regimes(_information(spark, sf), ["symbol"], "trades"), ["symbol", "regime"], "item", ["noise"], ["spread"], 30))
