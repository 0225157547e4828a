"""Queries on trade flow and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.stats import div, ols2, r6
from tapeloom.operators import flow
from tapeloom.operators.temporal import asof, before
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import ASOF, HOUR
from tapeloom.sources import market
from tapeloom.sources.market import CELL

W = "(PARTITION BY venue, symbol ORDER BY ts, seq)"


@query("fragmentation_index", f""", v AS (SELECT symbol, venue, sum(qty) AS q FROM tape GROUP BY ALL), s AS (SELECT symbol, q / sum(q) OVER (PARTITION BY symbol) AS p FROM v)
SELECT symbol, {R("-sum(p * ln(p)) / ln(count(*))")} AS fei FROM s GROUP BY symbol""")
def fragmentation_index(spark, sf):
    v = market.tape(spark, sf).groupBy("symbol", "venue").agg(F.sum("qty").alias("q"))
    return flow.fei(v, ["symbol"], "q").select("symbol", r6(F.col("fei")).alias("fei"))


@query("volume_herfindahl", f""", v AS (SELECT symbol, venue, sum(qty) AS q FROM tape GROUP BY ALL), s AS (SELECT symbol, q / sum(q) OVER (PARTITION BY symbol) AS p FROM v)
SELECT symbol, count(*) AS venues, {R("sum(p * p)")} AS hhi FROM s GROUP BY symbol""")
def volume_herfindahl(spark, sf):
    from pyspark.sql import Window

    v = market.tape(spark, sf).groupBy("symbol", "venue").agg(F.sum("qty").alias("q"))
    p = v.withColumn("p", F.col("q") / F.sum("q").over(Window.partitionBy("symbol")))
    return p.groupBy("symbol").agg(F.count("*").alias("venues"), r6(F.sum(F.col("p") * F.col("p"))).alias("hhi"))


@query("pov_schedule", f"""SELECT venue, symbol, {R("sum(least(qty * 0.05, 0.3))")} AS filled, {R("sum(least(qty * 0.05, 0.3) * px) / sum(least(qty * 0.05, 0.3))")} AS vwap, arg_min(px, seq) AS arrival,
{R("1e4 * (sum(least(qty * 0.05, 0.3) * px) / sum(least(qty * 0.05, 0.3)) - arg_min(px, seq)) / arg_min(px, seq)")} AS impact_bps FROM tape GROUP BY ALL""")
def pov_schedule(spark, sf):
    out = flow.participation(market.tape(spark, sf), CELL, 0.05, 1, 0.3)
    return out.select(*CELL, r6(F.col("filled")).alias("filled"), r6(F.col("vwap")).alias("vwap"), "arrival", r6(F.col("impact_bps")).alias("impact_bps"))


def _epps(step):
    return f"""SELECT symbol, a.venue AS a, b.venue AS b, {step} AS step, count(*) AS n, {R("CASE WHEN count(*) >= 5 THEN corr(a.r, b.r) END")} AS corr
FROM e{step} a JOIN e{step} b USING (symbol, ts) WHERE a.venue < b.venue AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL"""


def _epps_grid(step):
    return f""", g{step} AS (SELECT venue, symbol, unnest(generate_series(((min(ts) + {step} - 1) // {step} * {step})::BIGINT, (max(ts) // {step} * {step})::BIGINT, {step}::BIGINT)) AS ts FROM tape GROUP BY venue, symbol),
p{step} AS (SELECT g.venue, g.symbol, g.ts, t.px FROM g{step} g ASOF LEFT JOIN tape t ON g.venue = t.venue AND g.symbol = t.symbol AND g.ts >= t.ts),
e{step} AS (SELECT *, ln(px / lag(px) OVER (PARTITION BY venue, symbol ORDER BY ts)) AS r FROM p{step})"""


@query("epps_curve", _epps_grid(4 * HOUR) + _epps_grid(24 * HOUR) + "\n" + _epps(4 * HOUR) + "\nUNION ALL " + _epps(24 * HOUR))
def epps_curve(spark, sf):
    out = flow.corr_by_step(market.tape(spark, sf), ["symbol"], "venue", [4 * HOUR, 24 * HOUR])
    return out.select("symbol", "a", "b", "step", "n", r6(F.col("corr")).alias("corr"))


@query("beta_and_variance_share", f""", m AS (SELECT month, avg(y) AS fx FROM panel GROUP BY month), v AS (SELECT venue, month, avg(y) AS y FROM panel GROUP BY ALL)
SELECT venue, count(*) AS n, {R("regr_slope(y, fx)")} AS beta, {R("regr_r2(y, fx)")} AS r2, {R("least(1, greatest(0, pow(regr_slope(y, fx), 2) * var_pop(fx) / var_pop(y)))")} AS systematic FROM v JOIN m USING (month) GROUP BY venue""")
def beta_and_variance_share(spark, sf):
    p = market.panel(spark, sf)
    rows = p.groupBy("venue", "month").agg(F.avg("y").alias("y")).join(p.groupBy("month").agg(F.avg("y").alias("fx")), "month")
    beta = F.regr_slope("y", "fx")
    return rows.groupBy("venue").agg(F.count("*").alias("n"), r6(beta).alias("beta"), r6(F.regr_r2("y", "fx")).alias("r2"), r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), div(beta * beta * F.var_pop("fx"), F.var_pop("y"))))).alias("systematic"))


CAL = f""", cg AS (SELECT venue, symbol, unnest(generate_series(min(ts), max(ts), {HOUR}::BIGINT)) AS ts FROM tape GROUP BY venue, symbol),
cp AS (SELECT g.venue, g.symbol, g.ts, t.px FROM cg g ASOF LEFT JOIN tape t ON g.venue = t.venue AND g.symbol = t.symbol AND g.ts >= t.ts),
cr AS (SELECT *, ln(px / lag(px) OVER (PARTITION BY venue, symbol ORDER BY ts)) AS r FROM cp)
"""


@query("calendar_realized_variance", f"{CAL} SELECT venue, symbol, count(r) AS n, {R('sum(r * r)')} AS rv FROM cr GROUP BY ALL")
def calendar_realized_variance(spark, sf):
    r = flow.calendar_returns(market.tape(spark, sf), CELL, HOUR)
    return r.groupBy(*CELL).agg(F.count("r").alias("n"), r6(F.sum(F.col("r") * F.col("r"))).alias("rv"))


@query("volume_multiple_bars", f""", c AS (SELECT *, sum(qty) OVER {W} AS total FROM tape), b AS (SELECT venue, symbol, px, seq, unnest(generate_series(floor((total - qty) / 25)::BIGINT + 1, floor(total / 25)::BIGINT)) AS bar FROM c)
SELECT venue, symbol, count(*) AS bars, {R("sum(px * bar)")} AS checksum FROM b GROUP BY ALL""")
def volume_multiple_bars(spark, sf):
    b = flow.volume_multiples(market.tape(spark, sf), CELL, 25.0)
    return b.groupBy(*CELL).agg(F.count("*").alias("bars"), r6(F.sum(F.col("px") * F.col("bar"))).alias("checksum"))


BUCKETS = """, o AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY ts, seq) AS k FROM tape),
f(venue, symbol, k, vol, net, done) AS (
  SELECT venue, symbol, k, qty, side * qty, qty >= 20 FROM o WHERE k = 1
  UNION ALL
  SELECT o.venue, o.symbol, o.k, CASE WHEN f.done THEN 0 ELSE f.vol END + o.qty, CASE WHEN f.done THEN 0 ELSE f.net END + o.side * o.qty, CASE WHEN f.done THEN 0 ELSE f.vol END + o.qty >= 20
  FROM f JOIN o ON o.venue = f.venue AND o.symbol = f.symbol AND o.k = f.k + 1),
vb AS (SELECT f.venue, f.symbol, row_number() OVER (PARTITION BY f.venue, f.symbol ORDER BY f.k) AS bucket, o.ts AS end_ts, o.px, f.vol, f.net, abs(f.net) / f.vol AS imbalance
  FROM f JOIN o ON o.venue = f.venue AND o.symbol = f.symbol AND o.k = f.k WHERE f.done)
"""


@query("vpin_reset_buckets", f"{BUCKETS} SELECT venue, symbol, count(*) AS buckets, {R('avg(imbalance)')} AS imbalance, {R('sum(vol)')} AS volume FROM vb GROUP BY ALL", recursive=True)
def vpin_reset_buckets(spark, sf):
    b = flow.volume_buckets(market.tape(spark, sf), CELL, 20.0)
    return b.groupBy(*CELL).agg(F.count("*").alias("buckets"), r6(F.avg("imbalance")).alias("imbalance"), r6(F.sum("volume")).alias("volume"))


@query("vpin_rolling", f"""{BUCKETS}, vr AS (SELECT *, CASE WHEN bucket >= 10 THEN avg(imbalance) OVER (PARTITION BY venue, symbol ORDER BY bucket ROWS 9 PRECEDING) END AS vpin FROM vb)
SELECT venue, symbol, count(vpin) AS n, {R("avg(vpin)")} AS mean, {R("median(vpin)")} AS median, {R("arg_max(vpin, bucket)")} AS last FROM vr GROUP BY ALL""", recursive=True)
def vpin_rolling(spark, sf):
    b = flow.rolling_vpin(flow.volume_buckets(market.tape(spark, sf), CELL, 20.0), CELL, 10)
    return b.groupBy(*CELL).agg(F.count("vpin").alias("n"), r6(F.avg("vpin")).alias("mean"), r6(F.median("vpin")).alias("median"), r6(F.max_by("vpin", "bucket")).alias("last"))


@query("volume_bucket_panel", f"""{BUCKETS}, vl AS (SELECT *, px - lag(px) OVER (PARTITION BY venue, symbol ORDER BY bucket) AS dp FROM vb)
SELECT venue, symbol, count(dp) AS n, {R("regr_slope(dp, sign(net))")} AS slope FROM vl WHERE net <> 0 GROUP BY ALL""", recursive=True)
def volume_bucket_panel(spark, sf):
    from pyspark.sql import Window

    b = flow.volume_buckets(market.tape(spark, sf), CELL, 20.0).withColumn("dp", F.col("px") - F.lag("px").over(Window.partitionBy(*CELL).orderBy("bucket"))).where("net <> 0")
    return b.groupBy(*CELL).agg(F.count("dp").alias("n"), r6(F.regr_slope("dp", F.signum("net"))).alias("slope"))


OFI = f""", of AS (SELECT *, CASE WHEN pb IS NOT NULL THEN (CASE WHEN bid >= pb THEN bid_sz ELSE 0 END) - (CASE WHEN bid <= pb THEN ps ELSE 0 END)
  - (CASE WHEN ask <= pa THEN ask_sz ELSE 0 END) + (CASE WHEN ask >= pa THEN pz ELSE 0 END) END AS ofi
  FROM (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bid_sz) OVER w AS ps, lag(ask_sz) OVER w AS pz FROM tob WINDOW w AS {W})),
ob AS (SELECT venue, symbol, ts // {8 * HOUR} AS bar, sum(ofi) AS ofi, arg_max(mid, seq) AS mid FROM of GROUP BY ALL),
ox AS (SELECT *, ln(mid / lag(mid) OVER (PARTITION BY venue, symbol ORDER BY bar)) AS r FROM ob)
"""


@query("ofi_bars", f"{OFI} SELECT venue, symbol, count(*) AS bars, {R('sum(ofi)')} AS ofi, {R('corr(r, ofi)')} AS corr, {R('regr_slope(r, ofi) * 1e4')} AS slope FROM ox GROUP BY ALL")
def ofi_bars(spark, sf):
    from pyspark.sql import Window

    bar = F.floor(F.col("ts") / (8 * HOUR)).alias("bar")
    b = flow.order_flow(market.tob(spark, sf), CELL).groupBy(*CELL, bar).agg(F.sum("ofi").alias("ofi"), F.max_by("mid", F.struct("ts", "seq")).alias("mid"))
    b = b.withColumn("r", F.ln(F.col("mid") / F.lag("mid").over(Window.partitionBy(*CELL).orderBy("bar"))))
    return b.groupBy(*CELL).agg(F.count("*").alias("bars"), r6(F.sum("ofi")).alias("ofi"), r6(F.corr("r", "ofi")).alias("corr"), r6(F.regr_slope("r", "ofi") * 1e4).alias("slope"))


@query("trade_intensity", f""", e AS (SELECT venue, symbol, min(ts) AS lo, max(ts) AS hi FROM tape GROUP BY ALL),
b AS (SELECT venue, symbol, unnest(generate_series(0, (hi - lo) // {24 * HOUR} - 1)) AS bar FROM e),
c AS (SELECT venue, symbol, (ts - lo) // {24 * HOUR} AS bar, count(*) AS n FROM tape JOIN e USING (venue, symbol) GROUP BY ALL),
f AS (SELECT venue, symbol, bar, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (venue, symbol, bar)), l AS (SELECT *, lag(n) OVER (PARTITION BY venue, symbol ORDER BY bar) AS p FROM f)
SELECT venue, symbol, count(*) AS bars, {R("avg(n)")} AS mean_count, {R("corr(n, p)")} AS acf1 FROM l GROUP BY ALL""")
def trade_intensity(spark, sf):
    out = flow.intensity(market.tape(spark, sf), CELL, 24 * HOUR)
    return out.select(*CELL, "bars", r6(F.col("rate") * 86400).alias("mean_count"), r6(F.col("acf1")).alias("acf1"))


@query("amihud_illiquidity", f""", b AS (SELECT venue, symbol, ts // {24 * HOUR} AS bar, arg_max(px, seq) AS px, sum(px * qty) AS value FROM tape GROUP BY ALL),
r AS (SELECT *, ln(px / lag(px) OVER (PARTITION BY venue, symbol ORDER BY bar)) AS r FROM b)
SELECT venue, symbol, count(r) AS n, {R("avg(abs(r) / value) * 1e6")} AS amihud FROM r GROUP BY ALL HAVING count(r) >= 5""")
def amihud_illiquidity(spark, sf):
    from pyspark.sql import Window

    bar = F.floor(F.col("ts") / (24 * HOUR)).alias("bar")
    b = market.tape(spark, sf).groupBy(*CELL, bar).agg(F.max_by("px", F.struct("ts", "seq")).alias("px"), F.sum(F.col("px") * F.col("qty")).alias("value"))
    b = b.withColumn("r", F.ln(F.col("px") / F.lag("px").over(Window.partitionBy(*CELL).orderBy("bar"))))
    return b.groupBy(*CELL).agg(F.count("r").alias("n"), r6(F.avg(div(F.abs("r"), F.col("value"))) * 1e6).alias("amihud")).where("n >= 5")


DAYS = f", dc AS (SELECT venue, symbol, ts // {24 * HOUR} AS day, count(*) FILTER (WHERE side > 0) AS buys, count(*) FILTER (WHERE side < 0) AS sells, count(*) AS n, (max(ts) - min(ts)) / 3.6e9 AS span_h FROM tape GROUP BY ALL)\n"


@query("pin_daily_counts", f"{DAYS} SELECT venue, symbol, day, buys, sells, n, {R('span_h')} AS span_h, {R('(buys - sells) / n')} AS imbalance FROM dc")
def pin_daily_counts(spark, sf):
    d = flow.daily_counts(market.tape(spark, sf), CELL)
    return d.select(*CELL, "day", "buys", "sells", "n", r6(F.col("span_h")).alias("span_h"), r6(F.col("imbalance")).alias("imbalance"))


@query("pin_proxy", f"{DAYS} SELECT venue, symbol, {R('avg(abs(buys - sells) / greatest(buys + sells, 1))')} AS pin FROM dc GROUP BY ALL")
def pin_proxy(spark, sf):
    return flow.pin_proxy(flow.daily_counts(market.tape(spark, sf), CELL), CELL).select(*CELL, r6(F.col("pin")).alias("pin"))


@query("trade_sign_acf", f""", q AS (SELECT *, side - avg(side) OVER (PARTITION BY venue, symbol) AS q FROM tape), l AS (SELECT venue, symbol, q, lag(q, 1) OVER {W} AS l1, lag(q, 2) OVER {W} AS l2, lag(q, 3) OVER {W} AS l3 FROM q),
s AS (SELECT venue, symbol, sum(q * q) AS s, sum(q * l1) AS a, sum(q * l2) AS b, sum(q * l3) AS c FROM l GROUP BY ALL)
SELECT venue, symbol, unnest([1, 2, 3]) AS lag, unnest([{R("a / s")}, {R("b / s")}, {R("c / s")}]) AS acf FROM s""")
def trade_sign_acf(spark, sf):
    return flow.sign_acf(market.tape(spark, sf), CELL, 3).select(*CELL, "lag", r6(F.col("acf")).alias("acf"))


MOVES = f", tm AS (SELECT *, lead(mid) OVER {W} - mid AS d_mid FROM (SELECT t.*, q.mid FROM {ASOF}))\n"


def _ols(y, a, b, src):
    return f"""SELECT venue, symbol, count(*) AS n, sum({a} * {a}) AS aa, sum({a} * {b}) AS ab, sum({b} * {b}) AS bb, sum({a} * {y}) AS ay, sum({b} * {y}) AS by_, sum({y} * {y}) AS yy
FROM {src} WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"""


FIT = f"SELECT venue, symbol, n, {R('(ay * bb - by_ * ab) / (aa * bb - ab * ab)')} AS beta_a, {R('(by_ * aa - ay * ab) / (aa * bb - ab * ab)')} AS beta_b, {R('((ay * bb - by_ * ab) * ay + (by_ * aa - ay * ab) * by_) / (aa * bb - ab * ab) / yy')} AS r2 FROM x"


def _fit(rows, y, a, b):
    out = ols2(rows, CELL, y, a, b)
    return out.select(*CELL, "n", *(r6(F.col(c)).alias(c) for c in ("beta_a", "beta_b", "r2")))


@query("glosten_harris", f"{MOVES}, tv AS (SELECT *, side * qty AS qv FROM tm), x AS ({_ols('d_mid', 'side', 'qv', 'tv')}) {FIT}")
def glosten_harris(spark, sf):
    rows = flow.trades_with_moves(market.tape(spark, sf), market.tob(spark, sf), CELL).withColumn("qv", F.col("side") * F.col("qty"))
    return _fit(rows, "d_mid", "side", "qv")


@query("mrr_components", f""", d AS (SELECT *, px - lag(px) OVER {W} AS dp, lag(side) OVER {W} AS q1 FROM tape), x AS ({_ols('dp', 'side', 'q1', 'd')}),
rho AS (SELECT venue, symbol, corr(side, q1) AS rho FROM d GROUP BY ALL), b AS (SELECT venue, symbol, n, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS a, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b FROM x)
SELECT venue, symbol, n, {R("rho")} AS rho, {R("(a + b) / (1 - rho)")} AS theta, {R("a - (a + b) / (1 - rho)")} AS phi FROM b JOIN rho USING (venue, symbol)""")
def mrr_components(spark, sf):
    d = market.tape(spark, sf).withColumns({"dp": F.col("px") - before("px", CELL), "q1": before("side", CELL)})
    fit = ols2(d, CELL, "dp", "side", "q1").join(d.groupBy(*CELL).agg(F.corr("side", "q1").alias("rho")), CELL)
    theta = div(F.col("beta_a") + F.col("beta_b"), 1 - F.col("rho"))
    return fit.select(*CELL, "n", r6(F.col("rho")).alias("rho"), r6(theta).alias("theta"), r6(F.col("beta_a") - theta).alias("phi"))


@query("contemporaneous_lambda", f"{MOVES} SELECT venue, symbol, count(*) AS n, {R('sum(side * d_mid) / sum(side * side)')} AS lambda FROM tm WHERE d_mid IS NOT NULL GROUP BY ALL HAVING count(*) >= 20")
def contemporaneous_lambda(spark, sf):
    rows = flow.trades_with_moves(market.tape(spark, sf), market.tob(spark, sf), CELL).where("d_mid IS NOT NULL")
    return rows.groupBy(*CELL).agg(F.count("*").alias("n"), r6(div(F.sum(F.col("side") * F.col("d_mid")), F.sum(F.col("side") * F.col("side")))).alias("lambda")).where("n >= 20")


@query("dealer_inventory", f"""{MOVES}, i AS (SELECT *, lag(side) OVER {W} AS q1, -sum(side * qty) OVER (PARTITION BY venue, symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inv FROM tm), x AS ({_ols('d_mid', 'q1', 'inv', 'i')}) {FIT}""")
def dealer_inventory(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(*CELL).orderBy("ts", "seq")
    rows = flow.trades_with_moves(market.tape(spark, sf), market.tob(spark, sf), CELL)
    rows = rows.withColumns({"q1": F.lag("side").over(w), "inv": -F.sum(F.col("side") * F.col("qty")).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return _fit(rows, "d_mid", "q1", "inv")


@query("huang_stoll", f""", d AS (SELECT *, px - lag(px) OVER {W} AS dp, lag(side) OVER {W} AS q1 FROM tape), x AS ({_ols('dp', 'side', 'q1', 'd')}),
t AS (SELECT venue, symbol, avg((side <> q1)::INT) AS reversal FROM d WHERE dp IS NOT NULL GROUP BY ALL), b AS (SELECT venue, symbol, n, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS a, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b FROM x)
SELECT venue, symbol, n, {R("reversal")} AS reversal, {R("1 + b / a")} AS lambda, {R("a / 0.01")} AS traded_share FROM b JOIN t USING (venue, symbol)""")
def huang_stoll(spark, sf):
    out = flow.huang_stoll(market.tape(spark, sf), CELL, F.lit(0.01))
    return out.select(*CELL, "n", *(r6(F.col(c)).alias(c) for c in ("reversal", "lambda", "traded_share")))


@query("spread_components", f""", a AS (SELECT t.venue, t.symbol, t.ts, t.seq, t.px, t.side, q.mid FROM {ASOF}), d AS (SELECT venue, symbol, px - lag(px) OVER {W} AS y, mid - lag(mid) OVER {W} AS m, side AS a0, lag(side) OVER {W} AS a1, lag(side, 2) OVER {W} AS a2 FROM a),
s AS (SELECT venue, symbol, count(*) AS n, avg((a0 <> a1)::INT) AS p, sum(a0 * a0) AS s00, sum(a0 * a1) AS s01, sum(a0 * a2) AS s02, sum(a1 * a1) AS s11, sum(a1 * a2) AS s12, sum(a2 * a2) AS s22, sum(y * a0) AS y0, sum(y * a1) AS y1, sum(y * a2) AS y2, sum(m * a2) AS m2 FROM d WHERE y IS NOT NULL AND m IS NOT NULL AND a2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 8),
e AS (SELECT *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02) AS det, ((y0 * s11 - y1 * s01) + (y1 * s00 - y0 * s01)) / (s00 * s11 - s01 * s01) / 0.01 AS l FROM s),
f AS (SELECT *, (s00 * (y1 * s22 - y2 * s12) - y0 * (s01 * s22 - s12 * s02) + s02 * (s01 * y2 - y1 * s02)) / det / 0.01 AS c1, (s00 * (s11 * y2 - s12 * y1) - s01 * (s01 * y2 - y1 * s02) + y0 * (s01 * s12 - s11 * s02)) / det / 0.01 AS c2, -(m2 / 0.01 - l * s12) / ((1 - 2 * p) * s22) AS raw FROM e),
g AS (SELECT *, -c2 / nullif(1 - 2 * p, 0) AS adv, CASE WHEN l <= 0 THEN raw ELSE least(greatest(raw, 0), l) END AS radv FROM f)
SELECT venue, symbol, n, {R("p")} AS reversal, {R("l")} AS lambda_ab, {R("adv")} AS adverse, {R("c1 + 1 - adv")} AS inventory, {R("radv")} AS restricted_adverse, {R("l - radv")} AS restricted_inventory FROM g""")
def spread_components(spark, sf):
    rows = asof(market.tape(spark, sf), market.tob(spark, sf), CELL, ["mid"])
    out = flow.spread_components(rows, CELL, 0.01, 8)
    return out.select(*CELL, "n", *(r6(F.col(c)).alias(c) for c in ("reversal", "lambda_ab", "adverse", "inventory", "restricted_adverse", "restricted_inventory")))


@query("next_mid_change", f""", ch AS (SELECT * FROM (SELECT *, lag(mid) OVER {W} AS was FROM tob) WHERE mid <> was), n0 AS (SELECT t.*, q.mid FROM {ASOF}),
n1 AS (SELECT n.venue, n.side, n.mid, CASE WHEN c.ts - n.ts <= {4 * HOUR} THEN c.mid END AS next_mid FROM n0 n ASOF LEFT JOIN ch c ON n.venue = c.venue AND n.symbol = c.symbol AND n.ts < c.ts)
SELECT venue, count(next_mid) AS n, {R("avg(side * (next_mid - mid))")} AS move FROM n1 GROUP BY venue""")
def next_mid_change(spark, sf):
    rows = flow.next_mid_change(market.tape(spark, sf), market.tob(spark, sf), CELL, 4 * HOUR)
    return rows.groupBy("venue").agg(F.count("next_mid").alias("n"), r6(F.avg(F.col("side") * F.col("d_mid"))).alias("move"))


@query("ma1_from_acov", f""", r AS (SELECT venue, symbol, ts, seq, ln(px / lag(px) OVER {W}) AS r FROM tape), l AS (SELECT *, lag(r) OVER {W} AS l FROM r WHERE r IS NOT NULL),
g AS (SELECT venue, symbol, sum(r * l) / count(l) / (sum(r * r) / count(*)) AS rho FROM l GROUP BY ALL)
SELECT venue, symbol, {R("rho")} AS rho, {R("CASE WHEN abs(rho) <= 0.5 THEN (1 - sqrt(1 - 4 * rho * rho)) / (2 * rho) END")} AS theta FROM g""")
def ma1_from_acov(spark, sf):
    out = flow.ma1(flow.with_returns(market.tape(spark, sf), CELL, "px"), CELL, "r")
    return out.select(*CELL, r6(F.col("rho")).alias("rho"), r6(F.col("theta")).alias("theta"))
