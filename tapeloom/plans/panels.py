"""Queries on panels over venues, days and events, and on a rule's kill criteria."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import corr_or_null, r6
from tapeloom.operators import decisions as act
from tapeloom.operators import inference, panels, validation, vol
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import HOUR
from tapeloom.plans.decisions import EV, _events
from tapeloom.plans.inference import MEAN, boot, poisson, uniform
from tapeloom.plans.patterns import PANEL, _gaps
from tapeloom.plans.vol import KF, _filtered
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR
MARKS = f""", mb AS (SELECT venue, symbol, ts // {6 * HOUR} * {6 * HOUR} AS ts, arg_min(mid, {{'ts': ts, 'seq': seq}}) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, {{'ts': ts, 'seq': seq}}) AS mid, count(*) AS n FROM tob GROUP BY venue, symbol, ts // {6 * HOUR})"""


@query("mark_bars", f"{MARKS} SELECT * FROM mb")
def mark_bars(spark, sf):
    return panels.mark_bars(market.tob(spark, sf), CELL, 6 * HOUR)


@query("mark_basis", f"{MARKS} SELECT a.symbol, a.venue, a.ts, a.mid, h.mid AS home, {R('1e4 * ln(a.mid / h.mid)')} AS basis FROM mb a JOIN mb h ON h.symbol = a.symbol AND h.ts = a.ts AND h.venue = 0 WHERE a.venue <> 0")
def mark_basis(spark, sf):
    b = panels.basis(panels.mark_bars(market.tob(spark, sf), CELL, 6 * HOUR), ["symbol"], "venue", 0)
    return b.withColumn("basis", r6(1e4 * F.col("basis")))


@query("aligned_buckets", f""", lq AS (SELECT symbol, ts // {8 * HOUR} * {8 * HOUR} AS bucket, venue, arg_max({{'bid': bid, 'ask': ask, 'bid_sz': bid_sz, 'ask_sz': ask_sz}}, {{'ts': ts, 'seq': seq}}) AS q FROM tob GROUP BY symbol, ts // {8 * HOUR}, venue)
SELECT a.symbol, a.bucket, {', '.join(f'''"{v}".q.bid AS "{v}_bid", "{v}".q.ask AS "{v}_ask", "{v}".q.bid_sz AS "{v}_bid_sz", "{v}".q.ask_sz AS "{v}_ask_sz", ("{v}".q.bid + "{v}".q.ask) / 2 AS "{v}_mid", {R(f'1e4 * ("{v}".q.ask - "{v}".q.bid) / (("{v}".q.bid + "{v}".q.ask) / 2)')} AS "{v}_spread_bps", "{v}".q.bid_sz + "{v}".q.ask_sz AS "{v}_size"''' for v in range(3))}
FROM (SELECT symbol, bucket FROM lq GROUP BY ALL HAVING count(*) = 3) a {' '.join(f'JOIN lq "{v}" ON "{v}".symbol = a.symbol AND "{v}".bucket = a.bucket AND "{v}".venue = {v}' for v in range(3))}""")
def aligned_buckets(spark, sf):
    b = panels.aligned_buckets(market.tob(spark, sf), ["symbol"], "venue", [0, 1, 2], 8 * HOUR)
    return b.withColumns({f"{v}_spread_bps": r6(F.col(f"{v}_spread_bps")) for v in range(3)})


OCC = f"""{EV}, oe AS (SELECT venue, symbol, end_ts // {DAY} AS day, end_ts % {DAY} // {DAY // 2} AS pm, run % 4 AS intensity, z_peak, nested FROM ev),
od AS (SELECT venue, symbol, day, max(CASE WHEN pm = 0 THEN 1 ELSE 0 END) AS am, max(pm) AS pm, avg(CASE WHEN intensity = 0 THEN 1 ELSE intensity END) AS intensity, median(abs(z_peak)) AS abs_z, avg(nested::INT) AS nested_rate, count(*) AS n FROM oe GROUP BY ALL),
oc AS (SELECT venue, symbol, ts // {DAY} AS day, count(*) AS trades, count(*) >= 6 AS complete, avg((side > 0)::INT) AS share FROM tape GROUP BY ALL),
oa AS (SELECT venue, symbol, day, am, pm, intensity, abs_z, nested_rate, n, trades, complete, share FROM od FULL JOIN oc USING (venue, symbol, day)),
oh AS (SELECT oa.*, h.half, CASE WHEN h.half = 'am' THEN coalesce(am, 0) ELSE coalesce(pm, 0) END AS y, h.hour FROM oa JOIN (SELECT 'am' AS half, 6 AS hour UNION ALL SELECT 'pm', 18) h ON true WHERE n IS NOT NULL OR complete)"""


def _occurrences(spark, sf):
    e = _events(spark, sf).withColumn("intensity", (F.col("run") % 4).cast("double"))
    cells = market.tape(spark, sf).groupBy(*CELL, F.floor(F.col("ts") / DAY).alias("day")).agg(F.count("*").alias("trades"), (F.count("*") >= 6).alias("complete"), F.avg((F.col("side") > 0).cast("double")).alias("share"))
    return panels.occurrence_rows(e, cells, CELL)


@query("occurrence_rows", f"""{OCC} SELECT venue, symbol, day, half, y::INT AS y, hour, {R('coalesce(intensity, 0)')} AS intensity, {R('coalesce(abs_z, 0)')} AS abs_z, {R('coalesce(nested_rate, 0)')} AS nested_rate, {R('coalesce(share, 0.5)')} AS share, {R('ln(coalesce(n, 1))')} AS log_events, coalesce(trades, 0)::DOUBLE AS trades FROM oh""", recursive=True)
def occurrence_rows(spark, sf):
    return _occurrences(spark, sf).withColumns({c: r6(F.col(c)) for c in ("intensity", "abs_z", "nested_rate", "share", "log_events")})


@query("occurrence_design", f"""{OCC} SELECT venue, symbol, day, half, {R('coalesce(share, 0.5)')} AS share, hour::DOUBLE AS hour, {', '.join(f'(venue = {v})::INT::DOUBLE AS venue_{v}' for v in range(3))}, {', '.join(f'(symbol = {s})::INT::DOUBLE AS symbol_{s}' for s in range(2))}, y::DOUBLE AS y, true AS usable FROM oh""", recursive=True)
def occurrence_design(spark, sf):
    rows = _occurrences(spark, sf).withColumns({"own": F.col("venue"), "of": F.col("symbol")})
    d = panels.design(rows, [*CELL, "day", "half"], ["share", "hour"], {"venue": [0, 1, 2], "symbol": [0, 1]}, "y", ["intensity", "abs_z", "nested_rate", "log_events"])
    return d.withColumn("share", r6(F.col("share")))


@query("occurrence_model")
def occurrence_model(spark, sf):
    """No SQL: three coefficients by Newton steps; tests compare the posterior with NumPy."""
    rows = _occurrences(spark, sf).withColumn("log_trades", F.ln(F.greatest(F.col("trades"), F.lit(1.0))))
    return validation.logistic_posterior(rows, [], "y", ["share", "hour", "log_trades"])


@query("liquidity_around_bursts", f""", mt AS (SELECT venue, symbol, ts // {5 * DAY} AS block, arg_max({{'ts': ts}}, {{'qty': qty, 'seq': seq}}).ts AS ts FROM tape GROUP BY venue, symbol, ts // {5 * DAY})
SELECT p.venue, p.symbol, p.block, p.ts, count(q.ts) AS quotes, {R('avg(1e4 * (q.ask - q.bid) / q.mid)')} AS spread_bps, {R('avg(1e4 * (q.ask - q.bid) / q.mid) FILTER (WHERE q.ts < p.ts)')} AS spread_pre, {R('avg(1e4 * (q.ask - q.bid) / q.mid) FILTER (WHERE q.ts > p.ts)')} AS spread_post, {R('avg(q.bid_sz + q.ask_sz)')} AS depth
FROM mt p LEFT JOIN tob q ON q.venue = p.venue AND q.symbol = p.symbol AND q.ts BETWEEN p.ts - {6 * HOUR} AND p.ts + {6 * HOUR} GROUP BY ALL""")
def liquidity_around_bursts(spark, sf):
    points = market.tape(spark, sf).groupBy(*CELL, F.floor(F.col("ts") / (5 * DAY)).alias("block")).agg(F.max_by("ts", F.struct("qty", "seq")).alias("ts"))
    out = panels.liquidity_around(points, market.tob(spark, sf), CELL, 6 * HOUR)
    return out.withColumns({c: r6(F.col(c)) for c in ("spread_bps", "spread_pre", "spread_post", "depth")})


@query("moments_concord", f"""{KF}, mo AS (SELECT symbol, venue, arg_min({{'ts': start_ts}}, {{'z': -abs(z_peak), 'run': run}}).ts AS ts FROM ke GROUP BY ALL)
SELECT a.symbol, a.venue AS a, b.venue AS b, abs(a.ts - b.ts) AS apart, abs(a.ts - b.ts) <= {3 * DAY} AS concord FROM mo a JOIN mo b ON b.symbol = a.symbol AND a.venue < b.venue""", recursive=True)
def moments_concord(spark, sf):
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0)
    peak = e.groupBy(*CELL).agg(F.min_by("start_ts", F.struct(-F.abs("z_peak"), "run")).alias("ts"))
    return panels.moments_concord(peak, ["symbol"], "venue", 3 * DAY)


NEST = f"""{EV}, nf AS (SELECT venue, symbol, run, start_ts AS ts, abs(mo5) AS hold, tier <> 'observe' AS fire FROM ev), nk AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY ts, run) AS k FROM nf WHERE fire),
nw(venue, symbol, k, run, kept, until) AS (SELECT venue, symbol, k, run, true, ts + {2 * DAY} FROM nk WHERE k = 1 UNION ALL SELECT n.venue, n.symbol, n.k, n.run, n.ts >= until, CASE WHEN n.ts >= until THEN n.ts + {2 * DAY} ELSE until END FROM nw JOIN nk n ON n.venue = nw.venue AND n.symbol = nw.symbol AND n.k = nw.k + 1),
ne AS (SELECT nf.* FROM nf LEFT JOIN nw USING (venue, symbol, run) WHERE NOT fire OR kept), nb AS (SELECT venue, ts // {DAY} AS day, count(*) FILTER (WHERE fire)::DOUBLE AS nt, coalesce(sum(hold) FILTER (WHERE fire), 0) AS xt, count(*) FILTER (WHERE NOT fire)::DOUBLE AS nc, coalesce(sum(hold) FILTER (WHERE NOT fire), 0) AS xc FROM ne GROUP BY ALL)"""


@query("fires_without_nests", NEST + boot("nb", "venue", "day", "{xt} / nullif({nt}, 0) - {xc} / nullif({nc}, 0)", 60, 9), recursive=True)
def fires_without_nests(spark, sf):
    e = _events(spark, sf).select(*CELL, F.col("run").alias("seq"), F.col("start_ts").alias("ts"), F.abs("mo5").alias("hold"), (F.col("tier") != "observe").alias("fire"))
    kept = panels.first_of_nest(e, CELL, F.col("fire"), 2 * DAY).withColumn("day", F.floor(F.col("ts") / DAY))
    b = inference.block_bootstrap(inference.effect_sums(kept, ["venue", "day"], F.col("fire"), "hold"), ["venue"], "day", ["nt", "xt", "nc", "xc"], inference.effect_stat, 60, 9)
    return b.select("venue", "blocks", *(r6(F.col(c)).alias(c) for c in ("point", "low", "high")))


@query("relax_bars", f""", rx AS (SELECT *, ask - bid > 0.02 AS c, lag(ask - bid > 0.02) OVER (PARTITION BY venue, symbol ORDER BY ts, seq) AS was FROM tob), rb AS (SELECT venue, symbol, bar, row_number() OVER (PARTITION BY venue, symbol ORDER BY bar) AS k FROM (SELECT DISTINCT venue, symbol, ts // {HOUR} AS bar FROM rx WHERE was AND NOT c)),
rw(venue, symbol, k, bar, kept, until) AS (SELECT venue, symbol, k, bar, true, bar + 12 FROM rb WHERE k = 1 UNION ALL SELECT n.venue, n.symbol, n.k, n.bar, n.bar >= until, CASE WHEN n.bar >= until THEN n.bar + 12 ELSE until END FROM rw JOIN rb n ON n.venue = rw.venue AND n.symbol = rw.symbol AND n.k = rw.k + 1)
SELECT venue, symbol, bar FROM rw WHERE kept""", recursive=True)
def relax_bars(spark, sf):
    return panels.relax_bars(market.tob(spark, sf), CELL, F.col("ask") - F.col("bid") > 0.02, HOUR, 12)


@query("liquidity_elasticity", f"""{PANEL}, vb AS (SELECT symbol, ts // {4 * HOUR} * {4 * HOUR} AS ts, sum(qty) AS volume FROM tape GROUP BY symbol, ts // {4 * HOUR})
SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 20 THEN {R('corr(volume, pim)')} END AS corr FROM pp JOIN vb USING (symbol, ts) WHERE pim IS NOT NULL GROUP BY symbol""")
def liquidity_elasticity(spark, sf):
    step = 4 * HOUR
    v = market.tape(spark, sf).groupBy("symbol", (F.floor(F.col("ts") / step) * step).alias("bar")).agg(F.sum("qty").alias("volume")).withColumnRenamed("bar", "ts")
    g = _gaps(spark, sf).where("pim IS NOT NULL").join(v, ["symbol", "ts"])
    return g.groupBy("symbol").agg(F.count("*").alias("n"), r6(corr_or_null(F.col("volume"), F.col("pim"), 20)).alias("corr"))


SHARE = f"""{KF}, se AS (SELECT symbol, run * 10 + venue AS event, start_ts AS ts FROM ke WHERE venue = 0), sg AS (SELECT symbol, event, unnest(generate_series(ts - {2 * DAY}, ts + {2 * DAY}, {HOUR}::BIGINT)) AS ts FROM se),
sm AS (SELECT g.symbol, g.event, g.ts, a.mid AS ma, b.mid AS mb FROM sg g ASOF JOIN (SELECT * FROM tob WHERE venue = 0) a ON a.symbol = g.symbol AND g.ts >= a.ts ASOF JOIN (SELECT * FROM tob WHERE venue = 1) b ON b.symbol = g.symbol AND g.ts >= b.ts QUALIFY count(*) OVER (PARTITION BY g.symbol, g.event) >= 51),
sr AS (SELECT symbol, event, ts, ln(ma / lag(ma) OVER w) AS a0, ln(mb / lag(mb) OVER w) AS b0 FROM sm WINDOW w AS (PARTITION BY symbol, event ORDER BY ts)), sl AS (SELECT *, lag(a0) OVER w AS a1, lag(b0) OVER w AS b1 FROM sr WINDOW w AS (PARTITION BY symbol, event ORDER BY ts)),
ss AS (SELECT symbol, event, count(*) AS n, sum(a1 * a1) AS paa, sum(a1 * b1) AS pab, sum(b1 * b1) AS pbb, sum(a1 * a0) AS qaa, sum(a1 * b0) AS qab, sum(b1 * a0) AS qba, sum(b1 * b0) AS qbb, sum(a0 * a0) AS yaa, sum(a0 * b0) AS yab, sum(b0 * b0) AS ybb FROM sl WHERE a1 IS NOT NULL AND b1 IS NOT NULL GROUP BY ALL),
sc AS (SELECT *, (pbb * qaa - pab * qba) / (paa * pbb - pab * pab) AS caa, (paa * qba - pab * qaa) / (paa * pbb - pab * pab) AS cba, (pbb * qab - pab * qbb) / (paa * pbb - pab * pab) AS cab, (paa * qbb - pab * qab) / (paa * pbb - pab * pab) AS cbb FROM ss),
so AS (SELECT *, (yaa - caa * qaa - cba * qba) / n AS oaa, (yab - caa * qab - cba * qbb) / n AS oab, (ybb - cab * qab - cbb * qbb) / n AS obb, (1 - caa) * (1 - cbb) - cba * cab AS det FROM sc),
sp AS (SELECT *, ((1 - cbb) + cab) / (2 * det) AS u, ((1 - caa) + cba) / (2 * det) AS v FROM so),
st AS (SELECT *, u * u * oaa + 2 * u * v * oab + v * v * obb AS total FROM sp),
sh AS (SELECT symbol, event, n, pow(u * sqrt(oaa) + v * oab / sqrt(oaa), 2) / total AS f, u * u * (oaa - oab * oab / obb) / total AS l FROM st)"""


@query("event_information_share", f"{SHARE} SELECT symbol, event::BIGINT AS event, n, {R('least(f, l)')} AS share_a_low, {R('greatest(f, l)')} AS share_a_high FROM sh WHERE f IS NOT NULL AND NOT isnan(f)", recursive=True)
def event_information_share(spark, sf):
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0).where("venue = 0").select("symbol", (F.col("run") * 10 + F.col("venue")).alias("event"), F.col("start_ts").alias("ts"))
    s = panels.event_information_share(e, market.tob(spark, sf), ["symbol"], "venue", 0, 1, 2 * DAY, 2 * DAY, HOUR, 1)
    return s.select("symbol", "event", "n", *(r6(F.col(c)).alias(c) for c in ("share_a_low", "share_a_high")))


CLOCKS = f""", k0 AS (SELECT symbol, ts // {DAY} AS day, c.clock, ln(px) AS x, row_number() OVER (PARTITION BY symbol, ts // {DAY}, c.clock ORDER BY ts, seq) - 1 AS k FROM tape JOIN (SELECT unnest(['all', 'buys', 'sells']) AS clock) c ON c.clock = 'all' OR (c.clock = 'buys') = (side > 0) WHERE px > 0),
k1 AS (SELECT *, x - lag(x) OVER (PARTITION BY symbol, day, clock ORDER BY k) AS r, CASE WHEN k % 3 = 0 THEN x - lag(x, 3) OVER (PARTITION BY symbol, day, clock ORDER BY k) END AS r3 FROM k0),
k2 AS (SELECT symbol, day, clock, sum(r * r) / nullif(sum(r3 * r3), 0) AS ratio FROM k1 GROUP BY ALL),
k3 AS (SELECT symbol, day, max(ratio) FILTER (WHERE clock = 'all') AS a, max(ratio) FILTER (WHERE clock = 'buys') AS b, max(ratio) FILTER (WHERE clock = 'sells') AS s FROM k2 GROUP BY ALL),
k4 AS (SELECT symbol, day, unnest([{{'series': 'all', 'v': a}}, {{'series': 'buys', 'v': b}}, {{'series': 'sells', 'v': s}}, {{'series': 'all_minus_buys', 'v': a - b}}, {{'series': 'all_minus_sells', 'v': a - s}}, {{'series': 'buys_minus_sells', 'v': b - s}}]) AS q FROM k3),
k5 AS (SELECT symbol, q.series AS series, day, q.v AS v FROM k4 WHERE q.v IS NOT NULL QUALIFY count(*) OVER (PARTITION BY symbol, q.series) >= 3 OR NOT contains(q.series, '_minus_')),
k6 AS (SELECT symbol, series, draw, v, unnest(range({poisson(uniform('11', 'day', 'draw'))})) AS c FROM (SELECT *, unnest(range(1, 101)) AS draw FROM k5)), k7 AS (SELECT symbol, series, draw, median(v) AS v FROM k6 GROUP BY ALL),
k8 AS (SELECT symbol, series, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM k7 GROUP BY ALL)"""


@query("compare_clocks", f"{CLOCKS} SELECT symbol, series, count(*) AS n, {R('avg(v)')} AS mean, {R('median(v)')} AS median, {R('any_value(low)')} AS low, {R('any_value(high)')} AS high, any_value(low > 0 OR high < 0) AS excludes_0 FROM k5 JOIN k8 USING (symbol, series) GROUP BY symbol, series")
def compare_clocks(spark, sf):
    clock = F.explode(F.array(F.lit("all"), F.when(F.col("side") > 0, "buys").otherwise("sells")))
    w = Window.partitionBy("symbol", "day", "clock").orderBy("ts", "seq")
    t = market.tape(spark, sf).where("px > 0").select("symbol", F.floor(F.col("ts") / DAY).alias("day"), clock.alias("clock"), "ts", "seq", F.ln("px").alias("x"))
    t = t.withColumns({"k": F.row_number().over(w) - 1, "r": F.col("x") - F.lag("x").over(w), "r3": F.col("x") - F.lag("x", 3).over(w)})
    third = F.sum(F.when(F.col("k") % 3 == 0, F.col("r3") * F.col("r3")))
    ratio = t.groupBy("symbol", "day", "clock").agg((F.sum(F.col("r") * F.col("r")) / F.nullif(third, F.lit(0.0))).alias("ratio"))
    wide = ratio.groupBy("symbol", "day").agg(*(F.max(F.when(F.col("clock") == c, F.col("ratio"))).alias(c) for c in ("all", "buys", "sells")))
    m = inference.compare_medians(wide, ["symbol"], "day", ["all", "buys", "sells"], 100, 11)
    return m.select("symbol", "series", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "median", "low", "high")), "excludes_0")


KT = f""", kt AS (SELECT venue, symbol, seq, ts // {DAY} AS day, CASE WHEN seq % 17 <> 0 THEN side * (px - 100) + 0.05 END AS x, qty = 7 AS stopped FROM tape),
kb AS (SELECT venue, symbol, floor({uniform('42', 'seq')} * 64)::BIGINT AS blk, count(*)::DOUBLE AS n, sum(x) AS x FROM kt WHERE x IS NOT NULL GROUP BY ALL)"""
KILLED = f"""{KT}{boot('kb', 'venue, symbol', 'blk', MEAN, 80, 42).rsplit('SELECT', 1)[0]}, kd AS (SELECT venue, symbol, day, count(x) AS n, sum(x) AS s FROM kt WHERE x IS NOT NULL GROUP BY ALL), kw AS (SELECT venue, symbol, sum(n) OVER o AS n, sum(s) OVER o AS s FROM kd WINDOW o AS (PARTITION BY venue, symbol ORDER BY day ROWS 4 PRECEDING)),
k1 AS (SELECT venue, symbol, coalesce(bool_or(s / n <= 0) FILTER (WHERE n >= 20), false) AS k1 FROM kw GROUP BY ALL),
ka AS (SELECT venue, symbol, count(x) AS n, count(*) AS every, avg(x) AS mean, avg(x) FILTER (WHERE day % 2 = 0) AS early_mean, avg(x) FILTER (WHERE day % 2 = 1) AS late_mean, avg((x > 0)::INT) FILTER (WHERE x IS NOT NULL) AS hit_rate, avg(stopped::INT) AS stop_share FROM kt GROUP BY ALL),
kf AS (SELECT *, n >= 20 AND NOT (low > 0 OR high < 0) AS k2, coalesce(early_mean * late_mean < 0 AND n >= 20, false) AS k3, n >= 40 AND hit_rate < 0.55 AS k4, every >= 30 AND stop_share > 0.4 AS k5 FROM ka JOIN bq USING (venue, symbol) JOIN k1 USING (venue, symbol))"""


@query("evaluate_kills", f"""{KILLED} SELECT venue, symbol, n, {', '.join(f'{R(c)} AS {c}' for c in ('mean', 'low', 'high', 'early_mean', 'late_mean', 'hit_rate', 'stop_share'))}, k1, k2, k3, k4, k5, false AS k6, false AS k7, false AS k8, n >= 40 AND hit_rate < 0.65 AND NOT k4 AS hit_warn,
CASE WHEN k1 OR k2 OR k3 OR k4 OR k5 THEN 'Kill' WHEN n < 20 THEN 'Hold' ELSE 'Promote_shadow' END AS decision FROM kf""")
def evaluate_kills(spark, sf):
    t = market.tape(spark, sf).select(*CELL, "seq", "qty", F.floor(F.col("ts") / DAY).alias("day"), F.when(F.col("seq") % 17 != 0, F.col("side") * (F.col("px") - 100) + 0.05).alias("pnl"))
    k = act.evaluate_kills(t, CELL, "day", "pnl", "seq", F.col("day") % 2 == 0, F.col("day") % 2 == 1, F.col("qty") == 7, draws=80)
    return k.withColumns({c: r6(F.col(c)) for c in ("mean", "low", "high", "early_mean", "late_mean", "hit_rate", "stop_share")})
