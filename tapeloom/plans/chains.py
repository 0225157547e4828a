"""Queries on the detector as a whole, on feeds of JSON, and on what chance would show."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.stats import r6
from tapeloom.operators import estimators, placebo, vol
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import HOUR
from tapeloom.plans.flow import W
from tapeloom.plans.inference import uniform
from tapeloom.plans.vol import KF, _filtered
from tapeloom.sources import layout, market
from tapeloom.sources.market import CELL

DAY, BAR = 24 * HOUR, 4 * HOUR
C = "PARTITION BY venue, symbol"
BARS = f""", c0 AS (SELECT venue, symbol, max({{'ts': ts, 'seq': seq, 'x': ln(px)}}) AS m FROM tape WHERE px > 0 GROUP BY venue, symbol, ts // {BAR}),
c1 AS (SELECT venue, symbol, m.ts AS ts, m.seq AS seq, m.x - lag(m.x) OVER ({C} ORDER BY m.ts) AS r FROM c0), c2 AS (SELECT *, count(*) OVER ({C}) AS nb FROM c1 WHERE r IS NOT NULL),
c3 AS (SELECT *, greatest(sum(r * r) OVER ({C}, ts // {DAY}), 1e-18) AS h, ts % {DAY} // {BAR} AS slot FROM c2 WHERE nb >= 4),
c4 AS (SELECT venue, symbol, slot, avg(r * r / h) AS v FROM c3 GROUP BY ALL), c5 AS (SELECT *, v / avg(v) OVER ({C}) AS s FROM c4),
c6 AS (SELECT c3.*, s, r * r / greatest(h * s, 1e-18) AS zz, row_number() OVER (PARTITION BY c3.venue, c3.symbol ORDER BY ts, seq) AS k FROM c3 JOIN c5 USING (venue, symbol, slot)),
c7(venue, symbol, k, q, zz) AS (SELECT venue, symbol, k, 1.0::DOUBLE, zz FROM c6 WHERE k = 1 UNION ALL SELECT n.venue, n.symbol, n.k, 1e-4 + 0.05 * c7.zz + 0.9 * c7.q, n.zz FROM c7 JOIN c6 n ON n.venue = c7.venue AND n.symbol = c7.symbol AND n.k = c7.k + 1),
cb AS (SELECT c6.venue, c6.symbol, ts, seq, r, h, s, q / greatest(avg(q) OVER (PARTITION BY c6.venue, c6.symbol), 1e-12) AS q, h * s * q / greatest(avg(q) OVER (PARTITION BY c6.venue, c6.symbol), 1e-12) AS composite FROM c6 JOIN c7 USING (venue, symbol, k))"""


@query("mc_garch_bars", f"{BARS} SELECT venue, symbol, ts, seq, {R('1e6 * h')} AS h, {R('s')} AS s, {R('q')} AS q, {R('1e6 * composite')} AS composite FROM cb", recursive=True)
def mc_garch_bars(spark, sf):
    b = vol.mc_garch_bars(market.tape(spark, sf), CELL, BAR, 6)
    return b.select(*CELL, "ts", "seq", r6(1e6 * F.col("h")).alias("h"), r6(F.col("s")).alias("s"), r6(F.col("q")).alias("q"), r6(1e6 * F.col("composite")).alias("composite"))


CHAIN = f"""{BARS}, cf AS (SELECT venue, symbol, arg_min(composite, ts) AS first FROM cb GROUP BY ALL),
d0 AS (SELECT t.venue, t.symbol, t.ts, t.seq, t.px, cb.composite FROM (SELECT * FROM tape WHERE px > 0) t ASOF LEFT JOIN cb ON cb.venue = t.venue AND cb.symbol = t.symbol AND t.ts >= cb.ts),
d1 AS (SELECT d0.*, coalesce(composite, first) AS h, ln(px) AS y, ln(px) - lag(ln(px)) OVER w AS dy, row_number() OVER w AS k, coalesce(greatest((ts - lag(ts) OVER w) / 1e6, 1e-9), greatest((lead(ts) OVER w - ts) / 1e6, 1e-9), 1) AS dt FROM d0 LEFT JOIN cf USING (venue, symbol) WINDOW w AS ({C} ORDER BY ts, seq)),
d2 AS (SELECT venue, symbol, median(dy) AS mid FROM d1 GROUP BY ALL), d3 AS (SELECT venue, symbol, median(abs(dy - mid)) / 0.6745 AS mad, count(dy) AS n FROM d1 JOIN d2 USING (venue, symbol) GROUP BY ALL),
d4 AS (SELECT d1.*, greatest(coalesce(h / {BAR / 1e6}, 1e-12), 1e-12) * dt AS p_noise, greatest(power(CASE WHEN n > 10 THEN greatest(mad, 1e-4) ELSE 1e-4 END, 2), 1e-12) AS m_noise FROM d1 JOIN d3 USING (venue, symbol)),
kf(venue, symbol, k, ts, seq, px, x, p, z) AS (SELECT venue, symbol, k, ts, seq, px, y, m_noise, 0.0::DOUBLE FROM d4 WHERE k = 1 UNION ALL
SELECT n.venue, n.symbol, n.k, n.ts, n.seq, n.px, f.x + (f.p + n.p_noise) / (f.p + n.p_noise + n.m_noise) * (n.y - f.x), (f.p + n.p_noise) * (1 - (f.p + n.p_noise) / (f.p + n.p_noise + n.m_noise)), (n.y - f.x) / sqrt(f.p + n.p_noise + n.m_noise)
 FROM kf f JOIN d4 n ON n.venue = f.venue AND n.symbol = f.symbol AND n.k = f.k + 1),
ki AS (SELECT *, CASE WHEN abs(z) >= 1.5 AND coalesce(lag(abs(z)) OVER {W}, 0) < 1.5 THEN 1 ELSE 0 END AS st FROM kf), kr AS (SELECT *, sum(st) OVER ({C} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM ki),
ke AS (SELECT venue, symbol, run, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS prints, arg_min(px, k) AS first, min(px) AS low, max(px) AS high, arg_max(z, abs(z)) AS z_peak FROM kr WHERE abs(z) >= 1.5 GROUP BY ALL)"""


@query("detector_chain", f"""{CHAIN} SELECT venue, symbol, run::BIGINT AS run, start_ts, end_ts, prints, {R("100 * greatest(high - first, first - low) / first")} AS dp_pct, CASE WHEN first - low >= high - first THEN -1 ELSE 1 END AS direction, {R("z_peak")} AS z_peak FROM ke""", recursive=True)
def detector_chain(spark, sf):
    noise = estimators.detector_noise(market.tape(spark, sf), CELL, BAR, 6)
    e = vol.crash_events(vol.kalman_by_print(noise, CELL), CELL, 1.5)
    return e.select(*CELL, "run", "start_ts", "end_ts", "prints", r6(F.col("dp_pct")).alias("dp_pct"), "direction", r6(F.col("z_peak")).alias("z_peak"))


@query("trades_from_json", """ SELECT ts // 1000 * 1000 AS ts, seq, px, qty, side FROM tape WHERE seq % 10 > 1 AND seq % 13 <> 0""")
def trades_from_json(spark, sf):
    """Prints rendered as feed messages, some of them broken, and read back."""
    k = F.col("seq") % 10
    text = F.when(k == 0, "-1").when(k == 1, "x").otherwise(F.col("px").cast("string"))
    own = {"time": F.floor(F.col("ts") / 1000), "tid": F.col("seq"), "side": F.when(F.col("side") > 0, F.when(k < 5, "B").otherwise("buy")).otherwise("A")}
    named = F.struct(text.alias("px"), F.col("qty").alias("sz"), *(v.alias(c) for c, v in own.items()))
    other = F.struct(text.alias("price"), F.col("qty").alias("qty"), *(v.alias(c) for c, v in own.items()))
    channel = F.when(F.col("seq") % 13 == 0, "book").otherwise("trades").alias("channel")
    alone = F.to_json(F.struct(channel, other.alias("data")))
    line = F.when(k == 7, alone).otherwise(F.to_json(F.struct(channel, F.array(named).alias("data"))))
    return layout.trades_from_json(market.tape(spark, sf).select(line.alias("value")))


@query("best_books", """ SELECT symbol::VARCHAR AS symbol, ts // 1000 * 1000 AS ts, bid, ask, bid_sz, ask_sz FROM tob WHERE seq % 8 IN (0, 6, 7)""")
def best_books(spark, sf):
    """Quotes rendered as book messages with levels in any order, some of them broken, and read back."""
    k, text = F.col("seq") % 8, lambda c: F.col(c).cast("string")
    level = lambda px, sz: F.array(px, sz)
    far, none = level(F.lit("1"), F.lit("9")), F.array().cast("array<array<string>>")
    best, under = level(text("bid"), text("bid_sz")), level((F.col("bid") - 0.02).cast("string"), F.lit("5"))
    bids = F.when(k == 1, F.array(best, level(F.lit("x"), F.lit("1")))).when(k == 4, F.array(far)).when(k == 6, F.array(far, best, level(text("bid"), F.lit("70")))).when(k == 7, F.array(under, level(F.lit("-3"), F.lit("2")), best)).otherwise(F.array(under, best, far))
    ask, over = level(text("ask"), text("ask_sz")), level((F.col("ask") + 0.5).cast("string"), F.lit("4"))
    asks = F.when(k == 2, none).when(k == 3, F.array(level((F.col("bid") - 0.01).cast("string"), F.lit("1")))).when(k == 5, F.array(level(text("ask"), F.lit("?")))).otherwise(F.array(over, ask))
    book = F.struct(text("symbol").alias("symbol"), F.floor(F.col("ts") / 1000).alias("time"), F.struct(bids.alias("bids"), asks.alias("asks")).alias("orderBook"))
    return layout.books_from_json(market.tob(spark, sf).select(F.to_json(book).alias("value")))


DRAWS, SLACK = 20, 3 * HOUR
SHIFTED = f""", i0 AS (SELECT symbol, CASE venue WHEN 0 THEN 'a' ELSE 'b' END AS side, start_ts, end_ts FROM ke WHERE venue IN (0, 1)), i1 AS (SELECT *, unnest(range(-1, {DRAWS})) AS draw, start_ts // {DAY} AS day FROM i0),
i2 AS (SELECT symbol, side, draw, end_ts - start_ts AS len, CASE WHEN draw < 0 THEN start_ts ELSE day * {DAY} + (start_ts - day * {DAY} + 1 + floor({uniform('17', 'side', 'day', 'draw')} * {DAY - 2})::BIGINT) % {DAY} END AS start_ts FROM i1),
i3 AS (SELECT *, start_ts + len AS end_ts, row_number() OVER (PARTITION BY symbol, side, draw ORDER BY start_ts, len) AS k FROM i2),
i4 AS (SELECT a.symbol, a.draw, a.k, coalesce(list(b.k ORDER BY b.k) FILTER (WHERE b.k IS NOT NULL), []) AS may FROM i3 a LEFT JOIN i3 b ON b.symbol = a.symbol AND b.draw = a.draw AND b.side = 'b' AND b.start_ts <= a.end_ts + {SLACK} AND b.end_ts >= a.start_ts - {SLACK} WHERE a.side = 'a' GROUP BY ALL),
i5(symbol, draw, k, used, n) AS (SELECT DISTINCT symbol, draw, 0::BIGINT, []::BIGINT[], 0 FROM i3 UNION ALL
SELECT m.symbol, m.draw, m.k, CASE WHEN len(list_filter(may, lambda x: NOT list_contains(used, x))) > 0 THEN list_append(used, list_filter(may, lambda x: NOT list_contains(used, x))[1]) ELSE used END, n + (len(list_filter(may, lambda x: NOT list_contains(used, x))) > 0)::INT FROM i5 JOIN i4 m ON m.symbol = i5.symbol AND m.draw = i5.draw AND m.k = i5.k + 1),
i6 AS (SELECT symbol, draw, max(n) AS n FROM i5 GROUP BY ALL)"""


@query("placebo_concordance", f"""{KF}{SHIFTED} SELECT o.symbol, o.n AS observed, {R('avg(d.n)')} AS placebo_mean, {R('quantile_cont(d.n, 0.95)')} AS placebo_p95, {R('avg((d.n >= o.n)::INT)')} AS p FROM i6 o JOIN i6 d ON d.symbol = o.symbol AND d.draw >= 0 WHERE o.draw < 0 GROUP BY o.symbol, o.n""", recursive=True)
def placebo_concordance(spark, sf):
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0)
    p = placebo.placebo_concordance(e.where("venue = 0"), e.where("venue = 1"), ["symbol"], SLACK, DRAWS, 17)
    return p.select("symbol", "observed", *(r6(F.col(c)).alias(c) for c in ("placebo_mean", "placebo_p95", "p")))


K, SPAN, AFTER, LATER = 12, 6 * HOUR, 5 * HOUR, 20 * HOUR
WINDOWS = f""", w0 AS (SELECT *, count(*) OVER ({C}) AS n, row_number() OVER ({C} ORDER BY {uniform('42', 'seq')}, seq) AS u FROM tape WHERE px > 0), w1 AS (SELECT * FROM w0 WHERE n >= 50 AND u <= {K}),
w2 AS (SELECT w1.venue, w1.symbol, w1.ts, w1.seq, w1.px, max({{'ts': t.ts, 'seq': t.seq, 'px': t.px}}) AS e, 100 * max(abs(t.px - w1.px) / w1.px) AS dp_pct FROM w1 JOIN w0 t ON t.venue = w1.venue AND t.symbol = w1.symbol AND (t.ts > w1.ts OR t.ts = w1.ts AND t.seq >= w1.seq) AND t.ts <= w1.ts + {SPAN} GROUP BY ALL),
w3 AS (SELECT w2.venue, w2.symbol, w2.ts, w2.seq, dp_pct, e, max({{'ts': t.ts, 'seq': t.seq, 'px': t.px}}) FILTER (WHERE t.ts <= e.ts + {AFTER}) AS f, max(100 * abs(t.px - e.px) / e.px) AS sub_pct FROM w2 LEFT JOIN w0 t ON t.venue = w2.venue AND t.symbol = w2.symbol AND (t.ts > e.ts OR t.ts = e.ts AND t.seq > e.seq) AND t.ts <= e.ts + {LATER} GROUP BY ALL),
pw AS (SELECT venue, symbol, seq, ts, dp_pct, 1e4 * (f.px - e.px) / e.px AS mo_bps, sub_pct FROM w3)"""


@query("placebo_windows", f"{WINDOWS} SELECT venue, symbol, seq, ts, {R('dp_pct')} AS dp_pct, {R('mo_bps')} AS mo_bps, {R('sub_pct')} AS sub_pct FROM pw")
def placebo_windows(spark, sf):
    w = placebo.placebo_windows(market.tape(spark, sf), CELL, K, 42, SPAN, AFTER, LATER)
    return w.withColumns({c: r6(F.col(c)) for c in ("dp_pct", "mo_bps", "sub_pct")})


@query("placebo_p", f"""{KF}{WINDOWS}, o AS (SELECT venue, symbol, count(*) AS events, avg(100 * greatest(high - first, first - low) / first) AS observed FROM ke GROUP BY ALL)
SELECT venue, symbol, events, count(dp_pct) AS windows, {R('any_value(observed)')} AS observed, {R('avg(dp_pct)')} AS placebo, {R('avg((dp_pct >= observed)::INT)')} AS p FROM pw JOIN o USING (venue, symbol) GROUP BY venue, symbol, events""", recursive=True)
def placebo_p(spark, sf):
    events = vol.crash_events(_filtered(spark, sf), CELL, 2.0)
    windows = placebo.placebo_windows(market.tape(spark, sf), CELL, K, 42, SPAN, AFTER, LATER)
    return placebo.placebo_p(events, windows, CELL, "dp_pct").withColumns({c: r6(F.col(c)) for c in ("observed", "placebo", "p")})


@query("moved_intervals", f"""{KF}, m AS (SELECT venue, symbol, run, start_ts // {DAY} AS day, greatest({HOUR}, end_ts - start_ts) AS len, {uniform('3', 'symbol', 'start_ts')} AS u FROM ke)
SELECT venue, symbol, run::BIGINT AS run, day * {DAY} + floor(u * ({DAY} - len))::BIGINT AS start_ts, day * {DAY} + floor(u * ({DAY} - len))::BIGINT + len AS end_ts FROM m WHERE len < {DAY - HOUR}""", recursive=True)
def moved_intervals(spark, sf):
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0).select(*CELL, "run", "start_ts", "end_ts")
    return placebo.moved_intervals(e, "symbol", 3, least=HOUR)
