"""Queries on greedy scans and hashed draws; their SQL walks the rows of a key one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.stats import r6
from tapeloom.operators import flow, hft, policy, research, vol
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import HOUR, MARK
from tapeloom.plans.flow import DAYS, W
from tapeloom.plans.inference import MEAN, boot, uniform
from tapeloom.plans.vol import KF, _filtered
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR
SAME = "x.venue = s.venue AND x.symbol = s.symbol AND x.k = s.k + 1"
MOVE = "sign(x.px - s.px)::INT"
TURN = f"(({MOVE} <> 0 AND s.dir <> 0 AND {MOVE} <> s.dir) OR x.ts - s.start_ts > {DAY})"
LATE = f"x.ts - s.ts > {DAY}"


@query("directional_runs", f""", d0 AS (SELECT venue, symbol, ts, px, row_number() OVER {W} AS k FROM tape WHERE px > 0),
dr(venue, symbol, k, start_ts, ts, first, px, n, dir, o_start, o_end, o_n, o_pct, turned) AS (SELECT venue, symbol, k, ts, ts, px, px, 1, 0, ts, ts, 0, 0.0::DOUBLE, false FROM d0 WHERE k = 1 UNION ALL
SELECT s.venue, s.symbol, x.k, CASE WHEN {TURN} THEN CASE WHEN {LATE} THEN x.ts ELSE s.ts END ELSE s.start_ts END, x.ts, CASE WHEN {TURN} THEN CASE WHEN {LATE} THEN x.px ELSE s.px END ELSE s.first END, x.px,
 CASE WHEN {TURN} THEN CASE WHEN {LATE} THEN 1 ELSE 2 END ELSE s.n + 1 END, CASE WHEN {TURN} THEN CASE WHEN {LATE} THEN 0 ELSE {MOVE} END WHEN s.dir <> 0 THEN s.dir ELSE {MOVE} END, s.start_ts, s.ts, s.n, 100 * (s.px - s.first) / s.first, {TURN}
 FROM dr s JOIN d0 x ON {SAME}),
e AS (SELECT venue, symbol, o_start AS start_ts, o_end AS end_ts, o_n AS trades, o_pct AS pct FROM dr WHERE turned UNION ALL SELECT venue, symbol, start_ts, ts, n, 100 * (px - first) / first FROM dr WHERE k = (SELECT max(k) FROM d0 WHERE d0.venue = dr.venue AND d0.symbol = dr.symbol))
SELECT venue, symbol, start_ts, end_ts, trades, {R("pct")} AS pct FROM e WHERE trades >= 3 AND abs(pct) >= 0.5""", recursive=True)
def directional_runs(spark, sf):
    return vol.directional_runs(market.tape(spark, sf), CELL, DAY, 0.5, 3).withColumn("pct", r6(F.col("pct")))


@query("activity_bursts", f"""{DAYS}, b0 AS (SELECT venue, symbol, day AS bar, n AS v, row_number() OVER (PARTITION BY venue, symbol ORDER BY day) AS k FROM dc),
br(venue, symbol, k, bar, fired, armed, last) AS (SELECT venue, symbol, k, bar, v >= 10, v < 10, CASE WHEN v >= 10 THEN bar ELSE -1000000 END FROM b0 WHERE k = 1 UNION ALL
SELECT s.venue, s.symbol, x.k, x.bar, s.armed AND x.v >= 10 AND x.bar - s.last >= 2, CASE WHEN s.armed AND x.v >= 10 AND x.bar - s.last >= 2 THEN false ELSE s.armed OR x.v < 8 END, CASE WHEN s.armed AND x.v >= 10 AND x.bar - s.last >= 2 THEN x.bar ELSE s.last END FROM br s JOIN b0 x ON {SAME})
SELECT venue, symbol, bar FROM br WHERE fired""", recursive=True)
def activity_bursts(spark, sf):
    d = flow.daily_counts(market.tape(spark, sf), CELL)
    s = d.select(*CELL, F.col("day").alias("bar"), F.col("n").cast("double").alias("n"))
    return research.bursts(s, CELL, "n", 10.0, 8.0, 2)


@query("ignition_events", f""", m AS (SELECT venue, symbol, ts // {4 * HOUR} AS bar, arg_max(px, seq) AS mid FROM tape GROUP BY ALL), g AS (SELECT *, lag(mid, 2) OVER w AS m0, lead(mid, 2) OVER w AS m2, min(mid) OVER (w ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS lo, max(mid) OVER (w ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS hi FROM m WINDOW w AS (PARTITION BY venue, symbol ORDER BY bar)),
f AS (SELECT *, 1e4 * (m2 - mid) / mid AS move_bps, CASE WHEN m2 > mid THEN m2 - lo ELSE hi - m2 END / nullif(abs(m2 - mid), 0) AS recovery FROM g WHERE abs(1e4 * (mid - m0) / m0) <= 200),
c AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY bar) AS k FROM f WHERE abs(move_bps) >= 100 AND recovery >= 0.3),
r(venue, symbol, k, bar, move_bps, recovery, kept, bars_until) AS (SELECT venue, symbol, k, bar, move_bps, recovery, true, bar + 6 FROM c WHERE k = 1 UNION ALL
SELECT s.venue, s.symbol, x.k, x.bar, x.move_bps, x.recovery, x.bar >= s.bars_until, CASE WHEN x.bar >= s.bars_until THEN x.bar + 6 ELSE s.bars_until END FROM r s JOIN c x ON {SAME})
SELECT venue, symbol, bar, {R("move_bps")} AS move_bps, {R("recovery")} AS recovery FROM r WHERE kept""", recursive=True)
def ignition_events(spark, sf):
    bar = F.floor(F.col("ts") / (4 * HOUR)).alias("bar")
    b = market.tape(spark, sf).groupBy(*CELL, bar).agg(F.max_by("px", F.struct("ts", "seq")).alias("mid"))
    return hft.ignition(b, CELL, 200.0, 100.0, 0.3, (2, 2, 4)).select(*CELL, "bar", r6(F.col("move_bps")).alias("move_bps"), r6(F.col("recovery")).alias("recovery"))


EXIT = f"(s.open AND x.ts >= s.t + {4 * HOUR})"
ENTER = f"((NOT s.open OR {EXIT}) AND abs(x.z) >= 2 AND x.px <> 0)"


@query("sleeve_trades", f"""{KF}, z AS (SELECT venue, symbol, k, ts, px, z FROM kf),
sl(venue, symbol, k, ts, open, t, dir, px, o_t, o_ts, o_dir, o_px, o_exit, closed) AS (SELECT venue, symbol, k, ts, abs(z) >= 2 AND px <> 0, ts, CASE WHEN z > 0 THEN -1 ELSE 1 END, px, ts, ts, 0, px, px, false FROM z WHERE k = 1 UNION ALL
SELECT s.venue, s.symbol, x.k, x.ts, CASE WHEN {ENTER} THEN true WHEN {EXIT} THEN false ELSE s.open END, CASE WHEN {ENTER} THEN x.ts ELSE s.t END, CASE WHEN {ENTER} THEN CASE WHEN x.z > 0 THEN -1 ELSE 1 END ELSE s.dir END, CASE WHEN {ENTER} THEN x.px ELSE s.px END,
 s.t, x.ts, s.dir, s.px, x.px, {EXIT} FROM sl s JOIN z x ON {SAME})
SELECT venue, symbol, o_t AS entry_ts, o_ts AS exit_ts, o_dir AS direction, o_px AS entry, o_exit AS exit, {R("1e4 * o_dir * (o_exit - o_px) / o_px - 2")} AS pnl_bps FROM sl WHERE closed""", recursive=True)
def sleeve_trades(spark, sf):
    return policy.sleeve(_filtered(spark, sf), CELL, 2.0, 4 * HOUR, 1.0).withColumn("pnl_bps", r6(F.col("pnl_bps")))


@query("bootstrap_mean_markout", f"{MARK}, b AS (SELECT symbol, floor({uniform('7', 'ts', 'seq')} * 64)::BIGINT AS blk, count(*)::DOUBLE AS n, sum(markout) AS x FROM mk WHERE horizon = {HOUR} AND markout IS NOT NULL GROUP BY ALL)" + boot("b", "symbol", "blk", MEAN, 100, 7).replace("SELECT symbol, blocks,", "SELECT symbol,").replace("AS point,", "AS mean,"))
def bootstrap_mean_markout(spark, sf):
    m = flow.markouts(market.tape(spark, sf), market.tob(spark, sf), CELL, [HOUR])
    return policy.bootstrap_mean(m, ["symbol"], "markout", 100, 64, 7).select("symbol", *(r6(F.col(c)).alias(c) for c in ("mean", "low", "high")))


def _flips(draws: int) -> str:
    sums = ", ".join(f"abs(sum((1 - 2 * ((h{k // 32} >> {k % 32}) & 1)) * qty)) AS s{k}" for k in range(draws))
    return f"SELECT venue, symbol, abs(sum(side * qty)) AS observed, {sums} FROM hx GROUP BY ALL"


@query("sign_shuffle", f""", hs AS (SELECT *, md5(concat_ws('|', 17, seq)) AS h FROM tape), hx AS (SELECT venue, symbol, side, qty, {', '.join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i}" for i in range(4))} FROM hs), f AS ({_flips(100)})
SELECT venue, symbol, observed, ({' + '.join(f'(s{k} >= observed)::INT' for k in range(100))}) / 100 AS p FROM f""")
def sign_shuffle(spark, sf):
    return policy.sign_shuffle(market.tape(spark, sf), CELL, 100, 17)
