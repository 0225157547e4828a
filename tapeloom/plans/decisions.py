"""Queries on what a desk decides on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.stats import r6
from tapeloom.operators import decisions as act
from tapeloom.operators import flow, vol
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.book import HOUR
from tapeloom.plans.flow import DAYS
from tapeloom.plans.vol import KF, _filtered
from tapeloom.sources import market
from tapeloom.sources.market import CELL

DAY = 24 * HOUR
#: Events with made-up attributes that both engines derive alike.
EV = f"""{KF}, ev AS (SELECT *, CASE WHEN abs(z_peak) >= 3 THEN 'halt' WHEN abs(z_peak) >= 2.5 THEN 'size_cap' WHEN abs(z_peak) >= 2.2 THEN 'widen' ELSE 'observe' END AS tier, run % 7 = 0 AS nested, (run % 3) / 2.0 AS one, CASE WHEN run % 11 <> 0 THEN (run % 5) / 4.0 END AS two, end_seq % 9 - 4.0 AS mo1, end_seq % 13 - 6.0 AS mo5, CASE run % 3 WHEN 0 THEN 'v_recovery' WHEN 1 THEN 'continuation' ELSE 'partial' END AS kind FROM ke)
"""


def _events(spark, sf):
    z, run, s = F.abs("z_peak"), F.col("run"), F.col("end_seq")
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0)
    tier = F.when(z >= 3, "halt").when(z >= 2.5, "size_cap").when(z >= 2.2, "widen").otherwise("observe")
    kind = F.when(run % 3 == 0, "v_recovery").when(run % 3 == 1, "continuation").otherwise("partial")
    return e.withColumns({"tier": tier, "nested": run % 7 == 0, "one": (run % 3) / 2.0, "two": F.when(run % 11 != 0, (run % 5) / 4.0), "mo1": s % 9 - 4.0, "mo5": s % 13 - 6.0, "kind": kind})


@query("event_actions", f"""{EV} SELECT CASE WHEN tier IN ('widen', 'size_cap', 'halt') THEN 'ladder_fire' ELSE 'ladder_observe' END AS kind, CASE WHEN nested THEN 'nest_hard_pause' WHEN tier = 'halt' THEN 'halt_aggressive' ELSE tier END AS action, CASE WHEN nested THEN 'nested' END AS escalate, count(*) AS n, sum(CASE WHEN nested THEN 0 WHEN tier = 'widen' THEN 0.5 WHEN tier = 'size_cap' THEN 0.25 WHEN tier = 'halt' THEN 0 ELSE 1 END)::DOUBLE AS size,
 count(*) FILTER (WHERE nested OR tier = 'halt') AS pulls FROM ev GROUP BY ALL""", recursive=True)
def event_actions(spark, sf):
    a = act.event_actions(_events(spark, sf).drop("kind"), F.col("nested"))
    return a.groupBy("kind", "action", "escalate").agg(F.count("*").alias("n"), F.sum("size_mult").alias("size"), F.count(F.when(F.col("pull"), 1)).alias("pulls"))


@query("fire_pauses", f"""{EV}, p AS (SELECT venue, symbol, run, end_ts AS start_ts, end_ts + {6 * HOUR} AS end_ts FROM ev WHERE tier IN ('widen', 'size_cap', 'halt') AND end_ts > 0)
SELECT t.venue, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM p WHERE p.venue = t.venue AND p.symbol = t.symbol AND t.ts >= p.start_ts AND t.ts < p.end_ts)) AS paused FROM tape t GROUP BY t.venue""", recursive=True)
def fire_pauses(spark, sf):
    p = act.fire_pauses(_events(spark, sf), 6 * HOUR)
    rows = act.in_pause(market.tape(spark, sf), p, CELL)
    return rows.groupBy("venue").agg(F.count("*").alias("n"), F.count(F.when(F.col("paused"), 1)).alias("paused"))


@query("events_in_others_pauses", f"""{EV}, p AS (SELECT venue, symbol, run, end_ts AS start_ts, end_ts + {6 * HOUR} AS end_ts FROM ev WHERE tier IN ('widen', 'size_cap', 'halt') AND end_ts > 0)
SELECT e.venue, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM p WHERE p.venue = e.venue AND p.symbol = e.symbol AND p.run <> e.run AND e.end_ts >= p.start_ts AND e.end_ts < p.end_ts)) AS barred FROM ev e GROUP BY e.venue""", recursive=True)
def events_in_others_pauses(spark, sf):
    e = _events(spark, sf)
    rows = act.in_pause(e.select(*CELL, "run", F.col("end_ts").alias("ts"), F.col("run").alias("seq")), act.fire_pauses(e, 6 * HOUR), CELL, "run")
    return rows.groupBy("venue").agg(F.count("*").alias("n"), F.count(F.when(F.col("paused"), 1)).alias("barred"))


@query("regime_counts", f"""{EV}, p AS (SELECT venue, symbol, end_ts AS start_ts, end_ts + {6 * HOUR} AS end_ts FROM ev WHERE tier IN ('widen', 'size_cap', 'halt')), e AS (SELECT venue, symbol, end_ts AS ts, tier, nested FROM ev),
l AS (SELECT t.venue, t.symbol, t.ts, t.ts - e.ts <= {DAY} AS live, e.tier, e.nested FROM tape t ASOF LEFT JOIN e ON t.venue = e.venue AND t.symbol = e.symbol AND t.ts >= e.ts),
r AS (SELECT CASE WHEN coalesce(live AND nested, false) THEN 'nest_hard_pause' WHEN EXISTS (SELECT 1 FROM p WHERE p.venue = l.venue AND p.symbol = l.symbol AND l.ts >= p.start_ts AND l.ts < p.end_ts) THEN 'fire_pause' ELSE coalesce(CASE WHEN live THEN tier END, 'none') END AS regime FROM l) SELECT regime, count(*) AS n FROM r GROUP BY regime""", recursive=True)
def regime_counts(spark, sf):
    from tapeloom.operators.temporal import asof

    e = _events(spark, sf)
    refs = e.select(*CELL, F.col("end_ts").alias("ts"), F.col("run").alias("seq"), "tier", "nested")
    t = act.in_pause(market.tape(spark, sf), act.fire_pauses(e, 6 * HOUR), CELL)
    last = asof(t, refs, CELL, ["tier", "nested"], tolerance=DAY)
    return last.groupBy(act.regime(F.col("nested"), F.col("paused"), F.col("tier")).alias("regime")).agg(F.count("*").alias("n"))


@query("causal_classes", f"{EV} SELECT CASE WHEN two IS NULL THEN 'unknown' WHEN two >= 0.5 AND one >= 0.35 THEN 'v_recovery' WHEN two < 0.2 THEN 'continuation' ELSE 'partial' END AS class, count(*) AS n FROM ev GROUP BY class", recursive=True)
def causal_classes(spark, sf):
    return _events(spark, sf).groupBy(act.causal_class(F.col("two"), F.col("one")).alias("class")).agg(F.count("*").alias("n"))


def _rule(name, size):
    pnl = f"(-({size}) * mo5 - abs({size}) * 4.0)"
    return f"SELECT '{name}' AS rule, count(*) AS n, {R(f'avg({size})')} AS size_mean, count(*) FILTER (WHERE {size} > 0) AS traded, {R(f'avg({pnl})')} AS pnl_mean, {R(f'avg(CASE WHEN {size} > 0 THEN ({pnl} > 0)::INT END)')} AS hit_rate, {R(f'avg({pnl} - (-mo5 - 4.0))')} AS lift FROM q"


@query("size_rules", f"""{EV}, q AS (SELECT two AS p, mo5 FROM ev WHERE two IS NOT NULL) {_rule('always', '1.0')} UNION ALL {_rule('soft_linear', 'least(1.0, greatest(0.0, p))')} UNION ALL {_rule('soft_centered', 'least(1.0, greatest(0.0, 2 * p - 1))')}
UNION ALL {_rule('soft_piecewise', '(CASE WHEN p >= 0.7 THEN 1.0 WHEN p >= 0.4 THEN 0.5 ELSE 0.0 END)')} UNION ALL {_rule('soft_threshold', '(CASE WHEN p >= 0.55 THEN 1.0 ELSE 0.0 END)')}""", recursive=True)
def size_rules(spark, sf):
    s = act.size_rules(_events(spark, sf), "two", "mo5")
    return s.select("rule", "n", "traded", *(r6(F.col(c)).alias(c) for c in ("size_mean", "pnl_mean", "hit_rate", "lift")))


LADDER = "CASE tier WHEN 'widen' THEN 0.5 WHEN 'size_cap' THEN 0.25 WHEN 'halt' THEN 0.0 ELSE 1.0 END"
RESTORE = "CASE WHEN coalesce(one >= 0.5, false) THEN [0.5, 0.7, 1.0, 1.0] WHEN coalesce(two >= 0.5, false) THEN [0.5, 0.5, 0.85, 1.0] ELSE [0.5, 0.5, 0.5, 0.5] END"
CONFIRM = "CASE WHEN coalesce(one >= 0.5, false) AND coalesce(two >= 0.5, false) THEN [0.5, 0.5, 0.7, 1.0] WHEN coalesce(two >= 0.5, false) AND kind = 'v_recovery' THEN [0.5, 0.5, 0.5, 0.85] ELSE [0.5, 0.5, 0.5, 0.5] END"
PATHS = {
    "always_restore": "[1.0, 1.0, 1.0, 1.0]", "always_stay_wide": "[0.5, 0.5, 0.5, 0.5]", "ladder_only": f"[{LADDER}, {LADDER}, {LADDER}, {LADDER}]", "v_restore_confirm": RESTORE, "confirm_before_restore": CONFIRM,
    "ladder_plus_v_restore": f"list_transform({RESTORE}, lambda x: least(x, {LADDER}))", "ladder_plus_confirm_before_restore": f"list_transform({CONFIRM}, lambda x: least(x, {LADDER}))",
}


@query("policy_scores", f"""{EV}, p AS ({' UNION ALL '.join(f"SELECT '{name}' AS policy, ({path})::DOUBLE[] AS s, * FROM ev" for name, path in PATHS.items())}),
x AS (SELECT policy, (s[1] + s[2] + s[3] + s[4]) / 4 AS m, s[2] * greatest(mo1, 0) AS d1, s[4] * greatest(mo5, 0) AS d5, greatest(0, s[4] * greatest(mo5, 0) - 2.0 * s[4]) AS adverse, CASE WHEN tier IN ('size_cap', 'halt') OR nested THEN 1.0 ELSE 0.5 END AS deep FROM p)
SELECT policy, count(*) AS n, {R('avg(m)')} AS exposure, {R('avg(adverse)')} AS adverse, {R('avg(m * deep)')} AS hole, {R('avg(greatest(d1, d5))')} AS drawdown FROM x GROUP BY policy""", recursive=True)
def policy_scores(spark, sf):
    s = act.score_policies(_events(spark, sf))
    return s.select("policy", "n", *(r6(F.col(c)).alias(c) for c in ("exposure", "adverse", "hole", "drawdown")))


PNL = f""", d AS (SELECT venue, symbol, ts // {DAY} AS day, sum(side * qty) AS v FROM tape GROUP BY ALL), c AS (SELECT venue, symbol, count(*) AS n, avg(v) AS m, avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)) AS lo, avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*)) AS hi, avg(v) FILTER (WHERE day % 2 = 0) AS e, avg(v) FILTER (WHERE day % 2 = 1) AS l FROM d GROUP BY ALL)
"""


def _pnl(spark, sf):
    d = market.tape(spark, sf).groupBy(*CELL, F.floor(F.col("ts") / DAY).alias("day")).agg(F.sum(F.col("side") * F.col("qty")).alias("v"))
    half = 1.96 * F.stddev_samp("v") / F.sqrt(F.count("*"))
    return d, d.groupBy(*CELL).agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.avg("v") - half).alias("lo"), (F.avg("v") + half).alias("hi"), F.avg(F.when(F.col("day") % 2 == 0, F.col("v"))).alias("e"), F.avg(F.when(F.col("day") % 2 == 1, F.col("v"))).alias("l"))


@query("rule_verdicts", f"""{PNL}, x AS (SELECT *, coalesce(lo > 0 OR hi < 0, false) AS o, coalesce(e <> 0 AND l <> 0 AND (e > 0) = (l > 0), false) AS s FROM c)
SELECT venue, symbol, CASE WHEN n < 10 THEN 'Hold' WHEN m <= 0 THEN 'Kill' WHEN NOT o THEN 'Hold' WHEN NOT s THEN 'Kill' WHEN m <= 1 THEN 'Hold' ELSE 'Promote' END AS verdict,
 CASE WHEN n < 10 THEN 'monitor_only_underpowered' WHEN o AND s AND m > 1 THEN 'promote_as_risk_policy' WHEN o AND s THEN 'executable_rule_candidate_net_friction' ELSE 'monitor_only' END AS readiness FROM x""")
def rule_verdicts(spark, sf):
    c = _pnl(spark, sf)[1]
    outside = F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), F.lit(False))
    stable = F.coalesce((F.col("e") != 0) & (F.col("l") != 0) & ((F.col("e") > 0) == (F.col("l") > 0)), F.lit(False))
    v = act.verdict(F.col("n"), F.col("m"), F.col("lo"), F.col("hi"), F.col("e"), F.col("l"), F.col("m") > 1, 10)
    return c.select(*CELL, v.alias("verdict"), act.readiness(F.col("n"), outside, stable, F.col("m") > 1, least=10).alias("readiness"))


@query("rolling_kill", f"""{PNL}, p AS (SELECT venue, symbol, day, count(*) AS n, sum(side * (px - 100)) AS s FROM (SELECT *, ts // {DAY} AS day FROM tape) GROUP BY ALL), w AS (SELECT venue, symbol, sum(n) OVER o AS n, sum(s) OVER o AS s FROM p WINDOW o AS (PARTITION BY venue, symbol ORDER BY day ROWS 4 PRECEDING))
SELECT venue, symbol, {R('min(s / n) FILTER (WHERE n >= 5)')} AS worst, coalesce(min(s / n) FILTER (WHERE n >= 5) <= 0, false) AS tripped FROM w GROUP BY ALL""")
def rolling_kill(spark, sf):
    t = market.tape(spark, sf).withColumns({"day": F.floor(F.col("ts") / DAY), "pnl": F.col("side") * (F.col("px") - 100)})
    return act.rolling_kill(t, CELL, "day", "pnl", 5, 5).select(*CELL, r6(F.col("worst")).alias("worst"), "tripped")


@query("imputed_features", f"""{DAYS}, g AS (SELECT venue, symbol, day, CASE WHEN n % 3 <> 0 THEN n::DOUBLE END AS a, CASE WHEN buys > 0 THEN span_h END AS b, day % 4 <> 0 AS train FROM dc), m AS (SELECT venue, median(a) FILTER (WHERE train) AS ma, median(b) FILTER (WHERE train) AS mb FROM g GROUP BY venue)
SELECT venue, {R('sum(coalesce(a, ma, 0))')} AS a, {R('sum(coalesce(b, mb, 0))')} AS b FROM g JOIN m USING (venue) GROUP BY venue""")
def imputed_features(spark, sf):
    d = flow.daily_counts(market.tape(spark, sf), CELL)
    g = d.select("venue", "day", F.when(F.col("n") % 3 != 0, F.col("n").cast("double")).alias("a"), F.when(F.col("buys") > 0, F.col("span_h")).alias("b"))
    out = act.impute_median(g, ["venue"], F.col("day") % 4 != 0, ["a", "b"])
    return out.groupBy("venue").agg(r6(F.sum("a")).alias("a"), r6(F.sum("b")).alias("b"))


@query("fills_off_tape", "SELECT venue, count(*) AS bad FROM tape WHERE seq % 10 = 0 OR seq % 15 = 1 GROUP BY venue")
def fills_off_tape(spark, sf):
    t = market.tape(spark, sf)
    f = t.select(*CELL, "seq", F.when(F.col("seq") % 15 == 1, F.col("ts") + 1).otherwise(F.col("ts")).alias("ts"), F.when(F.col("seq") % 10 == 0, F.col("px") + 0.01).otherwise(F.col("px")).alias("px"))
    return act.fills_off_tape(f, t, CELL).groupBy("venue").agg(F.count("*").alias("bad"))


@query("already_moved", f"""{KF}, a AS (SELECT * FROM ke WHERE venue = 0), b AS (SELECT symbol, ts, px FROM tape WHERE venue = 1), p AS (SELECT a.*, b.px AS p0 FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.start_ts >= b.ts), q AS (SELECT p.*, b.px AS p1 FROM p ASOF LEFT JOIN b ON p.symbol = b.symbol AND p.end_ts >= b.ts),
d AS (SELECT *, CASE WHEN first - low >= high - first THEN -1 ELSE 1 END AS direction, 100 * greatest(high - first, first - low) / first AS dp FROM q) SELECT symbol, count(*) AS n, count(*) FILTER (WHERE direction * 100 * (p1 - p0) / p0 >= dp * 0.5 AND dp > 0) AS moved FROM d GROUP BY symbol""", recursive=True)
def already_moved(spark, sf):
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0).where("venue = 0")
    m = act.already_moved(e, market.tape(spark, sf).where("venue = 1").drop("venue"), ["symbol"])
    return m.groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(F.col("moved"), 1)).alias("moved"))


@query("joined_within", f"""{KF}, a AS (SELECT symbol, run, end_ts FROM ke WHERE venue = 0), b AS (SELECT symbol, end_ts + (run % 3) * {HOUR} AS end_ts, z_peak FROM ke WHERE venue = 1 UNION ALL SELECT symbol, end_ts, z_peak FROM ke WHERE venue = 0 AND run % 2 = 0),
m AS (SELECT a.symbol, a.run, a.end_ts, arg_min({{'t': b.end_ts, 'z': b.z_peak}}, {{'d': abs(b.end_ts - a.end_ts), 't': b.end_ts}}) FILTER (WHERE b.end_ts IS NOT NULL) AS x FROM a LEFT JOIN b ON a.symbol = b.symbol AND b.end_ts BETWEEN a.end_ts - {6 * HOUR} AND a.end_ts + {6 * HOUR} GROUP BY ALL)
SELECT symbol, CASE WHEN x IS NULL THEN 'miss' WHEN x.t = end_ts THEN 'exact' ELSE 'slack' END AS how, count(*) AS n, {R('sum(x.z)')} AS z FROM m GROUP BY ALL""", recursive=True)
def joined_within(spark, sf):
    e = vol.crash_events(_filtered(spark, sf), CELL, 2.0)
    a = e.where("venue = 0").select("symbol", F.col("run").alias("seq"), "end_ts")
    b = e.where("venue = 1").select("symbol", (F.col("end_ts") + (F.col("run") % 3) * HOUR).alias("end_ts"), "z_peak").unionByName(e.where("venue = 0 AND run % 2 = 0").select("symbol", "end_ts", "z_peak"))
    j = act.joined_within(a, b, ["symbol"], "end_ts", 6 * HOUR, ["z_peak"])
    return j.groupBy("symbol", "how").agg(F.count("*").alias("n"), r6(F.sum("z_peak")).alias("z"))


@query("thin_venues", f"""{KF}, v AS (SELECT symbol, venue, sum(qty) AS volume FROM tape GROUP BY ALL), k AS (SELECT symbol, venue, count(*) AS events FROM ke GROUP BY ALL), s AS (SELECT symbol, venue, volume / sum(volume) OVER (PARTITION BY symbol) AS v, coalesce(events, 0) / nullif(sum(coalesce(events, 0)) OVER (PARTITION BY symbol), 0) - volume / sum(volume) OVER (PARTITION BY symbol) AS x FROM v LEFT JOIN k USING (symbol, venue)),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v, venue) AS rv, row_number() OVER (PARTITION BY symbol ORDER BY x, venue) AS rx FROM s WHERE x IS NOT NULL) SELECT symbol, arg_min(venue, v) AS thin, {R('arg_min(x, v)')} AS thin_excess, {R('corr(rv, rx)')} AS rho FROM r GROUP BY symbol""", recursive=True)
def thin_venues(spark, sf):
    v = market.tape(spark, sf).groupBy("symbol", "venue").agg(F.sum("qty").alias("volume"))
    k = vol.crash_events(_filtered(spark, sf), CELL, 2.0).groupBy("symbol", "venue").agg(F.count("*").alias("events"))
    t = act.thin_venues(v.join(k, ["symbol", "venue"], "left").fillna(0, ["events"]), ["symbol"])
    return t.select("symbol", "thin", r6(F.col("thin_excess")).alias("thin_excess"), r6(F.col("rho")).alias("rho"))
