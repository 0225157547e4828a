"""What a desk decides on events: action ladders, pauses, sizes, policies, verdicts, kill criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import div, draw
from tapeloom.operators.inference import block_bootstrap, mean_stat
from tapeloom.operators.temporal import DAY_US, asof, merge_intervals, range_join

#: Quote size left under each tier, and which tiers count as a fire. Fixed values.
TIER_SIZE = {"observe": 1.0, "widen": 0.5, "size_cap": 0.25, "halt": 0.0}
FIRE = ["widen", "size_cap", "halt"]


def tier_size(tier: Column) -> Column:
    out = F.lit(1.0)
    for name, size in TIER_SIZE.items():
        out = F.when(tier == name, size).otherwise(out)
    return out


def event_actions(events: DataFrame, nested: Column, hard_pause: bool = True) -> DataFrame:
    """events (tier) with kind, size_mult, pull, takes, action and escalate: the ladder's action; an event
    nested in another detector's is a hard pause, or (hard_pause False) escalates if it fires."""
    tier = F.coalesce(F.when(F.col("tier").isin(*TIER_SIZE), F.col("tier")), F.lit("observe"))
    nested = F.coalesce(nested, F.lit(False))
    hard = nested if hard_pause else F.lit(False)
    size = F.when(hard, 0.0).otherwise(tier_size(tier))
    action = F.when(hard, "nest_hard_pause").when(tier == "halt", "halt_aggressive").otherwise(tier)
    escalate = F.when(hard | (nested & tier.isin(FIRE)), "nested")
    kind = F.when(tier.isin(FIRE), "ladder_fire").otherwise("ladder_observe")
    return events.withColumns({"kind": kind, "size_mult": size, "pull": size <= 0, "takes": F.when(size <= 0, "halt").otherwise("allow"), "action": action, "escalate": escalate})


def fire_pauses(events: DataFrame, hold: int) -> DataFrame:
    """The pauses that events of a firing tier start at their end: events with start_ts, end_ts of the pause."""
    fired = events.where(F.col("tier").isin(FIRE) & (F.col("end_ts") > 0) & (F.lit(hold) > 0))
    return fired.withColumns({"start_ts": F.col("end_ts"), "end_ts": F.col("end_ts") + hold})


def in_pause(rows: DataFrame, pauses: DataFrame, by: list[str], own: str | None = None, width: int = 600_000_000) -> DataFrame:
    """rows with paused: a pause holds [start_ts, end_ts) around ts. own: a column of both; a row is not
    barred by the pause of its own event. Pauses that overlap are one where no own event is exempt. Pauses are
    cut at multiples of `width`, so a long one meets the rows within it and no others."""
    spans = merge_intervals(pauses, by, "start_ts", "end_ts") if own is None else pauses.select(*by, own, "start_ts", "end_ts")
    keyed = rows.withColumn("_id", F.monotonically_increasing_id()) if "seq" not in rows.columns else rows.withColumn("_id", F.col("seq"))
    points = keyed.select(*by, "ts", "_id", *([own] if own is not None else []))
    met = range_join(spans.where("end_ts > start_ts"), points, by, F.col("start_ts"), F.col("end_ts") - 1, width)
    if own is not None:
        met = met.where(F.col(own) != F.col(f"r_{own}"))
    hit = met.select(*by, F.col("r__id").alias("_id")).distinct().withColumn("paused", F.lit(True))
    return keyed.join(hit, [*by, "_id"], "left").withColumn("paused", F.coalesce("paused", F.lit(False))).drop("_id")


def regime(nested: Column, paused: Column, tier: Column, hard_pause: bool = True) -> Column:
    """The name of what governs a moment: a nested hard pause, then a fire's pause, then the tier."""
    out = F.when(F.coalesce(paused, F.lit(False)), "fire_pause").otherwise(F.coalesce(tier, F.lit("none")))
    return F.when(F.coalesce(nested, F.lit(False)), "nest_hard_pause").otherwise(out) if hard_pause else out


def causal_class(two: Column, one: Column) -> Column:
    """The class of a recovery from its shares after one and two seconds, without looking further."""
    known = F.when(two >= 0.5, F.when(one.isNull() | (one >= 0.35), "v_recovery").otherwise("partial")).when(two < 0.2, "continuation").otherwise("partial")
    return F.when(two.isNull() | F.isnan(two), "unknown").otherwise(known)


def sizes(p: Column) -> dict[str, Column]:
    """How much to fade at a probability of recovery, under each rule."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return {
        "always": F.lit(1.0),
        "soft_linear": clip(p),
        "soft_centered": clip(2 * p - 1),
        "soft_piecewise": F.when(p >= 0.7, 1.0).when(p >= 0.4, 0.5).otherwise(0.0),
        "soft_threshold": F.when(p >= 0.55, 1.0).otherwise(0.0),
    }


def fade_pnl(size: Column, move: Column, cost: float = 4.0) -> Column:
    """What a fade of a size earns, in bps, on the move after it, less a round trip's cost."""
    return -size * move - F.abs(size) * cost


def size_rules(events: DataFrame, p: str, move: str, cost: float = 4.0) -> DataFrame:
    """rule, n, size_mean, traded, pnl_mean, hit_rate, lift: each rule's pnl, and over always fading."""
    own = events.where(F.col(p).isNotNull() & F.col(move).isNotNull())
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("size")) for k, v in sizes(F.col(p)).items())))
    rows = own.withColumn("_r", each).select("*", "_r.*").withColumn("pnl", fade_pnl(F.col("size"), F.col(move), cost))
    rows = rows.withColumn("over", F.col("pnl") - fade_pnl(F.lit(1.0), F.col(move), cost))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.avg("size").alias("size_mean"), F.count(F.when(F.col("size") > 0, 1)).alias("traded"), F.avg("pnl").alias("pnl_mean"), F.avg(F.when(F.col("size") > 0, (F.col("pnl") > 0).cast("double"))).alias("hit_rate"), F.avg("over").alias("lift"))


#: The size of a wide quote, and the policies' names. Fixed values.
WIDE = 0.5
POLICIES = ["always_restore", "always_stay_wide", "ladder_only", "v_restore_confirm", "confirm_before_restore", "ladder_plus_v_restore", "ladder_plus_confirm_before_restore"]


def size_path(policy: str, one: Column, two: Column, tier: Column, kind: Column, five: Column | None = None) -> list[Column]:
    """Relative quote sizes half a second, one, two and five seconds after an event, under a policy. one,
    two, five: shares recovered after one, two and five seconds; five stands in for two where that is null."""
    two = two if five is None else F.coalesce(two, five)
    first, second = F.coalesce(one >= 0.5, F.lit(False)), F.coalesce(two >= 0.5, F.lit(False))
    ladder, flat = tier_size(tier), lambda x: [x] * 4

    def pick(*branches):
        out = flat(F.lit(WIDE))
        for condition, path in reversed(branches):
            out = [F.when(condition, F.lit(a)).otherwise(b) for a, b in zip(path, out)]
        return out

    if policy.startswith("ladder_plus_"):
        base = {"ladder_plus_v_restore": "v_restore_confirm"}.get(policy, policy.removeprefix("ladder_plus_"))
        return [F.when(ladder > 0, F.least(x, ladder)).otherwise(0.0) for x in size_path(base, one, two, tier, kind, five)]
    return {
        "always_restore": lambda: flat(F.lit(1.0)),
        "always_stay_wide": lambda: flat(F.lit(WIDE)),
        "ladder_only": lambda: flat(ladder),
        "v_restore_confirm": lambda: pick((first, [WIDE, 0.7, 1.0, 1.0]), (second, [WIDE, WIDE, 0.85, 1.0])),
        "confirm_before_restore": lambda: pick((first & second, [WIDE, WIDE, 0.7, 1.0]), (second & (kind == "v_recovery"), [WIDE, WIDE, WIDE, 0.85])),
    }[policy]()


def score_policies(events: DataFrame, cost: float = 2.0, policies: list[str] = POLICIES) -> DataFrame:
    """policy, n, exposure, adverse, hole, drawdown: means over events (one, two, tier, kind, mo1, mo5,
    nested and, if it is there, recovery after five seconds) of the size held, of what moves against it cost beyond `cost`, of the size held in deep tiers,
    and of the worse of the two moves against it."""
    five = F.col("recovery") if "recovery" in events.columns else None
    paths = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.array(*(x.cast("double") for x in size_path(p, F.col("one"), F.col("two"), F.col("tier"), F.col("kind"), five))).alias("path")) for p in policies)))
    rows = events.withColumn("_p", paths).select("*", "_p.*")
    size = lambda k: F.element_at("path", k)
    mean = (size(1) + size(2) + size(3) + size(4)) / 4
    against = lambda m: F.coalesce(F.greatest(F.col(m), F.lit(0.0)), F.lit(0.0))
    adverse = F.greatest(F.lit(0.0), size(4) * against("mo5") - cost * size(4))
    deep = F.when(F.col("tier").isin("size_cap", "halt") | F.coalesce(F.col("nested"), F.lit(False)), 1.0).otherwise(0.5)
    worst = F.greatest(size(2) * against("mo1"), size(4) * against("mo5"))
    return rows.groupBy("policy").agg(F.count("*").alias("n"), F.avg(mean).alias("exposure"), F.avg(adverse).alias("adverse"), F.avg(mean * deep).alias("hole"), F.avg(worst).alias("drawdown"))


def verdict(n: Column, mean: Column, low: Column, high: Column, early: Column, late: Column, cleared: Column, least: int = 30) -> Column:
    """Promote, Hold or Kill a rule by its number of trades, interval, halves and costs."""
    outside = F.coalesce((low > 0) | (high < 0), F.lit(False))
    stable = F.coalesce((early != 0) & (late != 0) & ((early > 0) == (late > 0)), F.lit(False))
    loses = F.coalesce(mean <= 0, F.lit(False))
    return F.when(n < least, "Hold").when(loses, "Kill").when(~outside, "Hold").when(~stable, "Kill").when(~F.coalesce(cleared, F.lit(False)), "Hold").otherwise("Promote")


def readiness(n: Column, outside: Column, stable: Column, cleared: Column, monitored: Column | None = None, least: int = 30) -> Column:
    """How far a rule has come: a monitor, a candidate, a policy, or to be dropped."""
    known = F.when(n < least, "monitor_only_underpowered").when(outside & stable & cleared, "promote_as_risk_policy").when(outside & stable, "executable_rule_candidate_net_friction").otherwise("monitor_only")
    return known if monitored is None else F.when(~monitored, "kill_as_rule").otherwise(known)


def rename_gate(share: Column, n: Column, kill: float = 0.85) -> Column:
    """Whether a detector only renames another: by the share of its events that overlap the other's."""
    return F.when(share.isNull() | F.isnan(share), "hold").when((share >= kill) & (n >= 3), "kill_rename").when(share >= 0.5, "hold").otherwise("pass")


def rolling_kill(trades: DataFrame, by: list[str], day: str, pnl: str, days: int = 5, least: int = 20) -> DataFrame:
    """by, worst, tripped: the least mean pnl over `days` trading days with `least` trades or more, and
    whether it is at or under zero."""
    each = trades.where(F.col(pnl).isNotNull()).groupBy(*by, day).agg(F.count("*").alias("_n"), F.sum(pnl).alias("_s"))
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(-(days - 1), 0)
    each = each.withColumns({"_wn": F.sum("_n").over(w), "_ws": F.sum("_s").over(w)})
    out = each.groupBy(*by).agg(F.min(F.when(F.col("_wn") >= least, F.col("_ws") / F.col("_wn"))).alias("worst"))
    return out.withColumn("tripped", F.coalesce(F.col("worst") <= 0, F.lit(False)))


def impute_median(rows: DataFrame, by: list[str], train: Column, columns: list[str]) -> DataFrame:
    """rows with the gaps of `columns` filled by the key's median over the training rows, 0 if it has none."""
    good = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
    middle = rows.groupBy(*by).agg(*(F.median(F.when(train, good(c))).alias(f"_m_{c}") for c in columns))
    return rows.join(middle, by).withColumns({c: F.coalesce(good(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).drop(*(f"_m_{c}" for c in columns))


def fills_off_tape(fills: DataFrame, tape: DataFrame, by: list[str], eps: float = 1e-6) -> DataFrame:
    """The fills (seq, ts, px) that are not a print of the tape at their number, time and price."""
    own = tape.select(*by, "seq", F.col("ts").alias("_ts"), F.col("px").alias("_px"))
    met = fills.join(own, [*by, "seq"], "left")
    good = F.coalesce((F.col("ts") == F.col("_ts")) & (F.abs(F.col("px") - F.col("_px")) <= eps), F.lit(False))
    return met.where(~good).drop("_ts", "_px")


def already_moved(events: DataFrame, tape: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """events with moved: between start_ts and end_ts the other tape has gone `share` of dp_pct in the
    event's direction. Both prices as of their times."""
    names = {"px": "_p0", "ref_ts": "_t0"}
    one = asof(events.withColumn("seq", F.col("run")), tape, by, ["px"], at="start_ts").withColumnsRenamed(names)
    two = asof(one, tape, by, ["px"], at="end_ts").drop("ref_ts")
    gone = F.col("direction") * 100 * div(F.col("px") - F.col("_p0"), F.col("_p0"))
    goal = F.abs("dp_pct") * share
    return two.withColumn("moved", F.coalesce((gone >= goal) & (goal > 0), F.lit(False))).drop("px", "_p0", "_t0", "seq")


def joined_within(left: DataFrame, right: DataFrame, by: list[str], at: str, slack: int, values: list[str]) -> DataFrame:
    """left with `values` of the row of right at the same time, else of the nearest within slack (the
    earlier of two), and how: exact, slack or miss. left has seq."""
    r = right.select(*by, F.col(at).alias("ts"), *values)
    met = range_join(left.select(*by, "seq", at), r, by, F.col(at) - slack, F.col(at) + slack, max(1, 2 * slack))
    best = met.groupBy(*by, "seq").agg(F.min_by(F.struct(F.col("r_ts"), *(F.col(f"r_{v}").alias(v) for v in values)), F.struct(F.abs(F.col("r_ts") - F.col(at)), "r_ts")).alias("_b"))
    out = left.join(best, [*by, "seq"], "left")
    how = F.when(F.col("_b").isNull(), "miss").when(F.col("_b.r_ts") == F.col(at), "exact").otherwise("slack")
    return out.withColumns({"how": how} | {v: F.col(f"_b.{v}") for v in values}).drop("_b")


def thin_venues(shares: DataFrame, by: list[str]) -> DataFrame:
    """by, thin, thin_excess, rho: the venue of the least volume share, by how much its share of events
    is over it, and the rank correlation of volume shares and excess. shares: venue, volume, events."""
    w = Window.partitionBy(*by)
    own = shares.withColumns({"_v": F.col("volume") / F.sum("volume").over(w), "_e": F.col("events") / F.nullif(F.sum("events").over(w), F.lit(0))})
    own = own.withColumn("_x", F.col("_e") - F.col("_v")).where("_x IS NOT NULL")
    ranked = own.withColumns({"_rv": F.row_number().over(w.orderBy("_v", "venue")), "_rx": F.row_number().over(w.orderBy("_x", "venue"))})
    return ranked.groupBy(*by).agg(F.min_by("venue", F.struct("_v", "venue")).alias("thin"), F.min_by("_x", F.struct("_v", "venue")).alias("thin_excess"), F.when(F.count("*") > 1, F.corr("_rv", "_rx")).alias("rho"))


#: How far up the ladder a tier is. Fixed values.
TIER_RANK = {"observe": 1, "widen": 2, "size_cap": 3, "halt": 4}


def event_clock(prints: DataFrame, events: DataFrame, by: list[str], hold: int, pull: int, manage: int, slice_: int = DAY_US) -> DataFrame:
    """prints with tier, nested, managed, kind, one and two: what events in force at a print say.

    events: end_ts, seq, tier, nested, kind, one, two. From its end on (both ends of a hold count), an event holds its
    tier for `hold`, its nest for `pull`, and its class (kind, one, two) for `manage`. Of tiers that overlap the highest
    rules, of classes that of the last event, by end_ts and seq; else tier is none and kind unknown. An event
    without a known tier is observe; events that end at 0 or before, or never, do not count.

    Prints and events' ends are swept in order of time. A hold has one length, so the latest start of each tier
    tells whether any is in force: the sweep carries one number a tier, within slices, and from slice to
    slice a row a slice."""
    known = F.coalesce(F.when(F.col("tier").isin(*TIER_RANK), F.col("tier")), F.lit("observe"))
    ends = events.where(F.col("end_ts") > 0).select(*by, F.col("end_ts").alias("_t"), F.col("seq").alias("_s"), known.alias("_tier"), F.coalesce("nested", F.lit(False)).alias("_nested"), F.struct(F.col("end_ts").alias("at"), F.col("seq").alias("seq"), "kind", F.col("one").cast("double").alias("one"), F.col("two").cast("double").alias("two")).alias("_class"))
    rows = prints.withColumns({"_t": F.col("ts"), "_q": F.lit(1)}).unionByName(ends.withColumn("_q", F.lit(0)), allowMissingColumns=True).withColumn("_slice", F.floor(F.col("_t") / slice_))
    start = {**{f"_{name}": F.when(F.col("_tier") == name, F.col("_t")) for name in TIER_RANK}, "_nest": F.when(F.col("_nested"), F.col("_t")), "_last": F.col("_class")}
    w = Window.partitionBy(*by, "_slice").orderBy("_t", "_q", "_s").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumns({c: F.max(x).over(w) for c, x in start.items()}).where("_q = 1")
    into = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*by, "_slice").agg(*(F.max(x).alias(c) for c, x in start.items())).select(*by, "_slice", *(F.max(c).over(into).alias(f"{c}_in") for c in start))
    met = swept.join(carried, [*by, "_slice"], "left").withColumns({c: F.coalesce(c, f"{c}_in") for c in start})

    def within(column: str, length: int) -> Column:
        return F.coalesce(F.col("ts") <= F.col(column) + length, F.lit(False))

    tier = F.lit("none")
    for name in TIER_RANK:
        tier = F.when(within(f"_{name}", hold), name).otherwise(tier)
    managed = within("_last.at", manage)
    said = {"tier": tier, "nested": within("_nest", pull), "managed": managed, "kind": F.when(managed, F.coalesce("_last.kind", F.lit("unknown"))).otherwise("unknown"), **{c: F.when(managed, F.col(f"_last.{c}")) for c in ("one", "two")}}
    return met.select(*prints.columns, *(x.alias(c) for c, x in said.items()))


#: Marks of the kill criteria. Fixed values.
KILLS = {"days": 5, "least": 20, "hit_least": 40, "hit_kill": 0.55, "hit_warn": 0.65, "stop_least": 30, "stop_share": 0.4, "cost_bps": 5.0}


def evaluate_kills(trades: DataFrame, by: list[str], day: str, pnl: str, seq: str, early: Column, late: Column, stopped: Column, cost_bps: float = 2.0, floor_on: Column | None = None, skipped: bool = False, live: bool = False, draws: int = 800, seed: int = 42, marks: dict = KILLS) -> DataFrame:
    """by, n, mean, low, high, early_mean, late_mean, hit_rate, stop_share, the criteria as flags (k1 to k8), hit_warn and
    decision (Kill, Hold under `least` trades, else Promote_shadow).

    k1: a mean of no more than 0 over `days` trading days with `least` trades or more; k2: an interval of the mean that holds 0;
    k3: means of early and late days of unlike signs; k4: a low hit rate; k5: a high share of stops among all trades;
    k6: costs over the mark; k7: the detector's floor was off (floor_on false for any trade) or it skipped; k8: live
    orders. Flags that need `least` (hit_least, stop_least) trades are false under that. Trades without a pnl count for stops only.
    The interval is of block sums under Poisson weights of the trades' hashes."""
    x = F.when(~F.isnan(F.col(pnl).cast("double")), F.col(pnl).cast("double"))
    on = F.lit(True) if floor_on is None else F.coalesce(floor_on, F.lit(True))
    own = trades.select(*by, F.col(day).alias("_day"), F.col(seq).alias("_seq"), x.alias("_x"), early.alias("_early"), late.alias("_late"), stopped.alias("_stop"), on.alias("_on"))
    part = lambda c: F.when(F.col(c), F.col("_x"))
    total = own.groupBy(*by).agg(
        F.count("_x").alias("n"), F.count("*").alias("_all"), F.avg("_x").alias("mean"), F.avg(part("_early")).alias("early_mean"), F.avg(part("_late")).alias("late_mean"), (F.count(part("_early")) + F.count(part("_late"))).alias("_halves"),
        F.avg((F.col("_x") > 0).cast("double")).alias("hit_rate"), F.avg(F.coalesce(F.col("_stop"), F.lit(False)).cast("double")).alias("stop_share"), F.min("_on").alias("_floor"),
    )
    fine = own.where("_x IS NOT NULL")
    blocks = fine.groupBy(*by, F.floor(draw(F.lit(seed), F.col("_seq")) * 64).alias("_blk")).agg(F.count("*").cast("double").alias("n"), F.sum("_x").alias("x"))
    interval = block_bootstrap(blocks, by, "_blk", ["n", "x"], mean_stat, draws, seed).select(*by, "low", "high")
    kill = rolling_kill(fine, by, "_day", "_x", marks["days"], marks["least"]).select(*by, F.col("tripped").alias("k1"))
    out = total.join(interval, by, "left").join(kill, by, "left")
    powered = F.col("n") >= marks["least"]
    flags = {
        "k1": F.col("k1"), "k2": powered & ~((F.col("low") > 0) | (F.col("high") < 0)), "k3": (F.col("early_mean") * F.col("late_mean") < 0) & (F.col("_halves") >= marks["least"]),
        "k4": (F.col("n") >= marks["hit_least"]) & (F.col("hit_rate") < marks["hit_kill"]), "k5": (F.col("_all") >= marks["stop_least"]) & (F.col("stop_share") > marks["stop_share"]),
        "k6": F.lit(cost_bps > marks["cost_bps"]), "k7": F.lit(skipped) | ~F.col("_floor"), "k8": F.lit(live),
    }
    out = out.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    warn = (F.col("n") >= marks["hit_least"]) & (F.col("hit_rate") < marks["hit_warn"]) & ~F.col("k4")
    any_ = F.greatest(*(F.col(k) for k in flags))
    decision = F.when(any_, "Kill").when(~powered, "Hold").otherwise("Promote_shadow")
    return out.withColumns({"hit_warn": F.coalesce(warn, F.lit(False)), "decision": decision}).drop("_all", "_halves", "_floor")
