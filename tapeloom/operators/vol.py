"""Realised variance, two-scale estimators, drift bursts, filters and crash events."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.fold import fold
from tapeloom.functions.stats import div, log_change
from tapeloom.operators.clustering import affine_scan
from tapeloom.operators.temporal import DAY_US, asof, before, forward, grid, nearest, range_join, runs
from tapeloom.sources.shared import table

BPS = 1e4


def log_prices(rows: DataFrame, by: list[str], px: str = "px") -> DataFrame:
    """by, k (from 0, in order), x: the log of prices above zero."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy("ts", "seq")) - 1
    return rows.where(F.col(px) > 0).select(*by, "ts", "seq", F.ln(px).alias("x")).withColumn("k", k)


def sparse_rv(points: DataFrame, by: list[str], step: int) -> DataFrame:
    """by, offset, n, rv: realised variance on every step-th point, for each of the step offsets."""
    w = Window.partitionBy(*by, "offset").orderBy("k")
    rows = points.withColumn("offset", F.col("k") % step).withColumn("r", F.col("x") - F.lag("x").over(w))
    return rows.groupBy(*by, "offset").agg(F.count("r").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rv"))


def two_scales(points: DataFrame, by: list[str], step: int) -> DataFrame:
    """by, n, all (every point), sparse (offset 0), average (of the offsets), tsrv, tsrv_adj, noise."""
    every = sparse_rv(points, by, 1).select(*by, F.col("n"), F.col("rv").alias("all"))
    each = sparse_rv(points, by, step)
    sub = each.groupBy(*by).agg(F.avg("rv").alias("average"), F.avg("n").alias("n_bar"), F.max(F.when(F.col("offset") == 0, F.col("rv"))).alias("sparse"))
    out = every.join(sub, by)
    raw = F.col("average") - div(F.col("n_bar"), F.col("n").cast("double")) * F.col("all")
    return out.select(*by, "n", "all", "sparse", "average", raw.alias("tsrv"), div(raw, 1 - F.col("n_bar") / F.col("n")).alias("tsrv_adj"), div(F.col("all"), 2.0 * F.col("n")).alias("noise"))


def signature(points: DataFrame, by: list[str], steps: list[int]) -> DataFrame:
    """by, step, rv: realised variance on every step-th point from the first."""
    rows = points.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).where(F.col("k") % F.col("step") == 0)
    rows = rows.withColumn("r", F.col("x") - F.lag("x").over(Window.partitionBy(*by, "step").orderBy("k")))
    return rows.groupBy(*by, "step").agg(F.sum(F.col("r") * F.col("r")).alias("rv"))


def return_acf(points: DataFrame, by: list[str], most_lag: int) -> DataFrame:
    """by, lag, acf of demeaned returns, over n."""
    w = Window.partitionBy(*by).orderBy("k")
    r = points.withColumn("r", F.col("x") - F.lag("x").over(w)).where("r IS NOT NULL")
    r = r.withColumn("d", F.col("r") - F.avg("r").over(Window.partitionBy(*by)))
    r = r.withColumns({f"l{i}": F.col("d") * F.lag("d", i).over(w) for i in range(1, most_lag + 1)})
    s = r.groupBy(*by).agg(F.sum(F.col("d") * F.col("d")).alias("s"), *(F.sum(f"l{i}").alias(f"l{i}") for i in range(1, most_lag + 1)))
    return s.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("lag"), div(F.col(f"l{i}"), F.col("s")).alias("acf")) for i in range(1, most_lag + 1)))).alias("x")).select(*by, "x.*")


def pre_averaged(points: DataFrame, by: list[str], kn: int) -> DataFrame:
    """by, k, y: sums of kn - 1 returns under triangular weights."""
    w = Window.partitionBy(*by).orderBy("k")
    r = points.withColumn("r", F.col("x") - F.lag("x").over(w)).where("r IS NOT NULL")
    y = sum(min(j / kn, 1 - j / kn) * F.lead("r", j - 1).over(w) for j in range(1, kn))
    return r.withColumn("y", y).where("y IS NOT NULL").select(*by, "k", "y")


def _burst(sums: DataFrame, by: list[str], k2: float, scale: float) -> DataFrame:
    """T statistics S / sqrt(k2 Q) on either side, and the square root of the width times their product."""
    t = lambda s, q: F.col(s) / F.nullif(F.sqrt(k2 * F.col(q)), F.lit(0.0))
    out = sums.select(*by, "tau", t("sl", "ql").alias("t_minus"), t("sr", "qr").alias("t_plus"))
    return out.withColumn("v", math.sqrt(scale) * F.col("t_minus") * F.col("t_plus"))


def drift_burst_uniform(returns: DataFrame, by: list[str], taus: DataFrame, width: int, unit: float = 1e6) -> DataFrame:
    """by, tau, t_minus, t_plus, v as drift_burst, under one-sided uniform kernels of `width`."""
    near = range_join(taus, returns.where("r IS NOT NULL").select(*by, "ts", "r"), by, F.col("tau") - width, F.col("tau") + width, 2 * width)
    left, right = F.col("r_ts") <= F.col("tau"), F.col("r_ts") >= F.col("tau")
    part = lambda side, x: F.sum(F.when(side, x))
    r, rr = F.col("r_r"), F.col("r_r") * F.col("r_r")
    sums = near.groupBy(*by, "tau").agg(part(left, r).alias("sl"), part(left, rr).alias("ql"), part(right, r).alias("sr"), part(right, rr).alias("qr"))
    return _burst(sums, by, 1.0, width / unit)


def drift_burst(returns: DataFrame, by: list[str], taus: DataFrame, width: int, unit: float = 1e6, reach: int = 40) -> DataFrame:
    """by, tau, t_minus, t_plus, v: sqrt(h) times the product of the one-sided t statistics before and
    after tau, under exponential kernels of `width` (h, in `unit`s). taus: by, tau.

    Returns are summed once in buckets of the width; a tau takes the sums of `reach` buckets on either
    side, decayed to it, and the returns of its own bucket one by one. What lies further weighs less than
    the last digit of a double."""
    h = float(width)
    rows = returns.where("r IS NOT NULL").select(*by, "ts", "r").withColumn("_k", F.floor(F.col("ts") / width))
    after = F.exp(-(F.col("ts") - F.col("_k") * width) / h)
    to_end = F.exp((F.col("ts") - (F.col("_k") + 1) * width) / h)
    rr = F.col("r") * F.col("r")
    sums = rows.groupBy(*by, "_k").agg(F.sum(to_end * F.col("r")).alias("sl"), F.sum(to_end * rr).alias("ql"), F.sum(after * F.col("r")).alias("sr"), F.sum(after * rr).alias("qr"))
    own = taus.select(*by, "tau").withColumn("_own", F.floor(F.col("tau") / width))
    far = own.withColumn("_k", F.explode(F.sequence(F.col("_own") - reach, F.col("_own") + reach))).where("_k != _own").join(sums, [*by, "_k"])
    back, ahead = F.exp(((F.col("_k") + 1) * width - F.col("tau")) / h), F.exp(-(F.col("_k") * width - F.col("tau")) / h)
    left, right = F.when(F.col("_k") < F.col("_own"), back), F.when(F.col("_k") > F.col("_own"), ahead)
    far = far.select(*by, "tau", *((side * F.col(c)).alias(c) for side, c in ((left, "sl"), (left, "ql"), (right, "sr"), (right, "qr"))))
    near = own.withColumnRenamed("_own", "_k").join(rows, [*by, "_k"])
    w = F.exp(-F.abs(F.col("ts") - F.col("tau")) / h)
    before_, after_ = F.when(F.col("ts") <= F.col("tau"), w), F.when(F.col("ts") >= F.col("tau"), w)
    near = near.select(*by, "tau", *((side * x).alias(c) for side, x, c in ((before_, F.col("r"), "sl"), (before_, rr, "ql"), (after_, F.col("r"), "sr"), (after_, rr, "qr"))))
    total = far.unionByName(near).groupBy(*by, "tau").agg(*(F.sum(c).alias(c) for c in ("sl", "ql", "sr", "qr")))
    return _burst(total, by, 0.5, width / unit)


def least_burst(path: DataFrame, by: list[str]) -> DataFrame:
    """by, min_v, tau, t_minus, t_plus, shape: the least v of each key, the earliest of equal ones. A V
    falls and then rises, a Lambda rises and then falls."""
    best = path.where("v IS NOT NULL").groupBy(*by).agg(F.min_by(F.struct("v", "tau", "t_minus", "t_plus"), F.struct("v", "tau")).alias("x"))
    shape = F.when((F.col("x.t_minus") < 0) & (F.col("x.t_plus") > 0), "V").when((F.col("x.t_minus") > 0) & (F.col("x.t_plus") < 0), "Lambda").otherwise("other")
    return best.select(*by, F.col("x.v").alias("min_v"), "x.tau", "x.t_minus", "x.t_plus", shape.alias("shape"))


def garch(returns: DataFrame, by: list[str], omega: float, alpha: float, beta: float) -> DataFrame:
    """by, ts, h: the variance forecast before each return, from the unconditional variance on; a scan by days."""
    r = returns.where("r IS NOT NULL")
    x = affine_scan(r, by, ["ts", "seq"], F.lit(beta), omega + alpha * F.col("r") * F.col("r"), omega / (1 - alpha - beta), DAY_US)
    return x.select(*by, "ts", F.col("before").alias("h"))


def kalman(rows: DataFrame, by: list[str], process: float, measure: float) -> DataFrame:
    """by, ts, seq, px, z: standardised innovations of a local level on log prices; the process variance
    grows with the seconds between prints. Prices at or under zero are skipped."""
    def step(s, ts, seq, px):
        if px is None or px <= 0:
            return ()
        y = math.log(px)
        if s["x"] is None:
            s.update(x=y, p=measure, t=ts)
            return [(ts, seq, px, 0.0)]
        p = s["p"] + process * (ts - s["t"]) / 1e6
        v = p + measure
        e = y - s["x"]
        s.update(x=s["x"] + p / v * e, p=p * (1 - p / v), t=ts)
        return [(ts, seq, px, e / math.sqrt(v))]

    return fold(rows, by, ["ts", "seq"], ["ts", "seq", "px"], lambda: {"x": None, "p": 0.0, "t": 0}, step, "ts long, seq long, px double, z double")


def kalman_by_print(rows: DataFrame, by: list[str], least: float = 1e-18) -> DataFrame:
    """by, ts, seq, px, z: innovations as of kalman, with the variances of each print: process (of the time since the
    print before) and measure. The first print of a key has z 0."""
    def step(s, ts, seq, px, process, measure):
        if px is None or px <= 0:
            return ()
        y = math.log(px)
        if s["x"] is None:
            s.update(x=y, p=max(measure, 1e-12))
            return [(ts, seq, px, 0.0)]
        p = s["p"] + max(process, least)
        v = p + max(measure, least)
        e = y - s["x"]
        s.update(x=s["x"] + p / v * e, p=p * (1 - p / v))
        return [(ts, seq, px, e / math.sqrt(v))]

    return fold(rows, by, ["ts", "seq"], ["ts", "seq", "px", "process", "measure"], lambda: {"x": None, "p": 0.0}, step, "ts long, seq long, px double, z double")


def mc_garch_bars(rows: DataFrame, by: list[str], bar: int, slots: int, alpha: float = 0.05, beta: float = 0.9, least: int = 4) -> DataFrame:
    """by, ts, seq (of the bar's last trade), r, h, s, q, composite: the variance of each bar as that of its day (the sum
    of squared returns), times that of its time of day (mean over days, 1 on average), times a GARCH(1, 1) of
    what is left (1 on average). Keys with fewer than `least` returns have no bars."""
    last = rows.where("px > 0").groupBy(*by, F.floor(F.col("ts") / bar).alias("_bar")).agg(F.max(F.struct("ts", "seq", F.ln("px").alias("_x"))).alias("_m"))
    w = Window.partitionBy(*by)
    bars = last.select(*by, "_m.*").withColumn("r", F.col("_x") - F.lag("_x").over(w.orderBy("ts"))).where("r IS NOT NULL").drop("_x")
    bars = bars.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least).drop("_n")
    own = F.col("r") * F.col("r")
    day = F.greatest(F.sum(own).over(Window.partitionBy(*by, F.floor(F.col("ts") / DAY_US))), F.lit(1e-18))
    bars = table(bars.withColumns({"h": day, "_slot": F.floor((F.col("ts") % DAY_US) / bar) % slots}))
    slot = bars.groupBy(*by, "_slot").agg(F.avg(own / F.col("h")).alias("_v"))
    mean = F.avg("_v").over(w)
    bars = bars.join(slot.select(*by, "_slot", F.when(mean > 0, F.col("_v") / mean).otherwise(F.col("_v")).alias("s")), [*by, "_slot"])
    left = own / F.greatest(F.col("h") * F.col("s"), F.lit(1e-18))
    q = affine_scan(bars, by, ["ts", "seq"], F.lit(beta), 1e-4 + alpha * left, 1.0, DAY_US, ["r", "h", "s"])
    q = q.withColumn("q", F.col("before") / F.greatest(F.avg("before").over(w), F.lit(1e-12)))
    return q.select(*by, "ts", "seq", "r", "h", "s", "q", (F.col("h") * F.col("s") * F.col("q")).alias("composite"))


def crash_events(filtered: DataFrame, by: list[str], least_z: float) -> DataFrame:
    """by, run, start_ts, end_ts, end_seq, prints, dp_pct, direction, z_peak, first, last of the runs with
    |z| at the mark or over. direction and dp_pct: of the larger excursion from the first price, down if
    they are equal."""
    r = runs(filtered, by, F.abs("z") >= least_z)
    place = F.struct("ts", "seq")
    out = r.groupBy(*by, "run").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max_by("seq", place).alias("end_seq"), F.count("*").alias("prints"), F.min_by("px", place).alias("first"),
        F.max_by("px", place).alias("last"), F.min("px").alias("low"), F.max("px").alias("high"), F.max_by("z", F.abs("z")).alias("z_peak"),
    )
    down, up = F.col("first") - F.col("low"), F.col("high") - F.col("first")
    direction = F.when(down >= up, -1).otherwise(1)
    return out.select(*by, "run", "start_ts", "end_ts", "end_seq", "prints", (100 * F.greatest(up, down) / F.nullif(F.col("first"), F.lit(0.0))).alias("dp_pct"), direction.alias("direction"), "z_peak", "first", "last")


def severity_gate(events: DataFrame, least_pct: float = 0.1, least_prints: int = 5, least_z: float | None = None, least_us: int = 0) -> DataFrame:
    """Events of a large enough move, number of prints, peak and length."""
    out = events.where((F.abs("dp_pct") >= least_pct) & (F.col("prints") >= least_prints))
    if least_us > 0:
        out = out.where(F.col("end_ts") - F.col("start_ts") >= least_us)
    return out if least_z is None else out.where(F.abs("z_peak") >= least_z)


def recovery(events: DataFrame, trades: DataFrame, by: list[str], horizon: int, recovered: float = 0.5, continued: float = 0.2) -> DataFrame:
    """events with recovery and kind. recovery: the largest way back from the last price, within the
    horizon, over the way from the first price to the last; 0 without a later print, null where that way
    is none, whose kind is unknown."""
    met = range_join(events, trades.select(*by, "ts", "seq", "px"), by, F.col("end_ts"), F.col("end_ts") + horizon, max(1, horizon))
    met = met.where((F.col("r_ts") > F.col("end_ts")) | (F.col("r_seq") > F.col("end_seq")))
    back = met.groupBy(*by, "run").agg(F.max("r_px").alias("_top"), F.min("r_px").alias("_bottom"))
    rebound = F.when(F.col("direction") > 0, F.col("last") - F.col("_bottom")).otherwise(F.col("_top") - F.col("last"))
    share = F.greatest(F.lit(0.0), F.coalesce(rebound, F.lit(0.0))) / F.nullif(F.abs(F.col("last") - F.col("first")), F.lit(0.0))
    kind = F.when(F.col("recovery").isNull(), "unknown").when(F.col("recovery") >= recovered, "v_recovery").when(F.col("recovery") < continued, "continuation").otherwise("partial")
    return events.join(back, [*by, "run"], "left").withColumn("recovery", share).withColumn("kind", kind).drop("_top", "_bottom")


def directional_runs(rows: DataFrame, by: list[str], most_us: int, least_pct: float, least_trades: int) -> DataFrame:
    """by, start_ts, end_ts, trades, pct: one-way runs (equal prices go on) within most_us whose move
    reaches least_pct; a run ends at a turn or when it is too long, and the next starts there."""
    def emit(s):
        moved = 100 * (s["px"] - s["first"]) / s["first"] if s["first"] else 0.0
        return [(s["start"], s["ts"], s["n"], moved)] if s["n"] >= least_trades and abs(moved) >= least_pct else []

    def step(s, ts, px):
        if px is None or px <= 0:
            return ()
        if s["n"] == 0:
            s.update(start=ts, ts=ts, first=px, px=px, n=1, dir=0)
            return ()
        move = (px > s["px"]) - (px < s["px"])
        if (move and s["dir"] and move != s["dir"]) or ts - s["start"] > most_us:
            out = emit(s)
            s.update(start=s["ts"], first=s["px"], px=px, ts=ts, n=2, dir=move)
            if ts - s["start"] > most_us:
                s.update(start=ts, first=px, n=1, dir=0)
            return out
        s.update(px=px, ts=ts, n=s["n"] + 1, dir=s["dir"] or move)
        return ()

    return fold(rows, by, ["ts", "seq"], ["ts", "px"], lambda: {"n": 0}, step, "start_ts long, end_ts long, trades long, pct double", lambda s: emit(s) if s["n"] else ())


def outside_quotes(trades: DataFrame, quotes: DataFrame, by: list[str], eps: float = 0.0) -> DataFrame:
    """trades with outside: the price lies outside the quote in force, by more than eps."""
    q = asof(trades, quotes, by, ["bid", "ask"])
    return q.withColumn("outside", (F.col("px") > F.col("ask") + eps) | (F.col("px") < F.col("bid") - eps))


def diurnal(returns: DataFrame, by: list[str], bar: int, slots: int) -> DataFrame:
    """by, slot, s: mean squared return of each time of day over the mean of all observed slots; 1 for
    slots without a return."""
    r = returns.where("r IS NOT NULL").groupBy(*by, (F.floor(F.col("ts") / bar) % slots).alias("slot")).agg(F.avg(F.col("r") * F.col("r")).alias("v"))
    r = r.withColumn("s", div(F.col("v"), F.avg("v").over(Window.partitionBy(*by))))
    every = returns.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    return every.join(r, [*by, "slot"], "left").select(*by, "slot", F.coalesce("s", F.lit(1.0)).alias("s"))


def bar_returns(rows: DataFrame, by: list[str], bar: int) -> DataFrame:
    """by, ts (start of the bar), seq, r: log returns between the last prices of bars; bars without a
    trade are left out."""
    last = rows.where("px > 0").groupBy(*by, (F.floor(F.col("ts") / bar) * bar).alias("ts")).agg(F.max_by("px", F.struct("ts", "seq")).alias("px")).withColumn("seq", F.lit(0).cast("long"))
    return last.withColumn("r", log_change("px", by))


def z_scan(filtered: DataFrame, by: list[str], marks: list[float]) -> DataFrame:
    """by, mark, events, prints: how many runs of |z| at each mark or over."""
    rows = filtered.withColumn("mark", F.explode(F.array(*map(F.lit, marks))))
    r = runs(rows, [*by, "mark"], F.abs("z") >= F.col("mark"))
    return r.groupBy(*by, "mark").agg(F.countDistinct("run").alias("events"), F.count("*").alias("prints"))


def tick_rule(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with rule: the sign of the last price move that is not zero, +1 before any."""
    move = F.signum(F.col("px") - before("px", by))
    w = Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_m", F.nullif(move, F.lit(0.0))).withColumn("rule", F.coalesce(F.last("_m", ignorenulls=True).over(w), F.lit(1.0))).drop("_m")


def interval_matches(a: DataFrame, b: DataFrame, by: list[str], slack: int) -> DataFrame:
    """by, n_a, n_b, n, jaccard, precision, recall of a greedy one-to-one match of closed intervals
    (start_ts, end_ts) in the order of a; each b is taken once, the earliest first."""
    rows = a.select(*by, F.lit(0).alias("kind"), "start_ts", "end_ts").unionByName(b.select(*by, F.lit(1).alias("kind"), "start_ts", "end_ts"))
    # an interval of a is matched when no later b can overlap it; open intervals are the state
    def settle(s, upto):
        while s["a"] and (upto is None or s["a"][0][1] + slack < upto):
            lo, hi = s["a"].pop(0)
            free = next((i for i, (x, y) in enumerate(s["b"]) if x <= hi + slack and y >= lo - slack), None)
            if free is not None:
                s["b"].pop(free)
                s["n"] += 1
        low = s["a"][0][0] if s["a"] else upto
        s["b"] = [x for x in s["b"] if low is not None and x[1] + slack >= low]

    def step(s, kind, start, end):
        settle(s, start)
        s["ab"[kind]].append((start, end))
        s[f"n_{'ab'[kind]}"] += 1
        return ()

    def finish(s):
        settle(s, None)
        union = s["n_a"] + s["n_b"] - s["n"]
        return [(s["n_a"], s["n_b"], s["n"], s["n"] / union if union else None, s["n"] / s["n_a"] if s["n_a"] else None, s["n"] / s["n_b"] if s["n_b"] else None)]

    return fold(rows, by, ["start_ts", "end_ts", "kind"], ["kind", "start_ts", "end_ts"], lambda: {"a": [], "b": [], "n": 0, "n_a": 0, "n_b": 0}, step, "n_a long, n_b long, n long, jaccard double, precision double, recall double", finish)


def grid_coverage(rows: DataFrame, by: list[str], step: int) -> DataFrame:
    """by, points, filled: edges of a grid from the first trade, and how many have a trade of their own."""
    t0 = F.min("ts").over(Window.partitionBy(*by))
    own = rows.withColumn("_k", F.floor((F.col("ts") - t0) / step))
    return own.groupBy(*by).agg((F.max("_k") + 1).alias("points"), F.countDistinct("_k").alias("filled"))


def scale_scan(points: DataFrame, by: list[str], steps: list[int]) -> DataFrame:
    """by, step, tsrv_adj, nearest: the adjusted two-scale estimate at each step, and which of them lies
    nearest to their median."""
    out = None
    for s in steps:
        one = two_scales(points, by, s).select(*by, F.lit(s).alias("step"), "tsrv_adj")
        out = one if out is None else out.unionByName(one)
    middle = out.groupBy(*by).agg(F.median("tsrv_adj").alias("_m"))
    w = Window.partitionBy(*by).orderBy(F.abs(F.col("tsrv_adj") - F.col("_m")), "step")
    return out.join(middle, by).withColumn("nearest", F.row_number().over(w) == 1).drop("_m")


class _Legs:
    """A key's rows from the start that is tried on, and the extremes of the window behind it: queues of
    places whose prices fall (rise), so that the first is the least (most) of the window."""

    def __init__(self):
        self.rows, self.base, self.at, self.seen = deque(), 0, 0, 0  # rows from place base; the start; the window's end
        self.least, self.most = deque(), deque()
        self.second = None  # of a second leg that waits for rows: its start, shape, next place, best price so far

    def px(self, i: int) -> float:
        return self.rows[i - self.base][2]

    def ts(self, i: int) -> int:
        return self.rows[i - self.base][0]

    def end(self) -> int:
        return self.base + len(self.rows)

    def widen(self, to: int) -> None:
        while self.seen < to:
            x = self.px(self.seen)
            for queue, sign in ((self.least, 1), (self.most, -1)):
                while queue and sign * self.px(queue[-1]) > sign * x:
                    queue.pop()
                queue.append(self.seen)
            self.seen += 1

    def move(self, to: int) -> None:
        """The start goes on to place `to`; rows before it are dropped."""
        self.at = to
        while self.rows and self.base < to:
            self.rows.popleft()
            self.base += 1
        for queue in (self.least, self.most):
            while queue and queue[0] < to:
                queue.popleft()
        self.seen = max(self.seen, to)


def vshape_events(rows: DataFrame, by: list[str], least_pct: float = 0.8, most_us: int = 1_500_000, recovered: float = 0.5) -> DataFrame:
    """by, start_ts, mid_ts, mid_seq, end_ts, shape, dp_pct, recovery of V shapes (-1) and inverted ones (+1).

    From a start, the first leg goes to the lowest or highest price within most_us, whichever move is larger and of
    least_pct or more; the second, within most_us of there, has to win back the share `recovered`. After an event the
    search goes on behind it, after a first leg alone behind its end, else at the next row. Prices that are null or
    NaN are skipped; the last two rows of a key start nothing. State is the rows of two legs."""
    share = least_pct / 100

    def emit(s: _Legs, over: bool) -> list[tuple]:
        out = []
        while s.at < s.end() - (2 if over else 0):
            i = s.at
            first = s.px(i)
            if s.second is None:
                j = max(s.seen, i + 1)
                s.widen(j)
                while j < s.end() and s.ts(j) <= s.ts(i) + most_us:
                    j += 1
                    s.widen(j)
                if j == s.end() and not over:
                    return out  # rows of the window may follow
                low, high = s.least[0], s.most[0]
                down, up = ((first - s.px(low)) / first, (s.px(high) - first) / first) if first > 0 else (0.0, 0.0)
                if j == i + 1 or max(down, up) < share:
                    s.move(i + 1)
                    continue
                mid, shape = (low, -1) if down >= share and down >= up else (high, 1)
                s.second = [mid, shape, mid + 1, s.px(mid)]
            mid, shape, k, best = s.second
            while k < s.end() and s.ts(k) <= s.ts(mid) + most_us:
                best = max(best, s.px(k)) if shape < 0 else min(best, s.px(k))
                k += 1
            if k == s.end() and not over:
                s.second[2:] = k, best
                return out
            s.second, way = None, s.px(mid)
            back = (best - way) / (first - way) if first != way else 0.0
            if k > mid + 1 and back >= recovered:
                out.append((s.ts(i), s.ts(mid), s.rows[mid - s.base][1], s.ts(k - 1), shape, 100 * abs(way - first) / first, back))
                s.move(k)
            else:
                s.move(mid + 1)
        return out

    def step(s, ts, seq, px):
        if px is None or math.isnan(px):
            return ()
        s.rows.append((ts, seq, px))
        return emit(s, False)

    return fold(rows, by, ["ts", "seq"], ["ts", "seq", "px"], _Legs, step, "start_ts long, mid_ts long, mid_seq long, end_ts long, shape int, dp_pct double, recovery double", lambda s: emit(s, True))


def near_events(rows: DataFrame, events: DataFrame, by: list[str], within: int) -> DataFrame:
    """rows with near: an event (ts) lies within `within` of ts on either side."""
    marks = events.select(*by, "ts").distinct().withColumns({"seq": F.lit(0).cast("long"), "_mark": F.lit(1)})
    found = nearest(rows, marks, by, ["_mark"])
    return found.withColumn("near", F.coalesce(F.abs(F.col("ref_ts") - F.col("ts")) <= within, F.lit(False))).drop("ref_ts", "_mark")
