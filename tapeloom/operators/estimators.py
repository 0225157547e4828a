"""Further estimators on tapes and books: bucket sizes, sparse variances, touch survival, event paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tapeloom.functions.stats import corr_or_null, div, draw
from tapeloom.operators.flow import rolling_vpin, volume_buckets
from tapeloom.operators.temporal import ahead, asof, before, range_join, runs
from tapeloom.operators.vol import mc_garch_bars
from tapeloom.sources.shared import table

BPS = 1e4


def bucket_volume(trades: DataFrame, by: list[str], scale: float = 50.0, buckets: float | None = None, floor: float = 1e-8) -> DataFrame:
    """by, bucket_volume, method: the median size times `scale`, or (buckets given) the volume over their
    number; sizes of zero and under do not count."""
    q = F.when(F.col("qty") > 0, F.col("qty"))
    median = F.greatest(F.coalesce(F.median(q) * scale, F.lit(floor)), F.lit(floor))
    if not buckets or buckets <= 0:
        return trades.groupBy(*by).agg(median.alias("bucket_volume")).withColumn("method", F.lit("median_x_scale"))
    out = trades.groupBy(*by).agg(median.alias("_m"), F.sum(q).alias("_t"))
    sized = F.col("_t") > 0
    return out.select(*by, F.when(sized, F.greatest(F.col("_t") / buckets, F.lit(floor))).otherwise(F.col("_m")).alias("bucket_volume"), F.when(sized, "target_buckets").otherwise("median_x_scale").alias("method"))


def vpin_days(trades: DataFrame, by: list[str], day: int, scale: float = 50.0, window: int = 50, buckets: float | None = None) -> DataFrame:
    """by, day, bucket_volume, method, buckets, mean_imbalance, path, last_vpin: each key's volume-bucket
    toxicity by day, with buckets sized by the day. A task holds one day of one key."""
    keys = [*by, "day"]
    own = trades.withColumn("day", F.floor(F.col("ts") / day))
    size = bucket_volume(own, keys, scale, buckets)
    sized = own.join(size.select(*keys, "bucket_volume"), keys)
    path = rolling_vpin(volume_buckets(sized, keys, "bucket_volume"), keys, window)
    out = path.groupBy(*keys).agg(F.count("*").alias("buckets"), F.avg("imbalance").alias("mean_imbalance"), F.count("vpin").alias("path"), F.max_by("vpin", "bucket").alias("last_vpin"))
    return size.join(out, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("buckets", "path")})


def sparse_points(points: DataFrame, by: list[str], returns: Column | int) -> DataFrame:
    """by, step, n, rv: realised variance on about `returns` sparse returns: every step-th point, the step
    being the key's returns over their number, without its fraction."""
    n = F.count("*").over(Window.partitionBy(*by)) - 1
    want = returns if isinstance(returns, Column) else F.lit(returns)
    own = points.withColumn("step", F.greatest(F.lit(1), F.floor(n / F.greatest(F.floor(want), F.lit(1)))).cast("int")).where(F.col("k") % F.col("step") == 0)
    r = own.withColumn("r", F.col("x") - F.lag("x").over(Window.partitionBy(*by).orderBy("k")))
    return r.groupBy(*by, "step").agg(F.count("r").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rv"))


def optimal_returns(span: Column | float, noise: Column, quarticity: Column) -> Column:
    """How many sparse returns are best under noise of a variance: (T / (4 noise^2) IQ)^(1/3)."""
    return F.when((noise > 0) & (quarticity > 0), F.pow(span / (4 * noise * noise) * quarticity, F.lit(1 / 3)))


def two_scales_at(points: DataFrame, by: list[str], grids: int, step: int) -> DataFrame:
    """by, n, n_bar, average, tsrv, tsrv_adj from `grids` sparse grids of `step`, the k-th from the k-th
    point on (also of more grids than a step has points)."""
    first = F.col("k") % step
    # a point lies on the grids that start at k, k - step, ... of those there are
    last = F.least(F.col("k"), F.lit(grids - 1))
    starts = F.when(first <= last, F.sequence(first, last, F.lit(step)))
    each = points.withColumn("offset", F.explode(starts))
    r = each.withColumn("r", F.col("x") - F.lag("x").over(Window.partitionBy(*by, "offset").orderBy("k")))
    per = r.groupBy(*by, "offset").agg(F.count("r").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rv")).where("n > 0")
    mean = per.groupBy(*by).agg(F.avg("rv").alias("average"), F.avg("n").alias("n_bar"))
    whole = points.withColumn("r", F.col("x") - F.lag("x").over(Window.partitionBy(*by).orderBy("k"))).groupBy(*by).agg(F.count("r").alias("n"), F.sum(F.col("r") * F.col("r")).alias("all"))
    raw = F.col("average") - F.col("n_bar") / F.col("n") * F.col("all")
    return whole.join(mean, by).select(*by, "n", "n_bar", "average", raw.alias("tsrv"), (raw / F.nullif(1 - F.col("n_bar") / F.col("n"), F.lit(0.0))).alias("tsrv_adj"))


def fragility(rows: DataFrame, by: list[str], value: str, most: float = 0.5) -> DataFrame:
    """by, n, low, high, cv, fragile: how far an estimate spreads over its settings."""
    out = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), div(F.stddev_pop(value), F.abs(F.avg(value))).alias("cv"))
    return out.withColumn("fragile", F.coalesce(F.col("cv") > most, F.lit(False)))


def roll_mid(quotes: DataFrame, by: list[str], step: int = 1, least: int = 8) -> DataFrame:
    """by, n, g0, g1, c, spread_bps, sigma_u2: Roll's spread on changes of every step-th mid, in bps of the
    mean mid, and the variance of the efficient price; null with too few changes or a positive g1."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    own = quotes.where("mid > 0").withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") % step == 0)
    d = own.withColumn("d", F.col("mid") - F.lag("mid").over(w))
    d = d.withColumn("l", F.lag("d").over(w))
    out = d.groupBy(*by).agg(F.count("d").alias("n"), F.var_pop("d").alias("g0"), F.covar_samp("d", "l").alias("g1"), F.avg("mid").alias("_m"))
    ok = (F.col("n") >= least) & (F.col("g1") < 0)
    c = F.when(ok, F.sqrt(F.greatest(-F.col("g1"), F.lit(0.0))))
    return out.select(*by, "n", "g0", "g1", c.alias("c"), (2 * BPS * c / F.col("_m")).alias("spread_bps"), F.when(ok, F.col("g0") + 2 * F.col("g1")).alias("sigma_u2"))


def tick_profile(tob: DataFrame, by: list[str], tick: float, tol: float = 0.05) -> DataFrame:
    """by, n, mean_ticks, one_tick, leeway, leeway_p90, rel_tick_bps, excess_bps: how spreads sit on the tick."""
    own = tob.where("ask >= bid AND ask + bid > 0").withColumn("_t", (F.col("ask") - F.col("bid")) / tick)
    rel = BPS * tick / ((F.col("ask") + F.col("bid")) / 2)
    excess = F.when(F.col("_t") <= 1 + 1e-9, 0.0).otherwise((F.col("_t") - 1) * rel)
    return own.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_t").alias("mean_ticks"), F.avg((F.abs(F.col("_t") - 1) <= tol).cast("double")).alias("one_tick"), F.avg(F.col("_t") - 1).alias("leeway"), F.percentile(F.col("_t") - 1, F.lit(0.9)).alias("leeway_p90"), F.avg(rel).alias("rel_tick_bps"), F.avg(excess).alias("excess_bps"))


def _fill_waits(starts: DataFrame, hits: DataFrame, by: list[str], keep: list[str], horizon: int, sells: bool = False) -> DataFrame:
    """by, keep, wait of starts (ts, level, size): the time to the hit (ts, seq, qty, px) with which those at or through the level,
    later than the start and within the horizon, make up the size; null if none does, or the size is null. A task holds the
    hits of two horizons of a key, and looks on from each start until it is filled."""
    keys = [*by, "_slice"]
    own = starts.select(*by, *keep, "ts", "level", "size", F.floor(F.col("ts") / horizon).alias("_slice"))
    met = ahead(hits.select(*by, "ts", "seq", "qty", "px"), horizon)
    way = -1.0 if sells else 1.0

    def follow(s, h):
        h = h.sort_values(["ts", "seq"], kind="stable")
        ts, qty, px, waits = h["ts"].to_numpy(), h["qty"].to_numpy(float), way * h["px"].to_numpy(float), []
        at, level, size = s["ts"].to_numpy(), way * s["level"].to_numpy(float) + 1e-12, s["size"].to_numpy(float)
        for i, k, end in zip(range(len(s)), np.searchsorted(ts, at, "right"), np.searchsorted(ts, at + horizon, "right")):
            width, taken, wait = 64, 0.0, None
            while k < end and size[i] == size[i]:
                part = slice(k, min(k + width, end))
                through = px[part] <= level[i]
                each = np.where(through, qty[part], 0.0)
                each[0] += taken
                total = np.cumsum(each)
                first = np.argmax(filled := through & (total >= size[i]))
                if filled[first]:
                    wait = int(ts[k + first] - at[i])
                    break
                k, width, taken = k + width, 2 * width, total[-1]
            waits.append(wait)
        return s[[*by, *keep]].assign(wait=pd.array(waits, dtype="Int64"))

    schema = StructType([*(own.schema[c] for c in (*by, *keep)), StructField("wait", LongType())])
    return own.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(follow, schema)


def touch_survival(tob: DataFrame, trades: DataFrame, by: list[str], tick: float, offsets: list[int], stride: int, horizon: int) -> DataFrame:
    """by, offset, starts, filled, rate, mean_us, median_us: virtual bids of the touch's size, `offset` ticks
    under it, at every stride-th quote. Sell trades while the ask is at or through the bid take from its
    size; it is filled when nothing is left within the horizon."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    start = tob.withColumn("_k", F.row_number().over(w) - 1).where((F.col("_k") % stride == 0) & (F.col("bid_sz") > 0))
    start = start.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("level", F.col("bid") - F.col("offset") * tick)
    hits = asof(trades.where("side < 0 AND qty > 0"), tob, by, ["ask"]).where("ask IS NOT NULL")
    waits = _fill_waits(start.withColumn("size", F.col("bid_sz")), hits.withColumn("px", F.col("ask")), by, ["offset"], max(1, horizon))
    out = waits.groupBy(*by, "offset").agg(F.count("*").alias("starts"), F.count("wait").alias("filled"), F.avg("wait").alias("mean_us"), F.median("wait").alias("median_us"))
    return out.withColumn("rate", F.col("filled") / F.col("starts"))


def size_survival(tob: DataFrame, trades: DataFrame, by: list[str], stride: int, horizon: int, side: str = "buy", shares: list[float] = [0.25, 0.5, 0.75]) -> DataFrame:
    """by, share, size, starts, filled, rate, mean_us, median_us, monotone: virtual orders at the touch of each of the sizes that
    are quantiles of the key's own touch, at every stride-th quote but the last two.

    A buy rests at the bid, a sell at the ask. Trades against it, while the other side's quote is at or through its price,
    take from it; it is filled when nothing is left within the horizon, and not where no quote follows in that time. monotone:
    no larger size has a higher rate. Keys with under stride + 5 quotes, 20 sizes or 50 trades are left out."""
    own, other, near = ("bid", "ask", -1.0) if side == "buy" else ("ask", "bid", 1.0)
    w = Window.partitionBy(*by)
    busy = trades.groupBy(*by).agg(F.count("*").alias("_t")).where("_t >= 50").select(*by)
    q = tob.withColumns({"_k": F.row_number().over(w.orderBy("ts", "seq")) - 1, "_n": F.count("*").over(w), "_next": F.lead("ts").over(w.orderBy("ts", "seq"))}).where(F.col("_n") >= stride + 5).join(busy, by, "left_semi")
    sized = F.when(F.col(f"{own}_sz") > 0, F.col(f"{own}_sz"))
    cuts = q.groupBy(*by).agg(F.percentile(sized, F.array(*map(F.lit, shares))).alias("_cuts"), F.count(sized).alias("_c")).where("_c >= 20")
    cuts = cuts.select(*by, F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("_cuts").alias("size"))).alias("_z")).select(*by, "_z.share", "_z.size")
    start = q.where((F.col("_k") % stride == 0) & (F.col("_k") < F.col("_n") - 2) & F.col(own).isNotNull()).join(cuts.withColumnRenamed("size", "_size"), by)
    start = start.withColumns({"level": F.col(own), "size": F.when(F.col("_next") <= F.col("ts") + horizon, F.col("_size"))})
    hits = asof(trades.where((F.col("side") * near > 0) & (F.col("qty") > 0)).select(*by, "ts", "seq", "qty"), tob, by, [other])
    waits = _fill_waits(start, hits.withColumn("px", F.col(other)), by, ["share", "_size"], max(1, horizon), side != "buy").withColumnRenamed("_size", "size")
    out = waits.groupBy(*by, "share", "size").agg(F.count("*").alias("starts"), F.count("wait").alias("filled"), F.avg("wait").alias("mean_us"), F.median("wait").alias("median_us"))
    out = out.withColumn("rate", F.col("filled") / F.col("starts"))
    falls = F.coalesce(F.col("rate") <= F.lag("rate").over(w.orderBy("share")) + 1e-9, F.lit(True))
    return out.withColumn("_falls", falls).withColumn("monotone", F.min("_falls").over(w) & (F.count("*").over(w) > 1)).drop("_falls")


def unmet(events: DataFrame, others: DataFrame, by: list[str], slack: int, width: int = 600_000_000) -> DataFrame:
    """by, n, unique, unique_share: how many events (start_ts, end_ts) lie outside all the others, widened
    by slack. An event is met by one that starts within it, or by one that it starts within; intervals are cut at
    multiples of `width`, so the longest does not make the join coarse."""
    own = events.withColumn("_id", F.monotonically_increasing_id()) if "run" not in events.columns else events.withColumn("_id", F.col("run"))
    inside = range_join(own.select(*by, "_id", "start_ts", "end_ts"), others.select(*by, F.col("start_ts").alias("ts")), by, F.col("start_ts") - slack, F.col("end_ts") + slack, width).select(*by, "_id")
    around = range_join(others.select(*by, "start_ts", "end_ts"), own.select(*by, "_id", (F.col("start_ts") - slack).alias("ts")), by, F.col("start_ts"), F.col("end_ts"), width).select(*by, F.col("r__id").alias("_id"))
    hit = inside.unionByName(around).distinct().withColumn("_hit", F.lit(1))
    out = own.join(hit, [*by, "_id"], "left").groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("unique"))
    return out.withColumn("unique_share", F.col("unique") / F.col("n"))


def filter_noise(trades: DataFrame, bars: DataFrame, by: list[str], bar_s: float, share: float = 1.0, least: float = 1e-12, floor_log: float = 1e-4) -> DataFrame:
    """trades with process (variance over the time since the last print, from the bar in force) and measure
    (the squared scaled median deviation of log returns, not under the floor). bars: ts, seq, h."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    own = asof(trades, bars, by, ["h"]).withColumn("_r", F.ln("px") - F.ln(F.lag("px").over(w)))
    gap = F.greatest((F.col("ts") - F.lag("ts").over(w)) / 1e6, F.lit(1e-9))
    own = own.withColumn("_dt", F.coalesce(gap, F.greatest((F.lead("ts").over(w) - F.col("ts")) / 1e6, F.lit(1e-9)), F.lit(1.0)))
    middle = own.groupBy(*by).agg(F.median("_r").alias("_m"))
    spread = own.join(middle, by).groupBy(*by).agg((F.median(F.abs(F.col("_r") - F.col("_m"))) / 0.6745).alias("_mad"), F.count("_r").alias("_n"))
    noise = F.when(F.col("_n") > 10, F.greatest(F.col("_mad"), F.lit(floor_log))).otherwise(floor_log)
    rate = F.greatest(F.coalesce(F.col("h") / bar_s, F.lit(least)), F.lit(least))
    out = own.join(spread.select(*by, noise.alias("_noise")), by)
    return out.withColumns({"process": rate * F.col("_dt"), "measure": F.greatest(share * share * F.col("_noise") * F.col("_noise"), F.lit(least))}).drop("_r", "_dt", "_noise", "h", "ref_ts")


def detector_noise(trades: DataFrame, by: list[str], bar: int, slots: int, share: float = 1.0) -> DataFrame:
    """trades with process and measure, as of filter_noise, from the composite variance of bars; trades before the first
    bar take the first's."""
    bars = table(mc_garch_bars(trades, by, bar, slots).select(*by, "ts", "seq", F.col("composite").alias("h")))
    first = bars.groupBy(*by).agg(F.min_by("h", "ts").alias("h")).withColumns({"ts": F.lit(0).cast("long"), "seq": F.lit(0).cast("long")})
    return filter_noise(trades.where("px > 0"), bars.unionByName(first), by, bar / 1e6, share)


def forward_returns(decisions: DataFrame, trades: DataFrame, by: list[str], prints: int, horizon: int, volume: float) -> DataFrame:
    """decisions with r_prints, r_time and r_volume: log returns from the price in force over the next
    `prints` trades, over `horizon`, and up to the next close of a volume bar."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    total = F.sum("qty").over(w.rowsBetween(Window.unboundedPreceding, 0))
    tape = trades.withColumns({"later": F.lead("px", prints).over(w), "_bar": F.floor(total / volume), "_was": F.floor((total - F.col("qty")) / volume)})
    closes = tape.where("_bar > _was").select(*by, "ts", "seq", F.col("px").alias("close"))
    now = asof(decisions, tape, by, ["px", "later"]).withColumnsRenamed({"px": "p0", "ref_ts": "_t0"}).withColumn("_then", F.col("ts") + horizon)
    end = trades.groupBy(*by).agg(F.max("ts").alias("_end"))
    then = asof(now, trades, by, ["px"], at="_then").withColumnRenamed("px", "p1").drop("ref_ts").join(end, by, "left")
    from tapeloom.operators.temporal import forward

    out = forward(then, closes, by, ["close"])
    log = lambda a: F.when((F.col("p0") > 0) & (F.col(a) > 0), F.ln(F.col(a) / F.col("p0")))
    made = {"r_prints": log("later"), "r_time": F.when(F.col("_then") <= F.col("_end"), log("p1")), "r_volume": log("close")}
    return out.withColumns(made).drop("p0", "p1", "later", "close", "_t0", "_then", "_end", "next_ts")


def paths_after(events: DataFrame, trades: DataFrame, by: list[str], horizons: list[int], reach: int) -> DataFrame:
    """events (end_ts, end_seq, last) by horizon with path_bps, from the last price to the last print within
    it (null with none), and most_pct, the largest move from it within `reach` (0 with no print)."""
    last_of = trades.select(*by, "ts", "seq", "px")
    asked = events.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumns({"ts": F.col("end_ts"), "seq": F.col("end_seq"), "_then": F.col("end_ts") + F.col("horizon")})
    at = asof(asked, last_of.withColumn("_s", F.col("seq")), by, ["px", "_s"], at="_then")
    moved = (F.col("ref_ts") > F.col("end_ts")) | (F.col("_s") > F.col("end_seq"))
    at = at.withColumn("path_bps", F.when(moved, BPS * div(F.col("px") - F.col("last"), F.col("last")))).drop("px", "_s", "ref_ts", "_then")
    met = range_join(events, last_of, by, F.col("end_ts"), F.col("end_ts") + reach, max(1, reach))
    met = met.where((F.col("r_ts") > F.col("end_ts")) | (F.col("r_seq") > F.col("end_seq")))
    most = met.groupBy(*by, "run").agg(F.max(100 * F.abs(F.col("r_px") - F.col("last")) / F.col("last")).alias("most_pct"))
    return at.join(most, [*by, "run"], "left").withColumn("most_pct", F.coalesce("most_pct", F.lit(0.0))).drop("ts", "seq")


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, median, sd, p25, p75."""
    own = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = own.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), q.alias("_q"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    return out.select(*by, "n", "mean", F.element_at("_q", 2).alias("median"), "sd", F.element_at("_q", 1).alias("p25"), F.element_at("_q", 3).alias("p75"))


def innovation_lead(filtered: DataFrame, by: list[str], lags: list[int], least: int = 50) -> DataFrame:
    """by, lag, n, corr of z with the log return to the first print at or after ts + lag; a lag of 0 is the
    next print. Prints that meet themselves are left out."""
    from tapeloom.operators.temporal import forward

    w = Window.partitionBy(*by).orderBy("ts", "seq")
    own = filtered.where("px > 0 AND z IS NOT NULL")
    out = None
    for lag in lags:
        if lag == 0:
            met = own.withColumn("_p", F.lead("px").over(w)).withColumn("_own", F.lit(False))
        else:
            refs = own.select(*by, "ts", "seq", F.col("px").alias("_p"), F.col("seq").alias("_s"))
            met = forward(own.withColumn("_at", F.col("ts") + lag), refs, by, ["_p", "_s"], at="_at", strict=False).withColumn("_own", F.col("_s") == F.col("seq"))
        r = met.where(F.col("_p").isNotNull() & ~F.col("_own")).withColumn("_r", F.ln(F.col("_p") / F.col("px")))
        one = r.groupBy(*by).agg(F.count("*").alias("n"), corr_or_null(F.col("z"), F.col("_r"), least).alias("corr")).withColumn("lag", F.lit(lag))
        out = one if out is None else out.unionByName(one)
    return out


def shifted_runs(filtered: DataFrame, by: list[str], least_z: float, draws: int, seed: int) -> DataFrame:
    """by, observed, placebo_mean, p: how many runs of |z| at the mark or over there are, against series that
    start elsewhere and wrap round. A shift adds a run where it cuts one and joins the ends' runs."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    flag = F.coalesce(F.abs("z") >= least_z, F.lit(False))
    own = filtered.withColumns({"_f": flag, "_k": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    own = own.withColumn("_cut", F.col("_f") & F.coalesce(F.lag("_f").over(w), F.lit(False)))
    n_runs = runs(filtered, by, flag).groupBy(*by).agg(F.countDistinct("run").alias("_r"))
    ends = own.groupBy(*by).agg(F.first("_n").alias("_n"), (F.min_by("_f", "_k") & F.max_by("_f", "_k")).alias("_wraps")).join(n_runs, by, "left").withColumn("observed", F.coalesce("_r", F.lit(0)))
    shift = F.col("_n") - 1 - F.floor(draw(F.lit(seed), F.col("draw")) * F.greatest(F.col("_n") - 2, F.lit(1)))
    asked = ends.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_k", shift.cast("long"))
    met = asked.join(own.select(*by, F.col("_k").cast("long").alias("_k"), "_cut"), [*by, "_k"])
    placebo = F.col("observed") + F.col("_cut").cast("int") - F.col("_wraps").cast("int")
    return met.withColumn("_p", placebo).groupBy(*by).agg(F.max("observed").alias("observed"), F.avg("_p").alias("placebo_mean"), F.avg((F.col("_p") >= F.col("observed")).cast("double")).alias("p"))


def window_imbalance(events: DataFrame, trades: DataFrame, by: list[str], span: int, over: int) -> DataFrame:
    """events with before, during and after: the mean size of the running imbalance of `over` trades in the
    span before an event, in it, and in the span after. Null where there are no trades."""
    w = Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(-(over - 1), 0)
    tape = trades.withColumn("imb", F.abs(div(F.sum(F.col("side") * F.col("qty")).over(w), F.sum("qty").over(w)))).select(*by, "ts", "imb")
    met = range_join(events.select(*by, "run", "start_ts", "end_ts"), tape, by, F.col("start_ts") - span, F.col("end_ts") + span, max(1, 2 * span))
    mean = lambda c: F.avg(F.when(c, F.col("r_imb")))
    sums = met.groupBy(*by, "run").agg(mean(F.col("r_ts") < F.col("start_ts")).alias("before"), mean((F.col("r_ts") >= F.col("start_ts")) & (F.col("r_ts") <= F.col("end_ts"))).alias("during"), mean(F.col("r_ts") > F.col("end_ts")).alias("after"))
    return events.join(sums, [*by, "run"], "left")


def concordance(rows: DataFrame, by: list[str], leg: str, value: str, near: float = 0.35) -> DataFrame:
    """by, legs, rel_range, close: how near the legs' values are, over their median."""
    out = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.countDistinct(leg).alias("legs"), ((F.max(value) - F.min(value)) / F.greatest(F.median(value), F.lit(1e-12))).alias("rel_range")).where("legs >= 2")
    return out.withColumn("close", F.col("rel_range") < near)


def spread_on_volatility(tob: DataFrame, trades: DataFrame, by: list[str], bar: int, most_bps: float = 500.0) -> DataFrame:
    """by, bars, slope, r2, corr: mean quoted spread of a bar on its absolute mid return."""
    spread = BPS * (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2)
    q = tob.where((F.col("ask") >= F.col("bid")) & (spread < most_bps)).groupBy(*by, F.floor(F.col("ts") / bar).alias("bar")).agg(F.avg(spread).alias("spread"), F.max_by("mid", F.struct("ts", "seq")).alias("mid"))
    t = trades.groupBy(*by, F.floor(F.col("ts") / bar).alias("bar")).agg(F.sum(F.col("px") * F.col("qty")).alias("notional"))
    both = q.join(t, [*by, "bar"], "left").withColumn("vol", F.abs(F.ln("mid") - F.ln(F.lag("mid").over(Window.partitionBy(*by).orderBy("bar")))))
    return both.where("vol IS NOT NULL").groupBy(*by).agg(F.count("*").alias("bars"), F.regr_slope("spread", "vol").alias("slope"), F.regr_r2("spread", "vol").alias("r2"), F.corr("spread", "notional").alias("corr"))


def role_blur(tob: DataFrame, by: list[str], leg: str) -> DataFrame:
    """by, leg, update_share, size_share, blur: quotes and mean touch sizes of each leg as shares of all."""
    w = Window.partitionBy(*by)
    out = tob.groupBy(*by, leg).agg(F.count("*").alias("_u"), F.avg(F.col("bid_sz") + F.col("ask_sz")).alias("_s"))
    out = out.select(*by, leg, (F.col("_u") / F.sum("_u").over(w)).alias("update_share"), (F.col("_s") / F.sum("_s").over(w)).alias("size_share"))
    return out.withColumn("blur", F.abs(F.col("update_share") - F.col("size_share")))


def curve_days(trades: DataFrame, by: list[str], day: int, slots: int) -> DataFrame:
    """by, slot, days, mean, sd: each slot's share of a day's notional, over the days."""
    own = trades.withColumns({"_d": F.floor(F.col("ts") / day), "slot": F.floor(F.col("ts") % day * slots / day)})
    s = own.groupBy(*by, "_d", "slot").agg(F.sum(F.col("px") * F.col("qty")).alias("v"))
    days = s.groupBy(*by, "_d").agg(F.sum("v").alias("t"))
    every = days.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    share = every.join(s, [*by, "_d", "slot"], "left").withColumn("p", F.coalesce("v", F.lit(0.0)) / F.col("t"))
    return share.groupBy(*by, "slot").agg(F.count("*").alias("days"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("sd"))


def count_lead_lag(a: DataFrame, b: DataFrame, by: list[str], bar: int, lags: list[int]) -> DataFrame:
    """by, lag, bars, corr of the counts of two streams by bar, b shifted by lag; bars without events are 0."""
    both = a.select(*by, "ts", F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).unionByName(b.select(*by, "ts", F.lit(0.0).alias("a"), F.lit(1.0).alias("b")))
    each = both.groupBy(*by, F.floor(F.col("ts") / bar).alias("bar")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ends = each.groupBy(*by).agg(F.min("bar").alias("_lo"), F.max("bar").alias("_hi"))
    full = ends.select(*by, F.explode(F.sequence("_lo", "_hi")).alias("bar")).join(each, [*by, "bar"], "left").fillna(0.0, ["a", "b"])
    wide = Window.partitionBy(*by)
    full = full.withColumns({"_a": F.col("a") - F.avg("a").over(wide), "_b": F.col("b") - F.avg("b").over(wide)})
    w = wide.orderBy("bar")
    moved = full.withColumns({f"l{i}": F.col("_a") * (F.lead("_b", k).over(w) if k >= 0 else F.lag("_b", -k).over(w)) for i, k in enumerate(lags)})
    out = moved.groupBy(*by).agg(F.count("*").alias("bars"), F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b"))).alias("_d"), *(F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"l{i}") for i in range(len(lags))))
    return out.select(*by, "bars", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), div(F.col(f"l{i}"), F.col("_d")).alias("corr")) for i, k in enumerate(lags)))).alias("x")).select(*by, "bars", "x.*")


def quoted_trades(trades: DataFrame, tob: DataFrame, by: list[str], least: int = 200) -> DataFrame:
    """trades inside the quotes' span, with notional and the mid in force; all of them where fewer than
    `least` lie inside."""
    ends = tob.groupBy(*by).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    own = trades.join(ends, by, "left").withColumn("_in", F.coalesce(F.col("ts").between(F.col("_lo"), F.col("_hi")), F.lit(False)))
    own = own.withColumn("_n", F.count(F.when(F.col("_in"), 1)).over(Window.partitionBy(*by))).where(F.col("_in") | (F.col("_n") < least))
    return asof(own.drop("_lo", "_hi", "_in", "_n"), tob, by, ["mid"]).withColumn("notional", F.col("px") * F.col("qty"))


def expected_schedule(slices: DataFrame, by: list[str], volume: str, sigma: str, total: float, gamma: float = 1.0) -> DataFrame:
    """slices with child: `total` spread over a key's slices by volume over sigma ** (1 / gamma). Of like
    slices, that is an even schedule."""
    weight = F.col(volume) / F.pow(F.greatest(F.col(sigma), F.lit(1e-12)), F.lit(1 / gamma))
    return slices.withColumn("child", total * weight / F.sum(weight).over(Window.partitionBy(*by)))


def unwind_path(positions: DataFrame, total: str, n: int, urgency: float) -> DataFrame:
    """positions once for each k of 0 to n, with left: what is left of `total` after k of n slices under linear impact, the
    solution of x(k+1) = (2 + urgency) x(k) - x(k-1) from the total to nothing."""
    import math

    steps = positions.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))))
    if urgency <= 0:
        return steps.withColumn("left", F.col(total) * (1 - F.col("k") / n))
    a = math.acosh(1 + urgency / 2)
    return steps.withColumn("left", F.col(total) * F.sinh(a * (n - F.col("k"))) / math.sinh(a * n))


def synthetic_quotes(trades: DataFrame, by: list[str], bar: int) -> DataFrame:
    """by, ts, seq, bid, ask, mid at the end of each bar with a trade: the last seller's and the last
    buyer's price, in order; null until there are both. Not exchange quotes."""
    w = Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    own = trades.where("px > 0").withColumns({"_b": F.last(F.when(F.col("side") < 0, F.col("px")), ignorenulls=True).over(w), "_a": F.last(F.when(F.col("side") > 0, F.col("px")), ignorenulls=True).over(w)})
    last = own.groupBy(*by, F.floor(F.col("ts") / bar).alias("_k")).agg(F.max_by(F.struct("seq", "_b", "_a"), F.struct("ts", "seq")).alias("x"))
    out = last.select(*by, ((F.col("_k") + 1) * bar).alias("ts"), "x.seq", F.least("x._b", "x._a").alias("bid"), F.greatest("x._b", "x._a").alias("ask"), F.col("x._b").isNotNull().alias("_ok"), F.col("x._a").isNotNull().alias("_ok2"))
    return out.where("_ok AND _ok2").drop("_ok", "_ok2").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def spread_proxy(trades: DataFrame, marks: DataFrame, by: list[str], most_bps: float = 500.0) -> DataFrame:
    """by, effective_bps, roll_bps, spread_bps, kind: the mean effective spread against marks, where it is
    over 0 and under `most_bps`, else Roll's on log prices."""
    from tapeloom.operators.book import effective_spread_bps, roll

    w = Window.partitionBy(*by).orderBy("ts", "seq")
    own = asof(trades, marks, by, ["mid"]).withColumn("_es", effective_spread_bps(F.col("px"), F.col("mid"), F.col("side")))
    own = own.withColumn("_r", F.when(F.col("px") > 0, F.ln("px")) - F.when(F.lag("px").over(w) > 0, F.ln(F.lag("px").over(w))))
    own = own.withColumn("_l", F.lag("_r").over(w))
    out = own.groupBy(*by).agg(F.avg("_es").alias("effective_bps"), (BPS * roll(F.col("_r"), F.col("_l"))["spread"]).alias("roll_bps"))
    good = F.coalesce((F.col("effective_bps") > 0) & (F.col("effective_bps") < most_bps), F.lit(False))
    return out.withColumns({"spread_bps": F.when(good, F.col("effective_bps")).otherwise(F.col("roll_bps")), "kind": F.when(good, "effective_vs_mark").when(F.col("roll_bps").isNotNull(), "roll").otherwise("none")})


def option_name(name: Column) -> dict[str, Column]:
    """underlying, expiry, strike and flag (c or p) of names such as ETH-27SEP26-3000-C; null for others."""
    shape = r"^([A-Z_]+)-(\d{1,2}[A-Z]{3}\d{2})-(\d+)-([CP])$"
    part = lambda k: F.nullif(F.regexp_extract(F.upper(F.trim(name)), shape, k), F.lit(""))
    return {"underlying": part(1), "expiry": part(2), "strike": part(3).cast("double"), "flag": F.lower(part(4))}
