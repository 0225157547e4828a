"""Panels over venues, days and events: mark bars and their basis, aligned quotes, rows to model on, what
surrounds a moment, and information shares of event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.policy import without_overlap
from tapeloom.operators.temporal import DAY_US, asof, range_join
from tapeloom.operators.xvenue import information_share
from tapeloom.sources.shared import table


def mark_bars(tob: DataFrame, by: list[str], bar: int) -> DataFrame:
    """by, ts (the bar's start), open, high, low, mid (its last), n: bars of mids; bars without a quote are left out."""
    place = F.struct("ts", "seq")
    bars = tob.where("mid IS NOT NULL").groupBy(*by, (F.floor(F.col("ts") / bar) * bar).alias("_bar"))
    out = bars.agg(F.min_by("mid", place).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", place).alias("mid"), F.count("*").alias("n"))
    return out.withColumnRenamed("_bar", "ts")


def basis(marks: DataFrame, by: list[str], venue: str, home) -> DataFrame:
    """by, venue, ts, mid, home, basis: the log of each venue's mark over that of the venue `home` in the same bar."""
    base = marks.where(F.col(venue) == F.lit(home)).select(*by, "ts", F.col("mid").alias("home"))
    away = marks.where((F.col(venue) != F.lit(home)) & (F.col("mid") > 0))
    return away.join(base.where("home > 0"), [*by, "ts"]).select(*by, venue, "ts", "mid", "home", F.ln(F.col("mid") / F.col("home")).alias("basis"))


def aligned_buckets(tob: DataFrame, by: list[str], venue: str, venues: list, bucket: int) -> DataFrame:
    """by, bucket and, for each venue v, v_bid, v_ask, v_bid_sz, v_ask_sz, v_mid, v_spread_bps and v_size: the last quote of each
    venue in each bucket in which all the venues have one."""
    last = tob.where(F.col(venue).isin(venues)).groupBy(*by, (F.floor(F.col("ts") / bucket) * bucket).alias("bucket"), venue).agg(F.max_by(F.struct("bid", "ask", "bid_sz", "ask_sz"), F.struct("ts", "seq")).alias("_q"))
    wide = last.groupBy(*by, "bucket").agg(F.count("*").alias("_n"), *(F.max(F.when(F.col(venue) == F.lit(v), F.col("_q"))).alias(f"_{v}") for v in venues)).where(F.col("_n") == len(venues))
    columns = []
    for v in venues:
        q = F.col(f"_{v}")
        mid = (q["bid"] + q["ask"]) / 2
        own = {**{c: q[c] for c in ("bid", "ask", "bid_sz", "ask_sz")}, "mid": mid, "spread_bps": 1e4 * (q["ask"] - q["bid"]) / mid, "size": q["bid_sz"] + q["ask_sz"]}
        columns += [x.alias(f"{v}_{c}") for c, x in own.items()]
    return wide.select(*by, "bucket", *columns)


def occurrence_rows(events: DataFrame, cells: DataFrame, by: list[str], share: str = "share") -> DataFrame:
    """by, day, half (am, pm), y, hour, intensity, abs_z, nested_rate, share, log_events, trades: whether a half of a day has an
    event, with features of the whole day's cell.

    events: by, end_ts, intensity, z_peak, nested; cells: by, day, trades, complete and `share`. Cells with events have
    both halves, known to cells or not; complete cells without have two halves of no event. A missing intensity is 1, a
    missing share 0.5, and means are over the day's events."""
    own = events.withColumns({"day": F.floor(F.col("end_ts") / DAY_US), "_pm": F.floor((F.col("end_ts") % DAY_US) / (DAY_US // 2)) == 1})
    # an intensity of zero counts as missing, as the median of |z| is over all events
    intensity = F.when(F.coalesce(F.col("intensity"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("intensity"))
    daily = own.groupBy(*by, "day").agg(
        F.max(F.when(~F.col("_pm"), 1)).alias("_am"), F.max(F.when(F.col("_pm"), 1)).alias("_pm"), F.avg(intensity).alias("intensity"), F.median(F.abs(F.coalesce("z_peak", F.lit(0.0)))).alias("abs_z"),
        F.avg(F.coalesce("nested", F.lit(False)).cast("double")).alias("nested_rate"), F.count("*").alias("_n"),
    )
    all_ = daily.join(cells.select(*by, "day", "trades", "complete", F.col(share).cast("double").alias("share")), [*by, "day"], "full").where(F.col("_n").isNotNull() | F.col("complete"))
    half = F.explode(F.array(F.struct(F.lit("am").alias("half"), F.coalesce("_am", F.lit(0)).alias("y"), F.lit(6).alias("hour")), F.struct(F.lit("pm").alias("half"), F.coalesce("_pm", F.lit(0)).alias("y"), F.lit(18).alias("hour"))))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = all_.withColumn("_h", half)
    return out.select(*by, "day", "_h.half", "_h.y", "_h.hour", *map(zero, ("intensity", "abs_z", "nested_rate")), F.coalesce("share", F.lit(0.5)).alias("share"), F.ln(F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))).alias("log_events"), F.coalesce(F.col("trades").cast("double"), F.lit(0.0)).alias("trades"))


def design(rows: DataFrame, keep: list[str], numeric: list[str], levels: dict[str, list], target: str, forbidden: list[str] = []) -> DataFrame:
    """keep, the numeric features, a 0/1 column for each level (name_level), target and usable (the target is known and finite).
    A value outside the levels is 0 in all of them; gaps of numbers stay, to be filled from training rows. A forbidden
    column among the features is an error."""
    clash = set(numeric) & set(forbidden) | set(levels) & set(forbidden)
    if clash:
        raise ValueError(f"features that are known only afterwards: {sorted(clash)}")
    hot = [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for c, values in levels.items() for v in values]
    y = F.col(target).cast("double")
    return rows.select(*keep, *(F.col(c).cast("double").alias(c) for c in numeric), *hot, y.alias(target), F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)).alias("usable"))


def liquidity_around(points: DataFrame, tob: DataFrame, by: list[str], window: int) -> DataFrame:
    """points (ts) with quotes, spread_bps, spread_pre, spread_post (before and after ts) and depth: means of the quotes within
    `window` on either side; null where there are none."""
    own = points.withColumn("_id", F.monotonically_increasing_id())
    own = table(own)
    q = tob.select(*by, "ts", F.when(F.col("mid") > 0, 1e4 * (F.col("ask") - F.col("bid")) / F.col("mid")).alias("spread"), (F.col("bid_sz") + F.col("ask_sz")).alias("depth"))
    met = range_join(own.select(*by, "ts", "_id"), q, by, F.col("ts") - window, F.col("ts") + window, max(1, 2 * window))
    side = lambda c: F.avg(F.when(c, F.col("r_spread")))
    sums = met.groupBy("_id").agg(F.count("*").alias("quotes"), F.avg("r_spread").alias("spread_bps"), side(F.col("r_ts") < F.col("ts")).alias("spread_pre"), side(F.col("r_ts") > F.col("ts")).alias("spread_post"), F.avg("r_depth").alias("depth"))
    return own.join(sums, "_id", "left").drop("_id").withColumn("quotes", F.coalesce("quotes", F.lit(0)))


def moments_concord(points: DataFrame, by: list[str], leg: str, within: int) -> DataFrame:
    """by, a, b, apart, concord: pairs of legs (venues) with a moment (ts) each, how far they lie apart, and whether within
    `within`. One moment a leg."""
    a, b = (points.select(*by, F.col(leg).alias(x), F.col("ts").alias(f"_{x}")) for x in "ab")
    apart = F.abs(F.col("_a") - F.col("_b"))
    return a.join(b, by).where("a < b").select(*by, "a", "b", apart.alias("apart"), (apart <= within).alias("concord"))


def first_of_nest(events: DataFrame, by: list[str], fire, gap: int) -> DataFrame:
    """events without the fires that start within `gap` of one that stays; others stay all. events: ts, seq."""
    kept = without_overlap(events.where(fire), by, gap).select(*by, "ts", "seq")
    return events.where(fire).join(kept, [*by, "ts", "seq"], "left_semi").unionByName(events.where(~F.coalesce(fire, F.lit(False))))


def relax_bars(rows: DataFrame, by: list[str], constrained, bar: int, gap: int) -> DataFrame:
    """by, bar: bars in which a constraint has just ended, at least `gap` bars apart."""
    was = F.lag("_c").over(Window.partitionBy(*by).orderBy("ts", "seq"))
    ends = rows.withColumn("_c", F.coalesce(constrained, F.lit(False))).withColumn("_was", was).where("_was AND NOT _c")
    bars = ends.select(*by, F.floor(F.col("ts") / bar).alias("ts")).distinct().withColumn("seq", F.lit(0).cast("long"))
    return without_overlap(bars, by, gap).select(*by, F.col("ts").alias("bar"))


def event_information_share(events: DataFrame, tob: DataFrame, by: list[str], venue: str, home: int, far: int, before: int, after: int, step: int, lags: int = 5, least: int = 50) -> DataFrame:
    """by, event, n, share_a_low, share_a_high: bounds of the home venue's information share in the window round each event
    (event, ts), on a grid that starts `before` it. Events whose grid has under lags + least times with both mids are left out.

    All windows' grids are matched to quotes in one as-of join, and their autoregressions are sums, one small
    matrix an event."""
    times = F.explode(F.sequence(F.col("ts") - before, F.col("ts") + after, F.lit(step).cast("long")))
    grid = events.select(*by, "event", times.alias("_at")).withColumnRenamed("_at", "ts").withColumn(venue, F.explode(F.array(F.lit(home), F.lit(far)))).withColumn("seq", F.lit(0).cast("long"))
    panel = asof(grid, tob.where("mid > 0"), [*by, venue], ["mid"]).where("mid IS NOT NULL").select(*by, "event", venue, "ts", "mid")
    panel = table(panel)
    both = panel.groupBy(*by, "event", "ts").agg(F.count("*").alias("_v")).where("_v = 2").groupBy(*by, "event").agg(F.count("*").alias("_n")).where(F.col("_n") >= lags + least)
    return information_share(panel.join(both.select(*by, "event"), [*by, "event"], "left_semi"), [*by, "event"], home, far, lags)
