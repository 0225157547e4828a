"""High-frequency patterns: quote storms, fades, clock clusters, cascades, ignition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.fold import fold
from tapeloom.functions.stats import div
from tapeloom.operators.flow import quantiles
from tapeloom.operators.temporal import asof, before, forward, nearest, range_join


def storm_bars(tob: DataFrame, by: list[str], bar: int) -> DataFrame:
    """by, bar, updates, adds, cancels, moves, cancel_frac, hz, size_hz, range_bps; bars without a quote
    count 0. A quote adds (cancels) if the size of either side grows (shrinks), at whatever price; it moves
    if a price changes. A key's first quote does none of these."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy("ts", "seq")) == 1
    changed = {c: (F.col(c), before(c, by)) for c in ("bid", "ask", "bid_sz", "ask_sz")}
    any_of = lambda test, *names: F.coalesce(test(*changed[names[0]]), F.lit(False)) | F.coalesce(test(*changed[names[1]]), F.lit(False))
    add = any_of(lambda now, was: now > was * 1.0000001, "bid_sz", "ask_sz")
    cancel = any_of(lambda now, was: now < was * 0.9999999, "bid_sz", "ask_sz")
    still = F.coalesce((F.abs(F.col("bid") - changed["bid"][1]) < 1e-12) & (F.abs(F.col("ask") - changed["ask"][1]) < 1e-12), F.lit(False))
    rows = tob.withColumns({"_add": add, "_cancel": cancel, "_move": ~still & ~first})
    count = lambda c: F.count(F.when(F.col(c), 1))
    mid = F.when(F.col("mid") > 0, F.col("mid"))
    got = rows.groupBy(*by, F.floor(F.col("ts") / bar).alias("bar")).agg(F.count("*").alias("updates"), count("_add").alias("adds"), count("_cancel").alias("cancels"), count("_move").alias("moves"), (1e4 * div(F.max(mid) - F.min(mid), (F.max(mid) + F.min(mid)) / 2)).alias("range_bps"))
    ends = got.groupBy(*by).agg(F.min("bar").alias("lo"), F.max("bar").alias("hi"))
    every = ends.select(*by, F.explode(F.sequence("lo", "hi")).alias("bar"))
    full = every.join(got, [*by, "bar"], "left").fillna(0, ["updates", "adds", "cancels", "moves"])
    sizes = F.col("adds") + F.col("cancels")
    return full.withColumns({"cancel_frac": div(F.col("cancels").cast("double"), sizes.cast("double")), "hz": F.col("updates") / (bar / 1e6), "size_hz": sizes / (bar / 1e6)})


def storms(bars: DataFrame, by: list[str], least_z: float = 4.0, least_cancel: float = 0.4, most_range: float = 10.0, least_hz: float = 10.0, sizes: bool = False) -> DataFrame:
    """The bars whose rate of quotes (sizes: of size changes) stands least_z deviations over the cell's
    mean and is least_hz at least, with enough cancels and a quiet mid; unknown shares and ranges pass.
    z is 0 where all rates are equal; cells of fewer than five bars have no storms."""
    w, rate = Window.partitionBy(*by), F.col("size_hz" if sizes else "hz")
    spread = F.stddev_pop(rate).over(w)
    z = F.when(spread < 1e-12, 0.0).otherwise((rate - F.avg(rate).over(w)) / spread)
    ok = (F.col("z") >= least_z) & (rate >= least_hz) & F.coalesce(F.col("cancel_frac") >= least_cancel, F.lit(True)) & F.coalesce(F.col("range_bps") <= most_range, F.lit(True))
    return bars.withColumn("z", z).withColumn("_n", F.count("*").over(w)).where(ok & (F.col("_n") >= 5)).drop("_n")


def fades(trades: DataFrame, tob: DataFrame, by: list[str], horizons: list[int], drop: float) -> DataFrame:
    """trades by horizon with fade: a later quote within it shows the touch the trade took from smaller
    by `drop` or more."""
    touch = lambda side, a, b: F.when(side > 0, b).otherwise(a)
    now = asof(trades, tob, by, ["bid_sz", "ask_sz"]).where("ref_ts IS NOT NULL")
    now = now.withColumn("size0", touch(F.col("side"), F.col("bid_sz"), F.col("ask_sz"))).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    met = range_join(now, tob.select(*by, "ts", "bid_sz", "ask_sz"), by, F.col("ref_ts") + 1, F.col("ts") + F.col("horizon"), max(horizons))
    least = met.groupBy(*by, "seq", "horizon").agg(F.min(touch(F.col("side"), F.col("r_bid_sz"), F.col("r_ask_sz"))).alias("least"))
    out = now.join(least, [*by, "seq", "horizon"], "left")
    return out.withColumn("fade", F.coalesce(F.col("least") <= (1 - drop) * F.col("size0"), F.lit(False)))


def venue_fades(trades: DataFrame, tob: DataFrame, by: list[str], home: int, far: int, latency: int, horizon: int, drop: float) -> DataFrame:
    """Trades on the home venue with fade: the far touch, as it stood strictly before latency had passed,
    drops or moves between then and the horizon."""
    own = trades.where(F.col("venue") == home).drop("venue").withColumn("then", F.col("ts") + latency)
    quotes = tob.where(F.col("venue") == far).drop("venue")
    now = asof(own, quotes, by, ["bid", "ask", "bid_sz", "ask_sz"], at="then", strict=True).where("ref_ts IS NOT NULL")
    met = range_join(now, quotes.select(*by, "ts", "bid", "ask", "bid_sz", "ask_sz"), by, F.col("then"), F.col("then") + horizon, horizon)
    gone = F.when(F.col("side") > 0, (F.abs(F.col("r_ask") - F.col("ask")) > 1e-12) | (F.col("r_ask_sz") <= (1 - drop) * F.col("ask_sz"))).otherwise((F.abs(F.col("r_bid") - F.col("bid")) > 1e-12) | (F.col("r_bid_sz") <= (1 - drop) * F.col("bid_sz")))
    hit = met.groupBy(*by, "seq").agg(F.max(gone).alias("hit"))
    return now.join(hit, [*by, "seq"], "left").withColumn("fade", F.coalesce("hit", F.lit(False)))


def clock_clusters(trades: DataFrame, cycle: int, bin_: int) -> DataFrame:
    """bin, n, z: trades by their place in a cycle of time, and the excess over a uniform clock in
    Poisson deviations. Every bin is a row."""
    bins = cycle // bin_
    got = trades.groupBy(F.floor(F.pmod(F.col("ts"), F.lit(cycle)) / bin_).alias("bin")).agg(F.count("*").alias("n"))
    every = trades.sparkSession.range(bins).withColumnRenamed("id", "bin")
    full = every.join(got, "bin", "left").fillna(0, ["n"])
    mean = F.sum("n").over(Window.partitionBy()) / bins
    return full.withColumn("z", div(F.col("n") - mean, F.sqrt(mean)))


def near_hours(ts: Column, hours: list[int], minutes: float) -> Column:
    """True within `minutes` of one of the hours (UTC), midnight included."""
    day = 86_400_000_000
    out = F.lit(False)
    for h in hours:
        d = F.abs(F.pmod(ts, F.lit(day)) - h * 3_600_000_000)
        out = out | (F.least(d, day - d) <= minutes * 60_000_000)
    return out


def heat_map(rows: DataFrame, minute_bins: int) -> DataFrame:
    """hour, bin, n for all 24 hours and bins of the hour."""
    hour, part = 3_600_000_000, 3_600_000_000 // minute_bins
    got = rows.groupBy((F.floor(F.col("ts") / hour) % 24).alias("hour"), F.floor(F.pmod(F.col("ts"), F.lit(hour)) / part).alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(24 * minute_bins).select(F.floor(F.col("id") / minute_bins).alias("hour"), (F.col("id") % minute_bins).alias("bin"))
    return every.join(got, ["hour", "bin"], "left").fillna(0, ["n"])


def cascade(a: DataFrame, b: DataFrame, by: list[str], windows: list[int]) -> DataFrame:
    """window, n, p: the share of events a that the next event b follows within each window."""
    nxt = forward(a.select(*by, "ts"), b.select(*by, "ts", F.col("ts").alias("seq")), by, [], strict=False)
    wait = F.col("next_ts") - F.col("ts")
    return nxt.select(wait.alias("wait"), F.explode(F.array(*map(F.lit, windows))).alias("window")).groupBy("window").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("wait") <= F.col("window"), F.lit(False)).cast("double")).alias("p"))


def near_share(a: DataFrame, b: DataFrame, by: list[str], slack: int) -> DataFrame:
    """by, n, near: how many rows of a have a row of b within slack on either side."""
    rows = nearest(a.select(*by, "ts"), b.select(*by, "ts", F.col("ts").alias("seq")), by, [])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.abs(F.col("ref_ts") - F.col("ts")) <= slack, 1)).alias("near"))


def order_to_trade(bars: DataFrame, trades: DataFrame, by: list[str]) -> DataFrame:
    """by, cancels, trades, otr; null without a trade."""
    c, t = bars.groupBy(*by).agg(F.sum("cancels").alias("cancels")), trades.groupBy(*by).agg(F.count("*").alias("trades"))
    return c.join(t, by, "left").withColumn("otr", div(F.col("cancels").cast("double"), F.coalesce("trades", F.lit(0)).cast("double")))


def spread_response(events: DataFrame, tob: DataFrame, by: list[str], lags: list[int], base: int) -> DataFrame:
    """lag, n, change: the spread at each lag after an event over its mean in the time before (two
    quotes at least)."""
    q = tob.withColumn("spread", F.col("ask") - F.col("bid"))
    # the mean of a window is the difference of two sums from the first quote on, kept as decimals (18 places), whose differences are exact
    so_far = Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = q.withColumns({"_sum": F.sum(F.col("spread").try_cast("decimal(28, 18)")).over(so_far), "_n": F.count("spread").over(so_far), "_m": F.count("*").over(so_far)})
    ev = events.select(*by, "ts", "seq")
    upto = lambda rows, at, k: asof(rows, sums, by, ["_sum", "_n", "_m"], at=at, strict=True).drop("ref_ts").withColumnsRenamed({c: f"{c}{k}" for c in ("_sum", "_n", "_m")})
    met = upto(upto(ev, "ts", 1).withColumn("_from", F.col("ts") - base), "_from", 0)
    since = lambda c: F.col(f"{c}1") - F.coalesce(F.col(f"{c}0"), F.lit(0))
    based = met.where(since("_m") >= 2).select(*by, "ts", "seq", div(since("_sum").cast("double"), since("_n").cast("double")).alias("base"))
    asked = based.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("then", F.col("ts") + F.col("lag"))
    at = asof(asked, q, by, ["spread"], at="then")
    return at.groupBy("lag").agg(F.count("spread").alias("n"), F.avg(F.col("spread") - F.col("base")).alias("change"))


def event_markouts(events: DataFrame, marked: DataFrame, by: list[str], pre: int, post: int, most: int) -> DataFrame:
    """One row: events, and the mean and median over events of the mean markout of the first `most`
    trades from pre before to post after."""
    nexts = F.collect_list(F.struct("ts", "markout")).over(Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(0, most - 1))
    asked = events.select(*by, F.col("ts").alias("at"), F.col("seq").alias("event"), (F.col("ts") - pre).alias("ts"))
    met = forward(asked, marked.select(*by, "ts", "seq", nexts.alias("_nexts")), by, ["_nexts"], strict=False)
    first = met.select(*by, "event", "at", F.explode("_nexts").alias("_x")).where(F.col("_x.ts") <= F.col("at") + post).withColumn("r_markout", F.col("_x.markout"))
    each = first.groupBy(*by, "event").agg(F.avg("r_markout").alias("m"))
    return each.agg(F.count("*").alias("events"), F.avg("m").alias("mean"), F.median("m").alias("median"))


def ignition(bars: DataFrame, by: list[str], quiet: float, move: float, least_back: float, legs: tuple[int, int, int]) -> DataFrame:
    """by, bar, move_bps, recovery: quiet bars, then a move, then its recovery; events do not overlap.
    bars: by, bar (consecutive), mid."""
    w = Window.partitionBy(*by).orderBy("bar")
    a, b, c = legs
    m0, m1, m2 = F.lag("mid", a).over(w), F.col("mid"), F.lead("mid", b).over(w)
    after = w.rowsBetween(b, b + c)
    up = m2 > m1
    back = F.when(up, m2 - F.min("mid").over(after)).otherwise(F.max("mid").over(after) - m2)
    bps = lambda x, y: 1e4 * div(y - x, x)
    rows = bars.withColumns({"still": F.abs(bps(m0, m1)), "move_bps": bps(m1, m2), "recovery": div(back, F.abs(m2 - m1))})
    rows = rows.where((F.col("still") <= quiet) & (F.abs("move_bps") >= move) & (F.col("recovery") >= least_back))

    def step(s, bar, moved, back):
        if bar < s[0]:
            return ()
        s[0] = bar + b + c
        return [(bar, moved, back)]

    return fold(rows, by, ["bar"], ["bar", "move_bps", "recovery"], lambda: [-(1 << 62)], step, "bar long, move_bps double, recovery double")


def size_and_latency(trades: DataFrame, tob: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """by, sizes (array of quantiles), trades, quotes, and the median waits between trades and quotes."""
    wait = lambda rows: rows.withColumn("w", F.col("ts") - before("ts", by))
    t = wait(trades).groupBy(*by).agg(F.percentile("qty", F.array(*map(F.lit, quantiles))).alias("sizes"), F.count("*").alias("trades"), F.median("w").alias("trade_wait"))
    q = wait(tob).groupBy(*by).agg(F.count("*").alias("quotes"), F.median("w").alias("quote_wait"))
    return t.join(q, by, "left")


def vanishing_improvements(trades: DataFrame, tob: DataFrame, by: list[str], cancel: int) -> DataFrame:
    """by, improved, vanished: bids raised or asks lowered that are gone within `cancel` with no trade
    against them in between."""
    up, down = F.col("bid") > before("bid", by), F.col("ask") < before("ask", by)
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    rows = tob.withColumns({"_dir": F.when(up, 1.0).when(down, -1.0), "_next": F.lead("ts").over(w), "_bid": F.lead("bid").over(w), "_ask": F.lead("ask").over(w)}).where("_dir IS NOT NULL")
    gone = (F.col("_next") - F.col("ts") <= cancel) & F.when(F.col("_dir") > 0, F.col("_bid") < F.col("bid")).otherwise(F.col("_ask") > F.col("ask"))
    rows = rows.withColumn("_gone", F.coalesce(gone, F.lit(False))).select(*by, "ts", "seq", "_dir", "_gone", "_next")
    met = range_join(rows.where("_gone"), trades.select(*by, "ts", "side"), by, F.col("ts"), F.col("_next"), cancel)
    hit = met.where(F.col("r_side") == -F.col("_dir")).select(*by, "seq").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, [*by, "seq"], "left").groupBy(*by).agg(F.count("*").alias("improved"), F.count(F.when(F.col("_gone") & F.col("_hit").isNull(), 1)).alias("vanished"))


def share_near(rows: DataFrame, events: DataFrame, by: list[str], size: str, slack: int, k: int) -> DataFrame:
    """bin, n, near: rows by quantile bin of size, and how many have an event within slack."""
    e = [x for x in quantiles(rows, size, [i / k for i in range(1, k)]) if x is not None]
    own = nearest(rows.select(*by, "ts", "seq", size), events.select(*by, "ts", F.col("ts").alias("seq")), by, [])
    bin_ = sum(((F.col(size) >= F.lit(x)).cast("int") for x in e), F.lit(0))
    return own.withColumn("bin", bin_).groupBy("bin").agg(F.count("*").alias("n"), F.count(F.when(F.abs(F.col("ref_ts") - F.col("ts")) <= slack, 1)).alias("near"))
