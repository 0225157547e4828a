"""Spreads, ticks, depth and book events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import div
from tapeloom.operators.flow import quantiles
from tapeloom.operators.temporal import ahead, asof, before, range_join

BPS = 1e4


def mid_price(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def quoted_spread_bps(bid: Column, ask: Column) -> Column:
    return BPS * div(ask - bid, mid_price(bid, ask))


def effective_spread_bps(px: Column, mid: Column, side: Column) -> Column:
    return F.when(side != 0, 2 * BPS * side * div(px - mid, mid))


def realized_spread_bps(px: Column, later: Column, side: Column) -> Column:
    return effective_spread_bps(px, later, side)


def depth_imbalance(bid_sz: Column, ask_sz: Column) -> Column:
    return F.when(bid_sz + ask_sz > 0, (bid_sz - ask_sz) / F.nullif(bid_sz + ask_sz, F.lit(0.0)))


def relative_tick(tick: Column, mid: Column, bps: bool = False) -> Column:
    return div(tick, mid) * (BPS if bps else 1.0)


def spread_in_ticks(bid: Column, ask: Column, tick: Column) -> Column:
    return F.when(ask >= bid, div(ask - bid, tick))


def tick_constrained(ticks: Column, most: float = 2.0) -> Column:
    return (ticks > 0) & (ticks <= most)


def infer_tick(rows: DataFrame, by: list[str], price: str, least: float = 1e-12) -> DataFrame:
    """by, tick: the smallest gap of distinct prices (to 1e-10)."""
    own = rows.select(*by, F.round(price, 10).alias("p")).where("p IS NOT NULL").distinct()
    gap = F.col("p") - F.lag("p").over(Window.partitionBy(*by).orderBy("p"))
    return own.withColumn("gap", gap).groupBy(*by).agg(F.min(F.when(F.col("gap") > least, F.col("gap"))).alias("tick"))


def median_tick(rows: DataFrame, by: list[str], price: str, fallback: float = 1e-8) -> DataFrame:
    """by, tick: the median of the moves along the path that are not zero."""
    move = F.abs(F.col(price) - before(price, by))
    return rows.withColumn("move", move).groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("move") > 0, F.col("move"))), F.lit(fallback)).alias("tick"))


def venue_tick(known: Column, inferred: Column, catalog: Column) -> tuple[Column, Column]:
    """(tick, source) in the order known, inferred, catalog (from 1e-6 on), missing."""
    fine = F.when(catalog >= 1e-6, catalog)
    source = F.when(known.isNotNull(), "known").when(inferred.isNotNull(), "inferred").when(fine.isNotNull(), "catalog").otherwise("missing")
    return F.coalesce(known, inferred, fine), source


def roll(returns: Column, last: Column) -> dict[str, Column]:
    """Aggregates g0, g1 and Roll's implied spread; last is the return before."""
    g0, g1 = F.var_pop(returns), F.covar_samp(returns, last)
    return {"g0": g0, "g1": g1, "spread": F.when(g1 < 0, 2 * F.sqrt(F.greatest(-g1, F.lit(0.0))))}


def market_quality(tob: DataFrame, trades: DataFrame, by: list[str], tick: float) -> DataFrame:
    """Medians of spread, relative spread, mid, spread in ticks and depth; sums of volume, notional."""
    q = tob.groupBy(*by).agg(
        F.median(F.col("ask") - F.col("bid")).alias("spread"),
        F.median(quoted_spread_bps(F.col("bid"), F.col("ask"))).alias("spread_bps"),
        F.median("mid").alias("mid"),
        F.median((F.col("ask") - F.col("bid")) / tick).alias("spread_ticks"),
        F.median(F.col("bid_sz") + F.col("ask_sz")).alias("depth"),
    )
    t = trades.groupBy(*by).agg(F.sum("qty").alias("volume"), F.sum(F.col("qty") * F.col("px")).alias("notional"))
    return q.join(t, by, "left")


def terciles(rows: DataFrame, column: str, ties: str, by: list[str] = (), k: int = 3) -> Column:
    """floor(rank * k / n) of each row, 0 to k - 1; null values rank nowhere."""
    w = Window.partitionBy(*by, F.col(column).isNull())
    rank = F.row_number().over(w.orderBy(column, ties)) - 1
    return F.when(F.col(column).isNotNull(), F.floor(rank * k / F.count("*").over(w)).cast("int"))


def undercutting(tob: DataFrame, by: list[str], tick: float, most_ticks: float = 1.5) -> DataFrame:
    """Shares of updates that improve bid or ask, and that undercut by most_ticks at most; a bid's
    improvement comes first."""
    up = (F.col("bid") - before("bid", by)) / tick
    down = (before("ask", by) - F.col("ask")) / tick
    size = F.when(F.col("up") > 0.5, F.col("up")).when(F.col("down") > 0.5, F.col("down"))
    rows = tob.withColumns({"up": up, "down": down}).where("up IS NOT NULL").withColumn("size", size)
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("size").isNotNull()).alias("improve"), share(F.coalesce(F.col("size") <= most_ticks, F.lit(False))).alias("undercut"))


def fama_macbeth(rows: DataFrame, group: list[str], y: str, x: str, least: int = 3) -> DataFrame:
    """One row: groups, mean slope, its standard error and t; groups need `least` points and variance."""
    slopes = rows.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.count(F.when(F.col(y).isNotNull(), F.col(x))).alias("n"), F.var_pop(x).alias("v")).where((F.col("n") >= least) & (F.col("v") > 0))
    out = slopes.agg(F.count("*").alias("groups"), F.avg("slope").alias("mean"), (F.stddev_samp("slope") / F.sqrt(F.count("*"))).alias("se"))
    return out.withColumn("t", div(F.col("mean"), F.col("se")))


def constraint_flips(tob: DataFrame, by: list[str], constrained: Column, value: str, rows_each_side: int = 20) -> DataFrame:
    """by, kind (relax or tighten), n, and the mean of value over the rows before and after a flip."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    marked = tob.withColumn("c", constrained)
    marked = marked.withColumns({"was": F.lag("c").over(w), "pre": F.avg(value).over(w.rowsBetween(-rows_each_side, -1)), "post": F.avg(value).over(w.rowsBetween(0, rows_each_side - 1))})
    kind = F.when(F.col("was") & ~F.col("c"), "relax").when(~F.col("was") & F.col("c"), "tighten")
    return marked.withColumn("kind", kind).where("kind IS NOT NULL").groupBy(*by, "kind").agg(F.count("*").alias("n"), F.avg("pre").alias("pre"), F.avg("post").alias("post"))


def book_events(tob: DataFrame, by: list[str], size_step: float = 0.05) -> DataFrame:
    """The quotes that change the touch, with code: 1 the bid improves, -1 worsens; 3 its size grows, -3
    shrinks, by size_step or more of what it was; 2 the ask improves, -2 worsens; 4, -4 its size. The
    first of these that holds; prices within 1e-12 are equal."""
    b, a, bs, as_ = (before(c, by) for c in ("bid", "ask", "bid_sz", "ask_sz"))
    moved = lambda now, was: F.when(now > was + 1e-12, 1).when(now < was - 1e-12, -1)
    sized = lambda now, was: F.when(was > 0, F.when((now - was) / was >= size_step, 1).when((now - was) / was <= -size_step, -1))
    code = F.coalesce(moved(F.col("bid"), b), 3 * sized(F.col("bid_sz"), bs), -2 * moved(F.col("ask"), a), 4 * sized(F.col("ask_sz"), as_))
    return tob.withColumn("code", code.cast("int")).where("code IS NOT NULL")


def event_shares(events: DataFrame, by: list[str]) -> DataFrame:
    """by, n, improved, worsened, improve_share of book events."""
    count = lambda *codes: F.count(F.when(F.col("code").isin(*codes), 1))
    out = events.groupBy(*by).agg(F.count("*").alias("n"), count(1, 2).alias("improved"), count(-1, -2).alias("worsened"))
    return out.withColumn("improve_share", F.col("improved") / F.col("n"))


def resilience(tob: DataFrame, events: DataFrame, by: list[str], horizons: list[int]) -> DataFrame:
    """horizon, n, mean depth ratio and mean move (bps) after events; needs a newer quote by then."""
    quotes = tob.withColumn("depth", F.col("bid_sz") + F.col("ask_sz"))
    at0 = asof(events.select(*by, "ts", "seq"), quotes, by, ["mid", "depth"]).withColumnsRenamed({"ref_ts": "t0", "mid": "mid0", "depth": "depth0"})
    asked = at0.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("then", F.col("ts") + F.col("horizon"))
    later = asof(asked, quotes, by, ["mid", "depth"], at="then").where((F.col("ref_ts") > F.col("t0")) & (F.col("ref_ts") > F.col("ts")))
    return later.groupBy("horizon").agg(F.count("*").alias("n"), F.avg(div(F.col("depth"), F.col("depth0"))).alias("depth_ratio"), F.avg(BPS * F.abs(div(F.col("mid") - F.col("mid0"), F.col("mid0")))).alias("move_bps"))


def improve_markout(tob: DataFrame, by: list[str], horizon: int) -> DataFrame:
    """by, n, adverse_bps: the mid's move against those who improved bid or ask, after `horizon`."""
    up = F.col("bid") > before("bid", by)
    down = F.col("ask") < before("ask", by)
    moved = tob.withColumn("dir", F.when(up, 1.0).when(down, -1.0)).where("dir IS NOT NULL").select(*by, "ts", "seq", F.col("mid").alias("mid0"), "dir", (F.col("ts") + horizon).alias("then"))
    later = asof(moved, tob, by, ["mid"], at="then").where(F.col("ref_ts") > F.col("ts"))
    return later.groupBy(*by).agg(F.count("*").alias("n"), F.avg(-F.col("dir") * BPS * div(F.col("mid") - F.col("mid0"), F.col("mid0"))).alias("adverse_bps"))


def cancel_proxy(tob: DataFrame, trades: DataFrame, by: list[str], drop: float, window: int, same: float = 1e-9) -> DataFrame:
    """Size drops at an unchanged price (within `same`), by what opposite trades within the window explain of them: half
    or more is a fill, nothing a cancel, the rest mixed."""
    def side(price, size, name, against):
        was = before(size, by)
        fell = (F.abs(F.col(price) - before(price, by)) < same) & (was - F.col(size) >= drop * was) & (was > F.col(size))
        return tob.withColumns({"fell": fell, "lost": was - F.col(size)}).where("fell").select(*by, "ts", "seq", F.lit(name).alias("book_side"), F.lit(against).alias("against"), "lost")

    drops = side("bid", "bid_sz", "bid", -1.0).unionByName(side("ask", "ask_sz", "ask", 1.0))
    hit = range_join(drops, trades.select(*by, "ts", "qty", "side"), by, F.col("ts") - window, F.col("ts") + window, 2 * window)
    filled = hit.where(F.col("r_side") == F.col("against")).groupBy(*by, "seq", "book_side").agg(F.sum("r_qty").alias("filled"))
    rows = drops.join(filled, [*by, "seq", "book_side"], "left").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    kind = F.when(F.col("filled") == 0, "cancel").when(F.col("filled") >= 0.5 * F.col("lost"), "fill").otherwise("mixed")
    return rows.withColumn("kind", kind).rollup("book_side", "kind").agg(F.count("*").alias("n"), F.sum("lost").alias("lost")).where("kind IS NOT NULL OR book_side IS NULL")


def time_to_touch(tob: DataFrame, by: list[str], offsets: list[float], tick: float, horizon: int, stride: int, sells: bool = False) -> DataFrame:
    """offset, n, touched, median wait: an order to buy `offset` ticks under the bid of every stride-th
    quote (sells: to sell that far over its ask), and the first later quote within the horizon whose other
    side reaches it."""
    own, other, way = ("ask", "bid", 1) if sells else ("bid", "ask", -1)
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    starts = tob.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") % stride == 0)
    starts = starts.select(*by, "ts", "k", own, F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn("limit", F.col(own) + way * F.col("offset") * tick)
    met = range_join(starts, tob.select(*by, "ts", other), by, F.col("ts") + 1, F.col("ts") + horizon, horizon)
    reached = F.col(f"r_{other}") >= F.col("limit") if sells else F.col(f"r_{other}") <= F.col("limit")
    first = met.where(reached).groupBy(*by, "k", "offset").agg((F.min("r_ts") - F.first("ts")).alias("wait"))
    return starts.join(first, [*by, "k", "offset"], "left").groupBy("offset").agg(F.count("*").alias("n"), F.count("wait").alias("touched"), F.median("wait").alias("wait"))


def depth_moments(l2: DataFrame, most_level: int = 5) -> DataFrame:
    """side, level, n, mean: mean size at each level over snapshots, levels up to most_level."""
    return l2.where(F.col("level") < most_level).groupBy("side", "level").agg(F.count("*").alias("n"), F.avg("qty").alias("mean"))


def quantity_moments(rows: DataFrame, qty: str, powers: list[float], cuts: list[float]) -> DataFrame:
    """One row: power means, and the variance under each quantile over that under the 90 % one."""
    out = [F.pow(F.avg(F.pow(F.col(qty), p)), 1 / p).alias(f"m{str(p).replace('.', '_')}") for p in powers]
    e = quantiles(rows, qty, [0.9, *cuts])
    v = [F.var_pop(F.when(F.col(qty) <= F.lit(x).cast("double"), F.col(qty))) for x in e]
    return rows.agg(*out, *(div(x, v[0]).alias(f"v{k}") for k, x in enumerate(v[1:], 1)))


def crossed(tob: DataFrame, symbol: str, step: int) -> DataFrame:
    """bar, best bid, best ask, crossed: the venues' last quotes in each bar."""
    bar = (F.floor(F.col("ts") / step) * step).alias("bar")
    last = tob.groupBy(symbol, "venue", bar).agg(F.max_by(F.struct("bid", "ask"), F.struct("ts", "seq")).alias("q"))
    return last.groupBy(symbol, "bar").agg(F.max("q.bid").alias("bid"), F.min("q.ask").alias("ask"), F.count("*").alias("venues")).withColumn("crossed", F.col("bid") > F.col("ask"))


def refills(tob: DataFrame, by: list[str], drop: float, horizon: int, same: float = 1e-9) -> DataFrame:
    """book_side, n, refilled, worsened: size drops at an unchanged price, by what comes first (by seq) of the
    later quotes within the horizon: half of the loss back at that price, or a worse price. A better price
    ends the wait. A task holds the quotes of two horizons of a key, and looks on from each drop until one decides."""
    def lost(price, size):
        was = before(size, by)
        fell = (F.abs(F.col(price) - before(price, by)) < same) & (was > F.col(size)) & (was - F.col(size) >= drop * was)
        return F.when(fell, was - F.col(size))

    quotes = tob.select(*by, "ts", "seq", "bid", "ask", "bid_sz", "ask_sz").withColumns({"bid_lost": lost("bid", "bid_sz"), "ask_lost": lost("ask", "ask_sz")})

    def follow(g):
        g = g.sort_values("seq", kind="stable")
        ts, own, out = g["ts"].to_numpy(), ~g["_ahead"].to_numpy(bool), []
        # the first place with a later time, and the one behind the last within the horizon, even where seq is not in the order of time
        latest, earliest = np.maximum.accumulate(ts), np.minimum.accumulate(ts[::-1])[::-1]
        for name, worse in (("bid", -1), ("ask", 1)):
            price, size, gone = (g[c].to_numpy(float) for c in (name, f"{name}_sz", f"{name}_lost"))
            drops, refilled, worsened = np.flatnonzero(own & ~np.isnan(gone)), 0, 0
            for i, k, end in zip(drops, np.searchsorted(latest, ts[drops], "right"), np.searchsorted(earliest, ts[drops] + horizon, "right")):
                width = 32
                while k < end:
                    part = slice(k, min(k + width, end))
                    inside, move = (ts[part] > ts[i]) & (ts[part] <= ts[i] + horizon), (price[part] - price[i]) * worse
                    back, bad = inside & (np.abs(move) < same) & (size[part] - size[i] >= 0.5 * gone[i]), inside & (move >= same)
                    first = np.argmax(stop := back | bad | (inside & (move <= -same)))
                    if stop[first]:
                        refilled, worsened = refilled + back[first], worsened + bad[first]
                        break
                    k, width = k + width, 2 * width
            out.append((name, len(drops), int(refilled), int(worsened)))
        return pd.DataFrame(out, columns=["book_side", "n", "refilled", "worsened"])

    each = ahead(quotes, horizon).groupBy(*by, "_slice").applyInPandas(follow, "book_side string, n long, refilled long, worsened long")
    return each.where("n > 0").groupBy("book_side").agg(*(F.sum(c).alias(c) for c in ("n", "refilled", "worsened")))


def depth_before_trades(trades: DataFrame, tob: DataFrame, by: list[str]) -> DataFrame:
    """by, n, and the correlations of the sides' depth at a trade with its being a buy; mean depths."""
    q = asof(trades, tob, by, ["bid_sz", "ask_sz"]).where("ref_ts IS NOT NULL AND side <> 0").withColumn("buy", (F.col("side") > 0).cast("double"))
    mean = lambda c, k: F.avg(F.when(k, F.col(c)))
    return q.groupBy(*by).agg(F.count("*").alias("n"), F.corr("bid_sz", "buy").alias("bid_buy"), F.corr("ask_sz", "buy").alias("ask_buy"), mean("ask_sz", F.col("side") < 0).alias("ask_at_sell"), mean("bid_sz", F.col("side") > 0).alias("bid_at_buy"))
