"""Panel and study operators: clocks and bars, curves, lookbacks, event studies, regressions, models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.fold import fold
from tapeloom.functions.stats import corr_or_null, div
from tapeloom.operators.temporal import asof, range_join

HOUR = 3_600_000_000


def completeness(trades: DataFrame, by: list[str], day: int, least_n: int, least_span: int, least_cover: float) -> DataFrame:
    """by, day, n, span, cover (hours with a trade over 24), reasons (array), complete."""
    out = trades.groupBy(*by, F.floor(F.col("ts") / day).alias("day")).agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("span"), (F.countDistinct(F.floor(F.col("ts") / HOUR)) / 24).alias("cover"))
    why = F.array_compact(F.array(F.when(F.col("n") < least_n, "few"), F.when(F.col("span") < least_span, "short"), F.when(F.col("cover") < least_cover, "sparse")))
    return out.withColumn("reasons", why).withColumn("complete", F.size("reasons") == 0)


def hour_curve(trades: DataFrame, by: list[str]) -> DataFrame:
    """by, hour, n, value, share of the notional for all 24 hours."""
    got = trades.groupBy(*by, (F.floor(F.col("ts") / HOUR) % 24).alias("hour")).agg(F.count("*").alias("n"), F.sum(F.col("px") * F.col("qty")).alias("value"))
    every = trades.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    full = every.join(got, [*by, "hour"], "left").fillna(0, ["n"]).fillna(0.0, ["value"])
    return full.withColumn("share", div(F.col("value"), F.sum("value").over(Window.partitionBy(*by))))


def slices(trades: DataFrame, by: list[str], length: int) -> DataFrame:
    """by, slice (from each key's first trade), n, volume, net, vwap, first, last."""
    t0 = F.min("ts").over(Window.partitionBy(*by))
    rows = trades.withColumn("_t0", t0).withColumn("slice", F.floor((F.col("ts") - F.col("_t0")) / length))
    order = F.struct("ts", "seq")
    return rows.groupBy(*by, "slice").agg(F.count("*").alias("n"), F.sum("qty").alias("volume"), F.sum(F.col("side") * F.col("qty")).alias("net"), div(F.sum(F.col("px") * F.col("qty")), F.sum("qty")).alias("vwap"), F.min_by("px", order).alias("first"), F.max_by("px", order).alias("last"))


def impact_windows(trades: DataFrame, by: list[str], length: int, least: int) -> DataFrame:
    """slices of `least` trades or more with rho (|net| over volume), and the moves during it, kept at
    the end of the next slice, and given back (bps, signed by the flow)."""
    s = slices(trades, by, length)
    nxt = s.select(*by, (F.col("slice") - 1).alias("slice"), F.col("last").alias("after"))
    sign = F.signum("net")
    bps = lambda a, b: 1e4 * div(b - a, a) * sign
    out = s.where(F.col("n") >= least).join(nxt, [*by, "slice"]).withColumn("rho", div(F.abs("net"), F.col("volume")))
    out = out.withColumns({"during": bps(F.col("first"), F.col("last")), "kept": bps(F.col("first"), F.col("after"))})
    return out.withColumn("temporary", F.col("during") - F.col("kept"))


def bins(value: Column, edges: list[float]) -> Column:
    """The number of edges at or under the value."""
    return sum((value >= e).cast("int") for e in edges)


def parent_orders(trades: DataFrame, by: list[str], length: int, rates: list[float], horizon: int, stride: int) -> DataFrame:
    """by, rate, start (slice), filled, cost_bps: parents that start every `stride` slices and take `rate`
    of the volume of `horizon` slices, against the first price."""
    s = slices(trades, by, length)
    first = s.where(F.col("slice") % stride == 0).select(*by, F.col("slice").alias("start"), F.col("first").alias("arrival"))
    # each slice belongs to a bounded number of parents: the starts within the horizon before it
    k = F.floor(F.col("slice") / stride)
    own = s.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((F.col("slice") - horizon + 1) / stride)), k))).withColumn("start", F.col("start") * stride)
    own = own.join(first, [*by, "start"]).withColumn("rate", F.explode(F.array(*map(F.lit, rates))))
    child = F.col("volume") * F.col("rate")
    return own.groupBy(*by, "rate", "start").agg(F.sum(child).alias("filled"), (1e4 * div(div(F.sum(child * F.col("vwap")), F.sum(child)) - F.first("arrival"), F.first("arrival"))).alias("cost_bps"))


def lookback(events: DataFrame, trades: DataFrame, by: list[str], length: int) -> DataFrame:
    """events with pre_n, pre_value, pre_imbalance over the time just before each (the event left out)."""
    met = range_join(events.select(*by, "ts", "seq"), trades.select(*by, "ts", "px", "qty", "side"), by, F.col("ts") - length, F.col("ts") - 1, length)
    got = met.groupBy(*by, "seq").agg(F.count("*").alias("pre_n"), F.sum(F.col("r_px") * F.col("r_qty")).alias("pre_value"), div(F.sum(F.col("r_side") * F.col("r_qty")), F.sum("r_qty")).alias("pre_imbalance"))
    return events.join(got, [*by, "seq"], "left").fillna(0, ["pre_n"])


def recent_count(rows: DataFrame, by: list[str], length: int) -> Column:
    """Rows in (ts - length, ts]."""
    return F.count("*").over(Window.partitionBy(*by).orderBy("ts").rangeBetween(-(length - 1), 0))


def every_nth(trades: DataFrame, by: list[str], n: int) -> DataFrame:
    return trades.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("ts", "seq"))).where(F.col("_k") % n == 0).drop("_k")


def extreme_bars(trades: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, bar, step, px: of every n trades the open, the extreme further from it, and the close."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy("ts", "seq")) - 1
    order = F.struct("ts", "seq")
    b = trades.withColumn("bar", F.floor(k / n)).groupBy(*by, "bar").agg(F.min_by("px", order).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", order).alias("c"))
    far = F.when(F.col("h") - F.col("o") >= F.col("o") - F.col("l"), F.col("h")).otherwise(F.col("l"))
    return b.select(*by, "bar", F.posexplode(F.array("o", far, "c")).alias("step", "px"))


def value_bars(trades: DataFrame, by: list[str], value: float) -> DataFrame:
    """The trades at which the running notional crosses a multiple of `value`."""
    total = F.sum(F.col("px") * F.col("qty")).over(Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = trades.withColumn("_v", total)
    return rows.where(F.floor(F.col("_v") / value) > F.floor((F.col("_v") - F.col("px") * F.col("qty")) / value)).drop("_v")


def quantile_table(rows: DataFrame, by: list[str], x: str, y: str, k: int) -> DataFrame:
    """by, bin, n, mean of y by the quantile bins of x (edges interpolated, the last bin closed)."""
    cuts = [i / k for i in range(1, k)]
    e = rows.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, cuts))).alias("_e"))
    own = rows.join(e, by).withColumn("bin", F.size(F.filter("_e", lambda v: v <= F.col(x))))
    return own.where(F.col(x).isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def moments(column: str) -> dict[str, Column]:
    """n, mean, sd, and the bias-corrected skewness and kurtosis."""
    n, g1, g2 = F.count(column), F.skewness(column), F.kurtosis(column)
    return {
        "n": n, "mean": F.avg(column), "sd": F.stddev_samp(column),
        "skew": F.when(n > 2, F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)) * g1),
        "kurt": F.when(n > 3, ((n + 1.0) * g2 + 6.0) * (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0))),
    }


def partial_corr(x: Column, y: Column, z: Column) -> Column:
    a, b, c = F.corr(x, y), F.corr(x, z), F.corr(y, z)
    return div(a - b * c, F.sqrt((1 - b * b) * (1 - c * c)))


def lead_lag(rows: DataFrame, by: list[str], x: str, y: str, order: str, lags: list[int], least: int = 8) -> DataFrame:
    """by, lag, n, corr of x with y `lag` rows later."""
    w = Window.partitionBy(*by).orderBy(order)
    shifted = None
    for k in lags:
        v = F.lead(y, k).over(w) if k >= 0 else F.lag(y, -k).over(w)
        one = rows.select(*by, F.col(x).alias("x"), v.alias("y")).groupBy(*by).agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"), corr_or_null(F.col("x"), F.col("y"), least).alias("corr")).withColumn("lag", F.lit(k))
        shifted = one if shifted is None else shifted.unionByName(one)
    return shifted


def event_study(series: DataFrame, events: DataFrame, by: list[str], value: str, half: int) -> DataFrame:
    """lag, n, mean of value at bars from -half to half around events (by, bar); events whose window
    is not all there are dropped."""
    asked = events.select(*by, F.col("bar").alias("event"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("lag")).withColumn("bar", F.col("event") + F.col("lag"))
    met = asked.join(series.select(*by, "bar", value), [*by, "bar"])
    full = met.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "event"))).where(F.col("_n") == 2 * half + 1)
    return full.groupBy("lag").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def bursts(series: DataFrame, by: list[str], value: str, arm: float, disarm: float, gap: int) -> DataFrame:
    """by, bar where value reaches `arm`; the next counts after it has fallen under `disarm`, `gap` bars
    on at least."""
    def step(s, bar, v):
        if v is None:
            return ()
        if s["armed"] and v >= arm and bar - s["last"] >= gap:
            s.update(armed=False, last=bar)
            return [(bar,)]
        s["armed"] = s["armed"] or v < disarm
        return ()

    return fold(series, by, ["bar"], ["bar", value], lambda: {"armed": True, "last": -(1 << 62)}, step, "bar long")


def leave_one_out(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, low, high of the correlation without each row, from sums: no row meets another."""
    w = Window.partitionBy(*by)
    s = {k: F.sum(v).over(w) - v for k, v in {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "yy": F.col(y) * F.col(y), "xy": F.col(x) * F.col(y)}.items()}
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *(v.alias(f"_{k}") for k, v in s.items()))
    r = (F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")) / F.nullif(F.sqrt((F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x")) * (F.col("_n") * F.col("_yy") - F.col("_y") * F.col("_y"))), F.lit(0.0))
    return own.withColumn("r", r).groupBy(*by).agg(F.min("r").alias("low"), F.max("r").alias("high"))


def beta_shrinkage(rows: DataFrame, hits: str, trials: str, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """rows with posterior (under Beta(a0, b0)) and shrunk (under a Beta matched to the rows' moments)."""
    p = F.col(hits) / F.col(trials)
    w = Window.partitionBy()
    m, v = F.avg(p).over(w), F.var_samp(p).over(w)
    k = F.greatest(F.lit(0.0), div(m * (1 - m), v) - 1)
    own = rows.withColumns({"_m": m, "_k": F.coalesce(k, F.lit(0.0))})
    return own.withColumns({"posterior": (F.col(hits) + a0) / (F.col(trials) + a0 + b0), "shrunk": (F.col(hits) + F.col("_m") * F.col("_k")) / (F.col(trials) + F.col("_k"))}).drop("_m", "_k")


def hac_slope(rows: DataFrame, by: list[str], y: str, x: str, order: list[str], lags: int) -> DataFrame:
    """by, n, slope, se: least squares with a constant, and Newey-West errors with Bartlett weights."""
    own = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = own.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("cut"), F.avg(x).alias("mx"), F.regr_sxx(y, x).alias("sxx"))
    u = own.join(fit, by).withColumn("g", (F.col(x) - F.col("mx")) * (F.col(y) - F.col("cut") - F.col("slope") * F.col(x)))
    w = Window.partitionBy(*by).orderBy(*order)
    terms = F.col("g") * F.col("g") + sum(2 * (1 - k / (lags + 1)) * F.coalesce(F.col("g") * F.lag("g", k).over(w), F.lit(0.0)) for k in range(1, lags + 1))
    s = u.withColumn("t", terms).groupBy(*by).agg(F.sum("t").alias("s"))
    return fit.join(s, by).select(*by, "n", "slope", div(F.sqrt(F.greatest(F.col("s"), F.lit(0.0))), F.col("sxx")).alias("se"))


def autoregression(rows: DataFrame, by: list[str], x: str, lags: int, order: list[str]) -> DataFrame:
    """by, n, phi (array), sigma2, r2, rw_sigma2, impulse (array of 20): least squares on lags without a
    constant. Cross products are sums in Spark; each key's small system is solved in one row."""
    w = Window.partitionBy(*by).orderBy(*order)
    names = ["l0", *(f"l{k}" for k in range(1, lags + 1))]
    own = rows.where(F.col(x).isNotNull()).withColumns({f"l{k}": F.lag(x, k).over(w) if k else F.col(x) for k in range(lags + 1)}).dropna(subset=names)
    pairs = [(i, j) for i in range(lags + 1) for j in range(i, lags + 1)]
    sums = own.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs))

    def solve(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                s = np.zeros((lags + 1, lags + 1))
                for i, j in pairs:
                    s[i, j] = s[j, i] = r[f"s{i}_{j}"]
                if r["n"] <= 2 * lags or np.linalg.matrix_rank(s[1:, 1:]) < lags:
                    continue
                phi = np.linalg.solve(s[1:, 1:], s[1:, 0])
                rss = s[0, 0] - phi @ s[1:, 0]
                psi = [1.0]
                for h in range(1, 20):
                    psi.append(sum(phi[k] * psi[h - 1 - k] for k in range(min(h, lags))))
                s2 = rss / (r["n"] - lags)
                out.append((*(r[k] for k in by), int(r["n"]), phi.tolist(), s2, 1 - rss / s[0, 0], s2 / (1 - phi.sum()) ** 2, np.cumsum(psi).tolist()))
            yield pd.DataFrame(out, columns=[*by, "n", "phi", "sigma2", "r2", "rw_sigma2", "impulse"])

    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    return sums.mapInPandas(solve, f"{keys}, n long, phi array<double>, sigma2 double, r2 double, rw_sigma2 double, impulse array<double>")


def pin_fit(days: DataFrame, by: list[str], least_days: int = 3) -> DataFrame:
    """by, days, alpha, delta, mu, eps, pin: the likelihood of daily buys and sells under no news, good
    and bad news, by coordinate search from several starts. A row of day counts for each day is all
    that a key's group holds."""
    def loglik(p, b, s):
        alpha, delta, mu, eps = p
        logs = []
        for w, mb, ms in ((1 - alpha, eps, eps), (alpha * delta, eps, eps + mu), (alpha * (1 - delta), eps + mu, eps)):
            logs.append(math.log(max(w, 1e-12)) - mb - ms + b * math.log(mb) + s * math.log(ms))
        m = np.max(logs, axis=0)
        return float(np.sum(m + np.log(sum(np.exp(x - m) for x in logs))))

    def fit(key, frame):
        names = [*by, "days", "alpha", "delta", "mu", "eps", "pin"]
        b, s = frame.buys.to_numpy(float), frame.sells.to_numpy(float)
        if len(b) < least_days:
            return pd.DataFrame([], columns=names)
        mean, best = max((b.mean() + s.mean()) / 2, 1e-3), None
        for alpha in (0.2, 0.5, 0.8):
            for tilt in (0.25, 0.5, 1.0):
                p, step = np.array([alpha, 0.5, tilt * mean + 1e-3, mean]), 0.5
                at = loglik(p, b, s)
                while step > 1e-3:
                    moved = False
                    for k in range(4):
                        for sign in (1, -1):
                            q = p.copy()
                            q[k] = np.clip(q[k] + sign * step * (0.5 if k < 2 else max(q[k], 1e-3)), 1e-4, 1 - 1e-4 if k < 2 else None)
                            v = loglik(q, b, s)
                            if v > at + 1e-9:
                                p, at, moved = q, v, True
                    step = step if moved else step / 2
                if best is None or at > best[0]:
                    best = (at, p)
        a, d, mu, eps = best[1]
        return pd.DataFrame([(*key, len(b), a, d, mu, eps, a * mu / (a * mu + 2 * eps))], columns=names)

    keys = ", ".join(f"{k} {days.schema[k].dataType.simpleString()}" for k in by)
    return days.groupBy(*by).applyInPandas(fit, f"{keys}, days long, alpha double, delta double, mu double, eps double, pin double")
