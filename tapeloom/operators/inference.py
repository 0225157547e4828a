"""Inference over panels: block bootstraps, shuffles, robust least squares, conjugate posteriors.

Random numbers are md5 hashes of keys and draw numbers, so a lost task makes the same ones again.
Rows are summed to blocks before any draw; a draw weighs blocks, so no sample is ever gathered."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import div, draw, from_z, logistic_z, poisson_one
from tapeloom.operators.options import norm_cdf
from tapeloom.operators.validation import ranks
from tapeloom.sources.shared import table

Z95 = 1.959963984540054
PAIR = ["n", "x", "y", "xx", "yy", "xy"]


def block_bootstrap(blocks: DataFrame, by: list[str], block: str, sums: list[str], stat: Callable[[dict], Column], draws: int = 400, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """by, blocks, point, low, high: a percentile interval of a statistic of sums, under Poisson weights
    of whole blocks. blocks: a row for each block of each key. Draws without a statistic are left out."""
    value = stat({c: F.sum(c) for c in sums})
    weight = poisson_one(draw(F.lit(seed), F.col(block), F.col("draw")))
    drawn = blocks.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", weight)
    each = drawn.groupBy(*by, "draw").agg(stat({c: F.sum(F.col("_w") * F.col(c)) for c in sums}).alias("v"))
    ends = each.groupBy(*by).agg(F.percentile("v", F.lit(alpha / 2)).alias("low"), F.percentile("v", F.lit(1 - alpha / 2)).alias("high"))
    return blocks.groupBy(*by).agg(F.count("*").alias("blocks"), value.alias("point")).join(ends, by)


def mean_stat(c: dict) -> Column:
    return div(c["x"], c["n"])


def pair_sums(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, x, y, xx, yy, xy: sums over the pairs that are complete."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    own = rows.where(a.isNotNull() & b.isNotNull())
    return own.groupBy(*keys).agg(*(F.sum(v).alias(k) for k, v in zip(PAIR, (F.lit(1.0), a, b, a * a, b * b, a * b))))


def corr_stat(c: dict) -> Column:
    sx, sy = c["n"] * c["xx"] - c["x"] * c["x"], c["n"] * c["yy"] - c["y"] * c["y"]
    return F.when((sx > 0) & (sy > 0), (c["n"] * c["xy"] - c["x"] * c["y"]) / F.sqrt(F.greatest(sx * sy, F.lit(1e-300))))


def effect_sums(rows: DataFrame, keys: list[str], treated: Column, value: str) -> DataFrame:
    """keys, nt, xt, nc, xc: numbers and sums of treated and other rows."""
    own = rows.where(F.col(value).isNotNull())
    part = lambda flag, v: F.sum(F.when(flag, v).otherwise(0.0))
    return own.groupBy(*keys).agg(part(treated, F.lit(1.0)).alias("nt"), part(treated, F.col(value)).alias("xt"), part(~treated, F.lit(1.0)).alias("nc"), part(~treated, F.col(value)).alias("xc"))


def effect_stat(c: dict) -> Column:
    return div(c["xt"], c["nt"]) - div(c["xc"], c["nc"])


def median_draws(rows: DataFrame, by: list[str], value: str, item: str, draws: int, seed: int, bins: int = 256) -> DataFrame:
    """by, draw, v: the median of rows under Poisson weights of their items, exactly, for each draw.

    Rows are ranked by ranges and cut into bins of equal numbers. Weights are summed by draw and bin, which merges
    before it moves, and the sums tell which bin holds a draw's middle; only that bin's rows are weighed one by one."""
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(item).alias("_item"), F.col(value).cast("double").alias("_v"))
    own = ranks(own, by, "_v", "_item", "_r")
    own = table(own.join(own.groupBy(*by).agg(F.count("*").alias("_n")), by).withColumn("_bin", F.floor(F.col("_r") * bins / F.col("_n"))).drop("_n"))
    weight = poisson_one(draw(F.lit(seed), F.col("_item"), F.col("draw")))
    drawn = own.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy(*by, "draw", "_bin").agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by, "draw")
    at = drawn.withColumns({"_end": F.sum("_w").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_w").over(w)})
    at = at.withColumns({"_start": F.col("_end") - F.col("_w"), "_lo": F.floor((F.col("_all") - 1) / 2), "_hi": F.floor(F.col("_all") / 2)})
    inside = lambda x: (F.col("_start") <= F.col(x)) & (F.col(x) < F.col("_end"))
    held = table(at.where("_all > 0").where(inside("_lo") | inside("_hi")).select(*by, "draw", "_bin", "_start", "_lo", "_hi"))
    near = own.join(held, [*by, "_bin"]).withColumn("_w", weight).where("_w > 0")
    upto = F.sum("_w").over(Window.partitionBy(*by, "draw", "_bin").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_end", F.col("_start") + upto).withColumn("_start", F.col("_end") - F.col("_w"))
    middle = near.groupBy(*by, "draw").agg(F.max(F.when(inside("_lo"), F.col("_v"))).alias("_a"), F.max(F.when(inside("_hi"), F.col("_v"))).alias("_b"))
    return middle.select(*by, "draw", ((F.col("_a") + F.col("_b")) / 2).alias("v"))


def bootstrap_median(rows: DataFrame, by: list[str], value: str, item: str, draws: int = 400, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """by, n, median, low, high: a percentile interval of the median of rows (one an item), under Poisson weights."""
    own = rows.where(F.col(value).isNotNull())
    each = median_draws(own, by, value, item, draws, seed)
    ends = each.groupBy(*by).agg(F.percentile("v", F.lit(alpha / 2)).alias("low"), F.percentile("v", F.lit(1 - alpha / 2)).alias("high"))
    return own.groupBy(*by).agg(F.count("*").alias("n"), F.median(value).alias("median")).join(ends, by)


def compare_medians(rows: DataFrame, by: list[str], item: str, columns: list[str], draws: int = 500, seed: int = 11) -> DataFrame:
    """by, series, n, mean, median, low, high, excludes_0: of each column, and of each difference of two of them within an
    item (a_minus_b, over items that have both; left out under three). Draws weigh items, so all series are drawn jointly."""
    series = [F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in columns]
    series += [F.struct(F.lit(f"{a}_minus_{b}").alias("series"), (F.col(a) - F.col(b)).cast("double").alias("value")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    own = rows.select(*by, item, F.explode(F.array(*series)).alias("_s")).select(*by, item, "_s.*").where("value IS NOT NULL AND NOT isnan(value)")
    keys = [*by, "series"]
    n = F.count("*").over(Window.partitionBy(*keys))
    own = table(own.withColumn("_n", n).where((F.col("_n") >= 3) | ~F.col("series").contains("_minus_")).drop("_n"))
    mean = own.groupBy(*keys).agg(F.avg("value").alias("mean"))
    out = bootstrap_median(own, keys, "value", item, draws, seed).join(mean, keys)
    return out.withColumn("excludes_0", (F.col("low") > 0) | (F.col("high") < 0))


def shuffle_test(rows: DataFrame, by: list[str], block: list[str], x: str, y: str, item: str, draws: int = 200, seed: int = 0, ranks: bool = True) -> DataFrame:
    """by, n, observed, null_median, p: |correlation| of x and y (ranks: of their ordinal ranks) against
    shuffles of y within blocks. p: the share of shuffles that reach it. item: unique in a key. A row
    meets the one that takes its place by an equi-join, never all others. For panels, not for tapes."""
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *[c for c in block if c not in by], item, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    if ranks:
        w = Window.partitionBy(*by)
        own = own.withColumns({c: F.row_number().over(w.orderBy(c, item)).cast("double") for c in ("_x", "_y")})
    keys = [*by, *[c for c in block if c not in by]]
    sums = pair_sums(own, by, "_x", "_y")
    placed = own.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(item)))
    left = placed.select(*keys, "_i", "_x").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    right = placed.select(*keys, item, "_y").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = Window.partitionBy(*keys, "draw").orderBy(draw(F.lit(seed), F.col(item), F.col("draw")), item)
    right = right.withColumn("_i", F.row_number().over(order)).drop(item)
    crossed = left.join(right, [*keys, "draw", "_i"]).groupBy(*by, "draw").agg(F.sum(F.col("_x") * F.col("_y")).alias("xy"))
    c = {k: F.col(k) for k in PAIR}
    observed = sums.select(*by, *PAIR, F.abs(corr_stat(c)).alias("observed"))
    null = crossed.join(observed.drop("xy"), by).withColumn("null", F.abs(corr_stat(c)))
    found = null.groupBy(*by).agg(F.percentile("null", F.lit(0.5)).alias("null_median"), F.avg((F.col("null") >= F.col("observed") - 1e-12).cast("double")).alias("p"))
    return observed.select(*by, F.col("n").cast("long").alias("n"), "observed").join(found, by)


def ols(rows: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """by, n, beta (array: constant first), r2, resid_sd: least squares with a constant. Cross products are
    sums in Spark; each key's small system is solved in one row."""
    names = ["_1", *xs, y]
    own = rows.withColumn("_1", F.lit(1.0)).dropna(subset=[*xs, y])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = own.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")).alias(f"s{i}_{j}") for i, j in pairs))
    k = len(xs) + 1

    def solve(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                s = np.zeros((k + 1, k + 1))
                for i, j in pairs:
                    s[i, j] = s[j, i] = r[f"s{i}_{j}"]
                n = int(r["n"])
                if n < k + 2 or np.linalg.matrix_rank(s[:k, :k]) < k:
                    continue
                beta = np.linalg.solve(s[:k, :k], s[:k, k])
                rss, tss = s[k, k] - beta @ s[:k, k], s[k, k] - s[0, k] ** 2 / n
                out.append((*(r[c] for c in by), n, beta.tolist(), 1 - rss / tss if tss > 0 else None, math.sqrt(max(rss, 0.0) / (n - k))))
            yield pd.DataFrame(out, columns=[*by, "n", "beta", "r2", "resid_sd"])

    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return sums.mapInPandas(solve, f"{keys}, n long, beta array<double>, r2 double, resid_sd double")


def hac_ols(rows: DataFrame, by: list[str], y: str, xs: list[str], order: list[str], lags: int | None = None) -> DataFrame:
    """by, n, beta, se, t (arrays: constant first), r2, lags: least squares with Newey-West errors under
    Bartlett weights. lags None: floor(4 (n / 100) ** (2 / 9)) of each key. The scores' products at each
    lag are sums over a window; only a matrix for each key is solved in Python."""
    own = rows.dropna(subset=[*xs, y])
    fit = ols(own, by, y, xs)
    rule = F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int") if lags is None else F.lit(lags)
    fit = fit.withColumn("lags", F.greatest(F.lit(0), rule))
    most = fit.agg(F.max("lags")).first()[0] or 0
    k = len(xs) + 1
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    joined = own.join(fit.select(*by, "beta", "lags"), by)
    u = F.col(y) - sum(F.element_at("beta", i + 1) * c for i, c in enumerate(columns))
    g = joined.withColumns({f"_g{i}": u * c for i, c in enumerate(columns)} | {f"_x{i}": c for i, c in enumerate(columns)})
    w = Window.partitionBy(*by).orderBy(*order)
    lagged = g.withColumns({f"_g{i}_{l}": F.lag(f"_g{i}", l).over(w) for i in range(k) for l in range(1, most + 1)})
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def entry(i, j):
        out = F.sum(F.col(f"_g{i}") * F.col(f"_g{j}"))
        for l in range(1, most + 1):
            weight = F.greatest(F.lit(0.0), 1 - l / (F.col("lags") + 1.0))
            out = out + F.sum(weight * F.coalesce(F.col(f"_g{i}") * F.col(f"_g{j}_{l}") + F.col(f"_g{j}") * F.col(f"_g{i}_{l}"), F.lit(0.0)))
        return out

    sums = lagged.groupBy(*by).agg(*(entry(i, j).alias(f"s{i}_{j}") for i, j in cells), *(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"q{i}_{j}") for i, j in cells)).join(fit, by)

    def solve(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                s, q = np.zeros((k, k)), np.zeros((k, k))
                for i, j in cells:
                    s[i, j] = s[j, i] = r[f"s{i}_{j}"]
                    q[i, j] = q[j, i] = r[f"q{i}_{j}"]
                back = np.linalg.inv(q)
                se = np.sqrt(np.maximum(np.diag(back @ s @ back), 0.0))
                beta = np.array(r["beta"])
                out.append((*(r[c] for c in by), int(r["n"]), beta.tolist(), se.tolist(), [b / e if e > 0 else None for b, e in zip(beta, se)], r["r2"], int(r["lags"])))
            yield pd.DataFrame(out, columns=[*by, "n", "beta", "se", "t", "r2", "lags"])

    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return sums.mapInPandas(solve, f"{keys}, n long, beta array<double>, se array<double>, t array<double>, r2 double, lags int")


def mean_interval(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, se, low, high: the normal 95 % interval of a mean, as of slopes over cross-sections."""
    out = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))
    return out.withColumns({"low": F.col("mean") - Z95 * F.col("se"), "high": F.col("mean") + Z95 * F.col("se")})


def correlation_posterior(r: Column, n: Column, mean: float = 0.0, precision: float = 0.0) -> dict[str, Column]:
    """Posterior mean and 95 % bounds of a correlation, normal on Fisher's z; null under five pairs or at
    a correlation of one."""
    ok = (n >= 5) & (F.abs(r) < 1)
    weight = F.greatest(n - 3, F.lit(1))
    z, sd = (precision * mean + weight * logistic_z(r)) / (precision + weight), 1 / F.sqrt(precision + weight)
    return {"mean_r": F.when(ok, from_z(z)), "low_r": F.when(ok, from_z(z - 1.96 * sd)), "high_r": F.when(ok, from_z(z + 1.96 * sd))}


def p_from_interval(point: Column, low: Column, high: Column) -> Column:
    """A rough two-sided p from a percentile interval: 0.2 at least where it holds 0, at most where not."""
    half = (high - low) / 2
    tail = 2 * (1 - norm_cdf(F.abs(point) / F.nullif(half, F.lit(0.0))))
    outside = (low > 0) | (high < 0)
    p = F.when(half <= 0, F.when(outside, 0.001).otherwise(1.0)).when(outside, F.greatest(F.lit(0.001), F.least(F.lit(0.2), tail))).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(1.0), tail)))
    return F.when(point.isNotNull() & low.isNotNull() & high.isNotNull(), p)


def gamma_posterior(count: Column, exposure: Column, a0: Column | float = 1.0, b0: Column | float = 1.0) -> dict[str, Column]:
    """Mean, variance and 95 % bounds of a rate under a Gamma prior; the bounds by Wilson and Hilferty's
    cube-root form, within some tenths of a per cent from two events on."""
    a, b = count + a0, F.greatest(exposure, F.lit(1e-12)) + b0
    end = lambda z: a / b * F.pow(F.greatest(F.lit(0.0), 1 - 1 / (9 * a) + z / (3 * F.sqrt(a))), F.lit(3.0))
    return {"mean": a / b, "var": a / (b * b), "low": end(-Z95), "high": end(Z95)}


def poisson_shrinkage(rows: DataFrame, count: str, exposure: str, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """rows with rate, posterior (under the given prior) and shrunk (under half of it and half of a Gamma
    matched to the rows' rates). One row of sums meets the rows."""
    own = rows.where((F.col(exposure) > 0) & F.col(count).isNotNull())
    rate = F.col(count) / F.col(exposure)
    m = own.agg(F.avg(rate).alias("mu"), F.var_samp(rate).alias("v")).first()
    fits = bool(m["v"]) and m["v"] > 0 and m["mu"] > 0
    a = 0.5 * (max(0.5, m["mu"] ** 2 / m["v"]) if fits else a0) + 0.5 * a0
    b = 0.5 * (max(0.5, m["mu"] / m["v"]) if fits else b0) + 0.5 * b0
    return own.withColumns({"rate": rate, "posterior": gamma_posterior(F.col(count), F.col(exposure), a0, b0)["mean"], "shrunk": gamma_posterior(F.col(count), F.col(exposure), a, b)["mean"]})


#: Priors that a desk compares: a, b and what they are called. Fixed values.
PRIORS = [(1.0, 1.0, "uniform"), (0.5, 0.5, "jeffreys"), (2.0, 2.0, "weak_shrink_0.5"), (1.0, 19.0, "skeptical_p05"), (1.0, 99.0, "skeptical_p01")]


def prior_sensitivity(rows: DataFrame, hits: str, trials: str, priors: list[tuple] = PRIORS) -> DataFrame:
    """rows by prior, with the posterior mean and variance of the rate under it."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("prior"), F.lit(a).alias("a0"), F.lit(b).alias("b0")) for a, b, name in priors)))
    own = rows.withColumn("_p", each).select(*rows.columns, "_p.*")
    a, b = F.col("a0") + F.col(hits), F.col("b0") + F.greatest(F.lit(0.0), F.col(trials) - F.col(hits))
    return own.withColumns({"mean": a / (a + b), "var": a * b / ((a + b) * (a + b) * (a + b + 1))})


def split_signs(rows: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """by, early, late, same_sign: means over the first half of a key's days and the rest."""
    w = Window.partitionBy(*by)
    days = rows.select(*by, day).distinct()
    half = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 2))
    days = days.withColumn("_early", F.row_number().over(w.orderBy(day)) <= half)
    mean = lambda flag: F.avg(F.when(flag, F.col(value)))
    out = rows.join(days, [*by, day]).groupBy(*by).agg(mean(F.col("_early")).alias("early"), mean(~F.col("_early")).alias("late"))
    # means that are zero but for rounding have no sign
    return out.withColumn("same_sign", F.coalesce(F.col("early") * F.col("late") > 1e-15, F.lit(False)))


def quartile_means(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, quartile (1 to 4), n, mean of y by the quartile of x within by; the highest is closed above."""
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = own.groupBy(*by).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_e"))
    at = 1 + sum((F.col(x) >= F.element_at("_e", k)).cast("int") for k in (1, 2, 3))
    return own.join(edges, by).groupBy(*by, at.alias("quartile")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def calibration_bins(rows: DataFrame, by: list[str], y: str, p: str, tie: str, bins: int = 5) -> DataFrame:
    """by, bin, n, predicted, seen: mean prediction and share of hits by equal numbers of predictions."""
    own = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    w = Window.partitionBy(*by)
    at = F.floor((F.row_number().over(w.orderBy(p, tie)) - 1) * bins / F.count("*").over(w)).cast("int")
    return own.withColumn("bin", at).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("seen"))


def brier(y: Column, p: Column) -> dict[str, Column]:
    """Aggregates: the Brier score of predictions, and that of the share of hits."""
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    both = F.when(p.isNotNull(), y)
    return {"brier": F.avg((both - held) * (both - held)), "base": F.avg(y) * (1 - F.avg(y))}
