"""What an effect is made of: treated against other events with halves and costs, one driver against several legs, and a tape's
imbalance against the common and the own part of returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import corr_or_null, div, draw, finite, poisson_one
from tapeloom.operators.decisions import verdict
from tapeloom.operators.inference import PAIR, block_bootstrap, corr_stat, effect_stat, effect_sums, shuffle_test
from tapeloom.operators.validation import ranks
from tapeloom.sources.shared import table

SUMS = ["nt", "xt", "nc", "xc"]


def effect_verdicts(rows: DataFrame, by: list[str], day: str, treated: Column, value: str, early: Column, late: Column, bar: float, least: int = 40, draws: int = 400, seed: int = 0) -> DataFrame:
    """by, n_treated, n_control, treated_mean, control_mean, delta, low, high, early_delta, late_delta, cleared, verdict: how much
    larger `value` is in treated rows than in others, with an interval over blocks of days.

    A missing treatment is no treatment; rows without a value do not count. early and late are conditions on the day. The
    difference clears `bar` when its interval is off zero and it is over the bar. Keys whose draws never have both groups
    are left out. A loss whose interval is off zero is a Kill however few rows there are; else the verdict is that of decisions.
    Rows are summed by day once; draws weigh days."""
    own = rows.withColumn(value, finite(F.col(value)))
    sums = table(effect_sums(own, [*by, day], F.coalesce(treated, F.lit(False)), value))
    part = lambda flag: effect_stat({c: F.sum(F.when(flag, F.col(c)).otherwise(0.0)) for c in SUMS})
    means = sums.groupBy(*by).agg(
        F.sum("nt").cast("long").alias("n_treated"), F.sum("nc").cast("long").alias("n_control"), div(F.sum("xt"), F.sum("nt")).alias("treated_mean"), div(F.sum("xc"), F.sum("nc")).alias("control_mean"),
        part(early).alias("early_delta"), part(late).alias("late_delta"),
    )
    ends = block_bootstrap(sums, by, day, SUMS, effect_stat, draws, seed).where("low IS NOT NULL")
    out = means.join(ends.select(*by, F.col("point").alias("delta"), "low", "high"), by)
    cleared = F.coalesce(((F.col("low") > 0) | (F.col("high") < 0)) & (F.col("delta") > bar), F.lit(False))
    loss = F.coalesce((F.col("high") < 0) & (F.col("delta") < 0), F.lit(False))
    ruled = F.when(loss, "Kill").otherwise(verdict(F.col("n_treated"), F.col("delta"), F.col("low"), F.col("high"), F.col("early_delta"), F.col("late_delta"), cleared, least))
    return out.select(*by, "n_treated", "n_control", "treated_mean", "control_mean", "delta", "low", "high", "early_delta", "late_delta", cleared.alias("cleared"), ruled.alias("verdict"))


def cost_sweep(effects: DataFrame, by: list[str], bars: list[float], own_bar: float) -> DataFrame:
    """by, bar, delta, low, clears, break_bar, survives: the costs that an effect (delta, low) is over, the least of `bars` that it
    is not (null: none), and whether that is over `own_bar`."""
    clears = lambda b: F.coalesce((F.col("low") > 0) & (F.col("delta") > b), F.lit(False))
    first = F.array_min(F.array(*(F.when(~clears(b), F.lit(b)) for b in bars)))
    out = effects.withColumn("break_bar", first).withColumn("bar", F.explode(F.array(*map(F.lit, bars))))
    return out.select(*by, "bar", "delta", "low", clears(F.col("bar")).alias("clears"), "break_bar", F.coalesce(F.col("break_bar") > own_bar, F.lit(True)).alias("survives"))


def driver_by_leg(driver: DataFrame, values: DataFrame, by: list[str], day: str, leg: str, legs: list) -> DataFrame:
    """by, leg, n, corr, rank_corr, concordant: a daily driver (`driver`) against each leg's daily value (`value`) and, as leg
    joint, against the mean of the legs' standard scores on days that have them all.

    concordant: all the legs' correlations are of one sign, none missing. Values equal to 12 decimals tie, and ties rank by
    day. Windows hold one row a day of a key."""
    wide = values.where(F.col(leg).isin(legs)).groupBy(*by, day).agg(*(F.max(F.when(F.col(leg) == F.lit(v), finite(F.col("value")))).alias(f"_{i}") for i, v in enumerate(legs)))
    rows = driver.withColumn("driver", finite(F.col("driver"))).where("driver IS NOT NULL").join(wide, [*by, day])
    key = Window.partitionBy(*by)
    names = [f"_{i}" for i in range(len(legs))]
    whole = F.forall(F.array(*names), lambda x: x.isNotNull())
    score = lambda c: (F.col(c) - F.avg(F.when(whole, F.col(c))).over(key)) / (F.stddev_pop(F.when(whole, F.col(c))).over(key) + 1e-12)
    joint = F.when(whole, sum(score(c) for c in names) / len(names))
    each = [F.struct(F.lit(str(v)).alias("leg"), F.col(f"_{i}").alias("v")) for i, v in enumerate(legs)]
    long = rows.withColumn("_j", joint).select(*by, day, "driver", F.explode(F.array(*each, F.struct(F.lit("joint").alias("leg"), F.col("_j").alias("v")))).alias("_e"))
    long = long.select(*by, day, "driver", F.col("_e.leg").alias("leg"), F.col("_e.v").alias("v")).where("v IS NOT NULL")
    w = Window.partitionBy(*by, "leg")
    placed = long.withColumns({"_a": F.row_number().over(w.orderBy("driver", day)), "_b": F.row_number().over(w.orderBy(F.round("v", 12), day))})
    out = placed.groupBy(*by, "leg").agg(F.count("*").alias("n"), corr_or_null(F.col("driver"), F.col("v")).alias("corr"), F.when(F.count("*") >= 3, F.corr("_a", "_b")).alias("rank_corr"))
    sign = F.when(F.col("leg") != "joint", F.signum("corr"))
    one = (F.count(sign).over(key) == len(legs)) & (F.min(sign).over(key) == F.max(sign).over(key))
    return out.withColumn("concordant", F.coalesce(one, F.lit(False)))


def market_model(returns: DataFrame, base: DataFrame, by: list[str], at: str) -> DataFrame:
    """by, at, own, common: the residual of returns (r) on the base's (m) at the same time, and the part that the base explains,
    by least squares with a constant for each key. Keys whose base does not vary are left out."""
    both = returns.where("r IS NOT NULL").join(base.where("m IS NOT NULL"), [c for c in base.columns if c != "m"])
    fit = both.groupBy(*by).agg(F.regr_slope("r", "m").alias("_b"), F.regr_intercept("r", "m").alias("_a")).where("_b IS NOT NULL")
    return both.join(fit, by).select(*by, at, (F.col("r") - F.col("_a") - F.col("_b") * F.col("m")).alias("own"), (F.col("_b") * F.col("m")).alias("common"))


def flow_against_parts(parts: DataFrame, trades: DataFrame, by: list[str], at: str, span: int, least: int = 30) -> DataFrame:
    """by, n, rho_own, rho_common, mean_own, mean_common: rank correlations of the imbalance of a key's volume, in windows of
    `span` from its first trade on, with the sizes of the own and the common part of its returns at times within a window.

    Times before the first trade or in windows without volume do not count; keys with under `least` times are left out. Sizes
    equal to 12 decimals tie, and ties rank by time. Ranks are read off range partitions, so a long key is many tasks."""
    start = trades.groupBy(*by).agg(F.min("ts").alias("_t0"))
    slot = lambda t: F.floor((F.col(t) - F.col("_t0")) / span)
    flow = trades.join(start, by).groupBy(*by, slot("ts").alias("_slot")).agg(div(F.sum(F.col("side") * F.col("qty")), F.sum("qty")).alias("_rho")).where("_rho IS NOT NULL")
    size = lambda c: F.round(F.abs(c), 12)
    met = parts.join(start, by).withColumn("_slot", slot(at)).join(flow, [*by, "_slot"]).select(*by, at, "_rho", size("own").alias("_own"), size("common").alias("_common"))
    ranked = ranks(ranks(ranks(met, by, "_rho", at, "_a"), by, "_own", at, "_b"), by, "_common", at, "_c")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho_own"), F.corr("_a", "_c").alias("rho_common"), F.avg("_own").alias("mean_own"), F.avg("_common").alias("mean_common"))
    return out.where(F.col("n") >= least)


def regimes(rows: DataFrame, by: list[str], column: str, least: int = 20) -> DataFrame:
    """rows with regime: high at the key's median of a column or over it, else low; keys with under `least` values are left out.
    For panels: a key's values are one aggregate."""
    own = rows.withColumn(column, finite(F.col(column))).where(F.col(column).isNotNull())
    middle = own.groupBy(*by).agg(F.median(column).alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return own.join(middle, by).withColumn("regime", F.when(F.col(column) >= F.col("_m"), "high").otherwise("low")).drop("_m", "_n")


def rank_matrix(rows: DataFrame, by: list[str], item: str, xs: list[str], ys: list[str], draws: int = 400, seed: int = 7, least: int = 5) -> DataFrame:
    """by, x, y, n, rho, low, high, p: rank correlations of each of xs with each of ys over the items that have both, their
    intervals under Poisson weights of items, and the share of shuffles of y that reach them.

    item is unique in a key. Every draw is ranked anew: copies of an item share the middle of their ranks, values equal to
    12 decimals rank by item. An item weighs alike in all pairs. Pairs of under `least` items are left out. For panels: the
    rows are items x pairs x draws."""
    keys = [*by, "_of", "_with"]
    value = lambda c: F.round(finite(F.col(c)), 12)
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("_of"), F.lit(y).alias("_with"), value(x).alias("_a"), value(y).alias("_b")) for x in xs for y in ys)))
    long = rows.select(*by, F.col(item).alias("_item"), pairs.alias("_p")).select(*by, "_item", "_p.*").where("_a IS NOT NULL AND _b IS NOT NULL")
    long = table(long.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n"))
    w = poisson_one(draw(F.lit(seed), F.col("_item"), F.col("draw")))
    drawn = long.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", w).where("_w > 0")

    def middle(c):
        upto = F.sum("_w").over(Window.partitionBy(*keys, "draw").orderBy(c, "_item").rowsBetween(Window.unboundedPreceding, 0))
        return upto - (F.col("_w") - 1) / 2

    ranked = drawn.withColumns({"_ra": middle("_a"), "_rb": middle("_b")})
    n, a, b = F.col("_w"), F.col("_ra"), F.col("_rb")
    sums = dict(zip(PAIR, (F.sum(n), F.sum(n * a), F.sum(n * b), F.sum(n * a * a), F.sum(n * b * b), F.sum(n * a * b))))
    each = ranked.groupBy(*keys, "draw").agg(corr_stat(sums).alias("v"))
    ends = each.groupBy(*keys).agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))
    own = Window.partitionBy(*keys)
    point = long.withColumns({"_ra": F.row_number().over(own.orderBy("_a", "_item")), "_rb": F.row_number().over(own.orderBy("_b", "_item"))})
    point = point.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))
    null = shuffle_test(long, keys, [], "_a", "_b", "_item", draws, seed).select(*keys, "p")
    return point.join(ends, keys).join(null, keys).withColumnsRenamed({"_of": "x", "_with": "y"})
