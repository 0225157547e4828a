"""Venues side by side: law-of-one-price gaps, costs, dealer constraint, regimes, information shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import corr_or_null, div, log_change
from tapeloom.operators.temporal import asof


def aligned(tob: DataFrame, by: list[str], step: int, tolerance: int) -> DataFrame:
    """by, venue, ts, mid, half: quotes in force on a grid of multiples of step, within the tolerance."""
    ends = tob.groupBy(*by).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    times = ends.select(*by, F.explode(F.sequence(F.floor(F.col("lo") / step) * step, F.floor(F.col("hi") / step) * step, F.lit(step).cast("long"))).alias("ts"))
    asked = times.join(tob.select(*by, "venue").distinct(), by).withColumn("seq", F.lit(0).cast("long"))
    q = tob.withColumn("half", div(F.col("ask") - F.col("bid"), 2 * F.col("mid")))
    return asof(asked, q, [*by, "venue"], ["mid", "half"], tolerance=tolerance).select(*by, "venue", "ts", "mid", "half")


def gaps(panel: DataFrame, by: list[str], fee_bps: float = 0.0) -> DataFrame:
    """by, ts, pairs, vloop_max, vloop_mean, tcost, pim: log gaps of all pairs of venues with a quote;
    costs are the half spreads and the fees of all legs; pim is known only for a gap above zero."""
    fine = panel.where("mid IS NOT NULL")
    a, b = fine.select(*by, "ts", F.col("venue").alias("va"), F.col("mid").alias("ma")), fine.select(*by, "ts", F.col("venue").alias("vb"), F.col("mid").alias("mb"))
    pair = a.join(b, [*by, "ts"]).where("va < vb").groupBy(*by, "ts").agg(F.count("*").alias("pairs"), F.max(F.abs(F.ln(F.col("ma") / F.col("mb")))).alias("vloop_max"), F.avg(F.abs(F.ln(F.col("ma") / F.col("mb")))).alias("vloop_mean"))
    cost = fine.groupBy(*by, "ts").agg((F.sum(F.coalesce("half", F.lit(0.0))) + fee_bps / 1e4 * F.count("*")).alias("tcost"))
    return pair.join(cost, [*by, "ts"]).withColumn("pim", F.when(F.col("vloop_max") > 0, F.col("vloop_max") + F.abs("tcost")))


def rolling_vol(rows: DataFrame, by: list[str], level: str, window: int) -> DataFrame:
    """rows with rv: the deviation of log changes over `window` rows, from half of them on (2 at least)."""
    w = Window.partitionBy(*by).orderBy("ts")
    r = rows.withColumn("_r", log_change(level, by, ("ts",)))
    own = w.rowsBetween(-(window - 1), 0)
    return r.withColumn("rv", F.when(F.count("_r").over(own) >= max(window // 2, 2), F.stddev_samp("_r").over(own))).drop("_r")


def rolling_imbalance(trades: DataFrame, by: list[str], window: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    own = w.rowsBetween(-(window - 1), 0)
    return trades.withColumn("imbalance", F.when(F.row_number().over(w) >= window, div(F.sum(F.col("side") * F.col("qty")).over(own), F.sum("qty").over(own))))


def first_component(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """rows with pc1: the first principal component of the z-scores, signed so that the first column
    loads above zero. The covariances are one aggregate for each key; scores are projections."""
    fine = rows.dropna(subset=columns)
    keyed = fine.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns), *(F.corr(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j))
    k = len(columns)

    def load(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                c = np.eye(k)
                for i in range(k):
                    for j in range(i + 1, k):
                        c[i, j] = c[j, i] = r[f"c_{i}_{j}"] if r[f"c_{i}_{j}"] == r[f"c_{i}_{j}"] and r[f"c_{i}_{j}"] is not None else 0.0
                values, vectors = np.linalg.eigh(c)
                v = vectors[:, -1] * (1 if vectors[0, -1] >= 0 else -1)
                out.append((*(r[b] for b in by), v.tolist(), float(values[-1] / values.sum())))
            yield pd.DataFrame(out, columns=[*by, "load", "share"])

    schema = ", ".join(f"{b} {rows.schema[b].dataType.simpleString()}" for b in by) + ", load array<double>, share double"
    loads = keyed.mapInPandas(load, schema).join(keyed, by)
    score = sum(F.element_at("load", i + 1) * div(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")) for i, c in enumerate(columns))
    return fine.join(loads, by).select(*fine.columns, score.alias("pc1"), "share")


def regime_corr(rows: DataFrame, by: list[str], x: str, y: str, regime: str, low: float = 0.25, high: float = 0.75, least: int = 15) -> DataFrame:
    """by, corr_low, corr_high, delta: correlation of x and y where the regime is at or under its low
    quantile, and at or over its high one."""
    q = rows.groupBy(*by).agg(F.percentile(regime, F.array(F.lit(low), F.lit(high))).alias("_q"))
    own = rows.join(q, by)
    part = lambda c, k: F.when(c, F.col(k))
    lo, hi = F.col(regime) <= F.element_at("_q", 1), F.col(regime) >= F.element_at("_q", 2)
    out = own.groupBy(*by).agg(corr_or_null(part(lo, x), part(lo, y), least).alias("corr_low"), corr_or_null(part(hi, x), part(hi, y), least).alias("corr_high"))
    return out.withColumn("delta", F.col("corr_high") - F.col("corr_low"))


def logistic(x: Column, middle: Column, gamma: float = 1.0) -> Column:
    u = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), gamma * (x - middle)))
    return 1 / (1 + F.exp(-u))


def bucket_means(rows: DataFrame, by: list[str], columns: list[str], step: int) -> DataFrame:
    """by, bucket, ts (its middle), n and means over all buckets from the first row's on, empty ones too."""
    start = F.min("ts").over(Window.partitionBy(*by))
    own = rows.withColumn("_t0", start).withColumn("bucket", F.floor((F.col("ts") - F.col("_t0")) / step))
    got = own.groupBy(*by, "bucket").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))
    ends = own.groupBy(*by).agg(F.max("bucket").alias("_last"), F.first("_t0").alias("_t0"))
    every = ends.select(*by, "_t0", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("bucket"))
    return every.join(got, [*by, "bucket"], "left").select(*by, "bucket", (F.col("_t0") + F.col("bucket") * step + step // 2).alias("ts"), F.coalesce("n", F.lit(0)).alias("n"), *columns)


def information_share(panel: DataFrame, by: list[str], a: int, b: int, lags: int) -> DataFrame:
    """by, n, share_a_low, share_a_high: bounds of venue a's share of the common price's variance, from
    a VAR of both venues' log returns. The lagged cross products are sums in Spark; the small solve is
    one for each key."""
    wide = panel.where(F.col("venue").isin(a, b)).groupBy(*by, "ts").agg(F.max(F.when(F.col("venue") == a, F.col("mid"))).alias("ma"), F.max(F.when(F.col("venue") == b, F.col("mid"))).alias("mb")).dropna()
    w = Window.partitionBy(*by).orderBy("ts")
    r = wide.select(*by, "ts", log_change("ma", by, ("ts",)).alias("a0"), log_change("mb", by, ("ts",)).alias("b0"))
    names = [f"{v}{k}" for k in range(lags + 1) for v in "ab"]
    r = r.withColumns({f"{v}{k}": F.lag(f"{v}0", k).over(w) for k in range(1, lags + 1) for v in "ab"}).dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = r.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs))

    def solve(frames):
        for f in frames:
            out = []
            for _, row in f.iterrows():
                s = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    s[i, j] = s[j, i] = row[f"s{i}_{j}"]
                xx, xy = s[2:, 2:], s[2:, :2]
                if row["n"] <= 4 * lags or np.linalg.matrix_rank(xx) < len(xx):
                    continue
                coef = np.linalg.solve(xx, xy)
                omega = (s[:2, :2] - coef.T @ xy) / row["n"]
                phi = np.eye(2) - sum(coef[2 * k : 2 * k + 2].T for k in range(lags))
                if abs(np.linalg.det(phi)) < 1e-12 or np.linalg.det(omega) <= 0:
                    continue
                psi = np.linalg.inv(phi).mean(axis=0)
                total = psi @ omega @ psi
                first = (psi @ np.linalg.cholesky(omega))[0] ** 2 / total
                swap = np.linalg.cholesky(omega[::-1, ::-1])
                last = (psi[::-1] @ swap)[1] ** 2 / total
                out.append((*(row[k] for k in by), int(row["n"]), float(min(first, last)), float(max(first, last))))
            yield pd.DataFrame(out, columns=[*by, "n", "share_a_low", "share_a_high"])

    return sums.mapInPandas(solve, ", ".join(f"{k} {panel.schema[k].dataType.simpleString()}" for k in by) + ", n long, share_a_low double, share_a_high double")
