"""Models judged out of sample: ridge regressions over blocks of days, and a logistic posterior by Newton steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import all_of
from tapeloom.sources.shared import table


def _keys(rows: DataFrame, by: list[str]) -> str:
    return "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)


def ranks(rows: DataFrame, by: list[str], column: str, tie: str, name: str) -> DataFrame:
    """rows with `name`: the ordinal rank (from 0) of a column within by, ties by `tie`. Rows are sorted by ranges
    over all keys, so a key is as many tasks as its share of the rows."""
    part = table(rows.repartitionByRange(*by, column, tie).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = table(sizes.select(*by, "_part", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(column, tie)) - 1
    return part.withColumn("_in", inside).join(before, [*by, "_part"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def day_folds(rows: DataFrame, by: list[str], day: str, folds: int) -> DataFrame:
    """by, day, fold: blocks of days in order; days behind the last whole block have no fold. With fewer days than
    folds + 1 there are as many folds as days but one, two at least."""
    w = Window.partitionBy(*by)
    days = rows.select(*by, day).distinct().withColumns({"_k": F.row_number().over(w.orderBy(day)) - 1, "_n": F.count("*").over(w)})
    n = F.when(F.col("_n") < folds + 1, F.greatest(F.lit(2), F.col("_n") - 1)).otherwise(folds)
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    fold = F.floor(F.col("_k") / size)
    return days.select(*by, day, F.when(fold < n, fold).alias("fold"))


def _ridge(s: np.ndarray, alpha: float) -> np.ndarray | None:
    """Intercept and slopes on raw regressors, from cross products of (1, regressors, y): the penalty is on
    standardised ones, as of sums over centred rows."""
    n, k = s[0, 0], len(s) - 2
    mean = s[0] / n
    c = s / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c), 0.0))
    sd = np.where(sd[1:-1] <= 1e-12 * np.maximum(1.0, np.abs(mean[1:-1])), 1.0, sd[1:-1])
    left = n * c[1:-1, 1:-1] / np.outer(sd, sd) + alpha * np.eye(k)
    slopes = np.linalg.lstsq(left, n * c[1:-1, -1] / sd, rcond=None)[0] / sd
    return np.concatenate([[mean[-1] - slopes @ mean[1:-1]], slopes])


def blocked_ridge(rows: DataFrame, by: list[str], day: str, xs: list[str], y: str, tie: str, alphas: list[float], folds: int = 4, least_train: int = 30, least_test: int = 15) -> DataFrame:
    """by, fold, alpha, n_train, n_test, r2, ic: ridge regressions tested on blocks of days. Rows with a null or NaN
    are left out, and so are folds with too few rows. ic: the correlation of ordinal ranks, ties by `tie`.

    Cross products are summed by day once; a fold's training sums are the total less its own days, and all
    penalties are solved from them, so nothing is fitted to rows again."""
    fine = all_of(*(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in [*xs, y]))
    own = rows.where(fine).select(*by, day, F.col(tie).alias("_tie"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*xs, y], 1)))
    own = own.withColumn("_0", F.lit(1.0)).join(table(day_folds(own, by, day, folds)), [*by, day])
    k = len(xs) + 2
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    daily = own.groupBy(*by, "fold", day).agg(*(F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"s{i}_{j}") for i, j in pairs))
    names = [f"s{i}_{j}" for i, j in pairs]
    block = table(daily.groupBy(*by, "fold").agg(*(F.sum(c).alias(c) for c in names)))
    total = block.groupBy(*by).agg(*(F.sum(c).alias(f"all_{c}") for c in names))
    both = block.where("fold IS NOT NULL").join(total, by)

    def solve(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                test, whole = np.zeros((k, k)), np.zeros((k, k))
                for i, j in pairs:
                    test[i, j] = test[j, i] = r[f"s{i}_{j}"]
                    whole[i, j] = whole[j, i] = r[f"all_s{i}_{j}"]
                train = whole - test
                if train[0, 0] < least_train or test[0, 0] < least_test:
                    continue
                for a in alphas:
                    b = _ridge(train, a)
                    e = np.append(b, -1.0)
                    spread = test[-1, -1] - test[0, -1] ** 2 / test[0, 0]
                    out.append((*(r[c] for c in by), int(r["fold"]), a, int(train[0, 0]), int(test[0, 0]), 1 - e @ test @ e / spread if spread > 0 else None, b.tolist()))
            yield pd.DataFrame(out, columns=[*by, "fold", "alpha", "n_train", "n_test", "r2", "coef"])

    fits = table(both.mapInPandas(solve, f"{_keys(rows, by)}fold long, alpha double, n_train long, n_test long, r2 double, coef array<double>"))
    actual = ranks(own.where("fold IS NOT NULL"), [*by, "fold"], f"_{k - 1}", "_tie", "_ry")
    told = sum(F.element_at("coef", i + 1) * F.col(f"_{i}") for i in range(k - 1))
    told = actual.join(fits.select(*by, "fold", "alpha", "coef"), [*by, "fold"]).select(*by, "fold", "alpha", "_tie", "_ry", told.alias("_p"))
    told = ranks(told, [*by, "fold", "alpha"], "_p", "_tie", "_rp")
    apart = (F.col("_rp") - F.col("_ry")).cast("double")
    n = F.count("*").cast("double")
    ic = told.groupBy(*by, "fold", "alpha").agg(F.when(n >= 8, 1 - 6 * F.sum(apart * apart) / (n * (n * n - 1))).alias("ic"))
    return fits.drop("coef").join(ic, [*by, "fold", "alpha"])


def penalty_path(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, alpha, folds, ic_mean, r2_mean, best: the mean scores of each penalty, and whether its ic is the key's
    highest (the smallest penalty of equal ones)."""
    path = scores.groupBy(*by, "alpha").agg(F.count("*").alias("folds"), F.avg("ic").alias("ic_mean"), F.avg("r2").alias("r2_mean"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce("ic_mean", F.lit(-9.0)).desc(), "alpha"))
    return path.withColumn("best", first == 1)


def logistic_posterior(rows: DataFrame, by: list[str], y: str, xs: list[str], prior_var: float = 25.0, most: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """by, term (intercept, then xs), mean, se, low, high, n, converged, accuracy: the Gaussian posterior of logistic
    coefficients at their mode, under a Normal(0, prior_var) prior of each.

    A step is one job: gradient and Hessian are sums over rows, by key, and the steps of all keys are solved from
    them and written as a small table, so a lost executor repeats one step. It ends when no key that is still
    going moves by `tolerance`, or after `most` steps, which converged then says. Rows with a null or NaN are left out;
    keys with fewer rows than terms + 4, or of one outcome, have no row."""
    if not by:
        return logistic_posterior(rows.withColumn("_all", F.lit(0)), ["_all"], y, xs, prior_var, most, tolerance).drop("_all")
    fine = all_of(*(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in [*xs, y]))
    own = rows.where(fine).select(*by, F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_0"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(xs, 1)))
    k = len(xs) + 1
    enough = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi")).where(f"n >= {k + 4} AND lo < hi")
    state = table(enough.select(*by, "n", F.array(*[F.lit(0.0)] * k).alias("beta"), F.array(*[F.lit(None).cast("double")] * k).alias("se"), F.lit(False).alias("done")))
    own = table(own)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    schema = f"{_keys(rows, by)}n long, beta array<double>, se array<double>, done boolean"
    eta = sum(F.element_at("beta", i + 1) * F.col(f"_{i}") for i in range(k))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))

    def sums(now: DataFrame) -> DataFrame:
        met = own.join(now, by).withColumn("_p", p)
        w = F.col("_p") * (1 - F.col("_p"))
        return met.groupBy(*by, "n", "beta", "done").agg(*(F.sum(F.col(f"_{i}") * (F.col("_y") - F.col("_p"))).alias(f"g{i}") for i in range(k)), *(F.sum(w * F.col(f"_{i}") * F.col(f"_{j}")).alias(f"h{i}_{j}") for i, j in pairs), F.avg(((F.col("_p") >= 0.5) == (F.col("_y") >= 0.5)).cast("double")).alias("accuracy"))

    def parts(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        beta, h = np.array(r["beta"], float), np.eye(k) / prior_var
        for i, j in pairs:
            h[i, j] += r[f"h{i}_{j}"]
            h[j, i] = h[i, j]
        return beta, np.array([r[f"g{i}"] for i in range(k)]) - beta / prior_var, h

    def newton(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                beta, g, h = parts(r)
                move = np.linalg.solve(h, g)
                out.append((*(r[c] for c in by), r["n"], (beta + move).tolist(), None, bool(np.abs(move).max() < tolerance)))
            yield pd.DataFrame(out, columns=[*by, "n", "beta", "se", "done"])

    for _ in range(most):
        going = state.where("NOT done")
        if going.isEmpty():
            break
        state = table(sums(going.drop("se")).mapInPandas(newton, schema).unionByName(state.where("done")))

    def close(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                beta, _, h = parts(r)
                se = np.sqrt(np.maximum(np.diag(np.linalg.inv(h)), 0.0))
                out += [(*(r[c] for c in by), name, b, s, b - 1.96 * s, b + 1.96 * s, r["n"], bool(r["done"]), r["accuracy"]) for name, b, s in zip(["intercept", *xs], beta, se)]
            yield pd.DataFrame(out, columns=[*by, "term", "mean", "se", "low", "high", "n", "converged", "accuracy"])

    return sums(state.drop("se")).mapInPandas(close, f"{_keys(rows, by)}term string, mean double, se double, low double, high double, n long, converged boolean, accuracy double")
