"""Small statistics as column expressions and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    """Six decimals, halves up."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def log_change(x: str, by: list[str], order: tuple = ("ts", "seq")) -> Column:
    """ln of x over the row before; null unless both are above zero."""
    last = F.lag(x).over(Window.partitionBy(*by).orderBy(*order))
    return F.when((F.col(x) > 0) & (last > 0), F.ln(F.col(x) / last))


def corr_or_null(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson's r over complete pairs; null under `least` pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # not F.corr, which fails on a series without variance, whatever guards it
    return F.when(F.count(x) >= least, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def ordinal_rank(column: str, *ties: str, by: list[str] = ()) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(column, *ties))


def ols2(rows: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """by, n, beta_a, beta_b, r2: least squares without a constant on two regressors, from sums."""
    rows = rows.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    s = {f"{p}{q}": F.sum(F.col(v) * F.col(w)) for (p, v), (q, w) in [(("a", a), ("a", a)), (("a", a), ("b", b)), (("b", b), ("b", b)), (("a", a), ("y", y)), (("b", b), ("y", y)), (("y", y), ("y", y))]}
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in s.items()))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    one = div(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det)
    two = div(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det)
    return sums.select(*by, "n", one.alias("beta_a"), two.alias("beta_b"), (div(one * F.col("ay") + two * F.col("by"), F.col("yy"))).alias("r2"))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str], ties: str) -> DataFrame:
    """rows with q: the adjusted p-value of each, within `by`."""
    up = Window.partitionBy(*by).orderBy(p, ties)
    n = F.count("*").over(Window.partitionBy(*by))
    raw = rows.withColumn("_rank", F.row_number().over(up)).withColumn("_raw", F.col(p) * n / F.col("_rank"))
    down = Window.partitionBy(*by).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_rank", "_raw")


def draw(*keys) -> Column:
    """A number in [0, 1) from the md5 of the keys: the same in any engine, in any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 13), 16, 10).cast("double") / float(16**13)


#: The Poisson(1) distribution function at 0 to 5.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def poisson_one(u: Column) -> Column:
    """The inverse of the Poisson(1) distribution; 6 and over are 6."""
    return sum(F.when(u >= p, 1).otherwise(0) for p in POISSON)


def logistic_z(r: Column) -> Column:
    """Fisher's z of a correlation."""
    return F.ln((1 + r) / F.nullif(1 - r, F.lit(0.0))) / 2


def from_z(z: Column) -> Column:
    return (F.exp(2 * z) - 1) / (F.exp(2 * z) + 1)
