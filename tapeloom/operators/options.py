"""Option exposures: Black-Scholes greeks, dealer positions, gamma and vanna exposure."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.stats import div

#: Abramowitz and Stegun 7.1.26, error under 1.5e-7. Fixed values.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + _ERF_P * z)
    poly = F.lit(0.0)
    for c in reversed(_ERF):
        poly = (poly + c) * t
    half = (1 - poly * F.exp(-z * z)) / 2
    return 0.5 + F.signum(x) * half


def d1(s: Column, k: Column, t: Column, r: float, v: Column) -> Column:
    return F.when((t > 1e-8) & (v > 1e-8) & (s > 0) & (k > 0), (F.ln(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t)))


def gamma(s: Column, k: Column, t: Column, r: float, v: Column) -> Column:
    return norm_pdf(d1(s, k, t, r, v)) / (s * v * F.sqrt(t))


def vanna(s: Column, k: Column, t: Column, r: float, v: Column) -> Column:
    one = d1(s, k, t, r, v)
    return -norm_pdf(one) * (one - v * F.sqrt(t)) / v


def delta(flag: Column, s: Column, k: Column, t: Column, r: float, v: Column) -> Column:
    one = d1(s, k, t, r, v)
    return F.when(flag == "c", norm_cdf(one)).otherwise(norm_cdf(one) - 1)


def delta_shock(flag: Column, s: Column, k: Column, t: Column, r: float, v: Column, ds: float, dv: float) -> Column:
    return delta(flag, s + ds, k, t, r, v + dv) - delta(flag, s, k, t, r, v)


def dealer_position(trades: DataFrame) -> DataFrame:
    """instrument_id, ddoi: what dealers hold if customers are the aggressors; other sides count 0."""
    sign = F.when(F.col("aggressor_side") == 1, -1.0).when(F.col("aggressor_side") == 2, 1.0).otherwise(0.0)
    return trades.groupBy("instrument_id").agg(F.sum(sign * F.abs("qty")).alias("ddoi"))


def volatility(iv: Column) -> Column:
    """Values over 1.5 are percent."""
    return F.when(iv > 1.5, iv / 100).otherwise(iv)


def exposures(chain: DataFrame, spot: float, r: float = 0.0, d_sigma: float = 0.01, multiplier: float = 1.0) -> DataFrame:
    """chain (with ddoi) with gex, vex: exposure to a unit move of the spot and to d_sigma."""
    s, k, t, v = F.lit(float(spot)), F.col("strike"), F.col("ttm_years"), volatility(F.col("iv"))
    g = F.col("ddoi") * gamma(s, k, t, r, v) * spot * multiplier
    x = F.col("ddoi") * vanna(s, k, t, r, v) * d_sigma * spot * multiplier
    return chain.withColumns({"gex": g, "vex": x})


def book_map(chain: DataFrame, spot: float, spot_bps: list[float], shocks: list[float], r: float = 0.0) -> DataFrame:
    """spot_bps, shock, gex_plus, scarce: gamma plus vanna exposure over a grid; the grid is a literal
    array in each row, so no join is needed."""
    grid = [(b, d) for b in spot_bps for d in shocks]
    cell = F.explode(F.array(*(F.struct(F.lit(b).alias("spot_bps"), F.lit(d).alias("shock")) for b, d in grid)))
    rows = chain.select("*", cell.alias("g")).select("strike", "ttm_years", "iv", "ddoi", "g.*")
    s, k, t = spot * (1 + F.col("spot_bps") / 1e4), F.col("strike"), F.col("ttm_years")
    v = F.greatest(volatility(F.col("iv")) + F.col("shock"), F.lit(1e-6))
    plus = F.col("ddoi") * (gamma(s, k, t, r, v) * s + vanna(s, k, t, r, v) * F.col("shock") * s)
    return rows.groupBy("spot_bps", "shock").agg(F.sum(plus).alias("gex_plus")).withColumn("scarce", F.col("gex_plus") < 0)


def squeeze_intensity(gex: Column, vex: Column, gex_scale: float = 1.0, vex_scale: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), -gex / gex_scale) + F.greatest(F.lit(0.0), -vex / vex_scale)


def dealer_sign(value: Column) -> Column:
    return F.when(value > 0, "long").when(value < 0, "short").otherwise("flat")


def mid_range(mid: Column) -> Column:
    return div(F.max(mid) - F.min(mid), F.avg(mid))
