"""Trade flow: markouts, clocks, order-flow imbalance, toxicity, impact and spread components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.fold import fold
from tapeloom.functions.stats import corr_or_null, div, log_change
from tapeloom.operators.temporal import asof, before, forward, grid
from tapeloom.sources.shared import table

BPS = 1e4


def with_returns(rows: DataFrame, by: list[str], level: str, name: str = "r") -> DataFrame:
    return rows.withColumn(name, log_change(level, by))


def markouts(trades: DataFrame, quotes: DataFrame, by: list[str], horizons: list[int]) -> DataFrame:
    """trades by horizon with markout: the mid's move after it, in bps, signed by side. The mid must
    have been updated since the trade's own."""
    now = asof(trades, quotes, by, ["mid"]).withColumnsRenamed({"ref_ts": "t0", "mid": "mid0"}).where("t0 IS NOT NULL")
    asked = now.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("then", F.col("ts") + F.col("horizon"))
    later = asof(asked, quotes, by, ["mid"], at="then").where(F.col("ref_ts") > F.col("t0"))
    return later.withColumn("markout", F.col("side") * BPS * div(F.col("mid") - F.col("mid0"), F.col("mid0")))


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact interpolated quantiles of a column over all rows. Distinct values are counted and sorted in
    range partitions; the partitions' sizes tell where each rank lies, and only the values at the ranks
    asked for come to the driver."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    part = table(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    starts, total = [], 0
    for r in sorted(part.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        starts.append((r["part"], total))
        total += r["n"]
    if not total:
        return [None] * len(shares)
    place = rows.sparkSession.createDataFrame(starts, "part int, start long")
    w = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ends = part.withColumn("end", F.sum("n").over(w)).join(place, "part").select("v", (F.col("start") + F.col("end") - F.col("n")).alias("low"), (F.col("start") + F.col("end")).alias("high"))
    at = [s * (total - 1) for s in shares]
    ranks = sorted({k for x in at for k in (math.floor(x), math.ceil(x))})
    hit = [(F.col("low") <= k) & (F.col("high") > k) for k in ranks]
    found = ends.select("v", *(h.alias(f"h{i}") for i, h in enumerate(hit))).where(" OR ".join(f"h{i}" for i in range(len(ranks)))).collect()
    value = {k: next(r["v"] for r in found if r[f"h{i}"]) for i, k in enumerate(ranks)}
    return [value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x)) for x in at]


def adverse_selection(marked: DataFrame, least: int = 8) -> DataFrame:
    """side, size_bin, n, mean_bps by side and by quartile of notional."""
    rows = marked.withColumn("notional", F.col("qty") * F.col("px"))
    e = quantiles(rows, "notional", [0.25, 0.5, 0.75])
    bin_ = F.when(F.col("notional") < F.lit(e[0]), 0).when(F.col("notional") < F.lit(e[1]), 1).when(F.col("notional") < F.lit(e[2]), 2).otherwise(3)
    sets = [[F.col("side")], [F.col("size_bin")]]
    return rows.withColumn("size_bin", bin_).groupingSets(sets, "side", "size_bin").agg(F.count("*").alias("n"), F.avg("markout").alias("mean_bps")).where(F.col("n") >= least)


def global_terciles(rows: DataFrame, column: str, tie: str, k: int = 3) -> DataFrame:
    """rows with x_tercile = floor(rank * k / n) over all rows: ranks are row numbers inside sorted
    partitions plus the sizes of the partitions before, so no task sees all rows."""
    part = table(rows.repartitionByRange(column, tie).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column, tie)) - 1
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    sizes = table(sizes.select("_part", start.alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all")))
    ranked = part.withColumn("_at", inside).join(sizes, "_part")
    return ranked.withColumn("x_tercile", F.floor((F.col("_at") + F.col("_start")) * k / F.col("_all")).cast("int")).drop("_part", "_at", "_start", "_all")


def fei(shares: DataFrame, by: list[str], value: str, pools: int | None = None) -> DataFrame:
    """by, fei: entropy of the positive shares over the log of their number (or of `pools`)."""
    v = F.col(value)
    rows = shares.where(v > 0).withColumn("_q", v / F.sum(v).over(Window.partitionBy(*by)))
    n = F.count("*") if pools is None else F.lit(pools)
    return rows.groupBy(*by).agg(F.when(n > 1, -F.sum(F.col("_q") * F.ln("_q")) / F.nullif(F.ln(n), F.lit(0.0))).otherwise(0.0).alias("fei"))


def participation(trades: DataFrame, by: list[str], rate: float, side: int, most: float | None = None) -> DataFrame:
    """by, filled, vwap, arrival, impact_bps of a child order that takes `rate` of each trade."""
    child = F.col("qty") * rate if most is None else F.least(F.col("qty") * rate, F.lit(most))
    out = trades.withColumn("child", child).groupBy(*by).agg(F.sum("child").alias("filled"), div(F.sum(F.col("child") * F.col("px")), F.sum("child")).alias("vwap"), F.min_by("px", F.struct("ts", "seq")).alias("arrival"))
    return out.withColumn("impact_bps", side * BPS * div(F.col("vwap") - F.col("arrival"), F.col("arrival")))


def calendar_returns(trades: DataFrame, by: list[str], step: int, epoch: bool = False) -> DataFrame:
    """by, ts, px, r: the last price on a grid and its log returns."""
    on = asof(grid(trades, by, step, epoch=epoch).withColumn("seq", F.lit(0).cast("long")), trades, by, ["px"])
    return with_returns(on.select(*by, "ts", "seq", "px"), by, "px")


def corr_by_step(trades: DataFrame, by: list[str], leg: str, steps: list[int], least: int = 5) -> DataFrame:
    """by, a, b, step, n, corr of the legs' log returns on a common grid (Epps' curve)."""
    out = None
    for step in steps:
        span = trades.groupBy(*by, leg).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        # one grid for all legs: the multiples of the step
        times = span.select(*by, leg, F.explode(F.sequence(F.ceil(F.col("lo") / step) * step, F.floor(F.col("hi") / step) * step, F.lit(step).cast("long"))).alias("ts"), F.lit(0).cast("long").alias("seq"))
        r = with_returns(asof(times, trades, [*by, leg], ["px"]).select(*by, leg, "ts", "seq", "px"), [*by, leg], "px")
        a, b = r.select(*by, F.col(leg).alias("a"), "ts", F.col("r").alias("ra")), r.select(*by, F.col(leg).alias("b"), "ts", F.col("r").alias("rb"))
        both = a.join(b, [*by, "ts"]).where("a < b AND ra IS NOT NULL AND rb IS NOT NULL")
        one = both.groupBy(*by, "a", "b").agg(F.count("*").alias("n"), corr_or_null(F.col("ra"), F.col("rb"), least).alias("corr")).withColumn("step", F.lit(step))
        out = one if out is None else out.unionByName(one)
    return out


def volume_multiples(trades: DataFrame, by: list[str], volume: float) -> DataFrame:
    """by, bar, ts, px: the first trade at which the running volume reaches each multiple of `volume`;
    what is over counts for the next."""
    total = F.sum("qty").over(Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = trades.withColumn("_to", F.floor(total / volume)).withColumn("_from", F.floor((total - F.col("qty")) / volume))
    return rows.where("_to > _from").select(*by, "ts", "seq", "px", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("bar"))


def volume_buckets(trades: DataFrame, by: list[str], volume: float | str) -> DataFrame:
    """by, bucket, end_ts, volume, imbalance, px: a bucket closes when the volume since the last close
    reaches `volume` (or the column of that name); the counter starts anew, and the trailing part is
    dropped."""
    size = F.col(volume) if isinstance(volume, str) else F.lit(float(volume))

    def step(s, ts, px, qty, side, full):
        s["n" if side < 0 else "p"] += qty
        if s["n"] + s["p"] >= full:
            total, s["k"] = s["n"] + s["p"], s["k"] + 1
            out = [(s["k"], ts, total, abs(s["p"] - s["n"]) / total, s["p"] - s["n"], px)]
            s["n"] = s["p"] = 0.0
            return out

    return fold(trades.withColumn("_full", size), by, ["ts", "seq"], ["ts", "px", "qty", "side", "_full"], lambda: {"n": 0.0, "p": 0.0, "k": 0}, step, "bucket long, end_ts long, volume double, imbalance double, net double, px double")


def rolling_vpin(buckets: DataFrame, by: list[str], window: int) -> DataFrame:
    """buckets with vpin: the mean imbalance over the last `window` buckets, null until there are as many."""
    w = Window.partitionBy(*by).orderBy("bucket")
    return buckets.withColumn("vpin", F.when(F.row_number().over(w) >= window, F.avg("imbalance").over(w.rowsBetween(-(window - 1), 0))))


def order_flow(tob: DataFrame, by: list[str]) -> DataFrame:
    """tob with ofi: each quote's order-flow imbalance at the touch; null for the first."""
    b, a, bs, az = (before(c, by) for c in ("bid", "ask", "bid_sz", "ask_sz"))
    bid = F.when(F.col("bid") >= b, F.col("bid_sz")).otherwise(0.0) - F.when(F.col("bid") <= b, bs).otherwise(0.0)
    ask = F.when(F.col("ask") <= a, F.col("ask_sz")).otherwise(0.0) - F.when(F.col("ask") >= a, az).otherwise(0.0)
    return tob.withColumn("ofi", F.when(b.isNotNull(), bid - ask))


def intensity(trades: DataFrame, by: list[str], step: int) -> DataFrame:
    """by, bars, rate (a second), acf1 of counts over the whole bars from the first trade on."""
    ends = trades.groupBy(*by).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    bars = ends.select(*by, "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / step) - 1)).alias("bar"))
    counted = trades.join(ends, by).groupBy(*by, F.floor((F.col("ts") - F.col("lo")) / step).alias("bar")).agg(F.count("*").alias("n"))
    full = bars.where("bar >= 0").join(counted, [*by, "bar"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = full.withColumn("last", F.lag("n").over(Window.partitionBy(*by).orderBy("bar")))
    return full.groupBy(*by).agg(F.count("*").alias("bars"), (F.avg("n") / (step / 1e6)).alias("rate"), corr_or_null(F.when(F.col("last").isNotNull(), F.col("n")).cast("double"), F.col("last").cast("double")).alias("acf1"))


def sign_acf(trades: DataFrame, by: list[str], most_lag: int) -> DataFrame:
    """by, lag, acf of the demeaned trade signs."""
    q = F.col("side") - F.avg("side").over(Window.partitionBy(*by))
    rows = trades.withColumn("q", q)
    lags = rows.withColumns({f"l{k}": F.col("q") * F.lag("q", k).over(Window.partitionBy(*by).orderBy("ts", "seq")) for k in range(1, most_lag + 1)})
    sums = lags.groupBy(*by).agg(F.sum(F.col("q") * F.col("q")).alias("s"), *(F.sum(f"l{k}").alias(f"l{k}") for k in range(1, most_lag + 1)))
    return sums.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), div(F.col(f"l{k}"), F.col("s")).alias("acf")) for k in range(1, most_lag + 1)))).alias("x")).select(*by, "x.lag", "x.acf")


def trades_with_moves(trades: DataFrame, quotes: DataFrame, by: list[str]) -> DataFrame:
    """trades with d_mid: from the mid before the trade to the mid before the next one."""
    now = asof(trades, quotes, by, ["mid"])
    return now.withColumn("d_mid", F.lead("mid").over(Window.partitionBy(*by).orderBy("ts", "seq")) - F.col("mid"))


def next_mid_change(trades: DataFrame, quotes: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """trades with d_mid: to the first later quote of another mid, if it comes within the tolerance."""
    changes = quotes.withColumn("_was", before("mid", by)).where("mid <> _was").select(*by, "ts", "seq", F.col("mid").alias("next_mid"))
    now = asof(trades, quotes, by, ["mid"]).drop("ref_ts")
    return forward(now, changes, by, ["next_mid"], tolerance=tolerance).withColumn("d_mid", F.col("next_mid") - F.col("mid"))


def huang_stoll(rows: DataFrame, by: list[str], half: Column) -> DataFrame:
    """by, n, reversal, lambda, alpha: price changes on q_t and q_{t-1} give the half spread's share
    that is not order processing; reversal is P(the sign changes)."""
    from tapeloom.functions.stats import ols2

    w = Window.partitionBy(*by).orderBy("ts", "seq")
    own = rows.withColumns({"dp": F.col("px") - F.lag("px").over(w), "q1": F.lag("side").over(w)}).where("dp IS NOT NULL")
    fit = ols2(own, by, "dp", "side", "q1")
    turn = own.groupBy(*by).agg(F.avg((F.col("side") != F.col("q1")).cast("double")).alias("reversal"), F.avg(half).alias("half"))
    return fit.join(turn, by).select(*by, "n", "reversal", (1 + div(F.col("beta_b"), F.col("beta_a"))).alias("lambda"), div(F.col("beta_a"), F.col("half")).alias("traded_share"))


def spread_components(rows: DataFrame, by: list[str], half: float, least: int = 60) -> DataFrame:
    """by, n, reversal, lambda_ab, adverse, inventory, restricted_adverse, restricted_inventory: the parts
    of a half spread that are adverse selection and inventory cost. lambda_ab: from price changes on the
    change of sign and the last one; adverse, inventory: from price changes over the half spread on three
    signs; restricted: the first part from mid changes given lambda_ab, held between 0 and it. rows: ts,
    seq, px, mid, side; trades without a side, or without two before it, are left out. Sums of products in
    Spark, solved by Cramer's rule in columns."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    lag = lambda c, k: F.lag(c, k).over(w)
    own = rows.withColumns({"_y": F.col("px") - lag("px", 1), "_m": F.col("mid") - lag("mid", 1), "_0": F.col("side"), "_1": lag("side", 1), "_2": lag("side", 2)})
    own = own.where("_y IS NOT NULL AND _m IS NOT NULL AND _0 <> 0 AND _1 <> 0 AND _2 <> 0")
    names = ["0", "1", "2"]
    product = {f"s{a}{b}": F.sum(F.col(f"_{a}") * F.col(f"_{b}")) for i, a in enumerate(names) for b in names[i:]}
    product |= {f"{v}{a}": F.sum(F.col(f"_{v}") * F.col(f"_{a}")) for v in "ym" for a in names}
    s = own.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("_0") != F.col("_1")).cast("double")).alias("reversal"), *(v.alias(k) for k, v in product.items())).where(F.col("n") >= least)
    c = F.col
    det2 = c("s00") * c("s11") - c("s01") * c("s01")
    both = div(c("y0") * c("s11") - c("y1") * c("s01") + c("y1") * c("s00") - c("y0") * c("s01"), det2)
    three = lambda a, b, d: a[0] * (b[1] * d[2] - b[2] * d[1]) - a[1] * (b[0] * d[2] - b[2] * d[0]) + a[2] * (b[0] * d[1] - b[1] * d[0])
    one, two, last, y = [c("s00"), c("s01"), c("s02")], [c("s01"), c("s11"), c("s12")], [c("s02"), c("s12"), c("s22")], [c("y0"), c("y1"), c("y2")]
    det3 = three(one, two, last)
    second, third = div(three(one, y, last), det3) / half, div(three(one, two, y), det3) / half
    turn = F.nullif(1 - 2 * c("reversal"), F.lit(0.0))
    out = s.withColumns({"lambda_ab": both / half, "adverse": -third / turn}).withColumn("inventory", second + 1 - c("adverse"))
    raw = -(c("m2") / half - c("lambda_ab") * c("s12")) / (turn * c("s22"))
    held = F.when(c("lambda_ab") <= 0, raw).otherwise(F.least(F.greatest(raw, F.lit(0.0)), c("lambda_ab")))
    out = out.withColumn("restricted_adverse", held)
    return out.select(*by, "n", "reversal", "lambda_ab", "adverse", "inventory", "restricted_adverse", (c("lambda_ab") - c("restricted_adverse")).alias("restricted_inventory"))


def ma1(returns: DataFrame, by: list[str], r: str) -> DataFrame:
    """by, theta: the invertible MA(1) root from uncentred autocovariances; null if there is none."""
    rows = returns.where(F.col(r).isNotNull()).withColumn("_l", before(r, by))
    g = rows.groupBy(*by).agg((F.sum(F.col(r) * F.col(r)) / F.count("*")).alias("g0"), div(F.sum(F.col(r) * F.col("_l")), F.count("_l").cast("double")).alias("g1"))
    rho = div(F.col("g1"), F.col("g0"))
    return g.withColumn("rho", rho).withColumn("theta", F.when(F.abs("rho") <= 0.5, F.when(F.col("rho") == 0, 0.0).otherwise((1 - F.sqrt(F.greatest(F.lit(0.0), 1 - 4 * F.col("rho") * F.col("rho")))) / (2 * F.nullif(F.col("rho"), F.lit(0.0))))))


def hac_lags(n: int) -> int:
    return math.floor(4 * (n / 100) ** (2 / 9))


def pin_proxy(days: DataFrame, by: list[str]) -> DataFrame:
    """by, pin: the mean of |buys - sells| over all trades of a day."""
    return days.groupBy(*by).agg(F.avg(F.abs(F.col("buys") - F.col("sells")) / F.greatest(F.col("buys") + F.col("sells"), F.lit(1))).alias("pin"))


def daily_counts(trades: DataFrame, by: list[str], day: int = 86_400_000_000) -> DataFrame:
    """by, day, buys, sells, n, imbalance, span_h."""
    d = F.floor(F.col("ts") / day).alias("day")
    out = trades.groupBy(*by, d).agg(F.count(F.when(F.col("side") > 0, 1)).alias("buys"), F.count(F.when(F.col("side") < 0, 1)).alias("sells"), F.count("*").alias("n"), ((F.max("ts") - F.min("ts")) / 3.6e9).alias("span_h"))
    return out.withColumn("imbalance", (F.col("buys") - F.col("sells")) / F.col("n"))


def time_split(rows: DataFrame, by: list[str], share: float) -> DataFrame:
    """rows with train: ts at or under the key's quantile of ts."""
    cut = rows.groupBy(*by).agg(F.floor(F.percentile("ts", F.lit(share))).alias("_cut"))
    return rows.join(cut, by).withColumn("train", F.col("ts") <= F.col("_cut")).drop("_cut")


def trade_var(rows: DataFrame, by: list[str], lags: int, horizon: int = 20) -> DataFrame:
    """by, n, lambda (the trade's own effect), r2, impulse (array): a vector autoregression of mid moves
    and trade signs, the sign also contemporaneous, and the cumulative response of the mid to a trade.
    Cross products are sums in Spark; each key's system is solved in one row. rows: ts, seq, d_mid, side."""
    import numpy as np
    import pandas as pd

    w = Window.partitionBy(*by).orderBy("ts", "seq")
    names = ["m0", "q0", *(f"{v}{k}" for k in range(1, lags + 1) for v in "mq")]
    cols = {f"{v}{k}": F.lag(c, k).over(w) if k else F.col(c) for k in range(lags + 1) for v, c in (("m", "d_mid"), ("q", "side"))}
    own = rows.withColumns(cols).dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = own.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs))

    def solve(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                s = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    s[i, j] = s[j, i] = r[f"s{i}_{j}"]
                mid, sign = list(range(1, len(names))), list(range(2, len(names)))
                if r["n"] <= 2 * len(names) or np.linalg.matrix_rank(s[np.ix_(mid, mid)]) < len(mid):
                    continue
                a = np.linalg.solve(s[np.ix_(mid, mid)], s[mid, 0])
                b = np.linalg.solve(s[np.ix_(sign, sign)], s[sign, 1])
                m, q, path = [0.0] * lags, [0.0] * lags, []
                for h in range(horizon):
                    past = [x for k in range(lags) for x in (m[k], q[k])]
                    shock = 1.0 if h == 0 else float(b @ past)
                    move = float(a @ [shock, *past])
                    m, q = [move, *m[:-1]], [shock, *q[:-1]]
                    path.append((path[-1] if path else 0.0) + move)
                out.append((*(r[k] for k in by), int(r["n"]), float(a[0]), float(a @ s[mid, 0] / s[0, 0]), path))
            yield pd.DataFrame(out, columns=[*by, "n", "lambda", "r2", "impulse"])

    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    return sums.mapInPandas(solve, f"{keys}, n long, lambda double, r2 double, impulse array<double>")
