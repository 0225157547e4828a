"""Risk policy and paper trading: tiers, gates, cool-downs, sleeves, equity and drawdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.fold import fold
from tapeloom.functions.stats import div, draw


def tier(z: Column, marks: dict[str, float]) -> Column:
    """The name of the highest mark that |z| reaches; 'none' under all."""
    out = F.lit("none")
    for name, mark in sorted(marks.items(), key=lambda x: x[1]):
        out = F.when(F.abs(z) >= mark, name).otherwise(out)
    return out


def risk_multiplier(rows: DataFrame, events: DataFrame, by: list[str], off: int, back: int) -> DataFrame:
    """rows with risk: 0 for `off` after an event, then rising to 1 over `back`."""
    from tapeloom.operators.temporal import asof

    last = asof(rows, events, by, [])
    age = F.col("ts") - F.col("ref_ts")
    return last.withColumn("risk", F.when(age.isNull() | (age >= off + back), 1.0).when(age < off, 0.0).otherwise((age - off) / back)).drop("ref_ts")


def without_overlap(events: DataFrame, by: list[str], hold: int) -> DataFrame:
    """The events left when each taken one bars those that start within `hold` of it."""
    def step(s, ts, seq):
        if ts < s[0]:
            return ()
        s[0] = ts + hold
        return [(ts, seq)]

    return fold(events, by, ["ts", "seq"], ["ts", "seq"], lambda: [-(1 << 62)], step, "ts long, seq long")


def sleeve(rows: DataFrame, by: list[str], enter_z: float, hold: int, cost_bps: float) -> DataFrame:
    """by, entry_ts, exit_ts, direction, entry, exit, pnl_bps: trades against |z| >= enter_z, one at a
    time, out at the first print after `hold`, costs on both legs. rows: ts, seq, px, z."""
    def step(s, ts, px, z):
        out = []
        if s["open"] and ts >= s["t"] + hold:
            gain = 1e4 * s["dir"] * (px - s["px"]) / s["px"] - 2 * cost_bps
            out, s["open"] = [(s["t"], ts, s["dir"], s["px"], px, gain)], False
        if not s["open"] and z is not None and abs(z) >= enter_z and px:
            s.update(open=True, t=ts, px=px, dir=-1 if z > 0 else 1)
        return out

    return fold(rows, by, ["ts", "seq"], ["ts", "px", "z"], lambda: {"open": False}, step, "entry_ts long, exit_ts long, direction int, entry double, exit double, pnl_bps double")


def equity(trades: DataFrame, by: list[str], pnl: str, at: str) -> DataFrame:
    """trades with equity (running sum) and drawdown (under its running maximum, 0 counted)."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    e = trades.withColumn("equity", F.sum(pnl).over(w))
    return e.withColumn("drawdown", F.greatest(F.lit(0.0), F.max("equity").over(w)) - F.col("equity"))


def performance(trades: DataFrame, by: list[str], pnl: str) -> DataFrame:
    """by, n, total, mean, sd, hit, sharpe (a trade)."""
    out = trades.groupBy(*by).agg(F.count("*").alias("n"), F.sum(pnl).alias("total"), F.avg(pnl).alias("mean"), F.stddev_samp(pnl).alias("sd"), F.avg((F.col(pnl) > 0).cast("double")).alias("hit"))
    return out.withColumn("sharpe", div(F.col("mean"), F.col("sd")))


def mutual_information(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n, nats between two columns of classes."""
    joint = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("c"))
    over = lambda *k: F.sum("c").over(Window.partitionBy(*by, *k))
    j = joint.withColumns({"n": over(), "na": over(a), "nb": over(b)})
    p = F.col("c") / F.col("n")
    return j.withColumn("t", p * F.ln(F.col("c") * F.col("n") / (F.col("na") * F.col("nb")))).groupBy(*by).agg(F.max("n").alias("n"), F.sum("t").alias("nats"))


def bootstrap_mean(rows: DataFrame, by: list[str], column: str, draws: int, blocks: int, seed: int) -> DataFrame:
    """by, n, mean, low, high: a Poisson bootstrap of the mean over hashed blocks of rows, summed once; a
    95 % interval."""
    from tapeloom.operators.inference import block_bootstrap, mean_stat

    block = F.floor(draw(F.lit(seed), F.col("ts"), F.col("seq")) * blocks)
    sums = rows.where(F.col(column).isNotNull()).groupBy(*by, block.alias("_b")).agg(F.sum(column).alias("x"), F.count("*").cast("double").alias("n"))
    ends = block_bootstrap(sums, by, "_b", ["n", "x"], mean_stat, draws, seed)
    return sums.groupBy(*by).agg(F.sum("n").cast("long").alias("n")).join(ends, by).select(*by, "n", F.col("point").alias("mean"), "low", "high")


def sign_shuffle(trades: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """by, observed, p: the share of random sign flips whose |sum of signed size| reaches the tape's. The
    flips of a trade are the bits of one hash of its seq, at most 128; every draw is a sum of one aggregate."""
    if draws > 128:
        raise ValueError("a hash has 128 bits")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("seq")))
    words = trades.withColumns({f"_h{i}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)})
    flip = lambda k: 1 - 2 * F.shiftright(F.col(f"_h{k // 32}"), k % 32).bitwiseAND(F.lit(1))
    sums = words.groupBy(*by).agg(F.abs(F.sum(F.col("side") * F.col("qty"))).alias("observed"), *(F.abs(F.sum(flip(k) * F.col("qty"))).alias(f"_s{k}") for k in range(draws)))
    reached = sum((F.col(f"_s{k}") >= F.col("observed")).cast("int") for k in range(draws))
    return sums.select(*by, "observed", (reached / draws).alias("p"))
