"""Affine recurrences as associative scans, and how arrivals cluster: decayed excitation, counts' autocorrelation.

A recurrence x = f * x_before + a over a run of rows is one pair (product of f, value from 0), and pairs of
adjacent runs compose. So rows are taken in slices of their order, each slice gives a pair, pairs are carried
from slice to slice (a row a slice), and a hot key is as many tasks as it has slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.fold import fold
from tapeloom.functions.stats import div
from tapeloom.operators.temporal import DAY_US
from tapeloom.sources.shared import table

#: Bins of counts in one row.
SLICE = 64
#: Decays by unit of time that the fit tries. Fixed values.
BETAS = [0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0]


def affine_scan(rows: DataFrame, by: list[str], order: list[str], factor: Column, add: Column, start: float, slice_: int, keep: list[str] = []) -> DataFrame:
    """by, order, keep, before, after: the value of x = factor * x + add before and after each row, from `start`.

    Slices are of slice_ units of the first column of order."""
    cols = [*order, *keep]
    own = rows.select(*by, F.floor(F.col(order[0]) / slice_).alias("_slice"), *cols, factor.cast("double").alias("_f"), add.cast("double").alias("_a"))

    def local(s, *row):
        before, (f, a) = tuple(s), row[-2:]
        s[:] = s[0] * f, s[1] * f + a
        return [(*row[:-2], *before, *s)]

    def carried(s, slice_id, f, a):
        before = s[0]
        s[0] = f * before + a
        return [(slice_id, before)]

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in cols)
    pairs = table(fold(own, [*by, "_slice"], order, [*cols, "_f", "_a"], lambda: [1.0, 0.0], local, f"{kinds}, _fb double, _ab double, _f double, _a double"))
    ends = pairs.groupBy(*by, "_slice").agg(F.max_by(F.struct("_f", "_a"), F.struct(*order)).alias("_end")).select(*by, "_slice", "_end.*")
    into = fold(ends, by, ["_slice"], ["_slice", "_f", "_a"], lambda: [start], carried, "_slice long, _in double")
    x = pairs.join(into, [*by, "_slice"])
    return x.select(*by, *cols, (F.col("_fb") * F.col("_in") + F.col("_ab")).alias("before"), (F.col("_f") * F.col("_in") + F.col("_a")).alias("after"))


def binned(events: DataFrame, by: list[str], bin_: int) -> tuple[DataFrame, DataFrame]:
    """(spans, counts). spans: by, t0, t1, n, bins; counts: by, bin, n of the bins that hold events, from the
    first event of each key on."""
    spans = table(events.groupBy(*by).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("ts").alias("n")).withColumn("bins", F.greatest(F.floor((F.col("t1") - F.col("t0")) / bin_) + 1, F.lit(2))))
    at = F.floor((F.col("ts") - F.col("t0")) / bin_)
    return spans, events.join(spans.select(*by, "t0"), by).groupBy(*by, at.alias("bin")).agg(F.count("*").cast("double").alias("n"))


def hawkes_fit(events: DataFrame, by: list[str], bin_: int, unit: int = 1_000_000, betas: list[float] = BETAS, least: int = 10) -> DataFrame:
    """by, n_events, bins, mean_count, rss, beta, alpha, lambda0, branching, e_lambda: counts by bin, as rates, on what
    earlier counts have left under exponential decay (K <- K e^(-beta dt) + n), by least squares for each of betas
    at once; the fit of least rss among those with alpha and lambda0 of at least 0 and a branching ratio under 1.

    Bins lie in rows of SLICE counts, empty ones too; what enters a row is carried by the scan, and the sums for least
    squares are quadratic in it, so bins are read once. Keys under `least` events are left out; without an
    admissible fit its columns are null."""
    dt = bin_ / unit
    spans, counts = binned(events, by, bin_)
    spans = spans.where(F.col("n") >= least)
    filled = counts.groupBy(*by, F.floor(F.col("bin") / SLICE).alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("bin") % SLICE).cast("int").alias("at"), "n"))).alias("_held"))
    slices = spans.select(*by, "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bins") - 1) / SLICE))).alias("_row")).join(filled, [*by, "_row"], "left")
    size = F.least(F.lit(SLICE), F.col("bins") - F.col("_row") * SLICE).cast("int")
    dense = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.element_at("_held", i), F.lit(0.0)))
    rows = slices.select(*by, "_row", dense.alias("_c")).withColumn("beta", F.explode(F.array(*map(F.lit, betas)))).withColumn("_d", F.exp(-F.col("beta") * dt))

    names = ["_l", "_p", "_sl", "_sll", "_sln", "_sp", "_spp", "_spl", "_spn"]
    zero = F.struct(*(F.lit(1.0 if k == "_p" else 0.0).alias(k) for k in names))

    def step(s, n):
        l, p = s["_l"], s["_p"]
        new = [l * F.col("_d") + n, p * F.col("_d"), s["_sl"] + l, s["_sll"] + l * l, s["_sln"] + l * n, s["_sp"] + p, s["_spp"] + p * p, s["_spl"] + p * l, s["_spn"] + p * n]
        return F.struct(*(x.alias(k) for k, x in zip(names, new)))

    total = lambda square: F.aggregate("_c", F.lit(0.0), lambda s, n: s + (n * n if square else n))
    sums = rows.select(*by, "_row", "beta", F.size("_c").alias("_m"), total(False).alias("_sn"), total(True).alias("_snn"), F.aggregate("_c", zero, step).alias("_s"))
    sums = table(sums.select(*by, "_row", "beta", "_m", "_sn", "_snn", "_s.*"))
    # _l is left at a row's end of its own counts, _p of what has entered it
    scan = affine_scan(sums, [*by, "beta"], ["_row"], F.col("_p"), F.col("_l"), 0.0, 1024, ["_m", "_sn", "_snn", *names[2:]])
    into = F.col("before")
    t = scan.groupBy(*by, "beta").agg(
        F.sum("_m").cast("double").alias("_m"), F.sum("_sn").alias("_n"), F.sum("_snn").alias("_nn"), F.sum(F.col("_sl") + into * F.col("_sp")).alias("_x"),
        F.sum(F.col("_sll") + 2 * into * F.col("_spl") + into * into * F.col("_spp")).alias("_xx"), F.sum(F.col("_sln") + into * F.col("_spn")).alias("_xn"),
    )
    y, yy, xy = F.col("_n") / dt, F.col("_nn") / dt**2, F.col("_xn") / dt
    t = t.withColumn("alpha", div(F.col("_m") * xy - F.col("_x") * y, F.col("_m") * F.col("_xx") - F.col("_x") * F.col("_x")))
    t = t.withColumn("lambda0", (y - F.col("alpha") * F.col("_x")) / F.col("_m"))
    t = t.withColumns({"rss": yy - F.col("lambda0") * y - F.col("alpha") * xy, "branching": F.col("alpha") / F.col("beta")})
    good = (F.col("alpha") >= 0) & (F.col("lambda0") >= 0) & (F.col("branching") < 1)
    fit = ["rss", "beta", "alpha", "lambda0", "branching"]
    best = t.groupBy(*by).agg(F.min(F.when(good, F.struct(*fit))).alias("_x"))
    out = spans.join(best, by).select(*by, F.col("n").alias("n_events"), "bins", (F.col("n") / F.col("bins")).alias("mean_count"), "_x.*")
    return out.withColumn("e_lambda", F.col("lambda0") / (1 - F.col("branching")))


def count_acf(events: DataFrame, by: list[str], bin_: int, most_lag: int) -> DataFrame:
    """by, lag, acf: autocorrelation of counts by bin, empty bins too; null where counts do not vary. Only bins that
    hold events are rows; what empty bins add is known from the sums."""
    spans, counts = binned(events, by, bin_)
    counts = table(counts)
    lags = F.explode(F.sequence(F.lit(0), F.lit(most_lag))).alias("lag")
    later = counts.select(*by, lags, "bin", "n").withColumn("bin", F.col("bin") - F.col("lag"))
    both = later.join(counts.select(*by, "bin", F.col("n").alias("was")), [*by, "bin"]).groupBy(*by, "lag").agg(F.sum(F.col("n") * F.col("was")).alias("xy"))
    # counts under the first and over the last bins that a lag leaves out
    edge = counts.join(spans.select(*by, "bins"), by)
    head = edge.where(F.col("bin") < most_lag).select(*by, F.explode(F.sequence((F.col("bin") + 1).cast("int"), F.lit(most_lag))).alias("lag"), "n").groupBy(*by, "lag").agg(F.sum("n").alias("head"))
    tail = edge.where(F.col("bin") >= F.col("bins") - most_lag).select(*by, F.explode(F.sequence((F.col("bins") - F.col("bin")).cast("int"), F.lit(most_lag))).alias("lag"), "n").groupBy(*by, "lag").agg(F.sum("n").alias("tail"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss")).join(spans.select(*by, "bins"), by)
    out = total.select(*by, "s", "ss", "bins", lags)
    for part in (both, head, tail):
        out = out.join(part, [*by, "lag"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean, left = F.col("s") / F.col("bins"), F.greatest(F.col("bins") - F.col("lag"), F.lit(0))
    moved = zero("xy") - mean * (2 * F.col("s") - zero("head") - zero("tail")) + left * mean * mean
    var = F.col("ss") - F.col("bins") * mean * mean
    return out.select(*by, "lag", F.when(F.col("lag") < F.col("bins"), F.when(var > 1e-12, moved / var)).alias("acf"))


def interarrival_cv(events: DataFrame, by: list[str], slice_: int = DAY_US) -> DataFrame:
    """by, n, cv: standard deviation of the times between events over their mean; null where all are at one time.

    The time before the first event of a slice is read off the slices before, a row a slice."""
    own = events.withColumn("_slice", F.floor(F.col("ts") / slice_))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy(*by, "_slice").orderBy("ts"))
    inside = own.withColumn("_g", gap.cast("double")).groupBy(*by, "_slice").agg(F.count("*").alias("n"), F.sum(F.col("_g") * F.col("_g")).alias("gg"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    across = (F.col("lo") - F.lag("hi").over(Window.partitionBy(*by).orderBy("_slice"))).cast("double")
    t = inside.withColumn("_g", across).groupBy(*by).agg(F.sum("n").alias("n"), (F.coalesce(F.sum("gg"), F.lit(0.0)) + F.coalesce(F.sum(F.col("_g") * F.col("_g")), F.lit(0.0))).alias("gg"), (F.max("hi") - F.min("lo")).alias("span"))
    mean = F.col("span") / F.nullif(F.col("n") - 1, F.lit(0))
    return t.select(*by, "n", div(F.sqrt(F.greatest(F.col("gg") / F.nullif(F.col("n") - 1, F.lit(0)) - mean * mean, F.lit(0.0))), mean).alias("cv"))
