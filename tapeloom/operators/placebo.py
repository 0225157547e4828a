"""What events would show by chance: shifted days, random windows of the tape, intervals put elsewhere.

Draws come from hashes of keys, so a task that is run again draws the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import draw
from tapeloom.operators.temporal import DAY_US, asof, range_join
from tapeloom.operators.vol import BPS, interval_matches
from tapeloom.sources.shared import table


def shifted(rows: DataFrame, side: str, draws: int, seed: int, span: int = DAY_US) -> DataFrame:
    """rows (start_ts, end_ts) once for each draw, moved round their day: all intervals of a side and a day by one
    random shift, those that leave the day's end come in at its start; lengths stay."""
    day = F.floor(F.col("start_ts") / span)
    out = rows.withColumn("_day", day).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    by_ = 1 + F.floor(draw(F.lit(seed), F.lit(side), F.col("_day"), F.col("draw")) * (span - 2))
    start = F.col("_day") * span + (F.col("start_ts") - F.col("_day") * span + by_) % span
    length = F.greatest(F.col("end_ts") - F.col("start_ts"), F.lit(0))
    return out.withColumns({"start_ts": start, "end_ts": start + length}).drop("_day")


def placebo_concordance(a: DataFrame, b: DataFrame, by: list[str], slack: int, draws: int = 40, seed: int = 17) -> DataFrame:
    """by, observed, placebo_mean, placebo_p95, p: one-to-one matches of two sides' intervals, beside those after both
    sides have been shifted round their days; p is the share of draws with as many matches or more.

    All draws are matched in one pass, each a key of its own, so a key of many events is as many tasks as there
    are draws. Keys without intervals of both sides have no matches."""
    rows = [x.where("end_ts >= start_ts").select(*by, "start_ts", "end_ts") for x in (a, b)]
    observed = interval_matches(*rows, by, slack).select(*by, F.col("n").alias("observed"))
    moved = [shifted(x, side, draws, seed) for x, side in zip(rows, "ab")]
    drawn = interval_matches(*moved, [*by, "draw"], slack).select(*by, "draw", "n").join(observed, by)
    return drawn.groupBy(*by, "observed").agg(F.avg("n").alias("placebo_mean"), F.expr("percentile(n, 0.95)").alias("placebo_p95"), F.avg((F.col("n") >= F.col("observed")).cast("double")).alias("p"))


def sampled(rows: DataFrame, by: list[str], k: int, seed: int, id_: str = "seq") -> DataFrame:
    """k rows of each key: those whose hashes are lowest. Each task passes on its own k lowest of a key at most, so what
    meets in one place is k rows a task, however many the key has."""
    order = F.row_number().over(Window.partitionBy(*by).orderBy("_u", id_))
    return rows.withColumn("_u", draw(F.lit(seed), F.col(id_))).withColumn("_k", order).where(F.col("_k") <= k).drop("_u", "_k")


def placebo_windows(tape: DataFrame, by: list[str], k: int, seed: int, span: int, after: int, later: int, least: int = 50) -> DataFrame:
    """by, seq, ts, dp_pct, mo_bps, sub_pct of k random windows of each key with `least` prints or more. dp_pct: the largest
    move from the first price within `span`; mo_bps: the move from the window's last price over the time `after` it; sub_pct: the
    largest move within `later` of it; the last two are null where no print follows the window in that time."""
    t = tape.where("px > 0").select(*by, "ts", "seq", "px")
    enough = t.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*by)
    starts = table(sampled(t.join(enough, by, "left_semi"), by, k, seed))
    refs = t.withColumns({"_px": F.col("px"), "_seq": F.col("seq")})
    w = asof(starts.withColumn("_to", F.col("ts") + span), refs, by, ["_px", "_seq"], at="_to").withColumnsRenamed({"ref_ts": "_end", "_px": "_end_px", "_seq": "_end_seq"}).drop("_to")
    w = asof(w.withColumn("_to", F.col("_end") + after), refs, by, ["_px", "_seq"], at="_to").withColumnsRenamed({"ref_ts": "_after", "_px": "_after_px", "_seq": "_after_seq"}).drop("_to")
    w = table(w)

    def largest(rows: DataFrame, at: str, seq: str, px: str, length: int, name: str) -> DataFrame:
        met = range_join(rows, t, by, F.col(at), F.col(at) + length, max(1, length))
        met = met.where((F.col("r_ts") > F.col(at)) | (F.col("r_seq") >= F.col(seq)))
        return met.groupBy(*by, "seq").agg((100 * F.max(F.abs(F.col("r_px") - F.col(px)) / F.col(px))).alias(name), F.count("*").alias(f"_{name}"))

    moved = largest(w, "ts", "seq", "px", span, "dp_pct")
    follow = largest(w, "_end", "_end_seq", "_end_px", later, "sub_pct")
    later_print = (F.col("_after") > F.col("_end")) | (F.col("_after_seq") > F.col("_end_seq"))
    out = w.join(moved, [*by, "seq"], "left").join(follow, [*by, "seq"], "left")
    return out.select(*by, "seq", "ts", "dp_pct", F.when(later_print, BPS * (F.col("_after_px") - F.col("_end_px")) / F.col("_end_px")).alias("mo_bps"), F.when(F.col("_sub_pct") > 1, F.col("sub_pct")).alias("sub_pct"))


def placebo_p(events: DataFrame, windows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, events, windows, observed, placebo, p: mean values of events and of placebo windows, and the share of windows
    whose value is the events' mean or more."""
    seen = events.groupBy(*by).agg(F.count(value).alias("events"), F.avg(value).alias("observed"))
    met = windows.join(seen, by)
    return met.groupBy(*by, "events", "observed").agg(F.count(value).alias("windows"), F.avg(value).alias("placebo"), F.avg((F.col(value) >= F.col("observed")).cast("double")).alias("p"))


def moved_intervals(intervals: DataFrame, key: str, seed: int, span: int = DAY_US, least: int = 60_000_000) -> DataFrame:
    """intervals of the same lengths (`least` at least) at random places of their days; those of nearly a day are left out."""
    day, length = F.floor(F.col("start_ts") / span), F.greatest(F.lit(least), F.col("end_ts") - F.col("start_ts"))
    start = day * span + F.floor(draw(F.lit(seed), F.col(key), F.col("start_ts")) * (span - length)).cast("long")
    return intervals.where(length < span - least).withColumns({"start_ts": start, "end_ts": start + length})
