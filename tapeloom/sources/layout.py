"""Files in and out: day-partitioned tapes, JSON lines, thinning, quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import finite

TAPE = "venue int, symbol int, ts long, seq long, px double, qty double, side double"
TOB = "venue int, symbol int, ts long, seq long, bid double, ask double, mid double, bid_sz double, ask_sz double"
DAY_US = 86_400_000_000


def write_days(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet (zstd) by day and venue, sorted by symbol and time, so that filters prune folders and row
    groups."""
    day = F.date_from_unix_date(F.floor(F.col("ts") / DAY_US).cast("int"))
    out = rows.withColumn("day", day).repartition("day", "venue", "symbol").sortWithinPartitions("symbol", "ts", "seq")
    out.write.mode(mode).option("compression", "zstd").partitionBy("day", "venue").parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, venues: list[int] | None = None) -> DataFrame:
    """The days from first to last (both included) of some venues; only their folders are read."""
    rows = spark.read.parquet(path)
    for use, condition in ((first, lambda: F.col("day") >= F.lit(first).cast("date")), (last, lambda: F.col("day") <= F.lit(last).cast("date")), (venues, lambda: F.col("venue").isin(venues))):
        if use is not None:
            rows = rows.where(condition())
    return rows


def day_bounds(day: str) -> tuple[int, int]:
    """[start, end) of a UTC day in microseconds."""
    from datetime import datetime, timezone

    start = int(datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
    return start, start + DAY_US


def clip_to_day(rows: DataFrame, day: str) -> DataFrame:
    """The day's rows, with clipped; all rows, not clipped, if the day has none."""
    lo, hi = day_bounds(day)
    inside = (F.col("ts") >= lo) & (F.col("ts") < hi)
    any_ = F.max(F.when(inside, 1)).over(Window.partitionBy("venue", "symbol"))
    return rows.withColumn("clipped", any_.isNotNull()).where(inside | ~F.col("clipped"))


def normalized_side(rows: DataFrame, by: list[str]) -> DataFrame:
    """side as +1 and -1 where a key's codes are all 0 or 1 (null counts as 0); others stay."""
    codes = F.collect_set("side").over(Window.partitionBy(*by))
    binary = F.forall(codes, lambda x: x.isin(0.0, 1.0))
    return rows.withColumn("side", F.when(binary, F.when(F.col("side") > 0, 1.0).otherwise(-1.0)).otherwise(F.col("side")))


def cleaned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities as null."""
    return rows.withColumns({c: finite(F.col(c)) for c in columns})


def sane_quotes(tob: DataFrame, most_bps: float = 100.0) -> DataFrame:
    """Quotes that are not crossed nor wider than most_bps."""
    return tob.where((F.col("bid") > 0) & (F.col("ask") > F.col("bid")) & (1e4 * (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) <= most_bps))


def thinned(rows: DataFrame, by: list[str], per: int, most: int) -> DataFrame:
    """At most `most` rows of each `per` of time and key, evenly spaced in order."""
    w = Window.partitionBy(*by, "_slot")
    own = rows.withColumn("_slot", F.floor(F.col("ts") / per))
    own = own.withColumns({"_k": F.row_number().over(w.orderBy("ts", "seq")) - 1, "_n": F.count("*").over(w)})
    keep = (F.col("_n") <= most) | (F.floor((F.col("_k") + 1) * most / F.col("_n")) > F.floor(F.col("_k") * most / F.col("_n")))
    return own.where(keep).drop("_slot", "_k", "_n")


def trades_from_json(lines: DataFrame) -> DataFrame:
    """tape columns from feed messages, one JSON object a line (column value): {"channel": "trades",
    "data": a print or a list of them}. A print has px or price, sz or qty, time (ms), tid, and side: B,
    BUY or 1 in any case is a buyer, all else a seller. Other channels, lines that are no JSON and prints
    with a malformed or non-positive price, size or time are left out; a missing tid is 0."""
    one = "struct<px: string, price: string, sz: string, qty: string, time: string, tid: string, side: string>"
    m = lines.select(F.from_json("value", "channel string, data string").alias("m")).where("m.channel = 'trades'")
    listed = F.when(F.ltrim("m.data").startswith("["), F.col("m.data")).otherwise(F.concat(F.lit("["), F.col("m.data"), F.lit("]")))
    d = m.select(F.explode(F.from_json(listed, f"array<{one}>")).alias("d")).select("d.*")

    def number(kind: str, *names: str):
        """The first that is there, not empty and not zero, as the feed's readers take it."""
        texts = [F.nullif(F.trim(n), F.lit("")) for n in names]
        return F.coalesce(*texts, F.lit("0")).try_cast(kind)

    px, qty, ms, tid = number("double", "px", "price"), number("double", "sz", "qty"), number("long", "time"), number("long", "tid")
    buys = F.coalesce(F.upper("side").isin("B", "BUY", "1"), F.lit(False))
    out = d.select((ms * 1000).alias("ts"), tid.alias("seq"), px.alias("px"), qty.alias("qty"), F.when(buys, 1.0).otherwise(-1.0).alias("side"))
    return out.where("px > 0 AND qty > 0 AND ts > 0 AND seq IS NOT NULL")


#: Widest spread of a book, in bps, that is no stub. Fixed value.
STUB_BPS = 200.0


def books_from_json(lines: DataFrame) -> DataFrame:
    """symbol, ts, bid, ask, bid_sz, ask_sz: the best levels of book messages, one JSON object a line (column value):
    {"symbol", "time" (ms), "orderBook": {"bids": [[price, size], ...], "asks": ...}}, levels in any order.

    The best bid is the highest price above zero, the best ask the lowest; of levels at one price the first gives the
    size. Left out are lines that are no such object, books with a side that is empty or has no price above zero or
    a price that is no number, best levels whose size is no number, and books that are crossed or wider than
    STUB_BPS, as of levels far off the market."""
    schema = "symbol string, time string, orderBook struct<bids: array<array<string>>, asks: array<array<string>>>"
    m = lines.select(F.from_json("value", schema).alias("m")).select("m.symbol", F.col("m.time").try_cast("long").alias("_ms"), "m.orderBook.bids", "m.orderBook.asks")

    def level(x: Column) -> Column:
        return F.struct(F.get(x, 0).try_cast("double").alias("px"), F.get(x, 1).try_cast("double").alias("sz"))

    for side in ("bids", "asks"):
        m = m.withColumn(side, F.transform(side, level))
        sound = F.coalesce(F.forall(side, lambda x: x["px"].isNotNull()), F.lit(False))
        m = m.withColumn(side, F.when(sound, F.filter(side, lambda x: (x["px"] > 0) & ~F.isnan(x["px"]))))
    best = m.withColumns({"bid": F.array_max(F.transform("bids", lambda x: x["px"])), "ask": F.array_min(F.transform("asks", lambda x: x["px"]))})
    size = lambda side, px: F.get(F.filter(side, lambda x: x["px"] == F.col(px)), 0)["sz"]
    out = best.select("symbol", (F.col("_ms") * 1000).alias("ts"), "bid", "ask", size("bids", "bid").alias("bid_sz"), size("asks", "ask").alias("ask_sz"))
    wide = 1e4 * (F.col("ask") - F.col("bid")) / (0.5 * (F.col("ask") + F.col("bid")))
    return out.where((F.col("ask") > F.col("bid")) & (wide <= STUB_BPS)).dropna(subset=["symbol", "ts", "bid_sz", "ask_sz"])


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
