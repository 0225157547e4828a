"""The estimators on streams: de-duplication, event-time windows, and keyed state.

Streams have the tape's columns and event_time (timestamp). State is kept by key and expires by the
watermark; restarts go on from the checkpoint."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_tape(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    from tapeloom.sources.layout import TAPE

    rows = spark.readStream.schema(TAPE).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("event_time", F.timestamp_micros("ts"))


def deduplicated(stream: DataFrame, key: list[str], late: str) -> DataFrame:
    """Each key once, whatever is delivered again within the delay."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(key)


def flow_windows(stream: DataFrame, by: list[str], length: str, slide: str | None = None) -> DataFrame:
    """by, start, n, volume, imbalance, vwap of windows of event time (tumbling or sliding)."""
    w = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    out = stream.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum("qty").alias("volume"), F.sum(F.col("side") * F.col("qty")).alias("net"), F.sum(F.col("px") * F.col("qty")).alias("value"))
    return out.select(*by, F.col("w.start").alias("start"), "n", "volume", (F.col("net") / F.nullif(F.col("volume"), F.lit(0.0))).alias("imbalance"), (F.col("value") / F.nullif(F.col("volume"), F.lit(0.0))).alias("vwap"))


def sessions(stream: DataFrame, by: list[str], gap: str) -> DataFrame:
    """by, start, end, n, volume of bursts that a pause of `gap` ends."""
    w = F.session_window("event_time", gap)
    return stream.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum("qty").alias("volume")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")


Z_ROWS = "ts long, seq long, px double, z double"


def kalman_z(stream: DataFrame, by: list[str], process: float, measure: float, idle: str = "7 days") -> DataFrame:
    """by, ts, seq, px, z: standardised innovations of a local level on log prices, kept from batch to
    batch. Prints of one batch are taken in order of time; those older than the state's are left out."""
    wait = pd.Timedelta(idle).value // 1_000_000

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        x, p, last = state.get if state.exists else (0.0, -1.0, -(1 << 62))
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for ts, seq, px in zip(rows.ts, rows.seq, rows.px):
            if not px > 0 or ts < last:
                continue
            y = math.log(px)
            if p < 0:
                x, p, z = y, measure, 0.0
            else:
                prior = p + process * (ts - last) / 1e6
                v = prior + measure
                z = (y - x) / math.sqrt(v)
                x, p = x + prior / v * (y - x), prior * (1 - prior / v)
            last = ts
            out.append((*key, ts, seq, px, z))
        state.update((float(x), float(p), int(last)))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=[*by, "ts", "seq", "px", "z"])

    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in by) + ", " + Z_ROWS
    return stream.groupBy(*by).applyInPandasWithState(step, schema, "x double, p double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def volume_buckets(stream: DataFrame, by: list[str], volume: float) -> DataFrame:
    """by, bucket, end_ts, volume, imbalance as in the batch operator, with the open bucket as state."""
    def step(key, frames, state: GroupState):
        k, buys, sells = state.get if state.exists else (0, 0.0, 0.0)
        rows, out = pd.concat(list(frames)).sort_values(["ts", "seq"]), []
        for ts, qty, side in zip(rows.ts, rows.qty, rows.side):
            buys, sells = (buys + qty, sells) if side > 0 else (buys, sells + qty)
            if buys + sells >= volume:
                k += 1
                out.append((*key, k, ts, buys + sells, abs(buys - sells) / (buys + sells)))
                buys = sells = 0.0
        state.update((int(k), float(buys), float(sells)))
        yield pd.DataFrame(out, columns=[*by, "bucket", "end_ts", "volume", "imbalance"])

    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in by) + ", bucket long, end_ts long, volume double, imbalance double"
    return stream.groupBy(*by).applyInPandasWithState(step, schema, "k long, buys double, sells double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs over all that is there and stops; the sink is Parquet, exactly once."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_to_days(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The same, into a folder for each batch, in it folders by day and venue. A batch that is run again
    after a failure replaces its own folder, so that each row is there once."""
    from tapeloom.sources.layout import write_days

    def write(rows: DataFrame, batch: int) -> None:
        write_days(rows.drop("event_time"), f"{path}/batch={batch}", mode="overwrite")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sleeve(stream: DataFrame, by: list[str], enter_z: float, hold: int, cost_bps: float) -> DataFrame:
    """by, entry_ts, exit_ts, direction, entry, exit, pnl_bps as in the batch operator, with the open
    position as state. stream: ts, seq, px, z."""

    def step(key, frames, state: GroupState):
        opened, t, way, at = state.get if state.exists else (False, 0, 0, 0.0)
        rows, out = pd.concat(list(frames)).sort_values(["ts", "seq"]), []
        for ts, px, z in zip(rows.ts, rows.px, rows.z):
            if opened and ts >= t + hold:
                out.append((*key, t, ts, way, at, px, 1e4 * way * (px - at) / at - 2 * cost_bps))
                opened = False
            if not opened and z == z and abs(z) >= enter_z and px:
                opened, t, way, at = True, int(ts), -1 if z > 0 else 1, float(px)
        state.update((bool(opened), int(t), int(way), float(at)))
        yield pd.DataFrame(out, columns=[*by, "entry_ts", "exit_ts", "direction", "entry", "exit", "pnl_bps"])

    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in by) + ", entry_ts long, exit_ts long, direction int, entry double, exit double, pnl_bps double"
    return stream.groupBy(*by).applyInPandasWithState(step, schema, "opened boolean, t long, way int, at double", "append", GroupStateTimeout.NoTimeout)
