"""Queries that replay the tape as a stream and drain it; the results equal those of the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.stats import r6
from tapeloom.plans.base import query
from tapeloom.plans.base import r6 as R
from tapeloom.plans.flow import BUCKETS
from tapeloom.plans.vol import KF
from tapeloom.sources import market
from tapeloom.sources.market import CELL
from tapeloom.sources.shared import new_folder
from tapeloom.streaming import jobs


def _replayed(spark, rows):
    """rows as a stream of files, all in one batch."""
    path = new_folder(spark)
    rows.write.parquet(path)
    return jobs.read_tape(spark, path, 1_000_000)


def _drained(spark, stream):
    path = new_folder(spark)
    jobs.drain(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_deduplicated", f"SELECT venue, count(*) AS n, {R('sum(px * qty)')} AS value FROM tape GROUP BY venue")
def stream_deduplicated(spark, sf):
    t = market.tape(spark, sf)
    once = _drained(spark, jobs.deduplicated(_replayed(spark, t.unionByName(t.where("seq % 50 = 0"))), ["seq"], "60 days"))
    return once.groupBy("venue").agg(F.count("*").alias("n"), r6(F.sum(F.col("px") * F.col("qty"))).alias("value"))


@query("stream_volume_buckets", f"{BUCKETS} SELECT venue, symbol, count(*) AS buckets, {R('avg(imbalance)')} AS imbalance, {R('sum(vol)')} AS volume FROM vb GROUP BY ALL", recursive=True)
def stream_volume_buckets(spark, sf):
    b = _drained(spark, jobs.volume_buckets(_replayed(spark, market.tape(spark, sf)), CELL, 20.0))
    return b.groupBy(*CELL).agg(F.count("*").alias("buckets"), r6(F.avg("imbalance")).alias("imbalance"), r6(F.sum("volume")).alias("volume"))


@query("stream_innovations", f"{KF} SELECT venue, symbol, count(*) AS n, {R('sum(abs(z))')} AS total, {R('max(z)')} AS most FROM kf GROUP BY ALL", recursive=True)
def stream_innovations(spark, sf):
    z = _drained(spark, jobs.kalman_z(_replayed(spark, market.tape(spark, sf)).withWatermark("event_time", "1 hour"), CELL, 1e-10, 1e-5))
    return z.groupBy(*CELL).agg(F.count("*").alias("n"), r6(F.sum(F.abs("z"))).alias("total"), r6(F.max("z")).alias("most"))
