"""Expected directions of market quality when the tick changes, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ["quoted_spread", "relative_spread", "bbo_depth", "total_depth", "volume", "welfare"]
# The sign of each metric in the order of METRICS, by regime and book. +1: better or
# more, -1: worse or less, 0: not known.
SIGNS = {
    ("large_abs_reduction", "liquid"): [1, 1, -1, 1, 1, 0],
    ("large_abs_reduction", "less_liquid"): [-1, -1, -1, -1, -1, 0],
    ("small_abs_reduction", "liquid"): [-1, -1, -1, -1, -1, 0],
    ("small_abs_reduction", "less_liquid"): [-1, -1, -1, -1, -1, 0],
    ("large_abs_increase", "liquid"): [1, 1, 1, -1, -1, 0],
    ("large_abs_increase", "less_liquid"): [-1, -1, -1, 1, 1, 0],
    ("small_abs_increase", "liquid"): [0, 0, 0, 0, 0, 0],
    ("small_abs_increase", "less_liquid"): [0, 0, 0, 0, 0, 0],
    ("rel_tick_up", "any"): [0, -1, 1, 1, -1, 0],
    ("rel_tick_down", "any"): [0, 1, -1, -1, 1, 0],
}


def expected_signs(spark: SparkSession) -> DataFrame:
    """regime, book, metric, expected."""
    return spark.createDataFrame([(r, b, m, s) for (r, b), signs in SIGNS.items() for m, s in zip(METRICS, signs)], "regime string, book string, metric string, expected int")


def with_expected(rows: DataFrame) -> DataFrame:
    """rows (regime, book, metric) with expected: the book's own sign, else that of any book, else 0."""
    table = expected_signs(rows.sparkSession)
    own = table.withColumnRenamed("expected", "_own")
    other = table.where("book = 'any'").select("regime", "metric", F.col("expected").alias("_any"))
    return rows.join(own, ["regime", "book", "metric"], "left").join(other, ["regime", "metric"], "left").withColumn("expected", F.coalesce("_own", "_any", F.lit(0))).drop("_own", "_any")


def scorecard(rows: DataFrame) -> DataFrame:
    """hits, misses, skips of observed signs (column observed); nothing expected or seen is a skip."""
    known = (F.col("expected") != 0) & (F.col("observed") != 0) & (F.col("metric") != "welfare")
    count = lambda c: F.count(F.when(c, 1))
    out = with_expected(rows).agg(count(known & (F.col("observed") == F.col("expected"))).alias("hits"), count(known & (F.col("observed") != F.col("expected"))).alias("misses"), count(~known).alias("skips"))
    return out.withColumn("hit_rate", F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)))
