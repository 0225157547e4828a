"""Canonical tables of the engine as projections of the star-schema tables.

tape: trades. tob: top-of-book quotes. l2: order-book levels. chain, option_trades: options.
panel: days by venue. Times are microseconds (long); every order has a tie-breaker, seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A cell: the unit that estimators work on.
CELL = ["venue", "symbol"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin(kinds))
    return e.select(
        (F.col("user_id") % 3).cast("int").alias("venue"),
        (F.col("user_id") % 5).cast("int").alias("symbol"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        (F.floor((100 + (F.col("value") - 50) / 100) * 100 + 0.5) / 100).alias("level"),
        "event_type",
    )


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue, symbol, ts, seq, px, qty, side (+1 buyer, -1 seller)."""
    side = F.when(F.col("event_type") == "click", 1.0).otherwise(-1.0)
    qty = (1 + F.col("seq") % 7).cast("double")
    return _events(spark, sf_dir, ["click", "purchase"]).select("venue", "symbol", "ts", "seq", F.col("level").alias("px"), qty.alias("qty"), side.alias("side"))


def tob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue, symbol, ts, seq, bid, ask, mid, bid_sz, ask_sz."""
    half = (1 + F.col("seq") % 3) * 0.005
    mid = F.col("level")
    sizes = [(1 + F.col("seq") % 11).cast("double").alias("bid_sz"), (1 + F.col("seq") * 7 % 11).cast("double").alias("ask_sz")]
    return _events(spark, sf_dir, ["view", "signup", "error"]).select("venue", "symbol", "ts", "seq", (mid - half).alias("bid"), (mid + half).alias("ask"), mid.alias("mid"), *sizes)


def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_id, level, side (1 bid, 2 ask), qty, px: one row for each level of a snapshot."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus")).alias("x"))
    side = F.when(F.col("x.l_linestatus") == "O", 1).otherwise(2)
    return rows.select(F.col("l_orderkey").alias("snapshot_id"), (F.col("l_linenumber") - 1).alias("level"), side.alias("side"), F.col("x.l_quantity").alias("qty"), F.col("x.l_extendedprice").alias("px"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument_id, flag (c or p), strike, ttm_years, iv."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(key.alias("instrument_id"), F.when(key % 2 == 0, "c").otherwise("p").alias("flag"), F.col("p_retailprice").alias("strike"), (F.col("p_size") / 365.0).alias("ttm_years"), (0.2 + 0.01 * (key % 50)).alias("iv"))


def option_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument_id, qty, aggressor_side (1 buyer, 2 seller, 0 unknown)."""
    side = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("instrument_id"), F.col("l_quantity").alias("qty"), side.alias("aggressor_side"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, venue (region), x (account balance), y (order price), liq (segment)."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("month")
    return rows.select(month, F.col("n_regionkey").alias("venue"), F.col("c_acctbal").alias("x"), F.col("o_totalprice").alias("y"), F.col("c_mktsegment").alias("liq"), F.col("o_orderkey").alias("seq"))


#: The same tables for the SQL oracle.
VIEWS = """
lvl AS (SELECT (user_id % 3)::INT AS venue, (user_id % 5)::INT AS symbol, epoch_us(ts) AS ts, event_id AS seq,
               floor((100 + (value - 50) / 100) * 100 + 0.5) / 100 AS level, event_type FROM events),
tape AS (SELECT venue, symbol, ts, seq, level AS px, (1 + seq % 7)::DOUBLE AS qty,
                CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side
         FROM lvl WHERE event_type IN ('click', 'purchase')),
tob AS (SELECT venue, symbol, ts, seq, level - (1 + seq % 3) * 0.005::DOUBLE AS bid, level + (1 + seq % 3) * 0.005::DOUBLE AS ask,
               level AS mid, (1 + seq % 11)::DOUBLE AS bid_sz, (1 + seq * 7 % 11)::DOUBLE AS ask_sz
        FROM lvl WHERE event_type IN ('view', 'signup', 'error')),
l2 AS (SELECT l_orderkey AS snapshot_id, l_linenumber - 1 AS level, CASE WHEN x.l_linestatus = 'O' THEN 1 ELSE 2 END AS side,
              x.l_quantity AS qty, x.l_extendedprice AS px
       FROM (SELECT l_orderkey, l_linenumber, min({'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_quantity': l_quantity,
             'l_extendedprice': l_extendedprice, 'l_linestatus': l_linestatus}) AS x FROM lineitem GROUP BY ALL)),
chain AS (SELECT p_partkey AS instrument_id, CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE 'p' END AS flag, p_retailprice AS strike,
                 p_size / 365.0::DOUBLE AS ttm_years, 0.2::DOUBLE + 0.01::DOUBLE * (p_partkey % 50) AS iv FROM part),
option_trades AS (SELECT l_partkey AS instrument_id, l_quantity AS qty,
                         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS aggressor_side FROM lineitem),
panel AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS month, n_regionkey AS venue, c_acctbal AS x, o_totalprice AS y,
                 c_mktsegment AS liq, o_orderkey AS seq
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""
