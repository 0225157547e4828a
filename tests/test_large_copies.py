"""Queries on odd and dense events against DuckDB: copies at the same times, spreads all alike, plans that Spark changes as it runs."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import DATA, TABLES, plain
from tapeloom.functions.fold import fold
from tapeloom.operators import book, estimators, hft
from tapeloom.operators.temporal import forward
from tapeloom.plans import registry


@pytest.fixture
def both(spark, tmp_path):
    """both(name, sql): the query's rows by Spark and by its SQL, with the rows of `sql` as events."""

    def run(name: str, sql: str) -> tuple[list, list]:
        con = duckdb.connect()
        con.execute(f"COPY ({sql}) TO '{tmp_path}/events.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t == 'events' else f'{DATA}/sf0.001'}/{t}.parquet'")
        got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        return plain(got), plain(want)

    return run


def copies(k: int, sf: str = "sf0.001") -> str:
    """Events k times over, at the same times, with ids of their own."""
    return f"SELECT event_id + i * (SELECT max(event_id) + 1 FROM '{DATA}/{sf}/events.parquet') AS event_id, ts, user_id, event_type, value, props FROM '{DATA}/{sf}/events.parquet', range({k}) r(i)"


def test_spreads_all_alike_have_no_correlation(both):
    got, want = both("minute_joint_bars", f"SELECT * REPLACE (event_id * 3 AS event_id, 50.0 AS value) FROM '{DATA}/sf0.001/events.parquet'")
    assert got == want and len(got) == 3


@pytest.fixture
def late_broadcast(spark):
    """Joins are planned by sorting both sides, and turn into broadcasts of the small one as they run."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_key_is_folded_whole_after_a_join_by_it(spark, late_broadcast):
    rows = spark.range(0, 40000, 1, 8).select((F.col("id") % 5).alias("k"), F.col("id").alias("seq"))
    other = spark.range(0, 40000, 1, 8).groupBy((F.col("id") % 5).alias("k")).agg(F.count("*").alias("most"))

    def step(s, seq):
        s.append(seq)

    got = fold(rows.join(other, "k"), ["k"], ["seq"], ["seq"], list, step, "n long, sorted boolean", lambda s: [(len(s), s == sorted(s))])
    assert sorted(map(tuple, got.collect())) == [(k, 8000, True) for k in range(5)]


@pytest.mark.parametrize("strict", [True, False])
def test_forward_reads_each_row_once(spark, strict):
    """A frame from a row to the end of its slice is read anew for each row."""
    import io
    from contextlib import redirect_stdout

    rows = lambda times: spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], "k string, ts long, seq long")
    asked, refs = [0, 1, 1, 4, 9, 10, 11, 30, 31], [1, 1, 4, 10, 12, 12, 30]
    got = forward(rows(asked), rows(refs).withColumn("v", F.col("seq")), ["k"], ["v"], strict=strict, slice_=10)
    want = [(t, *next(((r, j) for j, r in enumerate(refs) if (r > t if strict else r >= t)), (None, None))) for t in asked]
    assert sorted(map(tuple, got.select("ts", "next_ts", "v").collect()), key=str) == sorted(want, key=str)
    with redirect_stdout(io.StringIO()) as plan:
        got.explain(True)
    assert "unboundedfollowing" not in plan.getvalue().lower()


def test_refills_of_copies_are_those_of_sql(both):
    got, want = both("same_side_refill", copies(4))
    assert got == want and len(got) == 2


def test_refills_are_looked_for_in_two_horizons(spark):
    """Each quote is dealt out twice, not once for each drop near it."""
    quotes = spark.range(3000).selectExpr("1 AS k", "id AS ts", "id AS seq", "10.0D AS bid", "11.0D AS ask", "5.0D - id % 2 AS bid_sz", "4.0D AS ask_sz")
    out = book.refills(quotes, ["k"], 0.1, 100_000)
    assert [tuple(r) for r in out.collect()] == [("bid", 1500, 1499, 0)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def paired(df) -> list[str]:
    """The joins that pair rows by more than equal keys, which make rows with the square of what is near each other."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [x for x in lines if "Join" in x and (">" in x or "<" in x)]


def survival_tables(spark):
    quotes = spark.range(1200).selectExpr("1 AS k", "id * 2 AS ts", "id AS seq", "100 - id % 7 + 0.0D AS bid", "101 - id % 5 + 0.0D AS ask", "1.0D + id % 11 AS bid_sz", "1.0D + id * 7 % 11 AS ask_sz")
    trades = spark.range(1200).selectExpr("1 AS k", "id * 2 + 1 AS ts", "id AS seq", "1.0D + id % 3 AS qty", "IF(id % 2 = 0, -1.0D, 1.0D) AS side")
    return quotes, trades


def test_touch_survival_follows_each_start_alone(spark):
    quotes, trades = survival_tables(spark)
    out = estimators.touch_survival(quotes, trades, ["k"], 1.0, [0, 3], 10, 90)
    assert not paired(out)
    q, t = ([r.asDict() for r in x.orderBy("ts").collect()] for x in (quotes, trades))
    hits = [(x["ts"], x["qty"], q[(x["ts"] - 1) // 2]["ask"]) for x in t if x["side"] < 0]
    for r in out.collect():
        waits = []
        for s in q[::10]:
            left = s["bid_sz"]
            for ts, qty, ask in hits:
                if s["ts"] < ts <= s["ts"] + 90 and ask <= s["bid"] - r["offset"] + 1e-12 and left > 0:
                    left -= qty
                    if left <= 0:
                        waits.append(ts - s["ts"])
        assert (r["starts"], r["filled"], r["mean_us"]) == (120, len(waits), sum(waits) / len(waits)) and 0 < len(waits) < 120


@pytest.mark.parametrize("side", ["buy", "sell"])
def test_size_survival_follows_each_start_alone(spark, side):
    quotes, trades = survival_tables(spark)
    out = estimators.size_survival(quotes, trades, ["k"], 11, 90, side)
    assert not paired(out)
    got = {r["share"]: (r["starts"], r["filled"]) for r in out.collect()}
    assert [n for n, _ in got.values()] == [109] * 3 and got[0.25][1] >= got[0.5][1] >= got[0.75][1] > 0


def test_event_markouts_take_the_first_trades_alone(spark):
    marked = spark.range(300).selectExpr("1 AS k", "id div 2 AS ts", "id AS seq", "IF(id % 7 = 0, NULL, id * 1.0D) AS markout")
    events = spark.createDataFrame([(1, 10, 1), (1, 140, 2), (1, 148, 3), (1, 149, 4), (1, 400, 5)], "k int, ts long, seq long")
    out = hft.event_markouts(events, marked, ["k"], 2, 1, 3)
    assert not paired(out)
    means = [(16 + 17 + 18) / 3, (276 + 277 + 278) / 3, (292 + 293) / 2, (295 + 296) / 2]
    assert [tuple(r) for r in out.collect()] == [(4, pytest.approx(sum(means) / 4), pytest.approx((means[1] + means[2]) / 2))]


def test_spread_response_sums_each_quote_once(spark):
    tob = spark.range(400).selectExpr("1 AS k", "id div 2 * 3 AS ts", "id AS seq", "100.0D AS bid", "IF(id % 31 = 0, NULL, 100.0D + (id * 7 % 13) / 8) AS ask")
    events = spark.createDataFrame([(1, t, i) for i, t in enumerate((0, 1, 4, 60, 61, 300, 601, 9000))], "k int, ts long, seq long")
    out = hft.spread_response(events, tob, ["k"], [0, 5], 40)
    assert not paired(out)
    q = [(r["ts"], None if r["ask"] is None else r["ask"] - r["bid"]) for r in tob.orderBy("ts", "seq").collect()]
    for r in out.collect():
        change = []
        for (e,) in events.select("ts").collect():
            was = [x for t, x in q if e - 40 <= t <= e - 1]
            now = [x for t, x in q if t <= e + r["lag"]][-1]
            if len(was) >= 2 and now is not None:
                base = [x for x in was if x is not None]
                change.append(now - sum(base) / len(base))
        assert (r["n"], r["change"]) == (len(change), pytest.approx(sum(change) / len(change))) and change


@pytest.mark.parametrize("name", ["forward_next_quote", "next_mid_change", "innovation_lead", "nearest_quote", "quotes_near_vshapes", "size_near_events", "storms_near_trades"])
def test_no_frame_runs_from_a_row_to_the_end(spark, name):
    plan = registry.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and not re.search(r"(currentrow\$\(\)|\b1), unboundedfollowing", plan)
