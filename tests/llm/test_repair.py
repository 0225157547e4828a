"""Structure repair against a shortest-path search, SQL on odd rows, and long conversations in many pieces."""

from __future__ import annotations

import heapq
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import plain
from tapeloom.llm import repair

GRAMMAR = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ON = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(codes: str) -> tuple[int, str]:
    """Dijkstra over (cost, audit)."""
    seen, heap = set(), [(0, "", 0, 0)]
    while True:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(codes) and s in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 2, audit + "I", i, ON[s]))
        if i < len(codes):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s))
            if codes[i] != "D":
                more = codes[i].isupper()
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, ON[s]))
                to = GRAMMAR.get(codes[i].lower(), {}).get(s)
                if to is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))


@pytest.mark.parametrize("layered", [1, 3, 32])
def test_layers_find_the_least_cheapest_audit(monkeypatch, layered):
    monkeypatch.setattr(repair, "LAYERED", layered)
    rng = random.Random(layered)
    for _ in range(400):
        codes = "".join(rng.choice("DuaUAsSoO" if rng.random() < 0.5 else "ua") for _ in range(rng.randrange(12)))
        blocks, before = repair.solve(codes, repair.closing())
        assert (before[0], repair.trace(blocks, 0, True)[0]) == cheapest(codes)
        cut = rng.randrange(len(codes) + 1)  # in two pieces
        costs, end = repair.matrix(codes[cut:]), repair.closing()
        middle = [min(costs[4 * s + t] + end[t] for t in range(4)) for s in range(4)]
        assert middle == repair.solve(codes[cut:], end)[1]
        one, state = repair.trace(repair.solve(codes[:cut], middle)[0], 0, False)
        assert one + repair.trace(repair.solve(codes[cut:], end)[0], state, True)[0] == cheapest(codes)[1]


def odd_rows():
    rng = random.Random(5)
    rows = [(1, 0, "user", "Hi."), (1, 1, None, None), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (2, None, "system", "Be."), (2, None, "user", ""), (2, 7, "User", "Well"), (2, 3, "", "No!"), (None, 1, "user", "A."), (None, None, "assistant", "B\n"), (3, None, None, None), (4, 5, "user", " \t"), (5, 2**40, "user", "x."), (5, -(2**40), "sam", "y?\x0b "), (5, 0, "assistant", "z. ")]
    return rows + [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["One.", "Two!", "Three", " ", None])) for c in range(100, 160) for t in rng.sample(range(20), 9)]


def sql_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con.execute(repair.OP11_SQL).df()


@pytest.mark.parametrize("piece", [4096, 3])
def test_odd_rows(spark, tmp_path, monkeypatch, piece):
    """Nulls anywhere, ties, repeated rows, odd roles and clashing columns, in pieces and whole."""
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = odd_rows()
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("copies", "same", "at", "again", "piece", "of", "kind")})
    d.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_structure_repair(spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(sql_rows(rows))


def test_empty_table(spark, tmp_path):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(d).count() == 0 and repair.repaired_rows(d).count() == 0


def test_one_conversation_of_a_third_of_all_rows(spark, monkeypatch):
    """Dealt to many pieces over all partitions, with many equal rows of one turn."""
    monkeypatch.setattr(repair, "PIECE", 50)
    rng = random.Random(2)
    hot = [(7, t, rng.choice(["user", "assistant"]), f"text {t}" + rng.choice([".", ""])) for t in range(1500)] + [(7, 900, "user", "again.")] * 700
    rows = hot + [(100 + i, t, ("user", "assistant")[t], f"{i}.") for i in range(600) for t in range(2)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = repair.pieces_of(repair._as_is(d)).where("conv_id = 7")
    assert pieces.count() > 40
    got = {r["conv_id"]: r for r in repair.repair(d).collect()}
    assert len(got) == 601 and all(got[100 + i]["audit"] == "KK" for i in range(600))
    seen, codes, order = set(), "", sorted(hot, key=lambda r: r[1:])
    for _, _, role, text in order:
        codes += "D" if (role, text) in seen else role[0] if text.endswith(".") else role[0].upper()
        seen.add((role, text))
    cost, audit = repair.solve(codes, repair.closing())[1][0], repair.trace(repair.solve(codes, repair.closing())[0], 0, True)[0]
    assert (got[7]["cost"], got[7]["audit"], got[7]["duplicate"], got[7]["gaps"]) == (cost, audit, 699, 0)
    mended = sorted(repair.repaired_rows(d).where("conv_id = 7").collect(), key=lambda r: r["place"])
    assert [r["role"][0] for r in mended] == ["u", "a"] * (len(mended) // 2) and len(mended) == len(audit) - audit.count("D")
