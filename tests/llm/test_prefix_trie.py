"""The trie against plain dictionaries of prefixes, with parts that cut nodes, long shared prefixes and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import plain
from tapeloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaf = children[p] == 0
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] += leaf
        saved[p] += own
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def rows_of(convs):
    return [(c, t, *x) for c, turns in convs.items() for t, x in enumerate(turns)]


@pytest.fixture
def many_parts(spark):
    """Parts are not put together again, so that they cut through nodes."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def random_convs(seed: int, n: int) -> dict:
    rng, out = random.Random(seed), {}
    words = [("user", "a"), ("user", "b c"), ("assistant", "a"), ("assistant", "")]
    for i in range(n):
        base = list(rng.choice(list(out.values()))) if out and rng.random() < 0.6 else []
        base = base[: rng.randrange(len(base) + 1)] if rng.random() < 0.7 else base
        out[i * 3 - 50] = base + [rng.choice(words) for _ in range(rng.randrange(5))]
    return {c: t for c, t in out.items() if t}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations_over_many_parts(spark, many_parts, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "STEP", 2)
    monkeypatch.setattr(prefix_trie, "LINKS", 3)
    convs = random_convs(seed, 150)
    convs |= {1000 + i: [("user", "hot")] * (2 if i % 3 else 5) for i in range(60)}  # a group that spans parts
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows_of(convs), SCHEMA).repartition(6))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(by_hand(convs), key=str)


def test_long_conversations(spark, many_parts):
    """Strings hold what is shared, in steps; the rest is a chain."""
    long = [("user", str(k)) for k in range(1000)]
    convs = {1: long, 2: long[:700] + [("user", "x")], 3: long[:64], 4: long[:128], 5: [("user", "y"), *long], 6: long}
    d = spark.createDataFrame(rows_of(convs), SCHEMA)
    turns = prefix_trie.turns_of(prefix_trie.ordinals(d))
    keys = {r["conv_id"]: len(r["key"]) // 16 for r in prefix_trie.strings(turns.select("conv_id").distinct(), turns).collect()}
    assert keys == {1: 1000, 2: 701, 3: 64, 4: 128, 5: 64, 6: 1000}
    assert sorted(map(tuple, prefix_trie.conversation_trie(d).collect()), key=str) == sorted(by_hand(convs), key=str)


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - c % 20  # ids are not negative here
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def test_query_on_odd_rows(spark, tmp_path, many_parts):
    """Nulls in any column, repeated rows, ties, conversations that end up without turns, clashing columns."""
    rng = random.Random(4)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "\t", "é x"])) for c in range(15, 120) for _ in range(rng.randrange(1, 6))]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)] + [(41, 9, "user", "again")] * 30
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("d", "part", "key", "place", "words", "own", "row", "k", "depth", "base", "h", "taken", "n")})
    d.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op12_prefix_trie(spark, str(tmp_path)).toPandas()
    convs = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            convs[c].append((role or "", text or ""))
    assert sorted(map(tuple, got.astype(object).where(got.notna(), None).values.tolist()), key=str) == sorted(by_hand(rebuild(convs)), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert plain(got) == plain(con.execute(prefix_trie.OP12_SQL).df())


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).count() == 0
    ids = spark.createDataFrame([(5,), (3,)], "conv_id long")
    none = prefix_trie.turns_of(prefix_trie.ordinals(empty))
    assert [tuple(r) for r in prefix_trie.trie(ids, none).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]
