"""Sharding by balanced label propagation.

Nodes link through hubs (all nodes of a hub are linked; for documents: equal texts), so links are rows
and a group of any size is no list. Linked nodes start at a shard by hash. Each round, hubs sum their
nodes by shard, nodes join their hubs and ask for the shard that holds most of their neighbours among
those with room (where there is next to none, in every other round among all); as many are let in as the
shard's quota has room for or as leave it, a small group as one. Rounds end when no node moves. In the end, nodes above a quota and all nodes without links fill what room is left,
so counts differ by one at most. Ranks are prefix sums over hash buckets; only loads and flows of the
shards come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import shards_for, table

#: Shards, and rounds at most; rounds end before that when no node moves.
SHARDS, ROUNDS = 16, 12
#: Rows that one task ranks (about), and into how many parts at least a shard's quota is dealt for that.
PER_BUCKET, PARTS_OF_QUOTA = 20_000, 64
PARTS = 1 << 20


def ranked(rows: DataFrame, group: str, spread: Column, total: int, salt: Column | None = None) -> DataFrame:
    """rows with rank, 0 up without gaps in each group: row numbers within hash buckets, plus the sizes
    of the buckets before. Rows of one spread go to buckets in turn, by their salt."""
    buckets = shards_for(total, PER_BUCKET, 64)
    bucket = F.pmod(F.pmod(F.xxhash64(spread), F.lit(buckets)) + (F.lit(0) if salt is None else salt), F.lit(buckets))
    rows = table(rows.withColumn("bucket", bucket.cast("int")))
    sizes = rows.groupBy(group, "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("bucket")) - F.col("n")
    sizes = table(sizes.select(group, "bucket", before.alias("before")))
    at = F.row_number().over(Window.partitionBy(group, "bucket").orderBy("hub", "uid")) - 1
    return rows.withColumn("at", at).join(sizes, [group, "bucket"]).withColumn("rank", F.col("at") + F.col("before")).drop("bucket", "at", "before")


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [found.get(k, 0) for k in range(shards)]


def _state(now: DataFrame, shards: int) -> tuple[list[int], int]:
    """(nodes in each shard, nodes that the last round moved); a node of several hubs is one."""
    nodes = now.groupBy("uid").agg(F.first("shard").alias("shard"), F.max((F.col("was") != F.col("shard")).cast("int")).alias("moved"))
    rows = nodes.groupBy("shard").agg(F.count("*").alias("n"), F.sum("moved").alias("moved")).collect()
    found = {r["shard"]: r["n"] for r in rows}
    return [found.get(k, 0) for k in range(shards)], sum(r["moved"] for r in rows)


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index + 1)


def _shares(room: list[int], asked: list) -> list[float]:
    """The share of the nodes asking for each shard that get in, so that those who come fit in the room
    and the places of those who leave; at most shards x shards numbers."""
    share = [1.0] * len(room)
    into = [sum(r["n"] for r in asked if r["to"] == t) for t in range(len(room))]
    for _ in range(100):
        out = [sum(r["n"] * share[r["to"]] for r in asked if r["shard"] == t) for t in range(len(room))]
        share = [min(s, (r + o) / n) if n else 1.0 for s, r, o, n in zip(share, room, out, into)]
    return share


def propagate(links: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """(uid, hub, shard) of linked nodes; links: uid, hub, size (nodes of the hub)."""
    shards = len(quota)
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    now = table(links.withColumns({"shard": start, "was": start}))
    still = 0
    for k in range(rounds):
        load, moved = _state(now, shards)
        still = 0 if moved or not k else still + 1
        if still == 2:
            break
        room = [max(0, q - n) for q, n in zip(quota, load)]
        counts = table(now.groupBy("hub", "shard").agg(F.count("*").alias("n")).groupBy("hub").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("n")))
        votes = now.join(counts, "hub").select("uid", "hub", "size", "shard", F.explode("n").alias("to", "n"))
        # where there is next to no room, nodes take the places of those who leave, in every other round
        swap = k % 2 == 1 and sum(room) * 20 < sum(load)
        open_ = F.lit(True) if swap else (F.col("to") == F.col("shard")) | (_pick(room, F.col("to")) > 0)
        sums = votes.where(open_).groupBy("uid", "shard", "to").agg(F.sum("n").alias("n"), F.max_by("hub", "n").alias("by"), F.max("size").alias("size"), F.max(F.xxhash64("hub", "to")).alias("tie"))
        # the best shards, as many as the node's largest group fills
        least = max(1, min(quota, default=1))
        first = F.slice(F.sort_array(F.collect_list(F.struct("n", "tie", "to", "by", "size")), asc=False), F.lit(1), F.ceil(F.max("size") / least).cast("int"))
        best = sums.groupBy("uid", "shard").agg(first.alias("first"))
        there = F.filter("first", lambda x: x["to"] == F.col("shard"))
        some = F.element_at("first", F.pmod(F.xxhash64("uid"), F.size("first")).cast("int") + 1)
        best = table(best.withColumn("best", F.when(F.size(there) > 0, F.element_at(there, 1)).otherwise(some)).select("uid", "shard", "best.to", "best.by", "best.size"))
        share = _shares(room, best.where("to != shard").groupBy("shard", "to").agg(F.count("*").alias("n")).collect())
        whole = F.col("size") * 8 <= least
        draw = F.pmod(F.when(whole, F.xxhash64("by", F.lit(k))).otherwise(F.xxhash64("uid", F.lit(k))), F.lit(PARTS)) / PARTS
        moved = best.select("uid", F.col("shard").alias("was"), F.when(draw < _pick(share, F.col("to")), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        now = table(now.drop("shard", "was").join(moved, "uid"))
    return now


def cut_edges(placed: DataFrame) -> DataFrame:
    """edges, cut: pairs of nodes that share a hub, and those of them in two shards, by sums over hubs.
    placed: uid, hub, shard."""
    by_shard = placed.groupBy("hub", "shard").agg(F.count("*").cast("double").alias("n"))
    hubs = by_shard.groupBy("hub").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("within"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return hubs.agg(F.coalesce(F.sum(pairs), F.lit(0.0)).alias("edges"), F.coalesce(F.sum(pairs - F.col("within")), F.lit(0.0)).alias("cut"))


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(uid, shard, slot) of every node: counts differ by one at most, slots have no gaps.

    nodes: uid, unique. links: uid, hub; hubs of one node are no links; null hubs link nothing."""
    total = nodes.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    hubs = table(links.where("hub IS NOT NULL").groupBy("hub").agg(F.count("*").alias("size")).where("size > 1"))
    placed = propagate(links.join(hubs, "hub").select("uid", "hub", "size"), quota, rounds)
    own = placed.groupBy("uid").agg(F.min("hub").alias("hub"), F.max("size").alias("size"), F.first("shard").alias("shard"))
    # a group is dealt to as many buckets as keep it to the rows that one task ranks
    most = max(1, min(PER_BUCKET, quota[-1] // PARTS_OF_QUOTA))
    salt = F.pmod(F.xxhash64("uid"), F.ceil(F.col("size") / most))
    at = ranked(own.select("uid", "hub", "shard", salt.alias("salt")), "shard", F.col("hub"), total, F.col("salt"))
    at = table(at.select("uid", "hub", "shard", "rank"))
    kept = at.where(F.col("rank") < _pick(quota, F.col("shard")))
    held = [min(q, n) for q, n in zip(quota, _loads(at, shards))]
    over = at.where(F.col("rank") >= _pick(quota, F.col("shard"))).select("uid", "hub")
    free = nodes.select("uid").join(at.select("uid"), "uid", "left_anti").select("uid", F.lit(None).cast("binary").alias("hub"))
    pool = ranked(over.unionByName(free).withColumn("all", F.lit(0)), "all", F.col("uid"), total)
    room, before = [q - h for q, h in zip(quota, held)], 0
    shard = slot = F.lit(None)
    for k in range(shards):
        inside = (F.col("rank") >= before) & (F.col("rank") < before + room[k])
        shard, slot = F.when(inside, k).otherwise(shard), F.when(inside, F.col("rank") - before + held[k]).otherwise(slot)
        before += room[k]
    filled = pool.select("uid", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    return kept.select("uid", "shard", F.col("rank").cast("long").alias("slot")).unionByName(filled)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a row for each row of docs. Equal texts are linked; null
    text is empty; rows that repeat a doc_id or have none are placed each. Other columns are not read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("hub"))
    rows = table(rows.withColumn("uid", F.monotonically_increasing_id()))
    placed = balanced_shards(rows.select("uid"), rows.select("uid", "hub"), shards)
    return rows.join(placed, "uid").select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
