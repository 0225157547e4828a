"""The trie of conversations' shared prefixes, by sorted turn arrays and a sweep over adjacent LCPs.

A turn is 16 bytes of SHA-256 over its role and text, so a conversation is a string of such turns, and
sorting these strings brings shared prefixes together. The sorted rows are swept once: for neighbours i
and i+1 whose longest common prefix has l turns, nodes deeper than l end at i. Nodes that more than one
conversation passes are on a stack, one entry for each depth up to the common prefix; what lies below
belongs to one conversation and is one row, a chain.

The sort is by ranges, so each task sweeps its own part. The first and last row of each part, and where
the nodes above the last row began, go to one task (a row for each part), which stitches the open stacks:
it gives each part the nodes that are open at its left end. Nodes over several parts come out in shares,
which are summed.

A conversation's string holds only as many turns as it shares with another one, in steps of STEP (at least one
step), so that a conversation of a third of all turns is not one row. What it shares is found by hashes of
its prefixes at multiples of STEP; a false hit makes a string longer and changes nothing else.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import batch, table
from tapeloom.llm.repair import crc32_sql

#: Turns by which strings grow; bytes of a turn.
STEP, TURN = 64, 16
#: Conversations of one family of rebuilt ones, and most turns that they take from the first.
FAMILY, HEADS = 20, 4
#: Depths of a chain that one row expands to.
LINKS = 4096
EMPTY = sha256().hexdigest()


def ordinals(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with d, the place (1, 2, ...) of each row in its conversation, by turn (null
    first), role and text.

    Rows are sorted by ranges, so a conversation may lie in several parts; each part counts its own, and the counts
    of the parts before are added: a row for each part that continues a conversation."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    schema = pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("own", pa.int64())])

    def number(batches):
        part, conv, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            at = np.arange(len(ids))
            new = np.concatenate([[ids[0] != conv], ids[1:] != ids[:-1]])
            first = np.maximum.accumulate(np.where(new, at, -1))
            own = np.where(first >= 0, at - first + 1, n + at + 1)
            conv, n = ids[-1], int(own[-1])
            yield batch(schema, *b.columns, np.full(len(ids), part, np.int32), own)

    rows = rows.withColumn("row", F.monotonically_increasing_id())  # parts equal rows
    counted = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(number, "conv_id long, role string, text string, part int, own long"))
    totals = counted.groupBy("conv_id", "part").agg(F.max("own").alias("n"))
    parts = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = table(totals.select("conv_id", "part", F.sum("n").over(parts).alias("before")).where("before IS NOT NULL"))
    return counted.join(before, ["conv_id", "part"], "left").select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("d"), "role", "text")


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, d, turn, words): what the trie needs of each row (conv_id, d, role, text)."""
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * TURN))
    return rows.select("conv_id", "d", digest.alias("turn"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_ids, turns of the rebuilt conversations): the first h turns of conversation c - c % 20, then c's own
    from the h-th on; h = crc32(c) % 4. Rows without conv_id belong to no conversation."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text")).where("conv_id IS NOT NULL")
    turns = table(turns_of(ordinals(rows)))
    ids = table(turns.select("conv_id").distinct())
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    base = lambda c: c - c % FAMILY
    # at most three turns of a conversation go to at most nineteen others
    heads = turns.where((F.col("d") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = ids.select("conv_id", base(F.col("conv_id")).alias("base"), h.alias("h")).join(heads, "base").where("d <= h").select("conv_id", "d", "turn", "words")
    # a family's first may have fewer than h turns: own turns move up
    taken = heads.groupBy("conv_id").agg(F.count("*").alias("taken"))
    own = turns.where(F.col("d") > h).join(taken, "conv_id", "left")
    own = own.select("conv_id", (F.col("d") - h + F.coalesce("taken", F.lit(0))).alias("d"), "turn", "words")
    return ids, table(heads.unionByName(own))


def strings(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, length, key, words): each conversation's string as far as it is shared, and the words of its turns."""
    steps = turns.withColumn("k", F.floor((F.col("d") - 1) / STEP)).groupBy("conv_id", "k")
    ordered = F.sort_array(F.collect_list(F.struct("d", "turn", "words")))
    step = table(steps.agg(ordered.alias("t"), F.count("*").alias("n")).select("conv_id", "k", "n", F.transform("t", lambda x: x["turn"]).alias("turns"), F.transform("t", lambda x: x["words"]).alias("words")))
    # prefixes of whole steps, by sums of hashes of their steps
    mixed = F.sum(F.xxhash64("k", "turns").cast("decimal(38,0)")).over(Window.partitionBy("conv_id").orderBy("k"))
    prefixes = step.where(f"n = {STEP}").select("conv_id", "k", mixed.alias("prefix"))
    met = prefixes.groupBy("k", "prefix").agg(F.count("*").alias("sharers")).where("sharers > 1")
    shared = prefixes.join(met, ["k", "prefix"]).groupBy("conv_id").agg((F.max("k") + 1).alias("shared"))
    lengths = step.groupBy("conv_id").agg(F.sum("n").alias("length"))
    rows = step.join(table(shared), "conv_id", "left").where("k <= coalesce(shared, 0)")
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "turns", "words"))).alias("s"))
    key = F.aggregate(F.flatten(F.transform("s", lambda x: x["turns"])), F.lit(b""), lambda s, x: F.concat(s, x))
    rows = rows.select("conv_id", key.alias("key"), F.flatten(F.transform("s", lambda x: x["words"])).alias("words"))
    none = F.array().cast("array<bigint>")
    return ids.join(lengths, "conv_id", "left").join(rows, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("key", F.lit(b"")).alias("key"), F.coalesce("words", none).alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    return int((x != y).argmax()) // TURN


SORTED = "part int, place long, conv_id long, length long, key binary, words array<bigint>, last_key binary, last_length long, began array<bigint>"
_SORTED = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("conv_id", pa.int64()), ("length", pa.int64()), ("key", pa.binary()), ("words", pa.list_(pa.int64())), ("last_key", pa.binary()), ("last_length", pa.int64()), ("began", pa.list_(pa.int64()))])


def _numbered(batches):
    """Sorted rows with part and place; and one row, of place -1, with the part's first and last string, and the place
    where the node of each depth above the last row began."""
    part, place, first, last, length, began = TaskContext.get().partitionId(), 0, None, None, 0, []
    for b in batches:
        for size, key in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if first is None:
                first, last = key, b""
            kept = common(last, key)
            began = began[:kept] + [place] * (len(key) // TURN - kept)
            last, length, place = key, size, place + 1
        n = b.num_rows
        if n:
            yield batch(_SORTED, np.full(n, part, np.int32), np.arange(place - n, place), *b.columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())))
    if first is not None:
        yield batch(_SORTED, [part], [-1], [None], [None], [first], [None], [last], [length], [began])


OPEN = "part int, at array<struct<part:int,place:bigint>>, before bigint, next bigint"
_AT = pa.struct([("part", pa.int32()), ("place", pa.int64())])
_OPEN = pa.schema([("part", pa.int32()), ("at", pa.list_(_AT)), ("before", pa.int64()), ("next", pa.int64())])


def _stitched(batches):
    """For each part, in order: where the nodes that are open at its left end began, the length of the row before
    it, and how deep the nodes are that are open at its right end."""
    held, row = None, None  # what is known of the part before, and its row, which waits for the next
    for b in batches:
        for part, first, last, length, began in zip(*(c.to_pylist() for c in b.columns)):
            at, before = [], -1
            if held is not None:
                part_before, last_before, length_before, began_before, at_before = held
                deep = common(last_before, first)
                yield batch(_OPEN, *([x] for x in (*row, deep)))
                # a node that began with the first row of a part may have been open there already
                at = [at_before[k] if began_before[k] == 0 and k < len(at_before) else (part_before, began_before[k]) for k in range(deep)]
                before = length_before
            held, row = (part, last, length, began, at), (part, [{"part": p, "place": x} for p, x in at], before)
    if row is not None:
        yield batch(_OPEN, *([x] for x in (*row, 0)))


SHARE, CHAIN, END = 0, 1, 2
SWEPT = "kind int, part int, place long, depth long, bottom long, above_part int, above_place long, conv_id long, n long, children long, leaves long, saved long, words long"
_SWEPT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("place", pa.int64()), ("depth", pa.int64()), ("bottom", pa.int64()), ("above_part", pa.int32()), *((c, pa.int64()) for c in ("above_place", "conv_id", "n", "children", "leaves", "saved", "words"))])
ROOT = (-1, -1)


class _Node:
    """A node on the stack, or a part's share of one: where it began and how many pass it here."""

    __slots__ = ("children", "conv_id", "at", "leaves", "n", "own", "saved", "words")

    def __init__(self, at, words: int, own: bool):
        self.at, self.words, self.own = at, words, own  # own: it began in this part
        self.n = self.children = self.leaves = self.saved = 0
        self.conv_id = None

    def add(self, n: int, conv_id: int | None, leaves: int, saved: int) -> None:
        self.n, self.leaves, self.saved = self.n + n, self.leaves + leaves, self.saved + saved
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id


def _sweep(batches):
    """Rows of one part after the other: first its open row (place -1: at, before, next), then its sorted rows."""
    out: list[tuple] = []
    state = None

    def step(now, key_after: bytes | None) -> None:
        """Takes in one row, whose common prefix with the next one is known by now."""
        part, place, conv, length, key, words = now
        stack, before, right = state["stack"], state["before"], state["next"]
        after = right if key_after is None else common(key, key_after)
        while len(stack) <= after:
            d = len(stack)
            stack[-1].children += 1
            stack.append(_Node((part, place), words[d - 1], True))
        m = len(stack) - 1
        if length > m:
            top = stack[m]
            top.children += 1
            top.add(1, conv, 1, 0)
            out.append((CHAIN, part, place, m + 1, length, *top.at, conv, 1, None, None, None, None))
        else:
            stack[length].add(1, conv, 0, 0)
            out.append((END, *stack[length].at, length, None, None, None, conv, None, None, None, None, None))
        while len(stack) - 1 > after:
            close(stack.pop(), len(stack), before, True)
        if key_after is None:
            for d in range(len(stack) - 1, -1, -1):
                close(stack.pop(), d, before, False)

    def close(node: _Node, d: int, before: int, whole: bool) -> None:
        """whole: no row behind passes the node. saved counts a node's words once less, where it began."""
        if whole and not node.children and (node.own or d == before):
            node.leaves += 1
        node.saved += node.n * node.words - (node.words if node.own else 0)
        above = state["stack"][d - 1].at if d else (None, None)
        if d:
            state["stack"][d - 1].add(node.n, node.conv_id, node.leaves, node.saved)
        out.append((SHARE, *node.at, d, d, *above, node.conv_id, node.n, node.children, node.leaves, node.saved, node.words))

    held = None
    for b in batches:
        for part, place, conv, length, key, words, at, before, after in zip(*(c.to_pylist() for c in b.columns)):
            if held is not None:
                step(held, None if place < 0 else key)
            held = None if place < 0 else (part, place, conv, length, key, words)
            if place < 0:
                state = {"stack": [_Node(ROOT, 0, False)], "before": before, "next": after, "at": [(x["part"], x["place"]) for x in at]}
            elif len(state["stack"]) == 1 and place == 0:
                state["stack"] += [_Node(x, words[k], False) for k, x in enumerate(state["at"])]
        if len(out) > 20_000:
            yield batch(_SWEPT, *zip(*out))
            out = []
    if held is not None:
        step(held, None)
    if out:
        yield batch(_SWEPT, *zip(*out))


def _ends(batches):
    """The digest of each node's conv_ids, joined by commas; rows sorted by node and conv_id."""
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    node, digest, out = None, None, []
    for b in batches:
        for *own, conv in zip(*(c.to_pylist() for c in b.columns)):
            if own != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = own, sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if len(out) > 10_000:
            yield batch(schema, *zip(*out))
            out = []
    if node is not None:
        yield batch(schema, *zip(*[*out, (*node, digest.hexdigest())]))


NODE = ["part", "place", "depth"]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    ids: conv_id of every conversation, each once, those without turns too; turns: conv_id, d (1, 2, ... without
    gaps), turn (16 bytes), words. The node of no turns has all conversations; without any there is no node."""
    order = ["key", "length", "conv_id"]
    rows = table(strings(ids, turns))
    rows = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "length", "key", "words").mapInArrow(_numbered, SORTED))
    edges = rows.where("place = -1").select("part", "key", "last_key", "last_length", "began")
    opened = table(edges.repartition(1).sortWithinPartitions("part").mapInArrow(_stitched, OPEN))
    columns = ["part", "place", "conv_id", "length", "key", "words"]
    nulls = [F.lit(None).cast(c).alias(n) for c, n in (("array<struct<part:int,place:bigint>>", "at"), ("bigint", "before"), ("bigint", "next"))]
    firsts = opened.select("part", F.lit(-1).cast("long").alias("place"), *(F.lit(None).cast(c).alias(n) for c, n in (("bigint", "conv_id"), ("bigint", "length"), ("binary", "key"), ("array<bigint>", "words"))), "at", "before", "next")
    stream = rows.where("place >= 0").select(*columns, *nulls).unionByName(firsts)
    swept = table(stream.repartition("part").sortWithinPartitions("part", "place").mapInArrow(_sweep, SWEPT))

    ends = swept.where(f"kind = {END}").select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    ends = table(ends.mapInArrow(_ends, "part int, place long, depth long, ends_sha256 string"))
    shares = swept.where(f"kind = {SHARE}").groupBy(*NODE).agg(
        F.max("above_part").alias("above_part"), F.max("above_place").alias("above_place"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved"))
    )
    leaves = F.when(F.col("children") == 0, 1).otherwise(F.col("leaves"))  # the root may be the only node
    nodes = table(shares.withColumn("leaves", leaves.cast("long")).join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))))
    above = nodes.select(F.col("part").alias("above_part"), F.col("place").alias("above_place"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    named = ["conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"]
    shared = nodes.join(above, ["above_part", "above_place", "depth"], "left").select(*named)

    # a chain's depths, in blocks of LINKS, so that no row holds all of them
    chains = swept.where(f"kind = {CHAIN}").select("conv_id", "depth", "bottom", "above_part", "above_place").join(above, ["above_part", "above_place", "depth"], "left")
    blocks = chains.withColumn("from", F.explode(F.sequence("depth", "bottom", F.lit(LINKS).cast("long"))))
    links = blocks.withColumn("d", F.explode(F.sequence("from", F.least(F.col("bottom"), F.col("from") + LINKS - 1))))
    last, one = F.col("d") == F.col("bottom"), F.lit(1).cast("long")
    alone = links.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    return shared.unionByName(alone).select(*COLUMNS)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are (conv_id, turn, role, text).

    Turns are by turn, null first; rows of one turn by role and text. Null role and text are empty; rows without
    conv_id belong to no conversation; repeated rows are turns each; other columns are not read; an empty table gives
    no nodes."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text")).where("conv_id IS NOT NULL")
    turns = table(turns_of(ordinals(rows)))
    return trie(turns.select("conv_id").distinct(), turns)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


OP12_SQL = rf"""
WITH c AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t,
           {crc32_sql("conv_id::VARCHAR")} % 4 AS h
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (
    SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) AS t FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, unnest(range(len(t) + 1)) AS depth, t FROM r),
q AS (SELECT conv_id, depth, t[1:depth] AS prefix, t[1:depth - 1] AS above, len(t) = depth AS ends, CASE WHEN depth > 0 THEN t[depth].text ELSE '' END AS text FROM p),
n AS (
    SELECT depth, prefix, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM q GROUP BY depth, prefix),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND m.above = n.prefix) AS n_children FROM n)
SELECT k.conv_id, k.depth, a.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k LEFT JOIN k a ON k.depth > 0 AND a.depth = k.depth - 1 AND a.prefix = k.above
JOIN (
    SELECT x.depth, x.prefix, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.words)::BIGINT AS saved_tokens
    FROM k x JOIN k y ON y.depth >= x.depth AND y.prefix[1:x.depth] = x.prefix GROUP BY x.depth, x.prefix) s
  ON s.depth = k.depth AND s.prefix = k.prefix
"""
