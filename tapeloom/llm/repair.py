"""Repair of the structure of conversations at least cost, by cost layers over grammar states.

Roles, by their initials, have to read `(s?(ua)+)?`. Each row is kept (K), given another role (R) or deleted (D), and
empty rows can be inserted (I), at the costs below. For each cost in turn, a layer holds for every row
the set of grammar states, as bits, from which the rest can be accepted at no more than that cost. The
first layer that has the start state gives the cost; from there, the least letter whose state is in the
layer of the cost left over is taken, row after row, which gives the least of the cheapest audits.

A conversation of any length is spread over tasks. Rows are sorted by ranges of (conversation, turn, role,
text) and cut into pieces of at most PIECE rows. A piece is a matrix of costs between states, found by
layers; matrices are composed from the end of each conversation of several pieces, which tells each
piece what is left to pay behind it. Then each piece traces its audit for every state it may be
entered in, and one stream over a conversation's pieces picks the audits that fit together.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import batch, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Most rows, and about the most bytes of text, of a piece; rows whose layers are held at once.
PIECE, PIECE_BYTES, LAYERED = 4096, 1 << 20, 32
#: States: at the start, after s, after u, after a. What an initial leads to, and where rows may end.
STATES, ACCEPTING = range(4), (0, 3)
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: By R or I every state but "start" has one way on; "start" goes on by u.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
MANY = 1 << 60


def _before(step: dict[int, int]) -> tuple[int, ...]:
    """For each set of states, as bits, the set of those that step leads into it."""
    return tuple(sum(1 << s for s, t in step.items() if bits >> t & 1) for bits in range(16))


_KEPT = {c: _before(step) for c, step in STEP.items()} | {"o": (0,) * 16}
_ANY = _before({s: t for s, (_, t) in NEXT.items()})
_KEPT |= {c.upper(): t for c, t in _KEPT.items()}


def layers(codes: str, end: list[int]) -> tuple[list[list[int]], int]:
    """(layers, cost of the first): layer k has, for each place before, between and behind the rows, the
    states from which all that follows costs at most the first's cost + k. Layers end when each state is in.

    codes: a letter for each row: s, u, a or o for other initials; upper case if truncated; D if the row
    has to go. end: the cost behind the rows, by state. Rows that have to go cost the same on every way, so
    they are left out of the layers' costs. A state that cannot get to any of end's states is in no layer."""
    n, least, out = len(codes), min(end), []
    most = max(x for x in end if x < MANY) - least + DELETE * n + 2 * INSERT
    none = [0] * (n + 1)
    while not out or out[-1][0] != 15 and len(out) <= most:
        k, now = len(out), [0] * (n + 1)
        one, two, three = (out[k - c] if k >= c else none for c in (TRUNCATED, REROLE, DELETE))  # INSERT is as REROLE
        now[n] = one[n] | sum(1 << s for s in STATES if end[s] <= least + k) | _ANY[two[n]]
        for i in range(n - 1, -1, -1):
            c, more = codes[i], one[i] | _ANY[two[i]]
            if c == "D":
                now[i] = now[i + 1] | more
            elif c.islower():
                now[i] = _KEPT[c][now[i + 1]] | _ANY[two[i + 1]] | three[i + 1] | more
            else:
                now[i] = _KEPT[c][one[i + 1]] | _ANY[three[i + 1]] | three[i + 1] | more
        out.append(now)
    return out, least


def solve(codes: str, end: list[int]) -> tuple[list[tuple[str, list[list[int]]]], list[int]]:
    """(the rows in blocks with their layers, in order; the cost from each state before the rows)."""
    blocks = []
    for j in range(len(codes), 0, -LAYERED):
        part = codes[max(0, j - LAYERED) : j]
        found, least = layers(part, end)
        first = [next((k for k, x in enumerate(found) if x[0] >> s & 1), MANY) for s in STATES]
        end = [min(MANY, least + DELETE * part.count("D") + k) for k in first]
        blocks.append((part, found))
    return blocks[::-1], end


def closing() -> list[int]:
    """The cost of accepting behind the last row, by inserts."""

    def cost(s: int) -> int:
        return 0 if s in ACCEPTING else INSERT + cost(NEXT[s][1])

    return [cost(s) for s in STATES]


def matrix(codes: str) -> list[int]:
    """The costs from each state to each, row by row of the state before."""
    columns = [solve(codes, [0 if s == t else MANY for s in STATES])[1] for t in STATES]
    return [columns[t][s] for s in STATES for t in STATES]


def trace(blocks: list[tuple[str, list[list[int]]]], state: int, last: bool) -> tuple[str, int]:
    """(the least of the cheapest audits from state, state behind it). last: with the inserts behind the last row."""
    audit: list[str] = []
    for codes, found in blocks:
        state = _walk(codes, found, state, audit)
    while last and state not in ACCEPTING:
        audit.append("I")
        state = NEXT[state][1]
    return "".join(audit), state


def _walk(codes: str, found: list[list[int]], state: int, audit: list[str]) -> int:
    left = next((k for k, x in enumerate(found) if x[0] >> state & 1), None)
    if left is None:
        raise ValueError("no way on from this state")

    def held(k: int, i: int, s: int) -> bool:
        return k >= 0 and found[k][i] >> s & 1 == 1

    for i, c in enumerate(codes):
        if c == "D":
            audit.append("D")
            continue
        more, kept = TRUNCATED if c.isupper() else 0, STEP.get(c.lower(), {}).get(state)
        while not held(left - DELETE, i + 1, state) and held(left - INSERT, i, NEXT[state][1]):
            audit.append("I")
            left, state = left - INSERT, NEXT[state][1]
            kept = STEP.get(c.lower(), {}).get(state)
        if held(left - DELETE, i + 1, state):
            audit.append("D")
            left -= DELETE
        elif kept is not None and held(left - KEEP - more, i + 1, kept):
            audit.append("K")
            left, state = left - KEEP - more, kept
        else:
            audit.append("R")
            left, state = left - REROLE - more, NEXT[state][1]
    return state


def _filled(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _as_is(conversations: DataFrame) -> DataFrame:
    ids = (F.col(c).cast("long").alias(c) for c in ("conv_id", "turn"))
    return conversations.select(*ids, _filled("role").alias("role"), _filled("text").alias("text"), F.lit(1).cast("long").alias("copies"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after damage by crc32(`conv_id:turn`) % 20; null parts of the
    key, roles and texts count as one space, null conv_ids and turns stay null."""
    kind = F.crc32(F.concat_ws(":", _filled("conv_id"), _filled("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(_filled("text"), ".!?", "")).otherwise(_filled("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", kind.alias("kind"))
    return rows.where("kind != 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(_filled("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


_WHITE = " \t\n\x0b\x0c\r"
PIECES = "conv_id long, piece long, codes string, first string, last string, blank long, duplicate long, truncated long, illegal long, roles array<string>, texts array<string>"
_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("codes", pa.string()), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_LEGAL = {"su", "ua", "au"}


def _cut(piece_rows: int, piece_bytes: int):
    """Sorted rows (conv_id, turn, role, text, copies, again) to pieces. Texts of rows that have to go are not kept."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        conv, began = None, False
        codes, initials, roles, texts, counts, size = [], [], [], [], [0, 0, 0, 0], 0

        def close():
            nonlocal k, size
            row = batch(_PIECES, [conv], [part << 32 | k], ["".join(codes)], [initials[0]], [initials[-1]], *([n] for n in counts), [list(roles)], [list(texts)])
            for x in (codes, initials, roles, texts):
                x.clear()
            counts[:], size, k = [0, 0, 0, 0], 0, k + 1
            return row

        for b in batches:
            for own, role, text, copies, again in zip(*(c.to_pylist() for c in b.columns)):
                if began and own != conv and codes:
                    yield close()
                conv, began = own, True
                first = role[:1]
                end = text.rstrip(_WHITE)[-1:]
                letter = first if first in STEP else "o"
                for copy in range(copies):
                    if len(codes) >= piece_rows or size > piece_bytes:
                        yield close()
                    fault = 0 if not end else 1 if again or copy else 2 if end not in ".!?" else None
                    if fault is not None:
                        counts[fault] += 1
                    if initials and initials[-1] + first not in _LEGAL:
                        counts[3] += 1
                    initials.append(first)
                    codes.append("D" if fault in (0, 1) else letter.upper() if fault == 2 else letter)
                    if fault not in (0, 1):
                        roles.append(role)
                        texts.append(text)
                        size += len(text)
        if codes:
            yield close()

    return run


def pieces_of(damaged: DataFrame) -> DataFrame:
    """The pieces of all conversations, in the order of `piece`, written."""
    keys = ["conv_id", "turn", "role", "text"]
    # equal rows are one with a count before anything is sorted
    rows = table(damaged.groupBy(*keys).agg(F.sum("copies").alias("copies")))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select(*keys, "copies", same.alias("same"), F.struct(F.col("turn").isNotNull(), "turn").alias("at"))
    # where a role and text come at several turns, all but the first turn's are duplicates
    many = rows.groupBy("conv_id", "same").agg(F.min("at").alias("first"), F.count("*").alias("turns")).where("turns > 1")
    many = table(many.select(F.col("conv_id").alias("of"), F.col("same").alias("known"), "first"))
    rows = rows.join(many, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("known")), "left")
    rows = table(rows.select(*keys, "copies", F.coalesce(F.col("first") != F.col("at"), F.lit(False)).alias("again")))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return table(rows.select("conv_id", "role", "text", "copies", "again").mapInArrow(_cut(PIECE, PIECE_BYTES), PIECES))


def _suffixes(batches):
    """What is left to pay behind each piece; rows (conv_id, piece, matrix) from the end of each conversation."""
    schema = pa.schema([("own", pa.int64()), ("end", pa.list_(pa.int64())), ("final", pa.bool_())])
    conv, began, end = None, False, closing()
    for b in batches:
        out = []
        for own, piece, costs in zip(*(c.to_pylist() for c in b.columns)):
            last = not began or own != conv
            if last:
                conv, began, end = own, True, closing()
            out.append((piece, end, last))
            end = [min(costs[4 * s + t] + end[t] for t in STATES) for s in STATES]
        yield batch(schema, *(zip(*out) if out else ([], [], [])))


def _matrices(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("costs", pa.list_(pa.int64()))])
    for b in batches:
        yield batch(schema, b.column(0), b.column(1), [matrix(x) for x in b.column(2).to_pylist()])


def _traces(batches):
    """Adds each piece's audit, state behind it and cost, for every state it may be entered in."""
    schema = None
    for b in batches:
        schema = schema or pa.schema([*b.schema, ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64())), ("start_cost", pa.int64())])
        audits, exits, costs = [], [], []
        for codes, end, last in zip(*(b.column(c).to_pylist() for c in ("codes", "end", "final"))):
            whole = end is None
            end, last = closing() if whole else end, whole or last
            blocks, before = solve(codes, end)
            found = [trace(blocks, s, last) if before[s] < MANY else (None, None) for s in ((0,) if whole else STATES)]
            audits.append([a for a, _ in found])
            exits.append([s for _, s in found])
            costs.append(before[0])
        yield batch(schema, *b.columns, audits, exits, costs)


RESULT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _repaired(audit: str, codes: str, roles: list[str], texts: list[str], state: int):
    """(role, text, edit) of each repaired row; roles and texts are those of rows that need not go."""
    rows, forced, kept = iter(zip(roles, texts)), iter(codes), 0
    for edit in audit:
        if edit == "I":
            initial, state = NEXT[state]
            yield ROLES[initial], "", edit
            continue
        own = next(rows) if next(forced) != "D" else None
        if edit == "D":
            continue
        role, text = own
        if edit == "R":
            initial, state = NEXT[state]
            role = ROLES[initial]
        else:
            state = STEP[role[:1]][state]
        yield role, text, edit


def _joined(batches):
    """One row for each conversation, from its pieces in order."""
    conv, began, last, state, cost, counts, audit, digest, empty = None, False, None, 0, 0, [0] * 4, [], sha256(), True

    def close():
        return batch(_RESULT, [conv], *([n] for n in counts), [cost], ["".join(audit)], [digest.hexdigest()])

    for b in batches:
        names = b.schema.names
        for row in zip(*(c.to_pylist() for c in b.columns)):
            r = dict(zip(names, row))
            if not began or r["conv_id"] != conv:
                if began:
                    yield close()
                conv, began, last, state, cost, counts, audit, digest, empty = r["conv_id"], True, None, 0, r["start_cost"], [0] * 4, [], sha256(), True
            counts = [n + r[c] for n, c in zip(counts, ("blank", "duplicate", "truncated", "illegal"))]
            if last is not None and last + r["first"] not in _LEGAL:
                counts[3] += 1
            last = r["last"]
            own = r["audits"][state]
            audit.append(own)
            for role, text, _ in _repaired(own, r["codes"], r["roles"], r["texts"], state):
                digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False
            state = r["exits"][state]
    if began:
        yield close()


def _traced(damaged: DataFrame) -> DataFrame:
    """The pieces with their audits."""
    pieces = pieces_of(damaged)
    several = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"))
    long = pieces.select("conv_id", "piece", "codes").join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    costs = table(long.mapInArrow(_matrices, "conv_id long, piece long, costs array<bigint>"))
    # sixteen numbers for each 4,096 rows of a conversation
    ends = table(costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(_suffixes, "own long, end array<bigint>, final boolean"))
    joined = pieces.join(ends, pieces["piece"] == ends["own"], "left").drop("own")
    return table(joined.mapInArrow(_traces, f"{PIECES}, end array<bigint>, final boolean, audits array<string>, exits array<bigint>, start_cost bigint"))


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of the rows (conv_id, turn, role, text) as they are: gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role and text, equal ones next to each other. Null
    roles and texts are one space; a role's initial is its first character, of an empty role none. Rows without
    conv_id are one conversation; other columns are not read; an empty table gives no rows. The digest of a
    conversation is one stream, as SHA-256 has it; audits of a conversation are one string."""
    return _report(_as_is(conversations), conversations)


def _report(damaged: DataFrame, conversations: DataFrame) -> DataFrame:
    turns = damaged.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    shown = _traced(damaged).drop("end", "final").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_joined, RESULT)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    as_of = lambda df, name: (df.withColumnRenamed("conv_id", name), F.col("conv_id").eqNullSafe(F.col(name)))
    (gaps, on_gaps), (shown, on_shown) = as_of(gaps, "of_gaps"), as_of(shown, "of_shown")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = ids.join(gaps, on_gaps, "left").join(shown, on_shown, "left")
    return joined.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """The repaired rows themselves: conv_id, place (0, 1, ...), role, text, edit (K, R or I)."""
    def render(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        conv, began, state, place = None, False, 0, 0
        for b in batches:
            for own, codes, roles, texts, audits, exits in zip(*(c.to_pylist() for c in b.columns)):
                if not began or own != conv:
                    conv, began, state, place = own, True, 0, 0
                made = list(_repaired(audits[state], codes, roles, texts, state))
                yield batch(schema, [own] * len(made), range(place, place + len(made)), *(zip(*made) if made else ([], [], [])))
                state, place = exits[state], place + len(made)

    ordered = _traced(_as_is(conversations)).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.select("conv_id", "codes", "roles", "texts", "audits", "exits").mapInArrow(render, "conv_id long, place long, role string, text string, edit string")


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return _report(damage(conversations), conversations)


def crc32_sql(key: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string."""
    step = "lambda x, i: xor(x >> 1, 3988292384 * (x & 1))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {step})))"


def _sql() -> str:
    """A plain dynamic programme forward over (cost, audit) of each state, by a recursive query."""
    add = lambda s, cost, letter: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}}"
    best = lambda *ways: f"list_min([{', '.join(ways)}])"
    when = lambda test, way: f"CASE WHEN {test} THEN {way} ELSE {{'c': 1000000000, 'a': ''}} END"
    one = f"s0, s1, {best('s2', *(add(s, 2, 'I') for s in ('s0', 's1', 's3')))} AS a2, {best('s3', add('s2', 2, 'I'))} AS a3"
    two = f"s0, s1, {best('a2', add('a3', 2, 'I'))} AS s2, {best('a3', add('a2', 2, 'I'))} AS s3"
    move = lambda s: (when("NOT forced", add(s, "2 + cut", "R")), when(f"NOT forced AND initial = '{'a' if s == 's2' else 'u'}'", add(s, "cut", "K")))
    new = [add("s0", 3, "D"), best(add("s1", 3, "D"), when("NOT forced AND initial = 's'", add("s0", "cut", "K"))), best(add("s2", 3, "D"), *move("s0"), *move("s1"), *move("s3")), best(add("s3", 3, "D"), *move("s2"))]
    white = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE c AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS own
    FROM c WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
e AS (
    SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^{white}]') AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           NOT regexp_matches(text, '[.!?][{white}]*$') AS unended
    FROM n),
r AS (
    SELECT *, blank OR again AS forced, (NOT blank AND NOT again AND unended)::INT AS cut,
           coalesce(lag(initial) OVER w || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
ways AS (
    SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': 1000000000, 'a': ''}} AS s1, {{'c': 1000000000, 'a': ''}} AS s2, {{'c': 1000000000, 'a': ''}} AS s3
    FROM (SELECT DISTINCT conv_id FROM r)
    UNION ALL
    SELECT conv_id, i, {", ".join(new)} FROM (
        SELECT conv_id, i, forced, cut, initial, {two} FROM (
            SELECT r.conv_id, r.i, forced, cut, initial, {one}
            FROM ways JOIN r ON r.conv_id IS NOT DISTINCT FROM ways.conv_id AND r.i = ways.i + 1))),
ended AS (
    SELECT conv_id, {best("s0", "s3")} AS s FROM (SELECT conv_id, {two} FROM (
        SELECT conv_id, {one} FROM ways QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))),
letters AS (SELECT conv_id, unnest(string_split(s.a, '')) AS l, generate_subscripts(string_split(s.a, ''), 1) AS k FROM ended WHERE s.a <> ''),
placed AS (
    SELECT *, count(*) FILTER (WHERE l <> 'I') OVER w AS i, count(*) FILTER (WHERE l <> 'D') OVER w AS place
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
made AS (
    SELECT p.conv_id, place, l, CASE WHEN l = 'K' THEN r.role END AS kept, CASE WHEN l = 'I' THEN '' ELSE r.text END AS text,
           bool_or(place = 1 AND l = 'K' AND r.initial = 's') OVER (PARTITION BY p.conv_id) AS opened
    FROM placed p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE l <> 'D'),
mended AS (
    SELECT conv_id, sha256(string_agg(coalesce(kept, CASE WHEN (place % 2 = 1) <> opened THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place)) AS repaired_sha256
    FROM made GROUP BY conv_id),
sums AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
           count(*) FILTER (WHERE again AND NOT blank) AS duplicate, sum(cut) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
    FROM r GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.c, 0)::BIGINT AS cost,
       coalesce(s.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN mended ON mended.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP11_SQL = _sql()
