"""Mixing sources to target weights, with DataFrame functions only.

Documents are summed to cells (source, lang, topic) once. Iterative proportional fitting rakes the
cells' token weights to a target share of each value of each dimension, until all of them are met; then
a rate is found at
which min(1, rate x weight / tokens) keeps the budgeted share of all tokens on average, and each
document is kept or not by comparing that probability with a number made from its doc_id. Only the
table of cells is raked; the documents meet it in one join, broadcast by Spark where it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import table

#: How strongly each dimension is levelled where no targets are given: its target shares are its token
#: shares to this power.
LEVEL = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of the tokens that is kept. Rounds between two looks at how far the sums are from the targets,
#: how far they may be, relatively, and rounds at most.
BUDGET, ROUNDS, NEAR, MOST_ROUNDS = 0.6, 8, 1e-10, 80
RATE_ROUNDS = 8
#: The class of a text by the first marker it contains; else prose.
TOPICS = {"contact": ["@", "://"], "legal": ["icense", "opyright"], "table": [" | ", "\t"]}
SPACE = r"\x20\x09-\x0D"


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, marks in reversed(TOPICS.items()):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(text, F.lit(mark))
        out = F.when(hit, name).otherwise(out)
    return out


def _goals(cells: DataFrame, level: dict[str, float], targets: dict[str, dict]) -> DataFrame:
    """cells with goal_<dimension>: the tokens that its value shall have in all."""
    over = {d: F.sum("tokens").over(Window.partitionBy(d)) for d in level}
    given = {d: F.create_map(*(F.lit(x) for k, v in t.items() for x in (k, float(v)))) for d, t in targets.items() if t}
    named = cells.withColumns({f"given_{d}": F.try_element_at(m, F.coalesce(F.col(d), F.lit(""))) for d, m in given.items()})
    free = named.agg(F.lit(0), *(F.sum(F.when(F.col(f"given_{d}").isNull(), F.col("tokens")).otherwise(0.0)).alias(d) for d in given)).first() if given else {}
    goals = {d: F.pow(over[d], F.lit(level[d])) if d not in given else F.coalesce(F.col(f"given_{d}"), over[d] / F.lit(free[d] or 1.0) * max(0.0, 1 - sum(map(float, targets[d].values())))) for d in level}
    raw = table(named.withColumns({f"goal_{d}": g for d, g in goals.items()} | {f"part_{d}": F.col("tokens") / over[d] for d in level}))
    sums = raw.agg(F.sum("tokens").alias("total"), *(F.sum(F.col(f"goal_{d}") * F.col(f"part_{d}")).alias(d) for d in level)).first()
    scaled = {f"goal_{d}": F.col(f"goal_{d}") / F.lit(sums[d] or 1.0) * F.lit(sums["total"] or 0.0) for d in level}
    return raw.withColumns(scaled).select(*level, "tokens", *scaled)


def rake(cells: DataFrame, level: dict[str, float] = LEVEL, targets: dict[str, dict] | None = None) -> DataFrame:
    """cells (the dimensions, tokens) with weight, whose sums over each value of each dimension come to
    the targets; the total stays the tokens' total. targets: shares of values by dimension ("" stands for
    null); values not named share what is left by their tokens; dimensions not named are levelled."""
    goals = table(_goals(cells.withColumn("tokens", F.col("tokens").cast("double")), level, targets or {}))
    out, done = goals.withColumn("weight", F.col("tokens")), 0
    while done < MOST_ROUNDS:
        for _ in range(ROUNDS):
            for d in level:
                held = F.sum("weight").over(Window.partitionBy(d))
                out = out.withColumn("weight", F.when(held > 0, F.col("weight") * (F.col(f"goal_{d}") / held)).otherwise(0.0))
        out, done = table(out), done + ROUNDS
        seen = out.withColumns({f"off_{d}": F.abs(F.sum("weight").over(Window.partitionBy(d)) / F.nullif(F.col(f"goal_{d}"), F.lit(0.0)) - 1) for d in level})
        most = seen.agg(*(F.coalesce(F.max(f"off_{d}"), F.lit(0.0)) for d in level)).first()
        if max(most) < NEAR:
            break
    return out.select(*level, "tokens", "weight")


def rate_of(cells: DataFrame, budget: float, rounds: int = RATE_ROUNDS) -> float:
    """The rate at which the cells keep `budget` of their tokens: cells that reach 1 stay there and
    the others make up the rest. One row a round comes to the driver."""
    rate = None
    for _ in range(rounds):
        full = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) >= F.col("tokens")
        r = cells.agg(F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not r["all"]:
            return 0.0
        if r["free"] > 0:
            rate = (budget * r["all"] - r["held"]) / r["free"]
    return rate


def mix(docs: DataFrame, level: dict[str, float] = LEVEL, budget: float = BUDGET, row: str | None = None, targets: dict[str, dict] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, sampled: a row for each row of docs.

    tokens: words plus one, so no document weighs nothing. Null text is empty; null source, lang or
    doc_id are values of their own; a doc_id that repeats is decided alike. A topic column of docs
    is used where there is one, else the text's class. targets: see rake; targets that contradict each
    other, or name no value that is there, are met as nearly as the rounds come. Other columns are not
    read, but for `row`, if named, which each row of docs keeps; no rows, no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(text)
    words = F.regexp_count(text, F.lit(f"[^{SPACE}]+"))
    kept = [row] if row else []
    rows = table(docs.select(*kept, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic.alias("topic"), (words + 1).cast("long").alias("tokens")))
    cells = rake(rows.groupBy(*level).agg(F.sum("tokens").alias("tokens")), level, targets)
    chance = F.least(F.lit(1.0), F.lit(rate_of(cells, budget)) * F.col("weight") / F.col("tokens"))
    cells = cells.select(*(F.col(d).alias(f"cell_{d}") for d in level), chance.alias("probability"))
    same = [F.col(d).eqNullSafe(F.col(f"cell_{d}")) for d in level]
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)
    return rows.join(cells, same).select(*kept, "doc_id", "source", "lang", "topic", "tokens", "probability", (draw < F.col("probability")).alias("sampled"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return mix(docs).withColumn("probability", F.round("probability", 6))


def mix_sql(documents: str = "documents", level: dict[str, float] = LEVEL, budget: float = BUDGET) -> str:
    """CTEs `mixed` with mix()'s rows (probability not rounded), each round written out."""
    quoted = lambda m: "'" + m.replace("\t", "' || chr(9) || '") + "'"
    topic = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(coalesce(text, ''), {quoted(m)})" for m in marks) + f" THEN '{name}'" for name, marks in TOPICS.items()) + " ELSE 'prose' END"
    dims = ", ".join(level)
    out = [
        f"classed AS (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) + 1 AS tokens FROM {documents})",
        f"cells AS (SELECT {dims}, sum(tokens)::DOUBLE AS tokens FROM classed GROUP BY ALL)",
        "goals AS (SELECT *, tokens AS weight, " + ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}), {p}) AS goal_{d}, tokens / sum(tokens) OVER (PARTITION BY {d}) AS part_{d}" for d, p in level.items()) + " FROM cells)",
        "scale AS (SELECT sum(tokens) AS total, " + ", ".join(f"sum(goal_{d} * part_{d}) AS sum_{d}" for d in level) + " FROM goals)",
        "r0 AS (SELECT * FROM goals, scale)",
    ]
    rounds = 5 * ROUNDS  # as many as the rows of the oracle need to meet the targets
    for k, d in enumerate(list(level) * rounds):
        out.append(f"r{k + 1} AS (SELECT * REPLACE (weight * (goal_{d} / sum_{d} * total / sum(weight) OVER (PARTITION BY {d})) AS weight) FROM r{k})")
    last = f"r{len(level) * rounds}"
    out.append("q0 AS (SELECT NULL::DOUBLE AS rate)")
    for k in range(RATE_ROUNDS):
        full = "coalesce(weight * rate >= tokens, false)"
        out.append(f"q{k + 1} AS (SELECT coalesce(({budget} * sum(tokens) - sum(CASE WHEN {full} THEN tokens ELSE 0 END)) / nullif(sum(CASE WHEN {full} THEN 0 ELSE weight END), 0), max(rate)) AS rate FROM {last}, q{k})")
    same = " AND ".join(f"c.{d} IS NOT DISTINCT FROM w.{d}" for d in level)
    out.append(f"mixed AS (SELECT c.*, least(1.0, rate * w.weight / w.tokens) AS probability, ('0x' || substr(md5(coalesce(c.doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(16**13)} < least(1.0, rate * w.weight / w.tokens) AS sampled FROM classed c JOIN {last} w ON {same}, q{RATE_ROUNDS})")
    return ",\n".join(out)


OP7_SQL = f"WITH {mix_sql()}\nSELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, sampled FROM mixed"
