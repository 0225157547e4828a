"""A corpus pipeline of five stages, each one of the operators over all documents it is given.

A stage numbers the rows it is given, and decides each by itself: rows that share a doc_id, or have none,
are rows of their own. Null texts count as empty. An empty table gives an empty table. Columns of documents
are kept as they are, whatever their names, but for ROW, which no column may have.

A stage deletes the tables that it has made on the way; its result reads its own input and a table of the
numbers of the rows that stay, which is no one else's. So results can be written in any order, again, or
side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import release, table, tables_within
from tapeloom.llm.exact_dedup import exact_dedup
from tapeloom.llm.mixing import mix
from tapeloom.llm.ngram_join import ngram_join
from tapeloom.llm.packing import pack, pieces
from tapeloom.llm.toxicity import score_toxicity

ROW = "_number_of_the_row"
FILE, INDEX = f"{ROW}_file", f"{ROW}_index"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row that stays the same however often it is read: the place in its file, where docs
    is files as they are, which copies nothing; else docs is written first."""
    for name in (ROW, FILE, INDEX):
        if name in docs.columns:
            raise ValueError(f"no column may be named {name}")
    scan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if not scan or "_metadata" in docs.columns:
        docs = table(docs)
        if "_metadata" in docs.columns:
            return table(docs.withColumn(ROW, F.monotonically_increasing_id()))
    placed = docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(INDEX))
    # a row for each file
    files = table(placed.select(FILE).distinct().select(FILE, F.row_number().over(Window.orderBy(FILE)).cast("long").alias(ROW)))
    return placed.join(files, FILE).withColumn(ROW, F.col(ROW) * F.lit(1 << 40) + F.col(INDEX)).select(*(F.col(f"`{c}`") for c in docs.columns), ROW)


def _staying(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of the numbered docs whose numbers decide(docs) has; its tables are deleted when they are known."""
    with tables_within() as made:
        rows = table(decide(docs).select(ROW))
        release(docs.sparkSession, made[:-1])
        del made[:-1]
    return _stay(docs, rows)


def _stay(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of the numbered docs whose number is in rows, which holds each once; joined in the same way however
    few the rows are."""
    return docs.join(rows.select(ROW).hint("merge"), ROW, "left_semi").drop(ROW)


def _first(docs: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """The number of each group's row of the smallest (doc_id, number), null doc_ids last; groups has
    the numbers as doc_id."""
    ids = docs.select(ROW, F.col("doc_id").cast("long").alias("own_id"))
    order = F.struct(F.col("own_id").isNull().alias("none"), "own_id", ROW)
    named = groups.select(F.col("doc_id").alias(ROW), F.col(group).alias("_group")).join(ids, ROW)
    return named.groupBy("_group").agg(F.min(order).alias("first")).select(f"first.{ROW}")


def _by_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(ROW).alias("doc_id"), "text")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Empty texts score as empty examples do; without labels of
    both kinds all have one score, and stay unless that reaches the mark."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _staying(_numbered(docs), lambda d: score_toxicity(d, labels, row=ROW).where("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id, of each group of equal texts; of several such rows, the first.
    Null and empty texts are one group."""
    return _staying(_numbered(docs), lambda d: _first(d, exact_dedup(_by_row(d)), "keep_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id, of each group of near copies. Texts without words are no copies
    of each other here."""
    return _staying(_numbered(docs), lambda d: _first(d, ngram_join(_by_row(d)), "class_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture draws; rows that share a doc_id and a cell are drawn alike."""
    docs = _numbered(docs)
    own = [c for c in (ROW, "doc_id", "text", "lang", "source", "topic") if c in docs.columns]
    return _staying(docs, lambda d: mix(d.select(*own), row=ROW).where("sampled"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in the packed sequences; an empty text is one token."""
    with tables_within() as made:
        out = pieces(pack(docs))  # reads the last table only
        release(spark, made[:-1])
        del made[:-1]
    return out


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]
#: The scores and the tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each on what the one before has left, written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        with tables_within() as made:
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = table(docs)
                release(spark, made[:-1])
                del made[:-1]
        release(spark, last)
        last = list(made)
    return docs
