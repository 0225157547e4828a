"""Shuffles by shards and buckets: how many there are of these changes neither results nor, beyond a bound, partitions."""

from __future__ import annotations

import pytest

from conftest import DATA
from tapeloom.llm import common, exact_dedup, line_dedup, substring_dedup


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_partitions_are_bounded(spark):
    def count(df):
        return df._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions()

    few, many = (common.dealt(spark.range(10), groups, "id") for groups in (5, 10**9))
    assert (count(few), count(many)) == (5, common.MOST_PARTITIONS)


@pytest.mark.parametrize("module, run", [(line_dedup, line_dedup.op1_line_dedup), (exact_dedup, exact_dedup.op2_exact_dedup), (substring_dedup, substring_dedup.op8_substring_dedup)])
def test_very_many_shards_in_few_partitions(spark, monkeypatch, module, run):
    want = rows(run(spark, f"{DATA}/sf0.001"))
    monkeypatch.setattr(common, "MOST_PARTITIONS", 8)
    monkeypatch.setattr(module, "shards_for", lambda *_: 100_000)
    assert rows(run(spark, f"{DATA}/sf0.001")) == want


def test_index_of_very_many_buckets_changes_in_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_PARTITIONS", 3)
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    index = exact_dedup.ExactIndex(100_000).insert(docs.where("doc_id < 60")).insert(docs.where("doc_id >= 60"))
    index = index.delete(docs.where("doc_id % 40 = 7 OR doc_id = 3").select("doc_id"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in index.lookup(docs).collect()}
    for i in range(100):
        left = [k for k in range(i % 40, 100, 40) if k % 40 != 7 and k != 3]
        assert got[i] == ((min(left), len(left)) if left else (None, None))
