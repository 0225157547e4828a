"""The pipeline's stages on nulls, empty, long and repeated rows, ties, clashing columns, and no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

LONG = " ".join(f"w{i}" for i in range(20_000))
ROWS = [(1, "a b"), (1, "a b"), (2, "a  b"), (3, None), (4, ""), (None, None), (None, "x y z"), (5, LONG), (6, LONG + " end"), (7, "é" * 3), (8, "a b")]
#: What each stage does to ROWS: the doc_ids and texts that stay, with white space as it was.
KEPT = {
    "toxicity": ROWS,
    "exact dedup": [(1, "a b"), (3, None), (None, "x y z"), (5, LONG), (6, LONG + " end"), (7, "é" * 3)],
    "n-gram Jaccard join": [(1, "a b"), (3, None), (4, ""), (None, None), (None, "x y z"), (5, LONG), (7, "é" * 3)],
}


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    spark.createDataFrame([(i, 0) for i in (1, 2, 5, 7, 8)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = {c: F.lit("c") for c in ("_row", "_group", "digest", "n", "class", "kept", "bucket", "first", "own_id", "tokens", "probability", "score")}
    return rows.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")} | clash)


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stage_on_odd_rows(spark, docs, place, name, stage):
    got = stage(spark, docs, place)
    if name in KEPT:
        key = lambda x: tuple(map(str, x))
        assert sorted(map(key, got.select("doc_id", "text").collect())) == sorted(map(key, KEPT[name]))
    if name == "packing":
        assert got.groupBy("doc_id").count().count() == len({i for i, _ in ROWS})
    else:
        assert got.columns == docs.columns
        if name == "mixing":
            drawn = {(r["doc_id"], r["text"]) for r in got.collect()}
            assert drawn <= set(ROWS) and got.where("doc_id = 1").count() in (0, 2)
    assert stage(spark, docs.limit(0), place).count() == 0


def test_results_live_side_by_side(spark, docs, place, tmp_path):
    """A stage called again, on other rows, or tried anew, leaves earlier results as they are; so does a second run."""
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    files = spark.read.parquet(f"{tmp_path}/docs")
    first = p.drop_copies(spark, files, place)
    other = p.drop_copies(spark, files.where("doc_id = 1"), place)
    again, near = p.drop_copies(spark, files, place), p.drop_near_copies(spark, files, place)
    assert (first.count(), other.count(), again.count(), near.count()) == (6, 1, 6, 7)
    assert first.exceptAll(again).count() == 0
    sf = "/root/testdata/sf0.001"
    one, two = p.run(spark, sf), p.run(spark, sf)
    assert one.count() == two.count() > 100


def test_a_column_of_the_number_is_an_error(spark, docs, place):
    with pytest.raises(ValueError, match="no column may be named"):
        p.drop_copies(spark, docs.withColumn(p.ROW, F.lit(1)), place)


def test_numbers_stay(spark, docs, tmp_path):
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    files = p._numbered(spark.read.parquet(f"{tmp_path}/docs"))
    one = {(r["doc_id"], r["text"], r[p.ROW]) for r in files.collect()}
    two = {(r["doc_id"], r["text"], r[p.ROW]) for r in files.repartition(5).collect()}
    assert one == two and len({x[2] for x in one}) == len(ROWS) == len(one)
