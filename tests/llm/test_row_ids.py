"""The pipeline's stages on null and repeated doc_ids: each row is decided by itself."""

from __future__ import annotations

import corpus_pipeline as p


def test_copies_of_null_and_repeated_ids_go(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a b"), (None, "a b"), (None, "c"), (5, "d"), (5, "d"), (5, "e"), (None, "e"), (7, long), (7, long + " x"), (None, long + " y")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = p.drop_copies(spark, docs, "")
    got = sorted((str(r["doc_id"]), r["text"]) for r in exact.collect())
    assert got == sorted([("None", "a b"), ("None", "c"), ("5", "d"), ("5", "e"), ("7", long), ("7", long + " x"), ("None", long + " y")])
    near = [(str(r["doc_id"]), r["text"]) for r in p.drop_near_copies(spark, exact, "").collect()]
    assert len(near) == 5 and sum(i == "7" for i, _ in near) == 1
    assert p.mix_sources(spark, docs, "").columns == docs.columns


def test_toxic_rows_go_whatever_shares_their_id(spark, tmp_path):
    from test_edge_cases import labelled

    rows = labelled(50)
    spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, "vile scum filth " + rows[0][1]), (None, "w1 w2 w3 w4 w5")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(i, t) for i, t, _ in rows] + more], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["text"] for r in p.reject_toxic(spark, docs, str(tmp_path)).where("doc_id IS NULL").collect()] == [more[1][1]]
