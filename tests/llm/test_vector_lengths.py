"""Vectors of several lengths in one table."""

from __future__ import annotations

from tapeloom.llm import embedding_dedup


def test_vectors_link_within_each_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.02]), (6, [1.0, 0.0, 0.0, 0.0]), (7, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), 7: (0, 7, True)}
