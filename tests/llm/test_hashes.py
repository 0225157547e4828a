"""Words and texts in the Thue-Morse pattern, which meet under any polynomial modulo a power of two."""

from __future__ import annotations

from tapeloom.llm import ngram_join, substring_dedup


def thue_morse(n: int, one: str, two: str) -> tuple[str, str]:
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((one, two)[x] for x in bits), "".join((two, one)[x] for x in bits)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_long_words_are_told_apart(spark):
    w1, w2 = thue_morse(2048, "a", "b")
    rest = " ".join(f"x{i}" for i in range(34))
    got = substring_dedup.dedup_substrings(frame(spark, [f"{w1} {rest}", f"{w2} {rest}", f"{w1} y {rest}"])).collect()
    assert [r["n_removed"] for r in got] == [0, 0, 0]
    got = ngram_join.ngram_join(frame(spark, [f"{w1} p q", f"{w2} p q", f"{w1} p q"])).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {0: (0, 1), 1: (1, 0), 2: (0, 1)}


def test_patterns_of_words_are_told_apart(spark):
    one, two = thue_morse(2048, "a ", "b ")
    got = substring_dedup.dedup_substrings(frame(spark, [" ".join(t.split()[:35]) for t in (one, two)])).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
    got = ngram_join.ngram_join(frame(spark, [one, two])).collect()  # sets of runs of five words are equal
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 1)}
