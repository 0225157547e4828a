"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import chat_format, common, embedding_dedup, exact_dedup, line_dedup, mixing, ngram_join, packing, sharding, substring_dedup, toxicity

LINE = "a line of twenty characters or more"
LONG = " ".join(f"w{i}" for i in range(40_000))
ODD = [(1, "a b"), (2, None), (3, ""), (4, "a  b"), (4, "a  b"), (None, "x\ty"), (5, LONG), (6, LONG), (7, "é" * 3), (None, None)]
CLASH = ["key", "n", "bucket", "digest", "size", "hub", "uid", "shard", "rank", "class", "hit", "text_sha256", "n_lines", "keep_id", "probability", "tokens", "at"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({c: F.lit("clash") for c in CLASH}).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})


OPERATORS = {
    "lines": line_dedup.dedup_lines,
    "exact": exact_dedup.exact_dedup,
    "pack": lambda d: packing.pieces(packing.pack(d)),
    "shard": sharding.shard_documents,
    "mix": mixing.mix,
    "substring": substring_dedup.dedup_substrings,
    "ngram": ngram_join.ngram_join,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(odd, name):
    got = OPERATORS[name](odd).collect()
    if name != "pack":
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD)
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_lines(spark):
    rows = [(1, f"{LINE}\nown\n{LINE.upper()} "), (2, f" {LINE}\nown"), (3, LINE), (None, LINE), (4, "short\nshort"), (5, None)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) for i in (1, 2, 3, 4, 5, None)] == [("own", 3, 2), ("own", 2, 1), (LINE, 1, 0), ("short\nshort", 2, 0), ("", 1, 0), (LINE, 1, 0)]


def test_filters_of_fewer_segments_than_shards(spark, monkeypatch):
    """Shards that share a segment, and a filter of few bits, change no result."""
    monkeypatch.setattr(common, "SEGMENTS", 4)
    monkeypatch.setattr(line_dedup, "TWICE_BITS", 1 << 10)
    monkeypatch.setattr(substring_dedup, "ANCHOR_BITS", 1 << 10)
    shared = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{LINE}\nown line of document number {i}\n{shared} own{i}") for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lines = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(d).collect()}
    assert lines == {i: int(i < 49) for i in range(50)}
    assert {r["n_removed"] for r in substring_dedup.dedup_substrings(d).collect()} == {40}


def test_exact_index_inserts_deletes_and_resizes(spark):
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % (n - 1)).cast("string")).alias("text"))
    index = exact_dedup.build_index(docs)
    live = lambda x: {(r["keep_id"], r["group_size"]) for r in x.live.collect()}
    assert live(index) == {(i, 2 if i == 0 else 1) for i in range(n - 1)}
    fewer = index.delete(spark.createDataFrame([(0,), (5,), (10**9,)], "doc_id long"))
    assert live(fewer) == {(n - 1 if i == 0 else i, 1) for i in range(n - 1) if i != 5}
    assert fewer.lookup(docs.where("doc_id = 5")).first()["keep_id"] is None
    again = fewer.insert(docs.where("doc_id IN (0, 5)"))
    assert live(again) == live(index)
    assert {r["keep_id"] for r in again.compact().lookup(docs.where("doc_id IN (0, 5, 7)")).collect()} == {0, 5, 7}


def test_exact_index_reads_stored_rows_on_hits_only(spark):
    """New texts miss the filters, but for a few false hits, and a full filter is made anew."""
    make = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    index = exact_dedup.build_index(make(0, 3000))
    added = exact_dedup._digests(make(3000, 9000), index.buckets).select("bucket", "digest", "doc_id").mapInArrow(exact_dedup._pre_aggregated, exact_dedup.ROW)
    kinds = {r["kind"]: r["count"] for r in index._run(added).groupBy("kind").count().collect()}
    assert kinds[exact_dedup.NEW] + kinds.get(exact_dedup.HIT, 0) == 6000 and kinds.get(exact_dedup.FULL)
    few = exact_dedup._digests(make(3000, 3400), index.buckets).select("bucket", "digest", "doc_id").mapInArrow(exact_dedup._pre_aggregated, exact_dedup.ROW)
    kinds = {r["kind"]: r["count"] for r in index._run(few).groupBy("kind").count().collect()}
    assert kinds[exact_dedup.NEW] >= 395
    more = index.insert(make(2000, 9000))
    assert {(r["keep_id"], r["group_size"]) for r in more.live.collect()} == {(i, 2 if 2000 <= i < 3000 else 1) for i in range(9000)}
    got = {r["doc_id"]: r["keep_id"] for r in more.lookup(make(8990, 9010)).collect()}
    assert got == {i: i if i < 9000 else None for i in range(8990, 9010)}
    left = more.delete(spark.range(0, 9000, 2).withColumnRenamed("id", "doc_id"))
    assert {r["keep_id"] for r in left.live.collect()} == set(range(1, 9000, 2))
    assert {r["keep_id"] for r in left.lookup(make(0, 50)).collect()} == {None, *range(1, 50, 2)}


def test_cuckoo_filter():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    f, held = exact_dedup.CuckooFilter(64), []
    for k in keys:
        held.append(k)
        if not f.add(k):
            f = f.resized(held)
    assert all(k in f for k in keys)
    for k in keys[::2]:
        f.remove(k)
    assert all(k in f for k in keys[1::2]) and sum(k in f for k in keys[::2]) < 50
    back = exact_dedup.CuckooFilter(data=f.data())
    assert all(k in back for k in keys[1::2])


def test_substrings_across_and_inside_documents(spark):
    rng = random.Random(1)
    words = lambda n, tag: [f"{tag}{rng.random()}" for _ in range(n)]
    shared, twice = words(35, "s"), words(40, "t")
    docs = {1: words(10, "a") + shared + words(7, "b"), 2: words(3, "c") + shared, 3: twice + words(5, "d") + twice, 4: words(9, "e") + shared[:34], 5: ["x"] * 40, 6: words(34, "f")}
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")).collect()}
    none = spark.createDataFrame([(None, " ".join(docs[6] + ["g"])), (7, " ".join(docs[6] + ["g", "h"]))], "doc_id long, text string")
    with_none = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(none).collect()}
    assert with_none == {None: " ".join(docs[6] + ["g"]), 7: "h"}
    kept = {1: docs[1][:10] + docs[1][45:], 2: docs[2][:3], 3: docs[3][40:45], 4: docs[4], 5: [], 6: docs[6]}
    assert {k: r["text"].split() for k, r in got.items()} == kept


def test_chats_fold_events_and_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\</s", "<s>\\<s>", "[\\INST]", "", "é\n", "<\\/s>"]
    for x in texts:
        made, *_ = chat_format.render(x, x)
        assert chat_format.parse(made) == (x, x)
        assert not any(c in chat_format.escape(x) for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    events = [(1, 0, 0, 1, "message", "user", "a"), (1, 1, 0, 2, "delta", "assistant", "b"), (1, 1, 0, 3, "delta", None, "c"), (1, 1, 0, 4, "regenerate", None, None), (1, 1, 0, 5, "delta", None, "d"),
              (1, 2, 0, 6, "message", "user", "gone"), (1, 2, 0, 7, "delete", None, None), (1, 0, 0, 8, "edit", None, "A"), (None, None, None, None, "message", None, None)]
    got = chat_format.format_chats(spark.createDataFrame(events, "conv_id long, turn long, part long, seq long, kind string, role string, text string").withColumn("formatted", F.lit(1)))
    assert sorted((r["conv_id"] or 0, *chat_format.parse(r["formatted"])) for r in got.collect()) == [(0, "", ""), (1, "assistant", "d"), (1, "user", "A")]
    d = {r["conv_id"]: r for r in chat_format.digests(got).collect()}
    assert (d[1]["n_turns"], d[1]["loss_chars"], d[1]["loss_sha256"]) == (2, 1, hashlib.sha256(b"d").hexdigest())
    assert chat_format.digests(chat_format.format_chats(spark.createDataFrame(events, "conv_id long, turn long, part long, seq long, kind string, role string, text string").limit(0))).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [2.0, 0.01]), (8, [1.0]), (None, [1.0, 0.0]), (9, [float("inf"), 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("rep", F.lit(2))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(d).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 7: (2, 1, False), None: (0, None, True), **{i: (0, i, True) for i in (3, 4, 5, 6, 8, 9)}}
    assert embedding_dedup.near_vectors(d.limit(0)).count() == 0


def test_ngrams_by_brute_force(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(150):  # one large family, and edits that put pairs on both sides of the threshold
        t = list(base)
        for _ in range(rng.randrange(0, 14)):
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        texts.append(" ".join(t))
    texts += ["one two three", "one two three", "one two", "", None, texts[0]]
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    links = np.array([[bool(a and b) and len(a & b) * 5 >= 4 * len(a | b) for b in sets] for a in sets])
    np.fill_diagonal(links, False)
    assert [got[i]["n_links"] for i in range(len(texts))] == links.sum(axis=1).tolist()
    label = np.arange(len(texts))
    while (new := np.minimum(label, np.where(links, label[None, :], 1 << 60).min(axis=1))).tolist() != label.tolist():
        label = new
    assert [got[i]["class_id"] for i in range(len(texts))] == label.tolist()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(5, 3), (3, 3), (100, 60), (7, 8)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 100: 10, 5: 3, 3: 3, 7: 7, 8: 7}


def test_sharding_splits_a_group_of_a_third_of_all_rows(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), F.floor(F.col("id") / 30).cast("string"))).otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_documents(docs).join(docs, "doc_id").toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    spread = got.groupby("text").shard.nunique()
    assert spread["hot"] <= 12 and (spread[spread.index.str.startswith("g")] > 1).mean() < 0.35


def test_sharding_cuts_few_links_and_stops(spark):
    """Cut edges against all pairs by hand, and against a start by hash; a second run moves nothing more."""
    rng = random.Random(12)
    links = [(u, u % 40) for u in range(400)] + [(u, 100 + rng.randrange(6)) for u in range(0, 400, 20)]
    d = spark.createDataFrame([(u, str(h).encode()) for u, h in links], "uid long, hub binary")
    sizes = {h: sum(1 for _, x in links if x == h) for _, h in links}
    sized = d.join(spark.createDataFrame([(str(h).encode(), n) for h, n in sizes.items()], "hub binary, size long"), "hub")
    placed = sharding.propagate(sized, [50] * 8, sharding.ROUNDS)
    shard = {r["uid"]: r["shard"] for r in placed.collect()}

    def cut(where):
        pairs = [(a, b) for a, ha in links for b, hb in links if a < b and ha == hb]
        return len(pairs), sum(where[a] != where[b] for a, b in pairs)

    got = sharding.cut_edges(placed).first()
    assert (got["edges"], got["cut"]) == cut(shard)
    start = {r["uid"]: r["s"] for r in d.select("uid", F.pmod(F.xxhash64("uid"), F.lit(8)).alias("s")).collect()}
    assert got["cut"] < 0.3 * cut(start)[1]
    balanced = sharding.balanced_shards(d.select("uid").distinct(), d, 8).toPandas()
    assert balanced.groupby("shard").size().tolist() == [50] * 8 and cut(dict(zip(balanced.uid, balanced["shard"])))[1] < 0.5 * cut(start)[1]


def test_mixing_meets_the_marginals(spark):
    rows = [(i, "w " * (10 + i % 50), ["en", "de", None][i % 3], f"s{i % 7 % 4}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("topic", F.when(F.col("doc_id") % 5 == 0, "a").otherwise("b"))
    got = mixing.mix(d, budget=0.4).toPandas()
    assert got.probability.between(0, 1).all()
    assert abs((got.probability * got.tokens).sum() / got.tokens.sum() - 0.4) < 1e-6
    want = got.groupby("lang", dropna=False).tokens.sum() ** mixing.LEVEL["lang"]
    have = (got.probability * got.tokens).groupby(got.lang, dropna=False).sum()
    assert np.allclose((want / want.sum()).sort_values().to_numpy(), (have / have.sum()).sort_values().to_numpy(), rtol=0.02)


def test_mixing_to_given_targets(spark):
    rows = [(i, "w " * (10 + i % 50), ["en", "de", None][i % 3], f"s{i % 7 % 4}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("topic", F.when(F.col("doc_id") % 5 == 0, "a").otherwise("b"))
    targets = {"lang": {"en": 0.5, "": 0.2}, "topic": {"a": 0.4, "b": 0.6}}
    cells = mixing.rake(mixing.mix(d).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), targets=targets).toPandas()
    share = lambda c: (cells.groupby(c, dropna=False).weight.sum() / cells.weight.sum()).to_dict()
    lang = {k if isinstance(k, str) else "": v for k, v in share("lang").items()}
    assert {k: round(v, 6) for k, v in lang.items()} == {"en": 0.5, "": 0.2, "de": 0.3}
    assert {k: round(v, 6) for k, v in share("topic").items()} == {"a": 0.4, "b": 0.6}
    want = cells.groupby("source").tokens.sum() ** mixing.LEVEL["source"]
    assert np.allclose(sorted(want / want.sum()), sorted(share("source").values()), rtol=1e-6)
    got = mixing.mix(d, budget=0.4, targets=targets).toPandas()
    assert abs((got.probability * got.tokens).sum() / got.tokens.sum() - 0.4) < 1e-6


def test_toxicity_without_labels_and_nearest_is_exact(spark, odd):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, none).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got}) == 1
    assert toxicity.score_toxicity(odd.limit(0), none).count() == 0
    rng = np.random.default_rng(3)
    sets = [rng.choice(50, k, replace=False) for k in rng.integers(1, 6, 700)] + [np.append(rng.choice(5, 2, replace=False), 50 + k % 40) for k in range(700)]
    vectors = [np.stack([np.sort(x), rng.integers(1, 5, len(x))], axis=1).astype(np.int32).tobytes() for x in sets]
    idf = np.append(rng.random(90) + 1, 3.0)
    index = toxicity.Index(idf, np.zeros(90, bool), pa.table({"doc_id": range(1400), "toxic": rng.integers(0, 2, 1400), "vector": vectors}))
    assert index.is_common.sum() > 3
    distinct = sorted((np.frombuffer(v, np.int32) for v in set(vectors)), key=lambda v: index.place[toxicity._digest(v)])
    full = np.zeros((len(distinct), 90))
    for i, v in enumerate(distinct):
        t, w = index.weigh(v)
        full[i, t] = w
    for q in range(0, len(distinct), 40):
        best, score = index.nearest(*index.weigh(distinct[q]))
        want = np.minimum(full @ full[q], 1)
        least = np.sort(want)[::-1][14]
        assert len(best) >= 15 and np.allclose(score, np.sort(want[want >= least - 5e-7])[::-1], atol=1e-5)
        assert np.allclose(want[best], score, atol=1e-5)


def labelled(toxic_share: int):
    """240 texts of 30 common words, every toxic one with three insults, and their labels."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        words = [f"w{rng.randrange(300)}" for _ in range(30)]
        bad = i % 100 < toxic_share
        for _ in range(3 * bad):
            words[rng.randrange(30)] = rng.choice(["vile", "scum", "filth"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.mark.parametrize("share", [12, 50, 80])
def test_toxicity_does_not_depend_on_the_balance_of_labels(spark, share):
    d = spark.createDataFrame(labelled(share), "doc_id long, text string, toxic int")
    got = toxicity.score_toxicity(d, d.select("doc_id", "toxic")).join(d.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got.predicted == got.toxic)[got.held_out].mean() > 0.95 and got.score.nunique() > 1


def test_toxicity_weighs_all_words(spark):
    rows = labelled(12)
    insult, clean = next(r for r in rows if r[2]), next(r for r in rows if not r[2])
    new = [(1000, "vile " + " ".join(f"w{i}" for i in range(300))), (1001, clean[1]), (1002, "vile " + " ".join(f"unseen{i}" for i in range(20_000)))]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + new, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")).collect()}
    assert max(e["cosine"] for e in got[1000]["evidence"]) < 0.99  # a long text that quotes one insult is not the insult
    assert max(e["cosine"] for e in got[1002]["evidence"]) < 0.5  # nor where no example has its other words
    assert got[insult[0]]["predicted"] == 1
    assert len(got[1001]["evidence"]) == 15 and (clean[0], 1.0) in [(e["doc_id"], round(e["cosine"], 6)) for e in got[1001]["evidence"]]


def test_encoder_on_odd_characters():
    from tokenizers import Tokenizer

    from tapeloom.llm.texts import slices

    t, rng = Tokenizer.from_file(packing.default_tokenizer()), random.Random(4)
    parts = ["A", "b", " ", "\n", ".", ",", "'s", "'", "é", "É", "×", "3", "Σ", "İ", "́", "J̌", "<|endoftext|>", "<|EndOfText|>", "\x1c", "\xa0", "中", "😀"]
    for pool in (parts, [x for x in parts if "<|" not in x and "́" not in x and "̌" not in x]):
        texts = ["".join(rng.choices(pool, k=rng.randrange(50))) for _ in range(500)]
        for i, j, data, offs in slices(pa.array(texts)):
            got = packing.Encoder.of(packing.default_tokenizer()).encode(data, offs)
            assert [np.frombuffer(x, "<u2").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts[i:j]]


def test_sequences_join_boundary_records(spark):
    from tokenizers import Tokenizer

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word and more "), (F.col("id") % 200).cast("int")).alias("text")).repartition(7)
    records = packing.records(docs)
    assert records.where("NOT complete").count() > 7
    made = packing.pack(docs).toPandas().sort_values("sequence_id")
    assert made.sequence_id.tolist() == list(range(len(made)))
    assert all(len(x) == 2048 or len(x) & (len(x) - 1) == 0 for x in made.input_ids)
    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r["doc_id"]: [*t.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}
    stream = [x for row in made.itertuples() for x in row.input_ids[: row.n_tokens]]
    want = [x for row in made.itertuples() for p in row.pieces for x in ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]]
    assert stream == want and len(stream) == sum(map(len, ids.values()))


def test_packing_with_a_cased_tokenizer():
    """A tokenizer that tells cases apart, or works across spaces, is given whole texts."""
    import json
    import pathlib

    from tokenizers import Tokenizer

    from tapeloom.llm.texts import slices

    path = next((str(p) for p in sorted(pathlib.Path(packing.default_tokenizer()).parent.glob("*.json")) if _cased(json, p)), None)
    if path is None:
        pytest.skip("no cased tokenizer here")
    texts, t = ["The Cat. the cat", "A b\nC", ""], Tokenizer.from_file(path)
    for i, j, data, offs in slices(pa.array(texts)):
        assert [np.frombuffer(x, "<u2").tolist() for x in packing.Encoder(path).encode(data, offs)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def _cased(json, path) -> bool:
    made = json.loads(path.read_text())
    return "model" in made and "Lowercase" not in json.dumps(made.get("normalizer")) and len(made["model"].get("vocab", ())) <= 1 << 16
