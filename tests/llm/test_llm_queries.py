"""The numbered queries and the pipeline against SQL, brute force, round trips and held-out labels."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pytest

from conftest import DATA, plain
from tapeloom.llm import registry

SF = "sf0.001"


def run(spark, name, sf=SF):
    return registry.QUERIES[name](spark, f"{DATA}/{sf}").toPandas()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/{SF}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, oracle, name):
    assert plain(run(spark, name)) == plain(oracle(registry.SQL[name], SF))


def token_ids(texts):
    from tokenizers import Tokenizer

    from tapeloom.llm.packing import default_tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check_pieces(got, ids):
    assert got.length.sum() == sum(map(len, ids.values()))
    for p in got.itertuples():
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert (zlib.crc32(own.tobytes()), len(own), len(ids[p.doc_id])) == (p.ids_crc32, p.length, p.doc_tokens)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert list(sizes.index) == list(range(len(sizes))) and (sizes[:-1] == 2048).all() and sizes.iloc[-1] <= 2048
    order = got.sort_values(["doc_id", "start"])
    assert (order.groupby("doc_id").length.cumsum() - order.length == order.start).all()


def test_packing(spark, documents):
    check_pieces(run(spark, "op3_packing"), dict(zip(documents.doc_id, token_ids(documents.text))))


def test_toxicity_on_held_out_labels(spark):
    got = run(spark, "op4_toxicity", "sf0.1")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels.dropna(subset=["toxic"]), on="doc_id")
    bad, good = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = (bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2
    assert auc > 0.9 and (held[held.toxic == 0].predicted == 0).mean() > 0.98


def test_sharding(spark, documents):
    got = run(spark, "op5_sharding", "sf0.01")
    sizes = got.groupby("shard").size()
    assert list(sizes.index) == list(range(16)) and sizes.max() - sizes.min() <= 1
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    groups = got.groupby("text_crc32").agg(n=("doc_id", "size"), shards=("shard", "nunique"))
    assert (groups[groups.n > 1].shards == 1).all()  # no group is larger than a shard here


def brute_components(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(links, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("hot", [False, True])
def test_embeddings(spark, tmp_path, hot):
    """Against brute force; hot: with a large group of near vectors and one of equal vectors."""
    rows = spark.read.parquet(f"{DATA}/{SF}/embeddings.parquet").toPandas()
    if hot:
        rng, dim = np.random.default_rng(6), len(rows.embedding[0])
        one, two = rng.standard_normal(dim), rng.standard_normal(dim)
        more = [*(one + 0.02 * rng.standard_normal((700, dim))), *([two] * 700)]
        rows = pd.concat([rows, pd.DataFrame({"vec_id": np.arange(len(more)) + 10**6, "embedding": [x.astype(np.float32).tolist() for x in more], "label": 0})])
        rows["embedding"] = [list(map(float, x)) for x in rows.embedding]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
        got = registry.QUERIES["op6_embedding_dedup"](spark, str(tmp_path)).toPandas().sort_values("vec_id")
    else:
        got = run(spark, "op6_embedding_dedup").sort_values("vec_id")
    rows = rows.sort_values("vec_id")
    v = np.stack(rows.embedding.to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = v @ v.T >= 0.95
    np.fill_diagonal(links, False)
    assert (got.n_links.to_numpy() == links.sum(axis=1)).all()
    assert (got.component_id.to_numpy() == brute_components(links, rows.vec_id.to_numpy())).all()


def test_pipeline_stages(spark, oracle):
    import corpus_pipeline as p
    from tapeloom.llm.common import table
    from tapeloom.llm.mixing import mix_sql

    docs, before = spark.read.parquet(f"{DATA}/{SF}/documents.parquet"), None
    for name, stage in p.STAGES:
        before, docs = docs, table(stage(spark, docs, f"{DATA}/{SF}"))
        was, now = before.toPandas(), docs.toPandas()
        if name == "toxicity":
            scored = run(spark, "op4_toxicity")
            assert set(now.doc_id) == set(scored[scored.predicted == 0].doc_id)
        elif name == "exact dedup":
            key = was.text.fillna("").str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)
            assert set(now.doc_id) == set(was.groupby(key).doc_id.min())
        elif name == "n-gram Jaccard join":
            sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").encode().split()) else set() for t in was.text]
            links = np.array([[bool(a and b) and len(a & b) * 5 >= 4 * len(a | b) for b in sets] for a in sets])
            label = brute_components(links, was.doc_id.to_numpy())
            assert set(now.doc_id) == set(was.doc_id[label == was.doc_id])
        elif name == "mixing":
            import duckdb

            con = duckdb.connect()
            con.register("kept", was)
            assert set(now.doc_id) == set(con.execute(f"WITH {mix_sql('kept')} SELECT doc_id FROM mixed WHERE sampled").df().doc_id)
        else:
            check_pieces(now, dict(zip(was.doc_id, token_ids(was.text))))
        if name != "packing":
            assert list(now.columns) == list(was.columns)
    assert plain(p.run(spark, f"{DATA}/{SF}").toPandas()[["doc_id", "start", "length", "ids_crc32"]]) == plain(docs.toPandas()[["doc_id", "start", "length", "ids_crc32"]])
