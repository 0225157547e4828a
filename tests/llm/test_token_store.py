"""Shard files and their perfect hash index: round trips, odd rows, keys that span shards."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tapeloom.llm import registry, token_store


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, token_store.END_ID] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_every_document_by_key(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").toPandas().sort_values("doc_id")
    ids = ids_of(docs.text)
    starts = np.cumsum([0, *map(len, ids)])
    want = [(i, s, len(x), crc(x)) for i, s, x in zip(docs.doc_id, starts, ids)]
    got = registry.QUERIES["op13_token_store"](spark, f"{DATA}/sf0.001")
    assert sorted(map(tuple, got.collect())) == want


def test_perfect_hash():
    for n in (0, 1, 2, 63, 64, 65, 20_000):
        keys = token_store._key_hash(np.arange(n) * 7 - 3)
        made = token_store.PerfectHash.build(keys)
        assert sorted(made.slots(keys)) == list(range(n)) and made.size == n
    index = token_store.KeyIndex.build(np.arange(20_000), np.zeros(20_000, bool), np.stack([np.arange(20_000)] * 3, axis=1))
    index = token_store.KeyIndex.of(index.data())
    of, place = index.find(np.arange(-5000, 25_000), np.zeros(30_000, bool))
    assert (np.sort(of) == np.arange(5000, 25_000)).all() and (place[:, 0] == of - 5000).all()
    assert 8 * sum(x.nbytes for x in index.hash.levels) < 4 * 20_000  # bits a key, beside fingerprints


ODD = [(3, "a b"), (3, "a b"), (3, "c d e"), (None, "x"), (None, None), (-7, ""), (2**62, "long " * 30_000), (0, "é é"), *((9, "hot key") for _ in range(500))]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    """Nulls first, rows of one key each, a key over many shards, a text over many reads, clashing columns."""
    if small:
        monkeypatch.setattr(token_store, "SHARD_DOCS", 7)
        monkeypatch.setattr(token_store, "SHARD_BYTES", 5000)
        monkeypatch.setattr(token_store, "READ", 1000)
        monkeypatch.setattr(token_store, "BUCKET_KEYS", 2)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("shard", "name", "row", "ids", "n", "bucket", "entry", "kind")})
    store = token_store.write_store(docs)
    keys = spark.createDataFrame([(3,), (None,), (-7,), (2**62,), (0,), (9,), (4,), (10**12,)], "doc_id long")
    got = sorted(map(tuple, store.digests(keys).collect()), key=lambda r: r[1])
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [i for i, _ in want]
    lengths = {(i, crc(x), len(x)) for (i, _), x in zip(ODD, ids_of(t for _, t in ODD))}
    assert {(i, c, n) for i, _, n, c in got} == lengths
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert [r["input_ids"] for r in store.ids(spark.createDataFrame([(0,)], "doc_id long")).collect()] == ids_of(["é é"])
    assert store.digests(spark.createDataFrame([(5,)], "doc_id long")).count() == 0
    assert (store.shards.count() > 70) if small else store.shards.count() <= 4


def test_empty_table_and_broken_files(spark):
    empty = token_store.write_store(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.digests(spark.range(3).withColumnRenamed("id", "doc_id")).count() == 0
    store = token_store.write_store(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    name = f"{store.folder.removeprefix('file://')}/{store.shards.first()['name']}"
    data = open(name, "rb").read()
    assert np.frombuffer(data[: 2 * len(ids_of(["a b c"])[0])], "<u2").tolist() == ids_of(["a b c"])[0]  # raw ids from byte 0
    open(name, "wb").write(data[:-3])
    with pytest.raises(Exception, match="not a shard file"):
        store.digests(spark.createDataFrame([(1,)], "doc_id long")).collect()
