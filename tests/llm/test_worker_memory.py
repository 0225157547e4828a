"""What a worker keeps from task to task goes when it goes on to other work."""

from __future__ import annotations

import pyarrow as pa
import pytest

from tapeloom.llm import packing, token_store, toxicity
from conftest import DATA


def _held(kinds: set[str]):
    def run(batches):
        import gc

        n = sum(b.num_rows for b in batches)
        found = [type(x).__name__ for x in gc.get_objects() if type(x).__name__ in kinds and type(x).__module__.startswith("tapeloom.")]
        yield pa.record_batch([pa.array([",".join(found)]), pa.array([n])], names=["found", "n"])

    return run


def held(spark) -> list[str]:
    """What tasks of another function see of indexes and encoders in their workers."""
    rows = spark.range(0, 64, 1, 16).mapInArrow(_held({"Index", "Encoder", "Known"}), "found string, n long").collect()
    assert sum(r["n"] for r in rows) == 64
    return [r["found"] for r in rows if r["found"]]


@pytest.mark.parametrize("work", ["toxicity", "packing", "token store"])
def test_workers_keep_nothing_for_other_work(spark, work):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    if work == "toxicity":
        assert toxicity.score_toxicity(docs, labels).count() == docs.count()
    elif work == "packing":
        assert packing.pack(docs).count()
    else:
        assert token_store.op13_token_store(spark, f"{DATA}/sf0.001").count() == docs.count()
    assert held(spark) == []


def test_an_encoder_is_shared_while_held():
    path = packing.default_tokenizer()
    lent, other = packing.Lent(path), packing.Lent(path)
    assert lent.encoder is lent.encoder is other.encoder is packing.Encoder.of(path)
