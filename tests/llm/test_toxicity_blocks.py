"""Blocks hold like examples, and many texts are searched at once with the same neighbours as one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tapeloom.llm import toxicity as t


def index(n: int = 1200):
    """Examples of two languages with no word in common, in turn, whose lengths are alike."""
    rng = np.random.default_rng(7)
    sets = [np.sort(rng.choice(40, 12, replace=False)) + 40 * (k % 2) for k in range(n)] + [np.array([80 + k % 50]) for k in range(100)]
    vectors = [np.stack([x, rng.integers(1, 4, len(x))], axis=1).astype(np.int32).tobytes() for x in sets]
    surer = np.isin(np.arange(130), [3, 50, 100])
    examples = pa.table({"doc_id": range(len(sets)), "toxic": rng.integers(0, 2, len(sets)), "vector": vectors})
    return t.Index(np.append(rng.random(130) + 1, 3.0), surer, examples), [np.frombuffer(v, np.int32) for v in vectors]


def test_blocks_hold_like_examples():
    own, _ = index(6000)
    own._bound()
    words = np.flatnonzero(own.is_common)
    most = own.most[:, own.column[words] - own.surer]
    mixed = (most[:, words < 40].any(1) & most[:, words >= 40].any(1)).sum()
    assert mixed <= t.GROUPS < own.blocks // 2  # so a text's bound leaves out blocks of other languages


def test_many_at_once_by_brute_force(monkeypatch):
    for postings in (t.POSTINGS, 50):
        monkeypatch.setattr(t, "POSTINGS", postings)
        own, vectors = index()
        names = sorted(own.place, key=own.place.get)
        by_name = {t._digest(v): v for v in vectors}
        full = np.zeros((len(names), 130))
        for i, name in enumerate(names):
            term, w = own.weigh(by_name[name])
            full[i, term] = w
        texts = [(*own.weigh(v), own.place[t._digest(v)] if k % 2 else None) for k, v in enumerate(vectors[::11])]
        for (term, w, without), (best, score) in zip(texts, own.nearest_to(texts)):
            want = full[:, term] @ w
            if without is not None:
                want[without] = 0
            least = np.sort(want)[-t.NEIGHBOURS]
            near = np.flatnonzero((want >= least - 5e-7) & (want > 0))
            assert set(near) <= set(best) and np.allclose(want[best], score, atol=1e-6) and (np.diff(score) <= 0).all()
            assert (want[best] >= least - 2e-6).all()


def test_the_index_stays_out_of_the_driver(spark, monkeypatch):
    """The driver neither collects the examples' vectors nor builds their index."""
    from pyspark.sql import DataFrame

    from conftest import DATA

    def refuse(*_):
        raise AssertionError("an index in the driver")

    seen, to_arrow = [], DataFrame.toArrow
    monkeypatch.setattr(t.Index, "__init__", refuse)
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: seen.append(self.columns) or to_arrow(self))
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    rows = t.score_toxicity(docs, labels).select("score").collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows}) > 1
    assert "vector" not in sum(seen, [])
