"""Whole scores against a brute-force version, and what they must not depend on."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from conftest import DATA
from tapeloom.llm import toxicity as t


def counts(text):
    return Counter(x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if x)


def brute(docs: dict, labels: dict) -> dict:
    """Scores by loops: docs {doc_id: text}, labels {doc_id: toxic} that may be learned from."""
    by_text: dict = {}
    for i, y in labels.items():
        if i in docs:
            by_text[docs[i] or ""] = max(y, by_text.get(docs[i] or "", 0))
    examples = [(counts(x), y) for x, y in by_text.items()]
    n, toxic = len(examples), sum(y for _, y in examples)
    base = (toxic + t.PRIOR * t.RARE) / (n + t.PRIOR)
    df = Counter(w for x in docs.values() for w in counts(x))
    seen = Counter(w for x, _ in examples for w in x)
    bad = Counter(w for x, y in examples if y for w in x)

    def part(k, expected):
        return k * math.log(k / expected) if k else 0.0

    def extra(w):
        a, b = bad[w], seen[w] - bad[w]
        rate = seen[w] / n
        ratio = 2 * (part(a, rate * toxic) + part(b, rate * (n - toxic)) + part(toxic - a, (1 - rate) * toxic) + part(n - toxic - b, (1 - rate) * (n - toxic)))
        return 1 + (t.SURER * math.sqrt(max(ratio - t.CHANCE, 0) / n) if a * (n - toxic) > b * toxic else 0)

    idf = {w: (math.log((len(docs) + 1) / (df[w] + 1)) + 1) * extra(w) for w in seen}

    def vector(own):
        v = {w: (1 + math.log(k)) * idf.get(w, math.log(len(docs) + 1) + 1) for w, k in own.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    classes: dict = {}
    for own, y in examples:
        if own:
            classes.setdefault(frozenset(own.items()), [vector(own), []])[1].append(y)
    classes = list(classes.values())
    none = [y for own, y in examples if not own]

    def vote(v, without=None):
        cos = [(min(1.0, sum(x * u.get(w, 0) for w, x in v.items())), sum(y) / len(y)) for k, (u, y) in enumerate(classes) if k != without]
        cos = sorted((c for c in cos if c[0] > 0), reverse=True)
        cos = [c for c in cos if len(cos) <= t.NEIGHBOURS or c[0] >= cos[t.NEIGHBOURS - 1][0] - t.TIE]
        w = [1 / (1 - c + t.SOFT) for c, _ in cos]
        return (sum(x * y for x, (_, y) in zip(w, cos)) + t.PRIOR * base) / (sum(w) + t.PRIOR)

    points = [(vote(u, k), y) for k, (u, ys) in enumerate(classes) for y in ys]
    knots = t.calibration(points, base)
    clean = (sum(none) + t.PRIOR * base) / (len(none) + t.PRIOR)
    return {i: float(np.interp(vote(vector(own)), *knots)) if any(w in idf for w in own) else clean for i, own in ((i, counts(x)) for i, x in docs.items())}


def check(spark, docs: dict, labels: dict):
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = t.score_toxicity(d, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).toPandas()
    learned = {i: y for i, y in labels.items() if y is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    want = brute(docs, learned)
    assert np.allclose(got.score, got.doc_id.map(want), atol=2e-3)
    return got


def test_scores_by_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").collect()}
    docs.update({10**6: None, 10**6 + 1: "", 10**6 + 2: "zzz-unseen", 10**6 + 3: docs[min(docs)]})
    got = check(spark, docs, labels)
    filled = got[got.doc_id.map(lambda i: bool(counts(docs[i])))]
    assert (filled.evidence.map(len) > 0).mean() > 0.95


def test_scores_do_not_depend_on_doc_ids(spark):
    """40 equal one-word examples, half of them toxic, and others, under other doc_ids."""
    rng = random.Random(8)
    texts = [("insult" if k < 40 else " ".join(rng.choices(["a", "b", "c", "d", "e", "insult", "vile"], k=5)), k % 2) for k in range(160)]
    scores = []
    for order in (1, -1):
        ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
        rows = list(zip(ids[::order], texts))
        d = spark.createDataFrame([(i, x, y) for i, (x, y) in rows], "doc_id long, text string, toxic int")
        got = {r["doc_id"]: r["score"] for r in t.score_toxicity(d, d.select("doc_id", "toxic")).collect()}
        scores.append([round(got[i], 9) for i, _ in rows])
    assert scores[0] == scores[1]
