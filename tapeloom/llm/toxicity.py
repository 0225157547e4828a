"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled documents, taken by their texts. The vector space is TF-IDF
over all terms of the examples, with document frequencies over the whole corpus; a term weighs more,
never less, the surer it is more frequent in toxic examples (by log-likelihood ratio). Terms of no
example count in a document's norm. Examples of equal vectors are one, with the share of them that is
toxic as its label. An inverted index holds the examples' postings; those of a common term are cut
into blocks of examples, with the largest weight of each. A query sums its rarer terms, bounds by block
what its common terms can add, and multiplies these only where a block may hold one of the k nearest by
cosine, so these are exact, ties with the last included. Distance-weighted votes are calibrated by
isotonic regression on the examples' own votes, each without itself. Every document is scored on its
whole text; a task writes the index, of bounded size, to the shared folder, where workers read it.
"""

from __future__ import annotations

import hashlib
import io
import pickle
import uuid
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import batch, give_back, new_folder, table
from tapeloom.llm.texts import Words, slices

#: Labelled documents that are learned from, at most (about): bounds what the driver and tasks hold.
EXAMPLES = 20_000
#: How much more a term weighs that tells toxic examples from clean ones, and how large twice its
#: log-likelihood ratio may be by chance (see relevance).
SURER, CHANCE = 100.0, 10.83
NEIGHBOURS, SOFT = 15, 0.05
#: Rates are smoothed by so many examples, of which so many in one are toxic.
PRIOR, RARE = 2.0, 0.1
REJECT = 0.3
#: A term that one in COMMON examples has is frequent; if it is not of more weight than its rarity gives,
#: it is common. Examples in a block; blocks whose cosines a query knows before it bounds the others;
#: cosines that are nearer to each other than TIE are equal.
COMMON, BLOCK, FIRST, TIE = 20, 128, 2, 1e-6
#: Groups of like examples, and rounds that find them; texts whose neighbours are sought together; postings read at once.
GROUPS, ROUNDS, BATCH, POSTINGS = 16, 5, 128, 1 << 18
#: Vectors whose neighbours a worker remembers.
CACHE = 20_000
#: Parts in which document frequencies are summed.
SEGMENTS = 64
#: All ASCII but letters and digits stands between terms.
GAP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _terms(column: pa.Array):
    """(first row, rows, row, term) of the terms of some texts, lower-cased."""
    for first, last, *_ in slices(column):
        for i, j, data, offs in slices(pc.utf8_lower(column.slice(first, last - first).fill_null(""))):
            words = Words(data, offs, GAP)
            yield first + i, first + j, words.doc, words.hash


def _distinct(batches):
    schema = pa.schema([("term", pa.int64())])
    for b in batches:
        for *_, terms in _terms(b.column(0)):
            yield batch(schema, np.unique(terms).view(np.int64))


def vocabulary(examples: DataFrame) -> np.ndarray:
    """Hashes of all terms of the examples (text, toxic), sorted; none if their labels are of one kind."""
    n = examples.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not n["t"] or n["t"] == n["n"]:
        return np.zeros(0, np.uint64)
    found = examples.select("text").mapInArrow(_distinct, "term long").distinct().toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def relevance(both: np.ndarray, a: np.ndarray, n: int, t: int) -> np.ndarray:
    """For each term 1, plus what its log-likelihood ratio adds where its rate in toxic examples is above
    that in clean ones: by the root of twice the ratio above chance for each example, which does not grow
    with their number. both, a: how many of n examples, and of the t toxic ones, have the term."""
    b, rate = both - a, both / max(1, n)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    ratio = 2 * (part(a, rate * t) + part(b, rate * (n - t)) + part(t - a, (1 - rate) * t) + part(n - t - b, (1 - rate) * (n - t)))
    return 1 + SURER * np.where(a * (n - t) > b * t, np.sqrt(np.maximum(ratio - CHANCE, 0.0) / max(1, n)), 0.0)


def _counted(column: pa.Array, names: np.ndarray):
    """For each slice of texts: its first row, the rows that have terms, where each one's terms start
    (and end), the terms' places in names (len(names): in no example) in the order in which they first
    occur, and how often each does."""
    for i, _, rows, terms in _terms(column):
        if not len(terms):
            continue
        where, new = pd.factorize(terms)
        at = np.full(len(new), len(names))
        if len(names):
            place = np.minimum(np.searchsorted(names, new), len(names) - 1)
            at = np.where(names[place] == new, place, at)
        code, pairs = pd.factorize(rows.astype(np.int64) * len(new) + where)
        row, term = np.divmod(pairs, len(new))
        docs, first = np.unique(row, return_index=True)
        yield i, docs, np.append(first, len(row)), at[term], np.bincount(code)


def _vectors(names):
    """(doc_id, toxic, text) to (doc_id, toxic, vector): packed pairs (term, times); no terms: empty."""

    def run(batches):
        for b in batches:
            out = [b""] * b.num_rows
            for i, docs, bounds, term, times in _counted(b.column(2), names.value) if len(names.value) else ():
                pairs = np.stack([term, times], axis=1).astype(np.int32)
                for k, doc in enumerate(docs.tolist()):
                    own = pairs[bounds[k] : bounds[k + 1]]
                    out[i + doc] = own[np.argsort(own[:, 0])].tobytes()  # equal vectors are equal bytes
            yield pa.record_batch([*b.columns[:2], pa.array(out, pa.binary())], names=["doc_id", "toxic", "vector"])

    return run


def frequencies(docs: DataFrame, names) -> tuple[int, np.ndarray]:
    """(documents, how many of them have each term): a task sends its counts in SEGMENTS parts."""
    size = len(names.value)
    width = -(-size // SEGMENTS)
    schema = pa.schema([("segment", pa.int32()), ("docs", pa.int64()), ("counts", pa.binary())])

    def count(batches):
        seen, n = np.zeros(width * SEGMENTS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for *_, term, _ in _counted(b.column(0), names.value):
                seen += np.bincount(term[term < size], minlength=len(seen))
        yield batch(schema, range(SEGMENTS), [n] * SEGMENTS, [part.astype(np.uint32).tobytes() for part in seen.reshape(SEGMENTS, width)])

    def merge(batches):
        total: dict[int, list] = {}
        for b in batches:
            for k, n, data in zip(*(c.to_pylist() for c in b.columns)):
                old = total.setdefault(k, [0, np.zeros(width, np.int64)])
                old[0] += n
                old[1] += np.frombuffer(data, np.uint32)
        yield batch(schema, list(total), [n for n, _ in total.values()], [m.tobytes() for _, m in total.values()])

    kind = "segment int, docs long, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).repartition(16, "segment").mapInArrow(merge, kind).collect()
    seen = np.zeros((SEGMENTS, width), np.int64)
    for r in rows:
        seen[r["segment"]] = np.frombuffer(r["counts"], np.int64)
    return max((r["docs"] for r in rows), default=0), seen.ravel()[:size]


def _digest(vector: np.ndarray) -> bytes:
    return hashlib.blake2b(vector.tobytes(), digest_size=16).digest()


def base_rate(n: int, toxic: int) -> float:
    """The smoothed share of n examples that are toxic."""
    return (toxic + PRIOR * RARE) / (n + PRIOR)


_POSTING = np.dtype([("example", np.int32), ("weight", np.float32)])


def _alike(rows: np.ndarray) -> np.ndarray:
    """An order in which rows of like direction lie together: some rounds of spherical k-means. It decides how much the
    search can skip, and nothing else."""
    if not rows.size:
        return np.arange(len(rows))
    size = np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-30)
    centre = rows[np.linspace(0, len(rows) - 1, GROUPS).astype(np.int64)]
    for _ in range(ROUNDS):
        centre = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-30)
        group, share = (rows @ centre.T).argmax(1), np.zeros((GROUPS, len(rows)), np.float32)
        share[group, np.arange(len(rows))] = 1 / size
        centre = share @ rows
    return np.argsort(group, kind="stable")


class Index:
    """A block-max inverted index of weighted examples; small enough to broadcast.

    idf: the weight of each term, and of terms of no example at the end; surer: whether it has more
    than its rarity gives. Vectors are packed pairs (term, times), empty for an example without terms."""

    def __init__(self, idf: np.ndarray, surer: np.ndarray, examples: pa.Table):
        """examples: doc_id, toxic, vector."""
        self.idf = idf
        ids, toxic = (np.asarray(examples.column(k).to_numpy()) for k in (0, 1))
        size = np.asarray(pc.binary_length(examples.column(2)).to_numpy()) // 8
        vectors = [np.frombuffer(v.as_buffer(), np.int32) for chunk in examples.column(2).chunks for v in chunk]
        self.base = base_rate(len(toxic), int(toxic.sum()))
        none = toxic[size == 0]
        self.clean = (int(none.sum()) + PRIOR * self.base) / (len(none) + PRIOR)
        classes: dict[bytes, list] = {}
        for k in np.flatnonzero(size):
            own = classes.setdefault(_digest(vectors[k]), [int(ids[k]), 0, 0, k])
            own[0], own[1], own[2] = min(own[0], int(ids[k])), own[1] + 1, own[2] + int(toxic[k])
        # like norms share blocks; nothing depends on doc_ids
        own = sorted((float(np.linalg.norm(self._raw(vectors[c[3]])[1])), name) for name, c in classes.items())
        n, total = len(own), sum(int(size[classes[name][3]]) for _, name in own)
        self.ids = np.array([classes[name][0] for _, name in own], np.int64)
        self.toxic = np.array([classes[name][2] / classes[name][1] for _, name in own])
        self.place = {name: k for k, (_, name) in enumerate(own)}
        term, weight, example = np.empty(total, np.int32), np.empty(total, np.float32), np.empty(total, np.uint16 if n <= 1 << 16 else np.uint32)
        end = 0
        for k, (norm, name) in enumerate(own):
            t, w = self._raw(vectors[classes[name][3]])
            at, end = slice(end, end + len(t)), end + len(t)
            term[at], weight[at], example[at] = t, w / norm, k
        order = np.argsort(term, kind="stable")
        self.first = np.searchsorted(term, np.arange(len(idf) + 1), sorter=order)
        self.example, self.weight = example[order], weight[order]
        self.is_frequent = np.diff(self.first) * COMMON > max(n, BLOCK)
        self.is_common = self.is_frequent & ~np.append(surer, True)
        self.rows, self.cache = None, {}

    def _bound(self) -> None:
        """Deals like examples to blocks, and makes a row of each example's weights of frequent terms, the surer
        ones first, and the largest weights of common terms in each block; made where used."""
        n = len(self.ids)
        surer, common = (np.flatnonzero(x) for x in (self.is_frequent & ~self.is_common, self.is_common))
        self.surer, terms = len(surer), np.concatenate([surer, common])
        self.column = np.full(len(self.idf), -1)
        self.column[terms] = np.arange(len(terms))

        def filled(place: np.ndarray, rows: int, terms: np.ndarray) -> np.ndarray:
            out = np.zeros((rows, len(terms)), np.float32)
            for k, t in enumerate(terms.tolist()):
                at = slice(self.first[t], self.first[t + 1])
                out[place[self.example[at]], k] = self.weight[at]
            return out

        commonest = common[np.argsort(-np.diff(self.first)[common], kind="stable")[:BLOCK]]
        self.order, self.blocks, place = _alike(filled(np.arange(n), n, commonest)), -(-n // BLOCK), np.empty(n, self.example.dtype)
        place[self.order] = np.arange(n)
        self.rows = filled(place, self.blocks * BLOCK, terms)
        self.most = np.maximum.reduceat(self.rows[:, self.surer :], np.arange(0, len(self.rows), BLOCK), axis=0)
        postings = np.empty(len(self.example), _POSTING)  # read together, as one number
        postings["example"], postings["weight"] = place[self.example], self.weight
        self.postings, self.spot = postings.view(np.int64), place
        self.example = self.weight = None
        #: Single precision may err by so much: weights are not negative, and a cosine is 1 at most.
        self.slack = (len(terms) + 4) * 2.0**-24

    def _raw(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        term, times = vector.reshape(-1, 2).T
        return term, (1 + np.log(times)) * self.idf[term]

    def weigh(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        term, w = self._raw(vector)
        return term, w / np.linalg.norm(w)

    def _sums(self, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What rarer terms add, read off their postings."""
        out, start = np.zeros(len(self.rows)), self.first[term]
        size = self.first[term + 1] - start
        end, w = np.cumsum(size), w.astype(np.float32)
        cuts = [0, *np.searchsorted(end, np.arange(POSTINGS, end[-1], POSTINGS)).tolist(), len(end)] if len(end) and end[-1] else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            base = end[i - 1] if i else 0
            at = np.repeat(start[i:j] - end[i:j] + size[i:j] + base, size[i:j])
            at += np.arange(len(at))
            read = self.postings.take(at).view(_POSTING)
            out += np.bincount(read["example"], read["weight"] * np.repeat(w[i:j], size[i:j]), len(out))
        return out

    def nearest(self, term: np.ndarray, w: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, and of all that tie with the last."""
        return self.nearest_to([(term, w, without)])[0]

    def nearest_to(self, texts: list[tuple[np.ndarray, np.ndarray, int | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each of some texts, at most BATCH. A block of examples is multiplied at once with all texts that
        it may hold neighbours of; those found in single precision, and all that may tie with them, are then summed in
        double precision."""
        if self.rows is None:
            self._bound()
        dots, own = np.zeros((len(texts), len(self.rows))), np.zeros((len(texts), self.rows.shape[1]), np.float32)
        for k, (term, w, without) in enumerate(texts):
            column = self.column[term]
            own[k, column[column >= 0]] = w[column >= 0]
            dots[k] = self._sums(term[column < 0], w[column < 0])
            if without is not None:
                dots[k, self.spot[without]] = -2.0
        near = dots.astype(np.float32)
        near += own[:, : self.surer] @ self.rows[:, : self.surer].T
        own = np.ascontiguousarray(own[:, self.surer :])
        most = near.reshape(len(texts), self.blocks, BLOCK).max(2) + own @ self.most.T
        margin, done = 2 * self.slack + TIE, np.zeros(most.shape, bool)

        def add(todo: np.ndarray) -> None:
            for block in np.flatnonzero(todo.any(0)).tolist():
                at, rows = np.flatnonzero(todo[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
                near[at, rows] += own[at] @ self.rows[rows, self.surer :].T

        # the blocks of the largest bounds give a cosine that the last neighbour has at least
        first = np.argpartition(most, max(0, self.blocks - FIRST), axis=1)[:, -FIRST:]
        np.put_along_axis(done, first, True, 1)
        add(done)
        known = np.take_along_axis(near.reshape(len(texts), self.blocks, BLOCK), first[:, :, None], 1).reshape(len(texts), -1)
        least = np.maximum(np.partition(known, -NEIGHBOURS, axis=1)[:, -NEIGHBOURS], 0.0) - margin
        add((most >= least[:, None]) & ~done)
        found = []
        for k, (term, w, _) in enumerate(texts):
            at = np.flatnonzero(near[k] >= max(least[k], 1e-30))
            if len(at) > NEIGHBOURS:
                known = near[k, at]
                at = at[known >= np.partition(known, -NEIGHBOURS)[-NEIGHBOURS] - margin]
            column, score = self.column[term], dots[k, at]
            column, w = column[column >= 0], w[column >= 0]
            for s in range(0, len(at) if len(w) else 0, 4096):
                score[s : s + 4096] += (self.rows[at[s : s + 4096, None], column] * w).sum(1)
            at = self.order[at]
            if len(at) > NEIGHBOURS:
                keep = score >= np.partition(score, -NEIGHBOURS)[-NEIGHBOURS] - TIE
                at, score = at[keep], score[keep]
            order = np.lexsort((at, -score))
            found.append((at[order], np.minimum(score[order], 1.0)))
        return found

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        w = 1 / (1 - score + SOFT)
        return float((w @ self.toxic[best] + PRIOR * self.base) / (w.sum() + PRIOR))

    def own_votes(self, vectors: list[np.ndarray]) -> list[float]:
        """Examples' votes, each without itself and its equals."""
        out: list[float] = []
        for s in range(0, len(vectors), BATCH):
            part = vectors[s : s + BATCH]
            out.extend(self.vote(*x) for x in self.nearest_to([(*self.weigh(v), self.place[_digest(v)]) for v in part]))
        return out

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]], knots: np.ndarray | None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(score, neighbours, cosines) of each text's (terms, times); terms of no example come last in idf."""
        keys, out, new = [], {b"": (self.clean, np.zeros(0, np.int64), np.zeros(0))}, {}
        for term, times in texts:
            known = term < len(self.idf) - 1
            keys.append(_digest(np.stack([term, times])) if known.any() and len(self.ids) else b"")
            if keys[-1] in self.cache:
                out[keys[-1]] = self.cache[keys[-1]]
            elif keys[-1] not in out and keys[-1] not in new:
                w = (1 + np.log(times)) * self.idf[term]
                new[keys[-1]] = (term[known], w[known] / np.linalg.norm(w), None)
        for s in range(0, len(new), BATCH):
            part = list(new)[s : s + BATCH]
            for key, (best, score) in zip(part, self.nearest_to([new[key] for key in part])):
                raw = self.vote(best, score)
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                out[key] = self.cache[key] = raw if knots is None else float(np.interp(raw, *knots)), best, score
        return [out[key] for key in keys]


_KNOWN = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("vector", pa.binary())])


class Held:
    """The index of examples (doc_id, toxic, vector), which are bounded: a task writes it to a file of the shared folder,
    where workers read it. It never passes through the driver. weights: idf and surer, broadcast. To be broadcast: a
    worker keeps a broadcast value, here with the index, and loses it when it goes on to tasks that do not use it."""

    def __init__(self, examples: DataFrame, weights):
        folder = new_folder(examples.sparkSession)

        def write(batches):
            index = Index(*weights.value, pa.Table.from_batches([b.cast(_KNOWN) for b in batches], _KNOWN))
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root)
            name = uuid.uuid4().hex  # a task tried again has a file of its own
            with store.open_output_stream(f"{root}/{name}") as out:
                pickle.dump(index, out, pickle.HIGHEST_PROTOCOL)
            yield batch(pa.schema([("name", pa.string())]), [name])

        rows = examples.repartition(1).mapInArrow(write, "name string").collect()
        self.folder, self.name, self.weights = folder, rows[0]["name"] if rows else None, None if rows else weights.value

    @cached_property
    def index(self) -> Index:
        if self.name is None:  # there are no examples, and so no terms
            return Index(*self.weights, _KNOWN.empty_table())
        store, root = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{root}/{self.name}") as data:
            return pickle.load(io.BufferedReader(data))


def calibration(votes: list[tuple[float, int]], base: float) -> np.ndarray | None:
    """Pools adjacent violators over (vote, label): the pools' middles and smoothed rates."""
    pools: list[list[float]] = []
    for x, y in sorted(votes):
        pools.append([x, x, y, 1.0])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return np.array([[(lo + hi) / 2, (t + base) / (n + 1)] for lo, hi, t, n in pools]).T if pools else None


#: toxic: of the examples that share the neighbour's vector, the share that is.
EVIDENCE = "array<struct<doc_id:bigint,cosine:double,toxic:double>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, most_examples: int = EXAMPLES, row: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence: a row for each row of docs.

    Learned from rows of labels whose crc32(doc_id) mod 4 is not 2; null labels are none, and of a
    doc_id's labels the largest counts. The score uses the text alone. Null and empty texts, and texts
    without a known term, score as such examples do. With no labels, or of one kind, every score is
    the labels' smoothed rate. A null doc_id is scored and not held out. Other columns are not
    read, but for the long `row`, if named, which each row of docs keeps. Evidence: the neighbours'
    smallest doc_ids, cosines and shares of toxic examples."""
    spark = docs.sparkSession
    own_row = (F.col(row) if row else F.lit(None)).cast("long").alias("_row")
    docs = docs.select(own_row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # of equal texts, one example: copies would make any of their words stand out
    name = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("name")
    named = table(docs.select("doc_id", name).join(known, "doc_id").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))
    share = min(1.0, most_examples / max(1, named.count()))
    # by the text's digest; the sample is bounded by most_examples rows of a digest and two numbers
    sample = named.where(F.conv(F.substring("name", 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))
    found = docs.select("doc_id", "text", name).join(F.broadcast(sample), ["doc_id", "name"])
    examples = table(found.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("toxic").alias("toxic"), F.first("text").alias("text")).drop("name"))
    names = spark.sparkContext.broadcast(vocabulary(examples))
    size = len(names.value)
    total, seen = frequencies(docs, names) if size else (0, np.zeros(0, np.int64))
    (n, both), (t, bad) = (frequencies(x, names) if size else (0, seen) for x in (examples, examples.where("toxic = 1")))
    extra = relevance(both, bad, n, t)
    known = table(examples.select("doc_id", "toxic", "text").mapInArrow(_vectors(names), "doc_id long, toxic int, vector binary"))
    # the term after the last stands for each that no example has: as rare as can be, and no surer
    idf = np.append((np.log((total + 1) / (seen + 1)) + 1) * extra, np.log(total + 1) + 1)
    labelled = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    held = spark.sparkContext.broadcast(Held(known, spark.sparkContext.broadcast((idf, extra > 1))))

    def vote(batches):
        schema = pa.schema([("vote", pa.float64()), ("toxic", pa.int32())])
        for b in batches:
            yield batch(schema, held.value.index.own_votes([np.frombuffer(v.as_buffer(), np.int32) for v in b.column(2)]), b.column(1))

    votes = known.where("length(vector) > 0").repartition(32, "doc_id").mapInArrow(vote, "vote double, toxic int").collect() if size else []
    knots = calibration([(r["vote"], r["toxic"]) for r in votes], base_rate(labelled["n"], labelled["t"]))

    def run(batches):
        schema = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("evidence", _EVIDENCE)])
        for b in batches:
            index, none = held.value.index, np.zeros(0, np.int64)
            scores, found = np.full(b.num_rows, index.clean), [(none, np.zeros(0))] * b.num_rows
            for i, rows, bounds, term, times in _counted(b.column(3), names.value):
                own = [slice(*x) for x in zip(bounds[:-1], bounds[1:])]
                for doc, known in zip(rows.tolist(), index.scores([(term[at], times[at]) for at in own], knots)):
                    scores[i + doc], *found[i + doc] = known
            best, cosine = (np.concatenate([none, *x]) for x in zip(*found)) if found else (none, none)
            evidence = pa.StructArray.from_arrays([pa.array(index.ids[best.astype(np.int64)]), pa.array(cosine, pa.float64()), pa.array(index.toxic[best.astype(np.int64)])], fields=list(_EVIDENCE.value_type))
            ends = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype(np.int32)
            yield batch(schema, b.column(0), b.column(1), b.column(2), scores, pa.ListArray.from_arrays(ends, evidence, type=_EVIDENCE))
            give_back()

    rows = docs.select("_row", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(run, f"_row long, doc_id long, held_out boolean, score double, evidence {EVIDENCE}")
    return scored.select(*([F.col("_row").alias(row)] if row else []), "doc_id", "held_out", "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "evidence")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    out = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted")
