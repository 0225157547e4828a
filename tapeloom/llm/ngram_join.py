"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each document gets a hash of its words and a MinHash signature of its shingles. Equal sequences of
   words are one class from here on.
2. Bands of the signature give buckets; buckets of one are dropped by a pre-aggregated count. In a
   bucket the signatures are compared a few hashes at a time, and a pair goes as soon as the
   posterior probability of reaching the threshold is below the tolerance. What is left links classes
   to families, as a forest of each bucket; a bucket too large for one task links whole, by rows.
3. Families are dealt as blocks and pairs of blocks. A task prunes their pairs again in the same way
   and verifies the rest exactly on whole shingle sets. It returns each class's number of links and a
   root of its links' forest, so no pair is ever a row.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import ID_FILTER_BITS, Bloom, batch, components, id_filter, id_hashes, table
from tapeloom.llm.embedding_dedup import _Forest
from tapeloom.llm.texts import Words, slices

SHINGLE, THRESHOLD = 5, (4, 5)
#: A pair at the threshold shares no band with probability (1 - 0.8**4)**24 = 3e-6.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-7
#: Members of a bucket whose pairs one task compares (those of a larger one are compared as a family's),
#: and members and words of a block of a family (about).
BUCKET, FAMILY_BLOCK, BLOCK_WORDS = 512, 128, 1 << 20

_rng = np.random.default_rng(20_240_531)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(threshold: float) -> dict[int, int]:
    """For each number of hashes compared, the fewest matches that are not pruned. With a uniform
    prior, P(J >= t | k of n) is P(Binomial(n + 1, t) <= k)."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        k, total = -1, 0.0
        while total < TOLERANCE:
            k += 1
            total += comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        out[n] = k
    return out


_LEAST = least_matches(THRESHOLD[0] / THRESHOLD[1])


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle, by row; one to four words are one shingle."""
    at, hashes = words.runs(SHINGLE)
    rows = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, words.sequences(0)[short]])
    order = np.argsort(rows, kind="stable")
    return rows[order], hashes[order]


def signatures(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their signatures of 16-bit MinHash values)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    own, first = np.unique(rows, return_index=True)
    out = np.empty((len(own), HASHES), np.uint16)
    for k in range(HASHES if len(own) else 0):
        y = (x ^ _XOR[k]) * _ODD[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(y, first) & np.uint32(0xFFFF)
    return own, out


_DOC = pa.schema([("doc_id", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
DOC = "doc_id long, one long, two long, n long, bands array<long>"


def _sign(batches):
    for b in batches:
        for i, j, data, offs in slices(b.column(1)):
            words = Words(data, offs)
            own, sig = signatures(*shingles(words))
            bands = np.ascontiguousarray(sig).view(np.int64).reshape(len(own), BANDS)
            at = np.full(j - i, len(own))
            at[own] = np.arange(len(own))
            lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * BANDS, pa.array(bands.ravel()))
            one, two = (pa.array(words.sequences(form).view(np.int64)) for form in (0, 1))
            yield pa.record_batch([b.column(0).slice(i, j - i), one, two, pa.array(np.diff(words.first)), lists.take(pa.array(np.where(at < len(own), at, 0), mask=at == len(own)))], schema=_DOC)


def alive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mask of pairs (a row of a, a row of b) that incremental comparison leaves."""
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    matches = np.zeros(len(i), np.int16)
    for n in range(STEP, HASHES + 1, STEP):
        matches += (a[i, n - STEP : n] == b[j, n - STEP : n]).sum(axis=1, dtype=np.int16)
        keep = matches >= _LEAST[n]
        i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            break
    out = np.zeros((len(a), len(b)), bool)
    out[i, j] = True
    return out


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_links(batches):
    """Rows (band, key, class, bands) sorted by band and key, to a forest of each bucket's pairs."""
    held: list = []
    at, out = None, []

    def close():
        ids = np.array([x[0] for x in held])
        bands = np.array([x[1] for x in held], np.int64)
        sig = bands.view(np.uint16)
        forest = _Forest()
        for s in range(0, len(ids), 128):
            near = alive(sig[s : s + 128], sig[s:])
            i, j = np.nonzero(np.triu(near, 1))
            # pairs that share an earlier band were linked there
            new = ~(bands[s + i, : at[0]] == bands[s + j, : at[0]]).any(axis=1)
            for x, y in zip(ids[s + i[new]].tolist(), ids[s + j[new]].tolist()):
                forest.link(x, y)
        out.extend((x, forest.root(x)) for x in list(forest.up) if forest.root(x) != x)

    for b in batches:
        for band, key, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (band, key) != at:
                if len(held) > 1:
                    close()
                at, held = (band, key), []
            held.append(row)
        if len(out) > 10_000:
            yield batch(_EDGE, *zip(*out))
            out = []
    if len(held) > 1:
        close()
    if out:
        yield batch(_EDGE, *zip(*out))


def families(classes: DataFrame) -> DataFrame:
    """(node, component) over the classes that pruning leaves linked."""
    rows = classes.select("class", F.posexplode("bands").alias("band", "key"))
    hubs = table(rows.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("class").alias("hub")).where("m > 1"))
    met = table(rows.join(hubs, ["band", "key"]))
    large = met.where(F.col("m") > BUCKET).select(F.col("class").alias("a"), F.col("hub").alias("b")).where("a != b").distinct()
    small = met.where(F.col("m") <= BUCKET).join(classes.select("class", "bands"), "class")
    small = small.select("band", "key", "class", "bands").repartition("band", "key").sortWithinPartitions("band", "key")
    return components(small.mapInArrow(_bucket_links, "a long, b long").unionByName(large))


def _sets(known):
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        bloom = Bloom(ID_FILTER_BITS, data=known.value)
        for b in batches:
            if not b.num_rows:
                continue
            b = b.filter(pa.array(bloom.has(id_hashes(b.column(0))) | b.column(0).is_null().to_numpy(zero_copy_only=False)))
            for _, _, data, offs in slices(b.column(1)):
                words = Words(data, offs)
                rows, hashes = shingles(words)
                own, first = np.unique(rows, return_index=True)
                bounds = np.append(first, len(rows))
                yield batch(schema, *(words.sequences(form).view(np.int64)[own] for form in (0, 1)), [np.unique(hashes[bounds[k] : bounds[k + 1]]).tobytes() for k in range(len(own))])

    return run


_PACKED = pa.schema([("family", pa.int64()), ("block", pa.int64()), ("blocks", pa.int64()), ("classes", pa.binary()), ("copies", pa.binary()), ("sigs", pa.binary()), ("sizes", pa.binary()), ("grams", pa.binary())])
PACKED = "family long, block long, blocks long, classes binary, copies binary, sigs binary, sizes binary, grams binary"
DATA = ["classes", "copies", "sigs", "sizes", "grams"]


def _pack(batches):
    """Rows (family, block, blocks, class, copies, bands, grams), sorted, to a row for each block."""
    at, held = None, {}

    def close():
        classes, (copies, bands, grams) = np.array(list(held), np.int64), zip(*held.values())
        sizes = np.array([len(g) // 8 for g in grams], np.int64)
        return batch(_PACKED, *([x] for x in (*at, classes.tobytes(), np.array(copies, np.int64).tobytes(), np.array(bands, np.int64).tobytes(), sizes.tobytes(), b"".join(grams))))

    for b in batches:
        for family, block, blocks, name, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (family, block, blocks) != at:
                if held:
                    yield close()
                at, held = (family, block, blocks), {}
            held[name] = row
    if held:
        yield close()


class _Block:
    def __init__(self, classes, copies, sigs, sizes, grams):
        self.ids, self.copies, self.sizes = (np.frombuffer(x, np.int64) for x in (classes, copies, sizes))
        self.sig = np.frombuffer(sigs, np.uint16).reshape(len(self.ids), HASHES)
        self.grams, self.at = np.frombuffer(grams, np.uint64), np.concatenate([[0], np.cumsum(self.sizes)])
        self.links = np.zeros(len(self.ids), np.int64)

    def set(self, i: int) -> np.ndarray:
        return self.grams[self.at[i] : self.at[i + 1]]


def _shared(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles each pair has in common, exactly."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(a.set(x), b.set(y), assume_unique=True)) for x, y in zip(i, j)], np.int64)
    names, where = np.unique(np.concatenate([a.grams, b.grams]), return_inverse=True)
    left, right = where[: len(a.grams)], where[len(a.grams) :]
    both = np.flatnonzero((np.bincount(left, minlength=len(names)) > 0) & (np.bincount(right, minlength=len(names)) > 0))
    place = np.full(len(names), -1)
    place[both] = np.arange(len(both))
    total = np.zeros((len(a.ids), len(b.ids)), np.float32)  # counts below 2**24 are exact
    for s in range(0, len(both), 8192):
        parts = []
        for side, own in ((a, place[left]), (b, place[right])):
            m = np.zeros((len(side.ids), min(8192, len(both) - s)), np.float32)
            hit = (own >= s) & (own < s + m.shape[1])
            m[np.repeat(np.arange(len(side.ids)), side.sizes)[hit], own[hit] - s] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total[i, j].astype(np.int64)


def _verify(batches):
    """Rows of one block, or of two blocks of a family, to (class, links, root)."""
    schema = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    p, q = THRESHOLD
    out = []
    for batch_ in batches:
        for row in range(batch_.num_rows):
            data = [c[row].as_py() for c in batch_.columns]
            a = _Block(*data[: len(DATA)])
            b = a if len(data) == len(DATA) or data[len(DATA)] == data[0] else _Block(*data[len(DATA) :])
            near = alive(a.sig, b.sig)
            i, j = np.nonzero(np.triu(near, 1) if a is b else near)
            if len(i):
                both = _shared(a, b, i, j)
                linked = both * q >= p * (a.sizes[i] + b.sizes[j] - both)
                i, j = i[linked], j[linked]
            np.add.at(a.links, i, b.copies[j])
            np.add.at(b.links, j, a.copies[i])
            forest = _Forest()
            for x, y in zip(a.ids[i].tolist(), b.ids[j].tolist()):
                forest.link(x, y)
            for side in (a,) if a is b else (a, b):
                out.extend((x, n, forest.root(x)) for x, n in zip(side.ids.tolist(), side.links.tolist()) if n)
        if len(out) > 10_000:
            yield batch(schema, *zip(*out))
            out = []
    if out:
        yield batch(schema, *zip(*out))


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, kept: a row for each row of docs.

    Words are runs of anything but ASCII white space, unchanged; a document is the set of its runs of
    five words (one to four words: one run of all). Documents link at Jaccard similarity 0.8 or more.
    n_links counts the other documents linked directly, copies included; class_id is the smallest
    doc_id that links reach. Null and empty texts link with nothing, nor do they with each other.
    Rows that repeat a doc_id are documents of their own. A null doc_id counts as a partner, and names
    a class only where there is no other. Other columns are not read; an empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    signed = table(docs.mapInArrow(_sign, DOC))
    full = signed.where("bands IS NOT NULL")
    # 128 bits of hash name a class: among 10**11 classes, two meet with a chance of 10**-17
    classes = full.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = table(classes.withColumn("class", F.monotonically_increasing_id()))
    near = table(families(classes))
    near = table(near.join(classes.select(F.col("class").alias("node"), "n"), "node"))
    sizes = near.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n") / BLOCK_WORDS)).alias("blocks"))
    members = near.join(table(sizes), "component").select(F.col("node").alias("class"), F.col("component").alias("family"), "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    members = table(members.join(classes, "class"))
    known = spark.sparkContext.broadcast(id_filter(members.where("rep IS NOT NULL"), "rep").map.tobytes())
    grams = docs.mapInArrow(_sets(known), "one long, two long, grams binary")
    rows = members.join(grams, ["one", "two"]).select("family", "block", "blocks", "class", "copies", "bands", "grams")
    packed = table(rows.repartition("family", "block").sortWithinPartitions("family", "block").mapInArrow(_pack, PACKED))
    alone = packed.where("blocks = 1").select(*DATA).mapInArrow(_verify, "class long, links long, root long")
    many = packed.where("blocks > 1")
    one = many.select("family", F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("b"), *DATA)
    two = many.select("family", F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in DATA))
    pairs = one.join(two, ["family", "b"]).select(*DATA, *(f"b_{c}" for c in DATA)).mapInArrow(_verify, "class long, links long, root long")
    found = table(alone.unionByName(pairs))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    named = classes.select("class", "one", "two", "rep", "copies").join(links, "class", "left").join(groups, "class", "left")
    named = table(named.select("one", "two", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component")))
    first = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = table(named.join(first, "component").select("one", "two", "n_links", "class_id"))
    linked = full.join(named, ["one", "two"]).select("doc_id", "class_id", "n_links")
    empty = signed.where("bands IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def join_sql(documents: str = "documents") -> str:
    """CTEs `joined` with ngram_join()'s rows, by exact comparison of all pairs that share a shingle."""
    return rf"""
nw AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM {documents}),
nk AS (SELECT doc_id, words, md5(array_to_string(words, ' ')) AS name FROM nw WHERE len(words) > 0),
nc AS (SELECT name, min(doc_id) AS rep, count(*) AS copies, any_value(words) AS words FROM nk GROUP BY name),
ng AS (SELECT DISTINCT rep, gram FROM (
    SELECT rep, unnest(list_transform(range(1, greatest(1, len(words) - 4) + 1), lambda i: md5(array_to_string(words[i : i + 4], ' ')))) AS gram FROM nc)),
ns AS (SELECT rep, count(*) AS n FROM ng GROUP BY rep),
nr AS (SELECT gram FROM ng GROUP BY gram HAVING count(*) > 1),
np AS (
    SELECT a.rep AS a, b.rep AS b, count(*) AS n_both FROM (SELECT * FROM ng SEMI JOIN nr USING (gram)) a
    JOIN (SELECT * FROM ng SEMI JOIN nr USING (gram)) b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY ALL),
ne AS (SELECT a, b FROM np JOIN ns x ON x.rep = a JOIN ns y ON y.rep = b WHERE n_both * 5 >= 4 * (x.n + y.n - n_both)),
reach(a, b) AS (SELECT a, b FROM ne UNION SELECT reach.a, ne.b FROM reach JOIN ne ON ne.a = reach.b),
nm AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
nl AS (SELECT a, sum(copies) AS links FROM ne JOIN nc ON nc.rep = ne.b GROUP BY a),
joined AS (
    SELECT nw.doc_id, coalesce(least(nc.rep, nm.least), nw.doc_id) AS class_id,
           coalesce(nc.copies - 1 + coalesce(nl.links, 0), 0)::BIGINT AS n_links,
           nw.doc_id = coalesce(least(nc.rep, nm.least), nw.doc_id) AS kept
    FROM nw LEFT JOIN nk ON nk.doc_id = nw.doc_id LEFT JOIN nc ON nc.name = nk.name
    LEFT JOIN nm ON nm.a = nc.rep LEFT JOIN nl ON nl.a = nc.rep)"""


OP10_SQL = f"WITH RECURSIVE {join_sql()}\nSELECT doc_id, class_id, n_links, kept FROM joined"
