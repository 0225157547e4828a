"""Exact dedup over a cuckoo-filter index of live digests.

The index is buckets of digests: a row for each live digest (its smallest doc_id and how many documents
hold it), and a cuckoo filter for each bucket. New digests are dealt to buckets and meet the filters only:
a miss is new for certain and is stored without a look at what is stored. Hits, and nothing else, meet
the stored digests in a join; SHA-256 digests stand for contents, as no two texts are known or expected
to share one. A filter that overflows is made anew, larger, from the bucket's stored keys. Deleting a
digest's last document takes its fingerprint out again. Only filters of touched buckets are written.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import batch, dealt, shards_for, table

SLOTS, KICKS = 4, 200
#: Digests a bucket is sized for: its task holds the new ones of these and its filter only.
PER_BUCKET = 50_000
ROW = "bucket int, kind int, digest binary, keep_id long, n long, filter binary"
ROW_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64()), ("filter", pa.binary())])
#: Kinds of rows, in the order in which a bucket's are applied. In: its filter, digests to add, to take
#: out, to build a filter of. Out: its filter, new digests, hits to be verified, a filter that is full.
FILTER, ADD, GONE, KEY = range(4)
NEW, HIT, FULL = range(4, 7)


class CuckooFilter:
    """16-bit fingerprints in rows of four slots; each key has two rows."""

    def __init__(self, rows: int = 64, data: bytes | None = None):
        self.table = [[] for _ in range(rows)]
        if data is not None:
            slots = np.frombuffer(data, np.uint16).reshape(-1, SLOTS)
            self.table = [[int(x) for x in row if x] for row in slots]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        i = int.from_bytes(digest[:8], "little") % len(self.table)
        return mark, i, self._other(i, mark)

    def _other(self, i: int, mark: int) -> int:
        return i ^ (mark * 0x5BD1E995 % len(self.table))

    def __contains__(self, digest: bytes) -> bool:
        mark, i, j = self._places(digest)
        return mark in self.table[i] or mark in self.table[j]

    def add(self, digest: bytes) -> bool:
        """False if it is full: the caller resizes it from the stored keys."""
        mark, i, j = self._places(digest)
        for at in (i, j):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        at = i
        for k in range(KICKS):
            row = self.table[at]
            mark, row[k % SLOTS] = row[k % SLOTS], mark
            at = self._other(at, mark)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        return False

    def remove(self, digest: bytes) -> None:
        mark, i, j = self._places(digest)
        self.table[i if mark in self.table[i] else j].remove(mark)

    def resized(self, keys) -> CuckooFilter:
        """Twice the rows (a power of two), refilled from the stored keys."""
        rows = len(self.table)
        while True:
            rows *= 2
            new = CuckooFilter(rows)
            if all(new.add(key) for key in keys):
                return new

    def data(self) -> bytes:
        slots = np.zeros((len(self.table), SLOTS), np.uint16)
        for i, row in enumerate(self.table):
            slots[i, : len(row)] = row
        return slots.tobytes()


class Bucket:
    """A bucket in its task: its filter, and the digests that are new. stored: whether the index has keys
    of the bucket, which this task does not hold."""

    def __init__(self, data: bytes | None):
        self.stored, self.full = data is not None, False
        self.filter, self.new, self.hits = CuckooFilter(data=data), {}, {}

    def add(self, digest: bytes, keep_id, n: int) -> None:
        if not self.full and digest not in self.filter:
            self.new[digest] = (keep_id, n)
            if not self.filter.add(digest):
                if self.stored:
                    self.full = True
                else:
                    self.filter = self.filter.resized(self.new)
            return
        held = self.new if digest in self.new or not self.stored else self.hits
        if digest not in held:
            # a false hit in a bucket without stored keys, or a hit to be verified
            if held is self.new and not self.filter.add(digest):
                self.filter = self.filter.resized([*self.new, digest])
            held[digest] = (keep_id, n)
            return
        old = held[digest]
        held[digest] = (min((x for x in (old[0], keep_id) if x is not None), default=None), old[1] + n)

    def key(self, digest: bytes) -> None:
        """A stored key of a filter that is made anew."""
        self.new[digest] = (None, 0)
        if not self.filter.add(digest):
            self.filter = self.filter.resized(self.new)

    def rows(self, k: int, keys: bool):
        kinds = [FULL if self.full else FILTER]
        yield batch(ROW_ARROW, [k], kinds, [None], [None], [None], [None if self.full else self.filter.data()])
        for kind, held in ((NEW, self.new), (HIT, self.hits)):
            if held and not keys:
                keep, n = zip(*held.values())
                yield batch(ROW_ARROW, [k] * len(n), [kind] * len(n), list(held), keep, n, [None] * len(n))


def _apply(batches):
    """Rows of kinds FILTER, ADD, GONE, KEY, sorted by bucket and kind, to rows of the kinds that go out."""
    at, bucket, keys = None, None, False
    for b in batches:
        for k, kind, digest, keep_id, n, data in zip(*(c.to_pylist() for c in b.columns)):
            if k != at:
                if bucket:
                    yield from bucket.rows(at, keys)
                at, bucket, keys = k, Bucket(data), False
            if kind == ADD:
                bucket.add(digest, keep_id, n)
            elif kind == GONE:
                bucket.filter.remove(digest)
            elif kind == KEY:
                keys = True
                bucket.key(digest)
    if bucket:
        yield from bucket.rows(at, keys)


def _pre_aggregated(batches):
    """(bucket, digest, doc_id) to a row for each digest of a batch: copies in a batch meet here."""
    for b in batches:
        seen: dict[bytes, list] = {}
        for k, digest, doc_id in zip(*(c.to_pylist() for c in b.columns)):
            old = seen.setdefault(digest, [k, doc_id, 0])
            old[2] += 1
            if doc_id is not None and (old[1] is None or doc_id < old[1]):
                old[1] = doc_id
        yield batch(ROW_ARROW, [x[0] for x in seen.values()], [ADD] * len(seen), list(seen), [x[1] for x in seen.values()], [x[2] for x in seen.values()], [None] * len(seen))


def _maybe(batches):
    """Rows (bucket, kind, digest, doc_id, filter), sorted, to (doc_id, digest, bucket, maybe) of the
    documents: whether the bucket's filter has the digest."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("bucket", pa.int32()), ("maybe", pa.bool_())])
    at, own = None, None
    for b in batches:
        out = []
        for k, kind, digest, doc_id, data in zip(*(c.to_pylist() for c in b.columns)):
            if k != at:
                at, own = k, None
            if kind == FILTER:
                own = CuckooFilter(data=data)
            else:
                out.append((doc_id, digest, k, own is not None and digest in own))
        if out:
            yield batch(schema, *zip(*out))


@dataclass
class ExactIndex:
    """members: doc_id, digest, bucket of each live document; rows: bucket, digest, keep_id, n of each live
    digest; filters: bucket, filter. The last two are None while nothing is stored."""

    buckets: int
    members: DataFrame | None = None
    rows: DataFrame | None = None
    filters: DataFrame | None = None

    @property
    def live(self) -> DataFrame:
        return self.rows.select("digest", "keep_id", F.col("n").alias("group_size"))

    def _run(self, changes: DataFrame) -> DataFrame:
        """The changes (see ROW) on the filters of their buckets, written."""
        if self.filters is not None:
            touched = changes.select("bucket").distinct()
            own = self.filters.join(touched, "bucket", "left_semi")
            changes = changes.unionByName(own.select("bucket", F.lit(FILTER).alias("kind"), "filter"), allowMissingColumns=True)
        rows = changes.select("bucket", "kind", "digest", "keep_id", "n", "filter")
        return table(dealt(rows, self.buckets, "bucket", "kind").mapInArrow(_apply, ROW))

    def _with_filters(self, made: DataFrame) -> DataFrame:
        made = made.where(F.col("kind") == FILTER).select("bucket", "filter")
        return made if self.filters is None else self.filters.join(made, "bucket", "left_anti").unionByName(made)

    def insert(self, docs: DataFrame) -> ExactIndex:
        added = table(_digests(docs, self.buckets))
        done = self._run(added.select("bucket", "digest", "doc_id").mapInArrow(_pre_aggregated, ROW))
        row = ["bucket", "digest", "keep_id", "n"]
        new, filters = done.where(F.col("kind") == NEW).select(*row), self._with_filters(done)
        if self.rows is None:
            return ExactIndex(self.buckets, added, new, filters)
        hits = done.where(F.col("kind") == HIT).select("bucket", "digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
        met = table(hits.join(self.rows, ["bucket", "digest"], "left"))
        changed = met.select("bucket", "digest", F.least("keep_id", "new_id").alias("keep_id"), (F.coalesce("n", F.lit(0)) + F.col("new_n")).alias("n"))
        rows = self.rows.join(met.select("digest"), "digest", "left_anti").select(*row).unionByName(changed).unionByName(new)
        # false hits are keys that the filter lacks; with the full ones, their buckets' filters are made anew
        anew = done.where(F.col("kind") == FULL).select("bucket").unionByName(met.where("n IS NULL").select("bucket")).distinct()
        keys = rows.join(anew, "bucket", "left_semi").select("bucket", F.lit(KEY).alias("kind"), "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("filter"))
        made = ExactIndex(self.buckets)._run(keys)
        filters = ExactIndex(self.buckets, filters=filters)._with_filters(made)
        return ExactIndex(self.buckets, self.members.unionByName(added), rows, table(filters))

    def delete(self, ids: DataFrame) -> ExactIndex:
        """Takes out all documents with the given doc_ids; unknown ids change nothing."""
        ids = ids.select(F.col("doc_id").cast("long")).distinct()
        touched = self.members.join(ids, "doc_id", "left_semi").select("bucket", "digest").distinct()
        left = table(self.members.join(ids, "doc_id", "left_anti"))
        now = left.join(touched, ["bucket", "digest"], "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        changed = table(touched.join(now, "digest", "left").select("bucket", "digest", "keep_id", "n"))
        gone = changed.where("n IS NULL").select("bucket", F.lit(GONE).alias("kind"), "digest", "keep_id", "n", F.lit(None).cast("binary").alias("filter"))
        rows = self.rows.join(changed.select("digest"), "digest", "left_anti").select("bucket", "digest", "keep_id", "n").unionByName(changed.where("n IS NOT NULL"))
        return ExactIndex(self.buckets, left, rows, self._with_filters(self._run(gone)))

    def compact(self) -> ExactIndex:
        """The same index, its rows and members written; for after many changes."""
        return ExactIndex(self.buckets, table(self.members), table(self.rows), table(self.filters))

    def lookup(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_sha256, keep_id, group_size of the live digest, null where there is none. Only
        documents whose digest is in its bucket's filter meet the stored digests."""
        asked = _digests(docs, self.buckets).select("bucket", F.lit(ADD).alias("kind"), "digest", "doc_id", F.lit(None).cast("binary").alias("filter"))
        both = asked.unionByName(self.filters.select("bucket", F.lit(FILTER).alias("kind"), "filter"), allowMissingColumns=True)
        seen = table(dealt(both, self.buckets, "bucket", "kind").mapInArrow(_maybe, "doc_id long, digest binary, bucket int, maybe boolean"))
        found = seen.where("maybe").join(self.rows, ["bucket", "digest"], "left").select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"))
        none = seen.where("NOT maybe").select("doc_id", "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
        return found.unionByName(none).select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size")


def _digests(docs: DataFrame, buckets: int) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def build_index(docs: DataFrame) -> ExactIndex:
    """An index of docs (doc_id, text; more columns are ignored; an empty table: an empty index)."""
    return ExactIndex(shards_for(docs.count(), PER_BUCKET, 32)).insert(docs)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    Texts are equal when identical after replacing runs of ASCII white space by one space; null is
    empty. The smallest doc_id of a group stays; a null doc_id stays only where the group has no
    other; rows that repeat a doc_id within a group count and are marked alike."""
    index = build_index(docs)
    return index.members.join(index.live, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
