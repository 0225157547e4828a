"""Token ids in binary shard files, with a minimal perfect hash index over document keys.

A shard file holds raw ids (little-endian, 16 bits) of documents in ascending doc_id order, so that a
trainer can map it; behind them stands where each document ends, and the counts. Keys are dealt by a hash
to index buckets. The index file of a bucket has a minimal perfect hash of its keys: levels of bits, where a
key that is alone at its bit has it, and those that meet go on to the next level; a key's slot is the
rank of its bit. A slot has the key's fingerprint (64 bits, one to one with the key, so no other key passes)
and its places: shard, first document there, number of documents. A look-up is one bucket, one slot,
one place, whatever the size of the store.

Files are written by tasks under names of their own; the manifests, which are Spark tables, name those of
the tasks that were committed, so a task that is lost or runs twice leaves a file that nobody reads.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import batch, give_back, mix64, shared_dir, shards_for, table
from tapeloom.llm.packing import SLICE, Lent, default_tokenizer
from tapeloom.llm.texts import slices

END_ID = 2
MAGIC = b"TLIDS\x00\x00\x01"
FOOTER = "<QQ8s"
#: Bytes of ids and documents after which a task begins another shard file; keys of an index bucket; bytes read at once.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 1 << 20
BUCKET_KEYS = 1 << 17
READ = 4 << 20
#: Bits of a level for each key that is left.
GAMMA = 2
_ONE = np.uint64(1)


class PerfectHash:
    """Slots 0..n-1 of n distinct 64-bit keys; a key that is not among them gets -1 or any slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # words of bits
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        base = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self.size = int(base[-1])
        self.rank = [b + np.cumsum(c) - c for b, c in zip(base, counts)]

    @staticmethod
    def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(bits)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Levels until no key is left; distinct keys part sooner or later, as every level mixes anew."""
        levels = []
        while len(keys):
            bits = -(-GAMMA * len(keys) // 64) * 64
            at = cls._at(keys, len(levels), bits).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, live = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, rank) in enumerate(zip(self.levels, self.rank)):
            if not len(live):
                break
            at = self._at(keys[live], level, 64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & _ONE == _ONE
            below = words[word] & ((_ONE << bit) - _ONE)
            out[live[hit]] = rank[word[hit]] + np.bitwise_count(below[hit])
            live = live[~hit]
        return out


def _key_hash(keys: np.ndarray) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    """One to one with the key, and independent of what the slots are made from."""
    return mix64(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))


class KeyIndex:
    """The index of one bucket: a perfect hash, a fingerprint and places of each slot, and those of the null key."""

    def __init__(self, levels, prints, first, places, none):
        self.hash, self.prints, self.first, self.places, self.none = PerfectHash(levels), prints, first, places, none

    @classmethod
    def build(cls, keys: np.ndarray, is_null: np.ndarray, places: np.ndarray) -> KeyIndex:
        """keys: not distinct; places: a row (shard, entry, documents) for each."""
        none, own, places = places[is_null], keys[~is_null], places[~is_null]
        distinct = np.unique(own)
        made = PerfectHash.build(_key_hash(distinct))
        slot = made.slots(_key_hash(own))
        order = np.lexsort((places[:, 1], places[:, 0], slot))
        prints = np.zeros(made.size, np.uint64)
        prints[slot] = _fingerprint(own)
        return cls(made.levels, prints, np.searchsorted(slot[order], np.arange(made.size + 1)), places[order], none)

    def find(self, keys: np.ndarray, is_null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the key, place) for each place of each key that the index has."""
        slot = np.where(is_null, -1, self.hash.slots(_key_hash(keys)))
        known = np.flatnonzero(slot >= 0)
        known = known[self.prints[slot[known]] == _fingerprint(keys[known])]
        first, last = self.first[slot[known]], self.first[slot[known] + 1]
        n = last - first
        row = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        nulls = np.repeat(np.flatnonzero(is_null), len(self.none))
        return np.concatenate([np.repeat(known, n), nulls]), np.concatenate([self.places[row], np.tile(self.none, (int(is_null.sum()), 1))])

    def data(self) -> bytes:
        out = io.BytesIO()
        for x in (np.array([len(self.hash.levels)]), *self.hash.levels, self.prints, self.first, self.places, self.none):
            np.save(out, x)
        return out.getvalue()

    @classmethod
    def of(cls, data: bytes) -> KeyIndex:
        src = io.BytesIO(data)
        levels = [np.load(src) for _ in range(int(np.load(src)[0]))]
        return cls(levels, *(np.load(src) for _ in range(4)))


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


WRITTEN = "kind int, doc_id long, shard long, entry long, n long, ids long, name string"
_WRITTEN = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("shard", pa.int64()), ("entry", pa.int64()), ("n", pa.int64()), ("ids", pa.int64()), ("name", pa.string())])
SHARD, PLACE = 0, 1


def _writer(folder: str, lent, end_id: int):
    """Tokenises sorted rows (doc_id, text) and writes shard files; gives a row for each shard, and one for each run
    of a key in a shard."""

    def run(batches):
        encoder, end = lent.value.encoder, np.array([end_id], "<u2").tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        part, k, out, ends, at, docs, name = TaskContext.get().partitionId(), 0, None, [], 0, 0, ""

        def close() -> pa.RecordBatch:
            out.write(np.concatenate(ends).tobytes())
            out.write(struct.pack(FOOTER, docs, at, MAGIC))
            out.close()
            return batch(_WRITTEN, [SHARD], [None], [part << 32 | k], [0], [docs], [at], [name])

        for b in batches:
            for i, j, data, offs in slices(b.column(1), SLICE):
                ids, doc_ids, done = [x + end for x in encoder.encode(data, offs)], b.column(0).slice(i, j - i), 0
                while done < len(ids):
                    if out is None:
                        name, ends, at, docs = f"shard-{part:06d}-{k:06d}-{uuid.uuid4().hex}.ids", [], 0, 0
                        out = store.open_output_stream(f"{root}/{name}")
                    sums = at + np.cumsum([len(x) // 2 for x in ids[done:]])
                    take = min(SHARD_DOCS - docs, int(np.searchsorted(2 * sums, SHARD_BYTES)) + 1, len(sums))
                    out.write(b"".join(ids[done : done + take]))
                    own = doc_ids.slice(done, take)
                    keys, none = _keys(own)
                    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (none[1:] != none[:-1])]))
                    nulls = pa.nulls(len(new), pa.int64())
                    yield batch(_WRITTEN, np.full(len(new), PLACE, np.int32), own.take(pa.array(new)), np.full(len(new), part << 32 | k), docs + new, np.diff(np.append(new, take)), nulls, nulls.cast(pa.string()))
                    ends.append(sums[:take].astype("<u8"))
                    at, docs, done = int(sums[take - 1]), docs + take, done + take
                    if 2 * at >= SHARD_BYTES or docs >= SHARD_DOCS:
                        yield close()
                        out, k = None, k + 1
                give_back()
        if out is not None:
            yield close()

    return run


def _indexer(folder: str):
    """Index files of buckets; rows sorted by bucket: bucket, doc_id, shard, entry, n."""
    schema = pa.schema([("bucket", pa.int64()), ("name", pa.string())])

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for bucket, columns in _runs(batches):
            keys, none = _keys(columns[0])
            name = f"index-{bucket:08d}-{uuid.uuid4().hex}.mph"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(KeyIndex.build(keys, none, np.stack([c.to_numpy() for c in columns[1:]], axis=1)).data())
            yield batch(schema, [bucket], [name])

    return run


def _runs(batches) -> Iterator[tuple[int, list[pa.Array]]]:
    """(value, the other columns) of each run of equal values in the first column."""
    at, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for i, j in zip(cuts, cuts[1:]):
            if key[i] != at and held:
                yield at, [pa.concat_arrays(c) for c in zip(*held)]
                held = []
            at = int(key[i])
            held.append([c.slice(i, j - i) for c in b.columns[1:]])
    if held:
        yield at, [pa.concat_arrays(c) for c in zip(*held)]


def _bucket(buckets: int):
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))


@dataclass
class TokenStore:
    """A written store. shards: shard, name, docs, ids, base (ids in all shards before it); index: bucket, name."""

    folder: str
    buckets: int
    shards: DataFrame
    index: DataFrame

    def places(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, entry, n) of the keys that the store has; keys: doc_id, each once."""
        folder, schema = self.folder, pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("entry", pa.int64()), ("n", pa.int64())])

        def find(batches):
            store, root = fs.FileSystem.from_uri(folder)
            for _, (ids, names) in _runs(batches):
                with store.open_input_file(f"{root}/{names[0].as_py()}") as src:
                    index = KeyIndex.of(src.read())
                of, place = index.find(*_keys(ids))
                yield batch(schema, ids.take(pa.array(of)), *(np.ascontiguousarray(c) for c in place.T))

        asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("bucket", _bucket(self.buckets).cast("long"))
        asked = asked.join(self.index, "bucket").select("bucket", "doc_id", "name")
        return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(find, "doc_id long, shard long, entry long, n long")

    def read(self, keys: DataFrame, reader, schema: str) -> DataFrame:
        """Applies reader(shard file, its base, doc_ids, entries, counts) -> batches to the places of keys, by
        shard and in the order of the file."""
        folder = self.folder

        def run(batches):
            store, root = fs.FileSystem.from_uri(folder)
            for _, (names, base, *places) in _runs(batches):
                with store.open_input_file(f"{root}/{names[0].as_py()}") as src:
                    yield from reader(src, base[0].as_py(), *places)

        at = table(self.places(keys)).join(self.shards.select("shard", "name", "base"), "shard")
        return at.select("shard", "name", "base", "doc_id", "entry", "n").repartition("shard").sortWithinPartitions("shard", "entry").mapInArrow(run, schema)

    def digests(self, keys: DataFrame) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of all documents of the keys, read from the files."""
        return self.read(keys, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def ids(self, keys: DataFrame) -> DataFrame:
        """(doc_id, start, input_ids) of all documents of the keys, read from the files."""
        return self.read(keys, _ids, "doc_id long, start long, input_ids array<int>")


def _spans(src, entries: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the place, first id, end id) of each document of the places; checks the file's form."""
    size, footer = src.size(), struct.calcsize(FOOTER)
    docs, n_ids, magic = struct.unpack(FOOTER, src.read_at(footer, size - footer))
    if magic != MAGIC or size != 2 * n_ids + 8 * docs + footer:
        raise ValueError("not a shard file of this form, or a part of one")
    ends = np.frombuffer(src.read_at(8 * docs, 2 * n_ids), "<u8").astype(np.int64)
    n = counts.to_numpy()
    of = np.repeat(np.arange(len(n)), n)
    entry = np.repeat(entries.to_numpy() - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return of, np.where(entry > 0, ends[entry - 1], 0), ends[entry]


def _windows(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents that one read of about READ bytes covers; at least one document."""
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(end, first[i] + READ // 2, "right")))
        yield i, j
        i = j


def _digest(src, base: int, doc_ids: pa.Array, entries: pa.Array, counts: pa.Array):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    of, first, end = _spans(src, entries, counts)
    for i, j in _windows(first, end):
        if 2 * (end[i] - first[i]) > READ:  # one document, part by part
            crc, at = 0, int(first[i])
            while at < end[i]:
                n = min(READ // 2, int(end[i]) - at)
                crc, at = zlib.crc32(np.frombuffer(src.read_at(2 * n, 2 * at), "<u2").astype("<u4"), crc), at + n
            found = [crc]
        else:
            ids = np.frombuffer(src.read_at(2 * int(end[j - 1] - first[i]), 2 * int(first[i])), "<u2").astype("<u4")
            found = [zlib.crc32(ids[a:b]) for a, b in zip((first[i:j] - first[i]).tolist(), (end[i:j] - first[i]).tolist())]
        yield batch(schema, doc_ids.take(pa.array(of[i:j])), base + first[i:j], end[i:j] - first[i:j], found)


def _ids(src, base: int, doc_ids: pa.Array, entries: pa.Array, counts: pa.Array):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("input_ids", pa.list_(pa.int32()))])
    of, first, end = _spans(src, entries, counts)
    for i, j in _windows(first, end):
        ids = np.frombuffer(src.read_at(2 * int(end[j - 1] - first[i]), 2 * int(first[i])), "<u2").astype(np.int32)
        lists = [ids[a:b] for a, b in zip((first[i:j] - first[i]).tolist(), (end[i:j] - first[i]).tolist())]
        yield batch(schema, doc_ids.take(pa.array(of[i:j])), base + first[i:j], lists)


def write_store(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> TokenStore:
    """Writes the ids of all docs (doc_id, text), each closed by end_id, in ascending doc_id order.

    Null and empty texts give end_id alone. Null doc_ids come first and are a key like others. Rows that share a
    doc_id are stored each, in an order that stays; a look-up of the key gives all of them. Other columns are not
    read, whatever their names. An empty table gives a store without shards, where no key is found."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/ids-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    # row parts equal keys, so that a key of a third of all rows is many tasks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    lent = ordered.sparkSession.sparkContext.broadcast(Lent(path or default_tokenizer()))
    written = table(ordered.mapInArrow(_writer(folder, lent, end_id), WRITTEN))
    # a row for each 64 MB of ids or million documents
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ids")
    shards = table(written.where(f"kind = {SHARD}").select("shard", "name", F.col("n").alias("docs"), "ids", before.alias("base")))
    places = written.where(f"kind = {PLACE}")
    buckets = shards_for(places.count(), BUCKET_KEYS, 1)
    keyed = places.select(_bucket(buckets).cast("long").alias("bucket"), "doc_id", "shard", "entry", "n")
    index = table(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_indexer(folder), "bucket long, name string"))
    return TokenStore(folder, buckets, shards, index)


def op13_token_store(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return write_store(docs).digests(docs.select("doc_id").distinct())
