"""What the operators share: tables in the shared folder, task-side batching, bounded filters."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter that prunes documents before a join: a constant, whatever the corpus size.
ID_FILTER_BITS = 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of our own in local mode (tests);
    on a cluster, an error: other machines would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Names of the tables that are made within the innermost tables_within(), if there is one.
_within: ContextVar[list[str] | None] = ContextVar("tables_within", default=None)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder, not used before, that counts as a table's."""
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if (made := _within.get()) is not None:
        made.append(path)
    return path


def table(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and any
    executor can read it after another is lost."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables_within() -> Iterator[list[str]]:
    """The paths of the tables that the block makes, in turn, whatever other threads make meanwhile. What is left in
    the list when the block ends counts for the block around it too."""
    made: list[str] = []
    token = _within.set(made)
    try:
        yield made
    finally:
        _within.reset(token)
        if (outer := _within.get()) is not None:
            outer.extend(made)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that one's own work has made and nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shards_for(rows: int, per_shard: int, least: int) -> int:
    return max(least, math.ceil(rows / per_shard))


def packed(shard: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, its values as bytes) for each shard that has any; order within a shard is kept."""
    order = np.argsort(shard, kind="stable")
    shard, values = shard[order], values[order]
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    for k, start, end in zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(shard)]):
        yield k, values[start:end].tobytes()


def give_back() -> None:
    """Arrow's free memory goes back to the machine; it would stay with a worker, also while that has no task."""
    pa.default_memory_pool().release_unused()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def bit_positions(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Bloom positions, one row a probe: double hashing on the two halves."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high + np.uint64(i * i)) % np.uint64(bits) for i in range(probes)]).astype(np.int64)


class Bloom:
    """A Bloom filter over uint64 hashes."""

    def __init__(self, bits: int, probes: int = 4, data: bytes | None = None):
        self.bits, self.probes = bits, probes
        self.map = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = bit_positions(hashes, self.bits, self.probes).ravel()
        np.bitwise_or.at(self.map, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in bit_positions(hashes, self.bits, self.probes):
            found &= (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of uint64 values (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def id_filter(ids: DataFrame, column: str) -> Bloom:
    """A filter of constant size (4 MB) over the ids of a table: false positives only cost shuffle.

    Each task ORs what it sees into sparse segments, so the driver gets the constant 4 MB."""
    segments, width = 64, ID_FILTER_BITS // 64
    schema = pa.schema([("segment", pa.int32()), ("map", pa.binary())])

    def fold(batches):
        bloom = Bloom(ID_FILTER_BITS)
        for b in batches:
            bloom.add(mix64(b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        parts = bloom.map.reshape(segments, width // 8)
        used = [k for k in range(segments) if parts[k].any()]
        yield batch(schema, used, [parts[k].tobytes() for k in used])

    def merge(batches):
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kept[k] = kept.get(k, 0) | np.frombuffer(m, np.uint8)
        yield batch(schema, list(kept), [m.tobytes() for m in kept.values()])

    rows = ids.select(F.col(column).cast("long")).mapInArrow(fold, "segment int, map binary").repartition(16, "segment").mapInArrow(merge, "segment int, map binary").collect()
    out = np.zeros((segments, width // 8), np.uint8)
    for r in rows:
        out[r.segment] = np.frombuffer(r.map, np.uint8)
    return Bloom(ID_FILTER_BITS, data=out.tobytes())


def id_hashes(ids: pa.Array) -> np.ndarray:
    return mix64(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose doc_id is not among ids, the others and some false positives), so that only the
    others need a join. docs: doc_id, text. ids: doc_id."""
    known = docs.sparkSession.sparkContext.broadcast(id_filter(ids, "doc_id").map.tobytes())

    def hit(batches):
        bloom = Bloom(ID_FILTER_BITS, data=known.value)
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([*b.columns, pa.array(bloom.has(id_hashes(b.column(0))))], names=["doc_id", "text", "hit"])

    marked = docs.select("doc_id", "text").mapInArrow(hit, "doc_id long, text string, hit boolean")
    return marked.where("NOT hit").drop("hit"), marked.where("hit").drop("hit")


#: Most partitions of a shuffle by shards or buckets, however many of these the corpus needs: what a
#: driver keeps of a shuffle grows with partitions x tasks. A task takes its shards one after another.
MOST_PARTITIONS = 1 << 13


def dealt(rows: DataFrame, groups: int, column: str, *order: str) -> DataFrame:
    """rows dealt by column, which has `groups` values at most, and sorted by it (and order) in each partition."""
    return rows.repartition(min(groups, MOST_PARTITIONS), column).sortWithinPartitions(column, *order)


#: Most segments of a filter that is made by shards: each shard ORs its bits into one of them.
SEGMENTS = 1 << 14


def segments_for(shards: int, bits: int) -> tuple[int, int]:
    """(segments, bits of each) of a filter of `bits` in all, whatever the number of shards."""
    segments = min(shards, SEGMENTS)
    return segments, bits // segments // 8 * 8


def merged_segments(maps: DataFrame) -> dict[int, bytes]:
    """The filter's segments, ORed over the shards that share them: rows (segment int, map binary)."""
    schema = pa.schema([("segment", pa.int32()), ("map", pa.binary())])

    def merge(batches):
        at, held = None, None
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1)):
                m = np.frombuffer(m.as_buffer(), np.uint8)
                if k != at:
                    if held is not None:
                        yield batch(schema, [at], [held.tobytes()])
                    at, held = k, m.copy()
                else:
                    held |= m
        if held is not None:
            yield batch(schema, [at], [held.tobytes()])

    merged = maps.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, map binary")
    return {r.segment: bytes(r.map) for r in merged.toLocalIterator()}


def in_segments(hashes: np.ndarray, segment: np.ndarray, maps: dict[int, bytes], bits: int) -> np.ndarray:
    """Whether each hash is in its segment's filter."""
    hit, order = np.zeros(len(hashes), bool), np.argsort(segment, kind="stable")
    ends = np.flatnonzero(np.diff(segment[order])) + 1
    for part in np.split(order, ends) if len(order) else ():
        data = maps.get(int(segment[part[0]]))
        if data is not None:
            hit[part] = Bloom(bits, data=data).has(hashes[part])
    return hit


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), copied both ways.

    Large-star and small-star rounds, each written to the shared folder; min() is pre-aggregated, a
    node of a third of all edges is rows of a join that Spark can split, and rounds grow with the
    logarithm of the longest path."""
    now = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    nodes, mark = now, None
    # one row tells whether a round changed anything
    while (last := mark) != (mark := tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) and mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that Spark can split the join at a node of very many edges
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = table(large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct())
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
