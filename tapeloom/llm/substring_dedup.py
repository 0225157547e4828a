"""Substring dedup by fixed-block anchors.

Any run of `window` words holds a block of (window + 1) // 2 words that starts at a multiple of that
length in its document. So:

1. Index and probe: each task hashes the non-overlapping blocks (the index) and every rolling window
   of a block's length (the probes), and sends each distinct hash once, 4 bytes of it packed by hash
   shard, with a flag each for "a block" and "seen twice here". A shard finds the blocks that occur
   anywhere else. It sends them on as its segment of one filter of constant size.
2. Extend: the documents are read again; every whole window that holds such an anchor is sent to a
   shard by a 96-bit hash, with its place. A task sends a hash once only: windows that repeat inside
   the task are settled there, so a passage of a third of all documents is an entry for each task.
   A shard answers the places of the windows that occur more than once. Consecutive answers are the
   maximal exact repeats.
3. Documents with answers (picked by a filter of constant size, then a join) lose the words covered.

A filter that is full costs time and shuffle, never results.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Bloom, batch, dealt, in_segments, merged_segments, mix64, packed, segments_for, shards_for, split_by_ids, table
from tapeloom.llm.texts import Words, slices

WINDOW = 35
#: Bits of the filter of repeated blocks over all shards: 16 MB, whatever the corpus size.
ANCHOR_BITS = 1 << 27
#: Hashes that a task gathers before it sends them on.
FLUSH = 2 << 20
_SHARD = pa.schema([("shard", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
SHARD = "shard int, kind byte, data binary"
#: Kinds of rows in the first pass: rolling hashes seen once, seen twice, blocks of the index.
ONCE, MORE, BLOCK = 0, 1, 2


def _rows(kind: int, parts) -> pa.RecordBatch:
    """A row for each shard that has data."""
    parts = list(parts)
    return batch(_SHARD, [k for k, _ in parts], [kind] * len(parts), [data for _, data in parts])


def _split(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 32 further bits of each hash: with more shards for more text, a shard's chance of a
    false match stays the same, and every match is checked in step 2."""
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _index_and_probe(size: int, shards: int):
    def run(batches):
        rolling, blocks, held = [], [], 0

        def flush():
            values, counts = np.unique(np.concatenate(rolling), return_counts=True)
            for kind, part in ((ONCE, values[counts == 1]), (MORE, values[counts > 1]), (BLOCK, np.unique(np.concatenate(blocks)))):
                shard, low = _split(part, shards)
                yield _rows(kind, packed(shard, low))

        for b in batches:
            for _, _, data, offs in slices(b.column(0)):
                words = Words(data, offs)
                at, hashes = words.runs(size)
                rolling.append(hashes)
                blocks.append(hashes[(at - words.first[words.doc[at]]) % size == 0])
                held += len(hashes)
                if held >= FLUSH:
                    yield from flush()
                    rolling, blocks, held = [], [], 0
        if held:
            yield from flush()

    return run


def _anchors(segments: int, segment_bits: int):
    """Blocks that are seen anywhere else, as a filter in the shard's segment."""
    schema = pa.schema([("segment", pa.int32()), ("map", pa.binary())])

    def run(batches):
        for shard, held in _by_shard(batches):
            once, counts = np.unique(_gather(held.get(ONCE, []), np.uint32), return_counts=True)
            more = np.unique(_gather(held.get(MORE, []), np.uint32))
            blocks = np.unique(_gather(held.get(BLOCK, []), np.uint32))
            # once in one task and again in another, or twice in one
            hits = np.intersect1d(blocks, np.union1d(once[counts > 1], more))
            bloom = Bloom(segment_bits)
            bloom.add(mix64(hits.astype(np.uint64)))
            yield batch(schema, [shard % segments], [bloom.map.tobytes()])

    return run


#: A window to settle: 96 bits of hash and its place, whose top bit says "seen twice here".
PLACE = np.dtype([("hash", "<u8"), ("more", "<u4"), ("doc", "<i8"), ("pos", "<u4")])
TWICE = np.uint32(1 << 31)
#: A settled place.
SPOT = np.dtype([("doc", "<i8"), ("pos", "<u4")])
OPEN, SETTLED = 0, 1
#: Stands for a null doc_id, whose windows count for others.
NO_ID = -(1 << 63)


def _repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number of each in that order) by hash."""
    order = np.lexsort((values["more"], values["hash"]))
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = (v["hash"][1:] != v["hash"][:-1]) | (v["more"][1:] != v["more"][:-1])
    return order, np.cumsum(new) - 1


def _shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(values.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _spots(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), SPOT)
    out["doc"], out["pos"] = values["doc"], values["pos"] & ~TWICE
    return out


def _windows(window: int, size: int, shards: int, segments: int, segment_bits: int, anchors):
    def run(batches):
        maps, held, n = anchors.value, [], 0

        def flush():
            values = np.concatenate(held)
            order, group = _repeats(values)
            values, repeated = values[order], np.bincount(group)[group] > 1
            first = np.ones(len(values), bool)
            first[1:] = group[1:] != group[:-1]
            values["pos"] |= np.where(repeated, TWICE, 0).astype(np.uint32)
            settled = _spots(values[repeated & ~first])
            for kind, part, by in ((OPEN, values[first], "hash"), (SETTLED, settled, "doc")):
                yield _rows(kind, packed(_shard_of(part[by], shards), part))

        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, _, data, offs in slices(b.column(1)):
                words = Words(data, offs)
                at, hashes = words.runs(window)
                if not len(at):
                    continue
                small, probes = words.runs(size)
                sums = np.zeros(len(words) + 1, np.int64)
                shard, low = _split(probes, shards)
                sums[small + 1] = in_segments(mix64(low.astype(np.uint64)), shard % segments, maps, segment_bits)
                sums = np.cumsum(sums)
                near = sums[at + window - size + 1] - sums[at] > 0
                if near.any():
                    part = np.zeros(int(near.sum()), PLACE)
                    at, part["hash"] = at[near], hashes[near]
                    part["more"] = words.runs(window, 1)[1][near] >> np.uint64(32)
                    part["doc"], part["pos"] = ids[i + words.doc[at]], at - words.first[words.doc[at]]
                    held.append(part)
                    n += len(part)
                if n >= FLUSH // 2:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _by_shard(batches):
    """(shard, its data by kind), one shard at a time, from rows sorted by shard."""
    shard, held = None, {}
    for b in batches:
        for k, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if k != shard:
                if held:
                    yield shard, held
                shard, held = k, {}
            held.setdefault(kind, []).append(data.as_buffer())
    if held:
        yield shard, held


def _gather(buffers, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in buffers] or [np.zeros(0, dtype)])


def _settle(shards: int):
    """The spots of repeated windows, dealt anew by document."""

    def run(batches):
        for _, held in _by_shard(batches):
            spots = [_gather(held.get(SETTLED, []), SPOT)]
            values = _gather(held.get(OPEN, []), PLACE)
            if len(values):
                order, group = _repeats(values)
                values = values[order]
                again = np.bincount(group, 1 + (values["pos"] >> np.uint32(31)))[group] > 1
                spots.append(_spots(values[again]))
            spots = np.concatenate(spots)
            yield _rows(SETTLED, packed(_shard_of(spots["doc"], shards), spots))

    return run


def _starts(batches):
    """A row for each document: where its repeated windows start, as first and last of each run."""
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.binary())])
    for _, held in _by_shard(batches):
        spots = np.unique(_gather(held[SETTLED], SPOT))
        if not len(spots):
            continue
        new = np.ones(len(spots), bool)
        new[1:] = (spots["doc"][1:] != spots["doc"][:-1]) | (spots["pos"][1:] != spots["pos"][:-1] + 1)
        first = np.flatnonzero(new)
        runs = np.stack([spots["pos"][first], spots["pos"][np.append(first[1:], len(spots)) - 1]], axis=1)
        own, at = np.unique(spots["doc"][first], return_index=True)
        bounds = np.append(at, len(first))
        yield batch(schema, own, [runs[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(own))])


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def run(batches):
        for b in batches:
            texts, n_words, n_removed = [], [], []
            for text, starts in zip(b.column(1), b.column(2)):
                words, starts = (text.as_py() or "").encode().split(), starts.as_py()
                n = len(words)
                if starts:
                    edge, runs = np.zeros(n + 1, np.int64), np.minimum(np.frombuffer(starts, np.uint32).astype(np.int64).reshape(-1, 2), n)
                    np.add.at(edge, runs[:, 0], 1)
                    np.add.at(edge, np.minimum(runs[:, 1] + window, n), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                texts.append(b" ".join(words).decode())
                n_words.append(n)
                n_removed.append(n - len(words))
            yield batch(schema, b.column(0), texts, n_words, n_removed)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed: a row for each row of docs.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a run of `window`
    words that covers it also starts anywhere else, the same document included. doc_id must be
    unique and not null where texts are to be told apart: rows that repeat a doc_id each count, and
    lose the words covered in any of them; rows of null doc_id count with others and lose nothing.
    Null text has no words. Other columns are not read; an empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, size = docs.sparkSession, (window + 1) // 2
    shards = shards_for(docs.count(), 2000, 64)
    segments, segment_bits = segments_for(shards, ANCHOR_BITS)
    first = docs.select("text").mapInArrow(_index_and_probe(size, shards), SHARD)
    maps = dealt(first, shards, "shard").mapInArrow(_anchors(segments, segment_bits), "segment int, map binary")
    anchors = spark.sparkContext.broadcast(merged_segments(maps))
    places = docs.mapInArrow(_windows(window, size, shards, segments, segment_bits, anchors), SHARD)
    spots = dealt(places, shards, "shard").mapInArrow(_settle(shards), SHARD)
    return _apply(docs, table(dealt(spots, shards, "shard").mapInArrow(_starts, "doc_id long, runs binary").where(F.col("doc_id") != NO_ID)), window)


def _apply(docs: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    out = "doc_id long, text string, n_words long, n_removed long"
    clean, touched = split_by_ids(docs, starts)
    clean = clean.withColumn("runs", F.lit(None).cast("binary")).mapInArrow(_remove(window), out)
    return clean.unionByName(touched.join(starts, "doc_id", "left").mapInArrow(_remove(window), out))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = rf"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w),
r AS (
    SELECT doc_id, pos, md5(array_to_string(words[pos : pos + {WINDOW - 1}], ' ')) AS run
    FROM p WHERE pos + {WINDOW - 1} <= len(words)),
s AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY run) > 1 AS again FROM r),
k AS (
    SELECT p.doc_id, p.pos, p.words[p.pos] AS word,
           coalesce(max(s.again::INT) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) = 1 AS gone
    FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.pos = p.pos)
SELECT w.doc_id, len(any_value(w.words))::BIGINT AS n_words, count(k.pos) FILTER (WHERE k.gone) AS n_removed,
       sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.pos) FILTER (WHERE NOT k.gone), '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id GROUP BY w.doc_id
"""
