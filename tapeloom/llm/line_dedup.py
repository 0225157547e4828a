"""Line dedup by two Bloom filters.

1. Each task sends the 64-bit hashes of its line keys (each at most once per document, twice per
   task) packed by hash shard: 8 bytes a line at most, no text.
2. A shard keeps a once-seen filter while its hashes stream by; a hash already in it enters the
   twice-seen filter, in the shard's segment of one filter of constant size. Shards beyond the number
   of segments share them.
3. That filter, of a size fixed by TWICE_BITS, picks suspected repeats while the documents are read
   again. Only those shuffle, as 16-byte digests of the key with the doc_id; exact counts and the
   largest doc_id come from a pre-aggregated groupBy. A full filter costs shuffle, never results.
4. Documents that lose a line (picked by a filter of constant size over their ids) join the keys they
   lose; the others pass by. A common key stays rows of a skew-splittable join.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Bloom, batch, dealt, in_segments, merged_segments, mix64, packed, segments_for, shards_for, split_by_ids, table

#: Bits of the twice-seen filter over all shards: 16 MB, whatever the corpus size.
TWICE_BITS = 1 << 27
ONCE_BITS = 1 << 24
FLUSH = 1 << 20


def line_keys(text: str | None, least: int):
    """(line, key) of each line; key is None where it has fewer than `least` code points."""
    raw = (text or "").encode()
    for line, key in zip(raw.split(b"\n"), raw.lower().split(b"\n")):
        key = key.strip()
        long = len(key) >= 4 * least or len(key) >= least and len(key.decode()) >= least
        yield line, key if long else None


def _key_hashes(least: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("hashes", pa.binary())])

    def run(batches):
        seen: list[int] = []

        def flush():
            values, counts = np.unique(np.array(seen, np.uint64), return_counts=True)
            values = np.concatenate([values, values[counts > 1]])
            seen.clear()
            found = list(packed((values % np.uint64(shards)).astype(np.int64), values))
            yield batch(schema, [k for k, _ in found], [data for _, data in found])

        for b in batches:
            for text in b.column(0):
                seen.extend({xxhash.xxh3_64_intdigest(key) for _, key in line_keys(text.as_py(), least) if key is not None})
                if len(seen) >= FLUSH:
                    yield from flush()
        if seen:
            yield from flush()

    return run


def _twice(segments: int, segment_bits: int):
    schema = pa.schema([("segment", pa.int32()), ("map", pa.binary())])

    def run(batches):
        shard, once, twice = None, None, None
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                if k != shard:
                    if twice is not None:
                        yield batch(schema, [shard % segments], [twice.map.tobytes()])
                    shard, once, twice = k, Bloom(ONCE_BITS), Bloom(segment_bits)
                values = mix64(np.frombuffer(data.as_buffer(), np.uint64))
                values, counts = np.unique(values, return_counts=True)
                twice.add(values[once.has(values) | (counts > 1)])
                once.add(values)
        if twice is not None:
            yield batch(schema, [shard % segments], [twice.map.tobytes()])

    return run


def _suspects(least: int, shards: int, segments: int, segment_bits: int, filters):
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])

    def run(batches):
        maps = filters.value
        for b in batches:
            ids, keys, hashes = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if doc_id is None:
                    continue
                own = {key for _, key in line_keys(text.as_py(), least) if key is not None}
                keys.extend(own)
                hashes.extend(map(xxhash.xxh3_64_intdigest, own))
                ids.extend([doc_id] * len(own))
            hashes = np.array(hashes, np.uint64)
            segment = (hashes % np.uint64(shards)).astype(np.int64) % segments
            hit = in_segments(mix64(hashes), segment, maps, segment_bits)
            at = np.flatnonzero(hit)
            yield batch(schema, [blake2b(keys[i], digest_size=16).digest() for i in at], [ids[i] for i in at])

    return run


def _drop(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def run(batches):
        for b in batches:
            texts, lines, dropped = [], [], []
            for text, gone in zip(b.column(1), b.column(2)):
                text, gone = text.as_py() or "", set(gone.as_py() or ())
                kept = text
                n = text.count("\n") + 1
                if gone:
                    left = [line for line, key in line_keys(text, least) if key is None or blake2b(key, digest_size=16).digest() not in gone]
                    kept, n_left = b"\n".join(left).decode(), len(left)
                texts.append(kept)
                lines.append(n)
                dropped.append(n - n_left if gone else 0)
            yield batch(schema, b.column(0), texts, lines, dropped)

    return run


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, text without repeated lines, n_lines (before), n_dropped: a row for each row of docs.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. A key of `least_chars`
    code points or more, in `least_docs` distinct doc_ids or more, stays only in the largest.
    Null text: one empty line. A null doc_id neither counts nor loses lines. Rows that repeat a
    doc_id count once and are treated alike. Other columns are not read. Empty tables: no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = shards_for(docs.count(), 5000, 64)
    segments, segment_bits = segments_for(shards, TWICE_BITS)
    spark = docs.sparkSession
    hashes = docs.select("text").mapInArrow(_key_hashes(least_chars, shards), "shard int, hashes binary")
    twice = dealt(hashes, shards, "shard").mapInArrow(_twice(segments, segment_bits), "segment int, map binary")
    filters = spark.sparkContext.broadcast(merged_segments(twice))
    suspects = table(docs.mapInArrow(_suspects(least_chars, shards, segments, segment_bits, filters), "key binary, doc_id long").distinct())
    keep = table(suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")).where(F.col("n") >= least_docs))
    gone = table(suspects.join(keep, "key").where("doc_id != keep_id").groupBy("doc_id").agg(F.collect_list("key").alias("gone")))
    whole, touched = split_by_ids(docs, gone)
    out = "doc_id long, text string, n_lines long, n_dropped long"
    whole = whole.withColumn("gone", F.lit(None).cast("array<binary>")).mapInArrow(_drop(least_chars), out)
    return whole.unionByName(touched.join(gone, "doc_id", "left").mapInArrow(_drop(least_chars), out))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
common AS (
    SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep_id AS gone
    FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
