"""Concatenate-and-cut packing by two-pass prefix sums.

Pass 1 tokenises and writes the ids with each document's token offset inside its partition. The
partitions' totals, summed twice (within blocks of partitions, then over blocks), give each
partition's global offset. Pass 2 cuts the stream into fixed windows: a window whose tokens lie in
one task is a complete record, the others are boundary records, which are joined. Tokens never shuffle,
but for the boundary records.
"""

from __future__ import annotations

import os
import zlib
from functools import cached_property
from weakref import WeakValueDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import give_back, table
from tapeloom.llm.texts import WHITE, Words, slices

END_ID, PAD_ID, LENGTH = 1, 0, 2048
#: Bytes of text that are split into words at once; new words that are tokenised in one call, joined to
#: texts of JOINED words; bytes of words and ids that a worker remembers, with ENTRY for each besides.
SLICE = 2 << 20
CALL, JOINED = 8_000, 100
CACHE, ENTRY = 80 << 20, 28
BLOCK = 1024
PIECES = "array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint>>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The bytes of a text by kind: ASCII letters, the apostrophe, other ASCII marks.
LETTER, QUOTE, MARK = 1, 2, 3
_KIND = bytearray(256)
for _kind, _bytes in ((LETTER, [*range(65, 91), *range(97, 123)]), (MARK, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), (QUOTE, [39])):
    for _k in _bytes:
        _KIND[_k] = _kind
_MARKS = "".join(map(chr, range(128))).translate({k: None for k in range(128) if _KIND[k] not in (QUOTE, MARK)})
#: Small letters that normalisation leaves alone.
_SMALL = "".join(c for c in map(chr, [*range(97, 123), *range(0xDF, 0x100)]) if c != "÷")


def split_marks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts a space between a letter (ASCII or Latin-1) and a mark after it, and between a mark, but for the
    apostrophe, and a letter after it, where the pre-tokeniser splits anyway, so that a word is one entry of
    the cache whatever marks are beside it."""
    kind = np.frombuffer(data.tobytes().translate(bytes(_KIND)), np.uint8)
    letter, at = kind == LETTER, np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    letter[at] = letter[at + 1] = True
    cut = np.flatnonzero(letter[:-1] & (kind[1:] >= QUOTE) | (kind[:-1] == MARK) & letter[1:]) + 1
    return np.insert(data, cut, 32), offs + np.searchsorted(cut, offs, "left")


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of values, one after the other."""
    end = np.cumsum(size)
    return values[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class Runs:
    """Runs of values, end to end in an array that doubles."""

    def __init__(self, kind):
        self.values, self.bounds, self.used, self.rows = np.empty(1 << 16, kind), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        used, rows = self.used + len(values), self.rows + len(size)
        if used > len(self.values):
            self.values, old = np.empty(2 * used, self.values.dtype), self.values
            self.values[: self.used] = old[: self.used]
        if rows >= len(self.bounds):
            self.bounds, old = np.zeros(2 * rows, np.int64), self.bounds
            self.bounds[: self.rows + 1] = old[: self.rows + 1]
        self.values[self.used : used] = values
        self.bounds[self.rows + 1 : rows + 1] = self.used + np.cumsum(size)
        self.used, self.rows = used, rows

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of some."""
        return self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]

    def last(self, rows: int) -> Runs:
        """What was added last."""
        out, first = Runs(self.values.dtype), self.bounds[self.rows - rows]
        out.add(self.values[first : self.used], np.diff(self.bounds[self.rows - rows : self.rows + 1]))
        return out


class Known:
    """Words and their ids in arrays, which take a quarter of a dictionary's memory. A word is found by a hash
    and told apart by its bytes; of words with one hash the first is kept."""

    def __init__(self):
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.words, self.ids = Runs(np.uint8), Runs("<u2")

    def __len__(self) -> int:
        return self.words.rows

    @property
    def held(self) -> int:
        return self.words.used + 2 * self.ids.used + ENTRY * len(self)

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The row of each word, or -1."""
        row = np.full(len(hashes), -1, np.int64)
        if len(self):
            order = np.argsort(hashes)
            at = np.minimum(np.searchsorted(self.hash, hashes[order]), len(self) - 1)
            row[order] = np.where(self.hash[at] == hashes[order], self.row[at], -1)
            begin, length = self.words.of(row)
            maybe = np.flatnonzero((row >= 0) & (length == size))
            found, own = row[maybe], size[maybe]
            same = gather(self.words.values, begin[maybe], own) == gather(data, start[maybe], own)
            row[:] = -1
            if len(maybe):
                row[maybe] = np.where(np.logical_and.reduceat(same, np.cumsum(own) - own), found, -1)
        return row

    def add(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        """Words that were not found, with their ids."""
        hashes, own = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hash, hashes)
        if len(self):
            new = self.hash[np.minimum(at, len(self) - 1)] != hashes
            hashes, own, at = hashes[new], own[new], at[new]
        self.hash, self.row = np.insert(self.hash, at, hashes), np.insert(self.row, at, len(self) + np.arange(len(own)))
        self.words.add(gather(data, start[own], size[own]), size[own])
        self.ids.add(gather(ids, first[own], n[own]), n[own])

    def forget(self) -> None:
        """Leaves the later half."""
        rows, gone = len(self) - len(self) // 2, len(self) // 2
        left = self.row >= gone
        self.hash, self.row = self.hash[left], self.row[left] - np.int32(gone)
        self.words, self.ids = self.words.last(rows), self.ids.last(rows)


class Encoder:
    """Ids of whole texts, word by word: this vocabulary's pre-tokeniser drops white space and never
    looks across it, and it lower-cases, so a text's ids are those of its lower-cased words in turn.
    Each different word of a slice is looked up once. Text that may hold a special token, or combining
    marks that join to some small letters only, is neither lower-cased nor split at marks first. New words
    of small letters, which are normal and whole already, skip those steps of the tokenizer. A tokenizer
    that does not work so, as probes show, is given whole texts, or new words with all steps."""

    _by_path: WeakValueDictionary[str, Encoder] = WeakValueDictionary()  # of those that someone holds

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Known()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        whole, low, two, one, other = self._probe("AB", "ab", "a b", "a", "b")
        self.by_word = whole == low and two == one + other
        for c in "aé":
            for mark in _MARKS:
                letter, alone, after, before = self._probe(c, mark, c + mark, mark + c)
                self.by_word &= after == letter + alone and (mark == "'" or before == alone + letter)
        self.plain, self.ends = self._plain(path)

    def _probe(self, *texts: str) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _plain(self, path: str):
        """The tokenizer for words of small letters, and which ids end a word; nothing if those words are not
        left as they are, or their ends cannot be seen."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if not (suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None)):
            return None, None
        made, ends = Tokenizer.from_file(path), np.zeros(1 << 16, bool)
        made.normalizer = normalizers.Sequence([])
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith(suffix)]] = True
        probe = " ".join([*_SMALL, *(a + b for a in _SMALL for b in _SMALL), _SMALL])
        ids = made.encode(probe, add_special_tokens=False).ids
        return (made, ends) if [ids] == self._probe(probe) and ends[ids].sum() == len(probe.split()) else (None, None)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if (made := cls._by_path.get(path)) is None:
            made = cls._by_path[path] = cls(path)
        return made

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number) of words. Many are joined by spaces in one text, and told apart by the ids that end
        a word, or by offsets."""
        small, lead = (data >= 97) & (data <= 122), data == 0xC3
        small |= lead
        small[1:] |= lead[:-1] & (data[1:] >= 0x9F) & (data[1:] <= 0xBF) & (data[1:] != 0xB7)
        bad = np.concatenate([[0], np.cumsum(~small)])
        plain = (bad[start + size] == bad[start]) & (self.plain is not None)
        ids, n, total = [], np.zeros(len(size), np.int64), 0
        first = np.zeros(len(size), np.int64)
        for rows, by_ends in ((np.flatnonzero(plain), True), (np.flatnonzero(~plain), False)):
            for s in range(0, len(rows), CALL):
                own = rows[s : s + CALL]
                end = np.cumsum(size[own])
                text, at = np.insert(gather(data, start[own], size[own]), end, 32).tobytes(), [*(end - size[own] + np.arange(len(own))).tolist()]
                cut = [*at[::JOINED], len(text)]
                groups = [text[i:j].decode() for i, j in zip(cut, cut[1:])]
                if by_ends:
                    got = np.concatenate([np.array(e.ids, "<u2") for e in self.plain.encode_batch_fast(groups, add_special_tokens=False)])
                    each = np.diff(np.flatnonzero(self.ends[got]), prepend=-1)
                else:
                    found = self.tokenizer.encode_batch(groups, add_special_tokens=False)
                    got, each = np.concatenate([np.array(e.ids, "<u2") for e in found]), np.concatenate([self._each(g, e) for g, e in zip(groups, found)])
                n[own], first[own] = each, total + np.cumsum(each) - each
                ids.append(got)
                total += len(got)
        return np.concatenate([np.zeros(0, "<u2"), *ids]), first, n

    @staticmethod
    def _each(group: str, e) -> np.ndarray:
        """How many ids each word of a text has."""
        begins = np.cumsum([0, *(len(w) + 1 for w in group.split(" ")[:-1])])
        return np.diff(np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), begins))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        raw = data.tobytes()
        if not self.by_word:
            return [np.array(self.tokenizer.encode(raw[s:e].decode(), add_special_tokens=False).ids, "<u2").tobytes() for s, e in zip(offs, offs[1:])]
        if not any(x in raw for x in (b"<|", b"\xcc", b"\xcd")):
            data, offs = split_marks(data, offs)
            data = np.frombuffer(data.tobytes().lower(), np.uint8)
        words = Words(data, offs)
        if not len(words):
            return [b""] * (len(offs) - 1)
        bounds = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
        letters = pa.py_buffer(data.tobytes().translate(None, WHITE))
        coded = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), letters]).dictionary_encode()
        own, at = coded.dictionary, coded.indices.to_numpy()
        data, bounds = np.frombuffer(own.buffers()[2], np.uint8), np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1]
        start, size, hashes = bounds[:-1], np.diff(bounds), Words(data[: bounds[-1]], bounds).hash
        row = self.known.find(hashes, data, start, size)
        old, new = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        first, n = self.known.ids.of(row)
        ids, first[new], n[new] = self._learn(data, start[new], size[new])
        first[new] += n[old].sum()
        ids, first[old] = np.concatenate([gather(self.known.ids.values, first[old], n[old]), ids]), np.cumsum(n[old]) - n[old]
        self.known.add(hashes[new], data, start[new], size[new], ids, first[new], n[new])
        if self.known.held > CACHE:
            self.known.forget()
        end = np.concatenate([[0], np.cumsum(n[at])])
        flat, cut = gather(ids, first[at], n[at]).tobytes(), (2 * end[words.first]).tolist()
        return [flat[i:j] for i, j in zip(cut, cut[1:])]


class Lent:
    """An encoder that is made where a task needs it. To be broadcast: a worker keeps a broadcast value, here with the
    words it has learned, from task to task, and loses it when it goes on to tasks that do not use it."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder.of(self.path)


TOKENS = "part int, start long, doc_id long, n long, ids binary"
TOKENS_ARROW = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """The token table: a row for each document, null text as empty, each closed by the end id."""
    lent = docs.sparkSession.sparkContext.broadcast(Lent(path))

    def run(batches):
        encoder, part, start = lent.value.encoder, TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u2").tobytes()
        for b in batches:
            for i, j, data, offs in slices(b.column(1), SLICE):
                ids = [x + end for x in encoder.encode(data, offs)]
                n = np.array([len(x) // 2 for x in ids])
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.record_batch([pa.array(np.full(j - i, part, np.int32)), pa.array(starts), b.column(0).slice(i, j - i), pa.array(n), pa.array(ids, pa.binary())], schema=TOKENS_ARROW)
                give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return table(rows.mapInArrow(run, TOKENS))


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """(part, base): the tokens of all partitions before it, by prefix sums at two levels."""
    totals = tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total")).withColumn("block", F.floor(F.col("part") / BLOCK))
    blocks = totals.groupBy("block").agg(F.sum("total").alias("in_block"))
    before = F.sum("in_block").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_block")
    within = F.sum("total").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")
    return table(totals.withColumn("within", within).join(blocks.select("block", before.alias("before")), "block").select("part", (F.col("within") + F.col("before")).alias("base")))


RECORDS = f"sequence_id long, offset long, complete boolean, ids binary, pieces {PIECES}"
_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
RECORDS_ARROW = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("complete", pa.bool_()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])


def _cut(length: int):
    def run(batches):
        out: list[tuple] = []
        window, first, ids, pieces, end = None, 0, [], [], 0

        def close():
            if window is not None:
                out.append((window, first, end - first == length, b"".join(ids), list(pieces)))

        def flush():
            cols = list(zip(*out))
            out.clear()
            flat = [p for x in cols[4] for p in x]
            inner = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], fields=list(_PIECE))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in cols[4]])]).astype(np.int32)
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.binary()), pa.ListArray.from_arrays(bounds, inner, type=pa.list_(_PIECE))], schema=RECORDS_ARROW)

        for b in batches:
            for doc_id, at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = memoryview(data.as_buffer())
                n, done = len(data) // 2, 0
                while done < n:
                    here, offset = divmod(at + done, length)
                    if here != window or offset != end:
                        close()
                        window, first, ids, pieces, end = here, offset, [], [], offset
                    take = min(n - done, length - offset)
                    ids.append(bytes(data[2 * done : 2 * (done + take)]))
                    pieces.append((doc_id, done, take, n))
                    done, end = done + take, offset + take
                if len(out) >= 2000:
                    yield flush()
        close()
        if out:
            yield flush()

    return run


def records(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(sequence_id, offset, complete, ids, pieces): what each task has of each window, written."""
    tokens = tokenise(docs, path or default_tokenizer())
    at = tokens.join(partition_offsets(tokens), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "ids")
    return table(at.mapInArrow(_cut(length), RECORDS))


_PLACED = pa.struct([pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")])
_SEQUENCE = pa.schema([("sequence_id", pa.int64()), ("input_ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("pieces", pa.list_(_PLACED))])
SEQUENCE = "sequence_id long, input_ids array<int>, n_tokens long, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,offset:bigint>>"
#: Sequences that a task holds padded at once.
PADDED = 256


def _padded(length: int):
    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.frombuffer(x.as_buffer(), "<u2") for x in b.column(1)]
        n = np.array([len(x) for x in rows], np.int64)
        full = np.where(n & (n - 1) == 0, n, length)
        first = np.cumsum(full) - full
        flat = np.full(int(full.sum()), PAD_ID, "<i4")
        for x, at in zip(rows, first.tolist()):
            flat[at : at + len(x)] = x
        own, each = b.column(2).flatten(), pc.list_value_length(b.column(2)).to_numpy()
        size, bounds = own.field("length").to_numpy(), np.concatenate([[0], np.cumsum(each)])
        before = np.concatenate([[0], np.cumsum(size)])
        offset = before[:-1] - np.repeat(before[bounds[:-1]], each)
        at = np.repeat(first, each) + offset
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at.tolist(), (at + size).tolist())]
        columns = [own.field("doc_id"), own.field("start"), own.field("length"), pa.array(crc, pa.int64()), own.field("doc_tokens"), pa.array(offset)]
        ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), pa.array(flat))
        placed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(_PLACED)))
        return pa.record_batch([b.column(0), ids, pa.array(n), placed.cast(_SEQUENCE.field(3).type)], schema=_SEQUENCE)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, PADDED):
                yield made(b.slice(s, PADDED))

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(sequence_id, input_ids, n_tokens, pieces): the token stream of docs in windows of `length`.

    Every document gives its ids and the end id, so empty and null texts give one token; a null
    doc_id stays null; rows that repeat a doc_id are packed each. Every sequence but the last holds
    `length` tokens; that is padded to `length`, unless it has a power of two already. pieces, in the order of
    the sequence: doc_id, start (in its document), length, ids_crc32 (of the ids as 32-bit integers),
    doc_tokens, offset (in the sequence). Other columns are not read; an empty table gives no sequences."""
    found = records(docs, path, length)
    whole = found.where("complete").select("sequence_id", "ids", "pieces")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "pieces")))
    cut = found.where("NOT complete").groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    cut = cut.select("sequence_id", joined.alias("ids"), F.flatten(F.transform("parts", lambda p: p["pieces"])).alias("pieces"))
    return whole.unionByName(cut).mapInArrow(_padded(length), SEQUENCE)


def pieces(sequences: DataFrame) -> DataFrame:
    """A row for each piece of a document in the sequences."""
    return sequences.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pieces(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
