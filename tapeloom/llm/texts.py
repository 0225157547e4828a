"""Whole columns of text as numpy arrays: words, their hashes, and hashes of runs of words.

Nothing here loops over words in Python, but for words of over LONG bytes. A word's hash mixes its
eight-byte pieces one after the other; a run's hash mixes those of its halves, so it takes as many
steps as its length has binary digits. No step is linear, so no pattern of letters or words makes
hashes meet. Each comes in two independent forms of 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tapeloom.llm.common import mix64

#: The six characters between words: space, tab, line feed, vertical tab, form feed, return.
WHITE = b" \t\n\x0b\x0c\r"
GAP = np.zeros(256, bool)
GAP[list(WHITE)] = True
#: Text is taken in slices of about this many bytes, and at least one document.
SLICE = 1 << 19

#: Words of more bytes are hashed one by one.
LONG = 64
#: What tells the two forms of a hash apart: where it starts, what it multiplies by.
FORMS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0x165667B19E3779F9, 0x9FB21C651E98DF25))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def both(a: np.ndarray, b: np.ndarray, times: int) -> np.ndarray:
    """A hash of pairs of hashes, in their order."""
    x = a * np.uint64(times)
    x ^= x >> np.uint64(29)
    x += b
    return mix64(x)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes, offsets); null is empty."""
    column = column.fill_null("")
    rows, (_, offsets, data) = len(column), column.buffers()
    if not rows:
        return
    offs = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """The words of some documents: start, end (bytes), doc (row), hash, and first (the index of
    each document's first word, and the end)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, gap: np.ndarray = GAP):
        n, rows = len(data), len(offs) - 1
        is_gap, edge = gap[data], np.zeros(n + 1, bool)
        edge[offs] = True
        first = ~is_gap
        last = first.copy()
        first[1:] &= is_gap[:-1] | edge[1:n]
        last[:-1] &= is_gap[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(rows + 1))
        self._data, self._hash = data, {}

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        return self.hashes(0)

    def hashes(self, form: int) -> np.ndarray:
        """A hash of each word."""
        if form not in self._hash:
            seed, times = FORMS[form]
            length = self.end - self.start
            padded = np.concatenate([self._data, np.zeros(8, np.uint8)])
            pieces = np.ndarray(len(self._data) + 1, "<u8", padded, strides=(1,))
            out = np.uint64(seed) + length.astype(np.uint64)
            live, done = np.flatnonzero(length <= LONG), 0
            while len(live):
                left = np.minimum(length[live] - done, 8)
                out[live] = both(out[live], pieces[self.start[live] + done] & _LOW[left], times)
                done += 8
                live = live[length[live] > done]
            for k in np.flatnonzero(length > LONG).tolist():
                word = self._data[self.start[k] : self.end[k]]
                out[k] = xxhash.xxh3_64_intdigest(word, seed=seed)
            self._hash[form] = out
        return self._hash[form]

    def runs(self, k: int, form: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one document."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        times, x, size = FORMS[form][1], self.hashes(form), 1
        while 2 * size <= k:
            x, size = both(x[: len(x) - size], x[size:], times), 2 * size
        if size < k:
            x = both(x[:n], x[k - size : k - size + n], times)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, x[at]

    def sequences(self, form: int) -> np.ndarray:
        """A hash of each document's words in their order; documents without words have one as well."""
        first, last = self.first[:-1], self.first[1:]
        place = np.arange(len(self)) - self.first[self.doc]
        sums = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(both(self.hashes(form), mix64(place.astype(np.uint64)), FORMS[form][1]), out=sums[1:])
        return mix64(sums[last] - sums[first] + (last - first).astype(np.uint64))
