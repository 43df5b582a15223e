"""Word tables of whole text columns as numpy arrays, for use inside Arrow tasks.

A batch of texts is one byte buffer; words, word hashes and k-gram hashes are
computed on whole arrays, so a task does a fixed number of passes over its bytes
and holds one slice of at most ``SLICE_BYTES`` (or one longer text) at a time.
Word classes are byte classes: every class used here keeps all bytes of 0x80 and
above on the same side, so UTF-8 sequences are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_HASH_WORDS = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word bytes of `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = False
ALNUM[0x3A:0x61] = False
ALNUM[0x7B:0x80] = False

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over a 64-bit hash (xor-shift and multiply rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def seeds(n: int, family: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers for one family of hashes."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(family * 7919)) | np.uint64(1)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span; spans are in order and do not overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    for i in range(0, len(out), _HASH_WORDS):
        s, e = start[i:i + _HASH_WORDS], end[i:i + _HASH_WORDS]
        lo, hi = int(s[0]), int(e[-1])
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _power(_BASE, hi - lo), out=sums[1:], dtype=np.uint64)
        back = _power(_INV, hi - lo + 1)
        out[i:i + _HASH_WORDS] = mix((sums[e - lo] - sums[s - lo]) * back[s - lo] + (e - s).astype(np.uint64))
    return out


class Words:
    """Words of consecutive texts: byte spans, the text each belongs to, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> None:
        self.data = _LOWER[data]
        self.n_docs = len(offsets) - 1
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = word_bytes[self.data]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        cut = offsets[:-1]
        begins = inside & ~before
        ends = before & ~inside
        # a text border inside a run of word bytes ends one word and begins another
        both = cut[(cut > 0) & (cut < len(data))]
        both = np.unique(both[inside[both] & before[both]])
        begins[both] = True
        ends[both] = True
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)  # first word of every text, and the total
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.data, self.start, self.end)
        return self._hash

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from every word on; the last k-1 of a text reach into the next."""
        m, n = seeds(k, k), max(0, len(self.start) - k + 1)
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total += self.hash[j:j + n] * m[j]
        return mix(total)

    def words(self, i: int, j: int) -> str:
        """Words i to j-1 joined by single spaces."""
        return b" ".join(self.data[self.start[x]:self.end[x]].tobytes() for x in range(i, j)).decode("utf-8", "replace")


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of consecutive rows with about ``size`` bytes of text."""
    if not len(column):
        return
    _, offsets = buffer_of(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, len(column))
        i = min(j, len(column))


def slices(column: pa.Array, word_bytes: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for slices of about SLICE_BYTES of text."""
    data, offsets = buffer_of(column)
    for i, j in row_slices(column):
        yield i, j, Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], word_bytes)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct k-word shingle hashes; with fewer words the whole
    sequence as one shingle; without words an empty set."""
    grams, sets = words.grams(k), []
    for d in range(words.n_docs):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= k:
            sets.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            sets.append(mix(np.sum(words.hash[a:b] * seeds(b - a, b - a), dtype=np.uint64, keepdims=True)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets
