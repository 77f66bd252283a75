"""Vectorised words and word hashes of Arrow strings, for use inside tasks.

A word is a run of digits, a-z and bytes beyond ASCII after lower-casing A-Z.
In UTF-8 every byte of a character beyond ASCII is itself beyond ASCII, so
working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text whose words are hashed at once; bounds the temporary arrays.
SEGMENT = 1 << 20


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``max_bytes`` of text each, or one row."""
    n = batch.num_rows
    sizes = np.array([0 if s is None else s for s in pa.compute.binary_length(batch.column(column)).to_pylist()], np.int64)
    begin = 0
    while begin < n:
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), max_bytes, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array, nulls as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of many texts: ``doc`` (index of the text), ``start``/``end`` (bytes
    in the joined texts), ``hash`` (64 bits). ``first[i]:first[i + 1]`` are the
    words of text i."""

    def __init__(self, texts: pa.Array):
        offsets, data = _buffers(texts)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        kind = np.zeros(256, bool)
        kind[48:58] = kind[97:123] = kind[128:] = True
        self.bytes = lower[data]
        inside = kind[self.bytes]
        n = len(inside)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < n]  # a text's first byte starts a word, the byte before ends one
        begins[edge] |= inside[edge]
        before = edge[edge > 0] - 1
        ends[before] |= inside[before]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Polynomial hashes mod 2^64 by prefix sums, mixed."""
        base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        table = np.random.default_rng(42).integers(1, 1 << 63, 256, np.uint64)
        out, k, m = np.empty(len(self.start), np.uint64), 0, len(self.start)
        powers = inverses = np.ones(0, np.uint64)
        while k < m:
            a = self.start[k]
            j = max(k + 1, int(np.searchsorted(self.end, a + SEGMENT, "right")))
            size = int(self.end[j - 1] - a)
            if len(powers) < size + 1:
                grow = lambda x: np.multiply.accumulate(np.concatenate(
                    [np.ones(1, np.uint64), np.full(max(size, SEGMENT), x, np.uint64)]))
                powers, inverses = grow(base), grow(inverse)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(table[self.bytes[a:a + size]] * powers[:size], out=sums[1:])
            s, e = self.start[k:j] - a, self.end[k:j] - a
            out[k:j] = mix((sums[e] - sums[s]) * inverses[s])
            k = j
        return out


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of all k-word shingles; a text of 1 to k - 1 words has one, of all its words.

    ``words`` are the word hashes of many texts, ``first`` the index of each text's first word and the end."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(begin[-1]) - begin[doc]
    at, left = first[doc] + pos, np.minimum(n[doc] - pos, k)
    h = np.full(len(doc), 0x51ED270B, np.uint64) + left.astype(np.uint64)
    for i in range(k):
        some = left > i
        w = words[np.where(some, at + i, 0)] if len(words) else np.zeros(len(at), np.uint64)
        h = np.where(some, (h ^ w.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25), h)
        h ^= h >> np.uint64(29)
    return doc, pos, mix(h)


def occurrences(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many earlier equal (group, value) each element has; groups are below 2^31."""
    key = mix(value + group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    run = np.flatnonzero(new)
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - run[np.cumsum(new) - 1] if len(s) else 0
    return out
