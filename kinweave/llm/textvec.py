"""Vectorised text primitives on Arrow string buffers.

A batch of texts is treated as one byte array. Words, their 64-bit hashes and
the hashes of word n-grams come out of a handful of numpy passes, so no Python
code runs per word. Only bytes are inspected: ASCII white space separates words
and A-Z is lower-cased, which never touches a byte of a multi-byte character.

Hashes are polynomials over random byte values modulo 2**64, finished with an
avalanche mixer; they depend on the word alone, never on its place or batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at a time; the arrays of a pass take eight times as much, and fit a processor's cache.
CHUNK = 1 << 18
_PRIME = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and every other ASCII character that is neither letter nor digit.
_MARK = _SPACE.copy()
_MARK[[c for c in range(128) if not chr(c).isalnum()]] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER_VALUE = _VALUE[_LOWER]

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        up, down = np.full(size, _PRIME), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _spans(data: np.ndarray, offs: np.ndarray, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK that never cut a word."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + CHUNK)
        while to < n:
            window = blank[data[to : to + 4096]]
            hits = np.flatnonzero(window)
            later = offs[np.searchsorted(offs, to, "left")]
            stop = min(to + hits[0] if len(hits) else n + 1, later)
            if stop <= to + 4096:
                to = int(stop)
                break
            to = min(n, to + 4096)
        yield at, to
        at = to


class Words:
    """Words of a batch: byte range, document index and 64-bit hash of each, and where each document's words begin."""

    def __init__(self, start: np.ndarray, end: np.ndarray, hash: np.ndarray, first: np.ndarray):
        self.start, self.end, self.hash, self.first = start, end, hash, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, marks: bool = False) -> Words:
    """Split every text at ASCII white space (with marks, at ASCII punctuation too) and hash the words with A-Z lower-cased."""
    data, offs = buffers(column)
    return words_of(data, offs, marks)


def words_of(data: np.ndarray, offs: np.ndarray, marks: bool = False) -> Words:
    starts, ends, hashes = [], [], []
    blank = _MARK if marks else _SPACE
    for lo, hi in _spans(data, offs, blank):
        part = data[lo:hi]
        space = blank[part]
        solid = ~space
        opens = solid.copy()
        opens[1:] &= space[:-1]
        closes = solid.copy()
        closes[:-1] &= space[1:]
        edges = offs[np.searchsorted(offs, lo, "left") : np.searchsorted(offs, hi, "left")] - lo
        edges = edges[edges < len(part)]
        opens[edges] |= solid[edges]
        edges = edges[edges > 0] - 1
        closes[edges] |= solid[edges]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_LOWER_VALUE[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + lo)
        ends.append(e + lo)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(start, end, hash, np.searchsorted(start, offs, "left"))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of every document, in order, and where each document's begin.

    A document of fewer than n words, but at least one, has one n-gram: all of
    its words. A document without words has none.
    """
    total = len(w.hash)
    counts = w.counts
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=first[1:])
    out = np.zeros(first[-1], dtype=np.uint64)
    if total >= n:
        rolled = np.full(total - n + 1, U(n), dtype=np.uint64)
        for k in range(n):
            rolled = mix(rolled * _PRIME + w.hash[k : total - n + 1 + k])
        long = counts >= n
        # place of each long document's n-grams in `rolled` and in `out`
        keep = np.zeros(total - n + 2, dtype=np.int32)
        np.add.at(keep, w.first[:-1][long], 1)
        np.add.at(keep, w.first[1:][long] - n + 1, -1)
        chosen = rolled[np.cumsum(keep[:-1]) > 0]
        target = np.ones(len(out), dtype=bool)
        target[first[:-1][(counts > 0) & ~long]] = False
        out[target] = chosen
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        h = U(counts[d])
        for x in w.hash[w.first[d] : w.first[d + 1]]:
            h = mix(np.array([h], dtype=np.uint64) * _PRIME + x)[0]
        out[first[d]] = h
    return out, first


def distinct(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of every document."""
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
