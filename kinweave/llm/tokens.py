"""Byte-level BPE ids of whole batches.

A tokenizer file of the byte-level BPE kind defines the ids. Texts are cut into
the pre-tokens of its pattern with numpy passes over code points, each distinct
pre-token is encoded once per worker, and ids are gathered by index. Texts with
code points beyond the tabled range, or that hold the string of an added token,
take the tokenizer itself, which is slower and gives the same ids.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from . import textvec as tv

#: The public pre-token pattern and the byte alphabet of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Code points that the vectorised cutter classifies.
TABLED = 0x3000
#: Pre-tokens kept by a worker before it starts anew.
CACHE = 1_000_000
#: Code points cut at a time.
SPAN = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level BPE files: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(TABLED, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        test = regex.compile(pattern)
        table[[c for c in range(TABLED) if test.match(chr(c))]] = kind
    return table


def cut(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points whose documents begin at `first` (all but the last entry)."""
    kind = _classes()[points]
    n = len(points)
    begins = np.zeros(n + 1, dtype=bool)
    begins[first[:-1][first[:-1] < n]] = True
    opens = begins[:-1].copy()
    opens[1:] |= kind[1:] != kind[:-1]
    start = opens.copy()
    at = np.flatnonzero(opens)
    ends = np.append(at[1:], n)
    space = kind[at] == SPACE
    # a run of white space gives its last character away if text of the document follows
    follows = (ends < n) & ~begins[ends]
    given = space & follows
    last = ends[given] - 1
    start[last] = True
    # a given space is the head of the next pre-token
    glued = ends[given][points[last] == 32]
    start[glued] = False
    # an apostrophe alone in its run, with no space glued to it, takes a short suffix
    alone = np.flatnonzero((points[at] == 39) & (ends - at == 1) & start[at] & follows)
    for i in alone:
        p = at[i]
        stop = ends[i + 1] if i + 1 < len(at) else n
        if kind[p + 1] != LETTER:
            continue
        tail = "".join(map(chr, points[p + 1 : min(p + 3, stop)]))
        for s in SUFFIXES:
            if tail.startswith(s):
                start[p + 1] = False
                if p + 1 + len(s) < stop:
                    start[p + 1 + len(s)] = True
                break
    return start


@lru_cache(1)
def _values() -> np.ndarray:
    """A random odd 64-bit value for each tabled code point."""
    return np.random.default_rng(20240301).integers(1, 1 << 63, TABLED, dtype=np.uint64) * tv.U(2) + tv.U(1)


class HashIndex:
    """Open-addressing table from non-zero 64-bit hashes to numbers, looked up and filled by whole arrays."""

    def __init__(self, most: int):
        size = 1 << (2 * most).bit_length()
        self.mask = tv.U(size - 1)
        self.keys, self.numbers = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.held = 0

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers, -1 where absent."""
        at = hashes & self.mask
        seen = self.keys[at]
        out = np.where(seen == hashes, self.numbers[at], -1).astype(np.int64)
        left = np.flatnonzero((seen != hashes) & (seen != 0))
        at = at[left]
        while len(left):
            at = (at + tv.U(1)) & self.mask
            want, seen = hashes[left], self.keys[at]
            hit = seen == want
            out[left[hit]] = self.numbers[at[hit]]
            go = ~hit & (seen != 0)
            left, at = left[go], at[go]
        return out

    def put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Enter distinct hashes that are absent."""
        self.held += len(hashes)
        at = hashes & self.mask
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            won = free & (self.keys[at] == hashes)
            self.numbers[at[won]] = numbers[won]
            hashes, numbers, at = hashes[~won], numbers[~won], (at[~won] + tv.U(1)) & self.mask


class Encoder:
    """Ids of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        kind = spec.get("pre_tokenizer") or {}
        letters = byte_alphabet()
        added = [t["content"] for t in spec.get("added_tokens", [])]
        specials = set(added)
        #: Texts that hold one of these may have ids of added tokens; the pattern ignores case and so errs on the safe side.
        self.added = regex.compile("|".join(map(regex.escape, added)), regex.IGNORECASE) if added else None
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in specials}
        self.path, self._direct = path, None
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._reset()

    @property
    def direct(self) -> Tokenizer:
        """The tokenizer itself, loaded when a text first needs it."""
        if self._direct is None:
            self._direct = Tokenizer.from_file(self.path)
        return self._direct

    def _reset(self) -> None:
        self.table = HashIndex(CACHE)
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pre-tokens and enter them in the table."""
        lists = [self.bpe.encode_ordinary(p) for p in pieces]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        base = len(self.begin) - 1
        self.ids = np.concatenate([self.ids, flat])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.table.put(hashes, base + np.arange(len(hashes)))

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=first[1:])
        at = np.flatnonzero(cut(points, first))
        up, down = tv._power_tables(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_values()[points] * up[: len(points)], out=total[1:])
        ends = np.append(at[1:], len(points))
        hashes = tv.mix((total[ends] - total[at]) * down[at]) | tv.U(1)
        slots = self.table.get(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            unique, where = np.unique(hashes[new], return_index=True)
            if self.table.held + len(unique) > CACHE:
                self._reset()
                unique, new = np.unique(hashes, return_index=True)
                where = np.arange(len(new))
            w = new[where]
            self._learn(unique, [joined[a:b] for a, b in zip(at[w].tolist(), ends[w].tolist(), strict=True)])
            slots = self.table.get(hashes)
        sizes = self.begin[slots + 1] - self.begin[slots]
        done = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(sizes, out=done[1:])
        index = np.arange(done[-1]) + np.repeat(self.begin[slots] - done[:-1], sizes)
        return self.ids[index], done[np.searchsorted(at, first, "left")]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text, without the special tokens that frame a text; added tokens that the text spells out count."""
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        group: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal group, held
            if group:
                ids, first = self._fast([texts[i] for i in group])
                for k, i in enumerate(group):
                    out[i] = ids[first[k] : first[k + 1]]
            group, held = [], 0

        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif (not text.isascii() and max(text) >= chr(TABLED)) or (self.added is not None and self.added.search(text)):
                out[i] = np.array(self.direct.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                group.append(i)
                held += len(text)
                if held >= SPAN:
                    flush()
        flush()
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8))


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]
