"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot is a mask with a bit
for each language (words of 63 bits, as many as the languages need), an n-gram sets its language's bit in each of its slots, and
the AND of an n-gram's slots names every language that may hold it. A text's
n-grams are looked up at once; the counts per language, corrected for each
language's rate of false positives, decide.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import small_batches

#: Languages in a word of a mask; slots of the filter; slots per n-gram; code points per n-gram.
WORD, SLOTS, HASHES, N = 63, 1 << 20, 3, 3
SPAN = 1 << 18
UNKNOWN = "und"
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


@lru_cache(1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself lower-cased if it is a letter or mark, else a space; and whether it is a letter."""
    fold, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    return fold, letter


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all trigrams of the folded texts (63 bits, exact), the text each is of, and whether each text has a letter.

    Texts are framed by spaces; a trigram with a space in its middle is left out.
    """
    fold, letter = _folding()
    raw = np.frombuffer("\x00".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = fold[raw].astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes
    hold = np.concatenate([[0], np.cumsum(letter[raw])])
    a, b, c = folded[:-2], folded[1:-1], folded[2:]
    good = np.flatnonzero(b != 32)
    codes = (a[good] << tv.U(42)) | (b[good] << tv.U(21)) | c[good]
    return codes, np.searchsorted(first, good + 1, "right") - 1, hold[first + sizes] > hold[first]


def slots_of(codes: np.ndarray, k: int) -> np.ndarray:
    x = codes * tv.U(_MULTIPLIERS[k])
    return ((x ^ (x >> tv.U(29))) * tv.U(_MULTIPLIERS[(k + 1) % 3]) >> tv.U(44)).astype(np.int64) & (SLOTS - 1)


def _spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SPAN:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class Filters:
    """languages in the order of their bits; masks by word and slot; rate: false positives of each language; usual: its share of the texts, which breaks ties."""

    languages: list[str]
    masks: np.ndarray
    rate: np.ndarray
    usual: np.ndarray

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of each text and language, n-grams of each text, and whether it has a letter."""
        hits, total, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for lo, hi in _spans(texts):
            codes, row, letters[lo:hi] = grams(texts[lo:hi])
            places = [slots_of(codes, k) for k in range(HASHES)]
            total[lo:hi] = np.bincount(row, minlength=hi - lo)
            edges = np.searchsorted(row, np.arange(hi - lo + 1))
            for word, held in enumerate(self.masks):
                mask = held[places[0]]
                for at in places[1:]:
                    mask = mask & held[at]
                for b in range(min(WORD, len(self.languages) - word * WORD)):
                    run = np.concatenate([[0], np.cumsum((mask >> b) & 1)])
                    hits[lo:hi, word * WORD + b] = run[edges[1:]] - run[edges[:-1]]
        return hits, total, letters

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and the share of its n-grams that the language explains."""
        hits, total, letters = self.counts(texts)
        share = (hits / np.maximum(total, 1)[:, None] - self.rate) / (1 - self.rate)
        share = np.clip(np.round(share, 6), 0, 1)
        best = (share + 1e-9 * self.usual).argmax(1) if len(self.languages) else np.zeros(len(texts), int)
        names = [self.languages[i] if ok and self.languages else UNKNOWN for i, ok in zip(best, letters, strict=True)]
        score = share[np.arange(len(texts)), best] if self.languages else np.zeros(len(texts))
        return names, np.where(letters, score, 0.0)


def learn_filters(labelled: DataFrame, per_language: int = 20_000, least: float = 5e-6) -> Filters:
    """Filters from (text, lang) rows without null lang.

    per_language bounds the sample: of each language about so many rows are
    taken, by a hash of the text. An n-gram enters a language's filter if it is
    seen three times or more and makes up at least a share `least` of the
    language's n-grams in the sample. Rows of null text or lang are not learned
    from; rows that repeat count as often as they stand there; an empty table
    gives filters that answer `und`. The driver holds one count per language.
    """
    small_batches(labelled.sparkSession)
    counts = {r["lang"]: r["count"] for r in labelled.filter("lang is not null and text is not null").groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Filters([], np.zeros((0, SLOTS), np.int64), np.zeros(0), np.zeros(0))
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(int(min(1.0, per_language / counts[name]) * (1 << 30))))])
    sample = labelled.filter("lang is not null and text is not null").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            mine = np.array([bit[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi in _spans(texts):
                codes, row, _ = grams(texts[lo:hi])
                for b in np.unique(mine[lo:hi]):
                    own = codes[mine[lo:hi][row] == b]
                    code, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(np.full(len(code), b)), pa.array(n)], names=["code", "bit", "n"])

    seen = sample.select("text", "lang").mapInArrow(count, "code long, bit long, n long").groupBy("code", "bit").agg(F.sum("n").alias("n"))
    total = seen.groupBy("bit").agg(F.sum("n").alias("total"))
    kept = seen.join(F.broadcast(total), "bit").filter((F.col("n") >= 3) & (F.col("n") >= F.col("total") * least)).groupBy("code", F.expr(f"cast(bit div {WORD} as int)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(bit % {WORD} as int))")).alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, word, mask = batch.column("code").to_numpy().view(np.uint64), batch.column("word").to_numpy(), batch.column("mask").to_numpy()
            at = np.concatenate([slots_of(codes, k) for k in range(HASHES)])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(word, HASHES)), pa.array(np.tile(mask, HASHES))], names=["slot", "word", "mask"])

    # at most one row per slot and word reaches the driver, 8 MB of masks for 63 languages
    rows = kept.mapInArrow(place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((-(-len(languages) // WORD), SLOTS), np.int64)
    masks[rows["word"].to_numpy(np.int64), rows["slot"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    fill = np.array([((masks[b // WORD] >> b % WORD) & 1).mean() for b in range(len(languages))])
    usual = np.array([counts[name] for name in languages], float)
    return Filters(languages, masks, fill**HASHES, usual / usual.sum())


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with lang_pred and score (0 to 1); null texts and texts without a letter get `und` and 0. Columns of these names are replaced.

    Equal texts get equal answers; of languages that explain as many n-grams,
    the one with more texts among those learned from wins.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, score = shared.value.decide([t or "" for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": score})

    out = docs.drop("lang_pred", "score").withColumn("__kw_p", predict("text"))
    return out.withColumns({"lang_pred": F.col("__kw_p.lang_pred"), "score": F.col("__kw_p.score")}).drop("__kw_p")
