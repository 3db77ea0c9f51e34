"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An alignment that reaches the wanted score holds a known number of seeds (pairs
of neighbouring words, or single words for short items): inserted, deleted and
replaced words are paid for out of one budget, and cannot break more pairs than
it buys. Half of that number is given up for the commonest seeds of each item,
so only its rarer seeds are searched for, and a place is aligned if it holds
the rest of the number. How common a seed is only decides which seeds these
are: nothing that reaches the score is lost, whatever the corpus.

Documents are read twice through a Bloom filter of bounded size: once to count
the seeds, once to find the places of the rarer ones. Hits of one item that lie
close together make a window, and the words of window and item are aligned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import OWN, HashFilter, small_batches, stage, text_key, tidy

MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds are broadcast to their places up to so many rows of 40 bytes; beyond, they are joined in SALTS shares.
BROADCAST_SEEDS, SALTS = 500_000, 16


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences of word hashes: score, and where it begins and ends in the window.

    Row by row; gaps along the row come from a running maximum.
    """
    if not len(item) or not len(window):
        return 0, 0, 0
    n = len(window)
    steps = np.arange(n + 1) * -GAP
    # scores carry their starting column in the low bits, so the start needs no traceback
    base = np.int64(n + 2)
    fresh_start = base - 1 - np.arange(n + 1)
    above = fresh_start.copy()
    best, end = 0, 0
    for w in item:
        near = np.where(window == w, MATCH, MISMATCH) * base
        row = fresh_start.copy()
        np.maximum(row[1:], above[:-1] + near, out=row[1:])
        np.maximum(row, above + GAP * base, out=row)
        row = np.maximum.accumulate(row + steps * base) - steps * base
        np.maximum(row, fresh_start, out=row)
        k = int(np.argmax(row // base))
        if row[k] // base > best:
            best, end, at = int(row[k] // base), k, int(row[k] % base)
        above = row
    return (best, int(base - 1 - at), end) if best else (0, 0, 0)


def seed_plan(words: int, least: float) -> tuple[int, int, int]:
    """(n, given, span) for an item: words in a seed, how many of its commonest seeds need not be searched, and how many an alignment still holds.

    With m matching words and e others, a score of `least` means
    2m - e >= 2 * least * words and m <= words. The m matches lie in at most
    e + 1 runs, so at least m - e - 1 pairs of neighbouring matches remain,
    which is least at m = words. If that leaves no pair, single words are the
    seeds, of which at least `least` * words match. An alignment spans at most
    words + 2 * (1 - least) * words words of the document.
    """
    edits = math.floor(2 * words - 2 * least * words + 1e-9)
    pairs, single = words - edits - 1, max(1, math.ceil(least * words - 1e-9))
    n, held = (2, pairs) if pairs >= 1 else (1, single)
    given = held // 2
    return n, given, held - given


def _span(words: int, least: float) -> int:
    return words + math.floor(2 * words - 2 * least * words + 1e-9)


def _keyed_items(items: DataFrame, least: float) -> DataFrame:
    """Distinct (item_id, text) with a number of their own, their words, and their seeds' plan; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tv.words(batch.column("text"), marks=True)
            counts = w.counts
            kept = np.flatnonzero(counts)
            plans = [seed_plan(int(counts[i]), least) for i in kept]
            columns = [batch.column("item").take(pa.array(kept)), batch.column("item_id").take(pa.array(kept)), pa.array(counts[kept], pa.int64())]
            columns += [pa.array([p[k] for p in plans], pa.int32()) for k in range(3)] + [pa.array([_span(int(counts[i]), least) for i in kept], pa.int64())]
            columns.append(pa.array([w.hash[w.first[i] : w.first[i + 1]].tobytes() for i in kept], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "n_words", "n", "given", "needed", "span", "words"])

    slim = items.select("item_id", F.lower("text").alias("text")).distinct().withColumn("item", F.monotonically_increasing_id())
    return stage(slim.select("item", "item_id", "text").mapInArrow(run, "item long, item_id long, n_words long, n int, given int, needed int, span long, words binary"), "items")


def _grams(w: tv.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams, the n-grams of a document of fewer words left out, and where each document's begin."""
    g, first = tv.ngrams(w, n)
    short = (w.counts > 0) & (w.counts < n)
    if short.any():
        g = g.copy()
        g[first[:-1][short]] = tv.U(0)
    return g, first


def item_seeds(keyed: DataFrame) -> DataFrame:
    """(item, hash, at): every seed of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for item, n, blob in zip(batch.column("item").to_pylist(), batch.column("n").to_pylist(), batch.column("words").to_pylist(), strict=True):
                h = np.frombuffer(blob, np.uint64)
                g, _ = tv.ngrams(tv.Words(np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), h, np.array([0, len(h)])), n)
                out.append((np.full(len(g), item, np.int64), g.view(np.int64), np.arange(len(g))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["item", "hash", "at"])

    return keyed.select("item", "n", "words").mapInArrow(run, "item long, hash long, at long")


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.6) -> DataFrame:
    """Passages of test items in documents: (doc_id, item_id, score, start, end, n_words), one row per document and item.

    docs has doc_id and text, items item_id and text. Words are runs of
    lower-cased text between ASCII white space or punctuation. The score is the
    Smith-Waterman score (match 2, others -1) over twice the item's words: 1 for
    an exact copy, 0.85 if one word in ten is replaced; passages from `least`
    count, and every one of them is found (see seed_plan). start and end are
    word positions in the document. An item of a single word is found wherever
    the word is.

    Null and empty texts hold nothing, and items without words are in nothing;
    null ids are ids of their own. Rows that repeat an item_id are looked for
    one by one, and rows that repeat a doc_id searched one by one; of one
    doc_id and item_id the best score is returned (of equal ones the smallest
    start, then the smallest end). An empty table on either side gives no rows;
    other columns are not read.
    """
    best = _leaks(docs, items, least)
    return best.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("start"), (-F.col("end")).alias("end"), "n_words")).alias("m")).select("doc_id", "item_id", "m.score", (-F.col("m.start")).alias("start"), (-F.col("m.end")).alias("end"), "m.n_words")


def _leaks(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(doc_id, key, item_id, score, start, end, n_words) per different (doc_id, text) and item row that reach the score."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed_items = _keyed_items(items, least)
    sizes = {r["n"] for r in keyed_items.select("n").distinct().collect()}
    seeds = stage(item_seeds(keyed_items), "seeds")
    unique, n_seeds = seeds.select("hash").distinct(), seeds.count()
    all_seeds = spark.sparkContext.broadcast(HashFilter.of(unique, n_seeds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def fold() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "times"])

        for batch in batches:
            w = tv.words(batch.column("text"), marks=True)
            for n in sizes:
                g = _grams(w, n)[0]
                held.append(g[all_seeds.value.places(g)])
                size += len(held[-1])
            if size > 1 << 18:
                yield fold()
                held, size = [], 0
        if held:
            yield fold()

    texts = docs.select(F.lower("text").alias("text"))
    times = texts.mapInArrow(tidy(count), "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times"))
    rarest = Window.partitionBy("item").orderBy(F.coalesce("times", F.lit(0)).desc(), "hash", "at")
    rare = seeds.join(times, "hash", "left").withColumn("nth", F.row_number().over(rarest)).join(keyed_items.select("item", "given", "needed", "span"), "item").filter("nth > given and times > 0")
    rare = stage(rare.select("hash", "item", "needed", "span").distinct(), "rare", n_seeds)
    searched = rare.select("hash").distinct()
    held = spark.sparkContext.broadcast(HashFilter.of(searched, searched.count()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tv.words(batch.column("text"), marks=True)
            for n in sizes:
                g, first = _grams(w, n)
                at = held.value.places(g)
                row = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(g[at].view(np.int64)), pa.array(at - first[row])], names=["key", "hash", "pos"])

    keyed = docs.select("doc_id", text_key("doc_id", "text").alias("key"), F.lower("text").alias("text"))
    places = keyed.select("key", "text").mapInArrow(tidy(search), "key binary, hash long, pos long")
    if rare.count() <= BROADCAST_SEEDS:
        hits = places.join(F.broadcast(rare), "hash")
    else:
        shares = rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = places.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int")).join(shares, ["hash", "salt"])
    hits = hits.select("key", "item", "needed", "span", "pos").distinct()
    # neighbourhoods: hits of an item that one alignment may hold
    w = Window.partitionBy("key", "item").orderBy("pos")
    chained = hits.withColumn("new", (F.col("pos") - F.lag("pos").over(w) > F.col("span")).cast("int")).withColumn("area", F.sum(F.coalesce("new", F.lit(0))).over(w))
    areas = chained.groupBy("key", "item", "needed", "span", "area").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("hits")).filter("hits >= needed")
    # a long area is cut; each piece holds whatever an alignment with a hit in it may hold
    stride = F.col("span") * 2 + 8
    cut = areas.select("key", "item", "lo", "hi", "span", F.explode(F.sequence(F.lit(0), ((F.col("hi") - F.col("lo")) / stride).cast("int"))).alias("k"))
    cut = cut.select("key", "item", (F.col("lo") + F.col("k") * stride - F.col("span")).alias("lo"), (F.least("hi", F.col("lo") + (F.col("k") + 1) * stride) + F.col("span") + 2).alias("hi"))
    cut = cut.join(keyed_items.select("item", "item_id", "words"), "item")
    windows = stage(cut.groupBy("key").agg(F.collect_list(F.struct("item_id", "lo", "hi", "words")).alias("windows")), "windows")

    # only documents that may have a window move
    here = windows.select(F.xxhash64("key").alias("hash")).distinct()
    wanted = spark.sparkContext.broadcast(HashFilter.of(here, here.count()))

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        out = np.zeros(len(hashes), bool)
        out[wanted.value.places(hashes.to_numpy(np.int64).view(np.uint64))] = True
        return pd.Series(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            w = tv.words(batch.column("text"), marks=True)
            out: list[tuple] = []
            for i, (doc, key, spots) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "windows")), strict=True)):
                words = w.hash[w.first[i] : w.first[i + 1]]
                for s in spots:
                    lo, item = max(0, s["lo"]), np.frombuffer(s["words"], np.uint64)
                    best, a, b = align(item, words[lo : s["hi"]])
                    if best / (MATCH * len(item)) >= least - 1e-9:
                        out.append((doc, key, s["item_id"], best / (MATCH * len(item)), lo + a, lo + b, len(item)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["doc_id", "key", "item_id", "score", "start", "end", "n_words"])

    moved = keyed.filter(F.col("text").isNotNull() & may(F.xxhash64("key"))).join(windows.hint("merge"), "key")
    return moved.select("doc_id", "key", "text", "windows").mapInArrow(tidy(score), "doc_id long, key binary, item_id long, score double, start long, end long, n_words long")


def decontaminate(docs: DataFrame, items: DataFrame, least: float = 0.6) -> DataFrame:
    """docs without the rows whose text holds a passage of a test item (see find_leaks); rows that share a doc_id are judged each by its own text."""
    leaks = _leaks(docs, items, least).select(F.col("key").alias(f"{OWN}k")).distinct()
    kept = docs.withColumn(f"{OWN}k", text_key("doc_id", "text")).join(leaks, f"{OWN}k", "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
