"""Packing documents into fixed windows by best-fit decreasing.

A document's ids and an end id are cut into full windows first; what is left,
shorter than a window, is packed. Pieces are spread by hash over groups of a
bounded number; in a group they go from long to short, each into the tightest
open window, which a segment tree indexed by remaining capacity finds in one
descent. A group leaves at most a few windows unfilled, so padding stays small
however many groups there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import small_batches, stage, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `window` ids of every document (a null text is empty): doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: list[tuple] = []
                kept: list[np.ndarray] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(tokens.texts_of(part.column("text"))), strict=True):
                    ids = np.concatenate([ids, end])
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        rows.append((doc, at, len(piece), tokens.crc(piece), len(ids)))
                        kept.append(piece)
                columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array([k.astype(np.int64) for k in kept], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run, tokens.__name__), PIECES + (", ids array<long>" if with_ids else ""))


class CapacityTree:
    """Segment tree over remaining capacities 0..window; a leaf holds the open windows of that capacity."""

    def __init__(self, window: int):
        self.width = 1 << window.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.width
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of least capacity of at least `least`."""
        i = least + self.width
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.width
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each length, taken in the order given; and the number of windows."""
    tree, bins, offsets, made = CapacityTree(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        capacity, at = found or (window, made)
        made += found is None
        bins[k], offsets[k] = at, window - capacity
        if capacity > n:
            tree.put(capacity - n, at)
    return bins, offsets, made


def pack(pieces: DataFrame, window: int = 1024, group_rows: int = 50_000) -> DataFrame:
    """pieces (doc_id, start, length, ...) with sequence_id and offset.

    Groups get group_rows pieces on average, whatever doc_ids are null or repeated. Sequence ids are unique, not
    gapless: a group's number times 2**32 plus the window's number in it. Ties
    of length go by doc_id (null first) and start. The input should be a
    written table: it is read twice.
    """
    n = pieces.filter(F.col("length") < window).count()
    groups = max(1, math.ceil(n / group_rows))
    # rows are dealt by what they hold and where they stand in the table, so neither one doc_id nor equal rows make a large group
    deal = F.xxhash64("doc_id", "start", "length", F.monotonically_increasing_id())
    full = pieces.filter(F.col("length") >= window)
    rest = pieces.filter(F.col("length") < window)
    names = pieces.columns

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], na_position="first", kind="stable")
        bins, offsets, _ = best_fit(pdf["length"].to_numpy(), window)
        return pdf[names].assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=offsets)

    packed = rest.withColumn("__kw_g", F.pmod(deal, F.lit(groups)).cast("int")).groupBy("__kw_g").applyInPandas(run, rest.schema.simpleString()[7:-1] + ", sequence_id long, offset long")
    alone = full.withColumns({"sequence_id": F.monotonically_increasing_id() + (1 << 62), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, group_rows: int = 50_000) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts hold the end id alone. Rows that repeat a doc_id are
    documents of their own. Empty tables give no rows; other columns are not read.
    """
    return pack(stage(token_pieces(docs, tokenizer, window, end_id), "pieces"), window, group_rows)
