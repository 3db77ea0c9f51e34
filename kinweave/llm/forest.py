"""Nearest neighbours by inner product with hash-prefix forests.

A tree gives every vector a 64-bit hash string, one bit per random hyperplane.
The table is range-partitioned by the strings of a first tree; each range,
in segments of bounded size, holds a forest: for each tree, a sorted array of
strings. A query goes to the ranges whose prefixes it could reach at the least
cost (the margins of the bits that differ). There it descends every tree to its
longest matching prefix, and the trees then ascend together, one prefix length
at a time, until they offer enough vectors; those are scored exactly. Segments
answer independently; their best k are merged.

How many ranges are visited, and how many vectors are enough, is measured: a
bounded sample of queries is answered by brute force, and the least work that
finds the wanted share of their neighbours is taken. Where vectors lie in
clusters that is little; where they are spread evenly over a sphere of many
dimensions, prefixes tell little and most of the table is read, since no less
reaches the recall.

To turn the largest inner product into the smallest angle, vectors get one
more component that brings all to the same length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import released, small_batches, stage

BITS = 64
#: Ranges of the routing tree at most; shares of a segment's rows that are tried, in entries of all trees together.
RANGES, SHARES = 1024, (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.5, 3.0, 6.0, 64.0)


@lru_cache(256)
def _planes(tree: int, seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, dim]).standard_normal((dim, BITS))


def hash_strings(x: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """64-bit hash strings of the rows in one tree, first hyperplane in the highest bit."""
    return np.packbits(x @ _planes(tree, seed, x.shape[1]) > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that brings them to a squared length of top."""
    return np.column_stack([vectors, np.sqrt(np.maximum(0, top - np.einsum("ij,ij->i", vectors, vectors)))])


class Forest:
    """Sorted arrays of hash strings over one segment; top is the largest squared length of any vector."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int = 7, top: float | None = None):
        self.vectors, self.trees, self.seed = vectors, trees, seed
        x = lifted(vectors, np.einsum("ij,ij->i", vectors, vectors).max() if top is None else top)
        self.order, self.keys = [], []
        for t in range(1, trees + 1):
            h = hash_strings(x, t, seed)
            o = np.argsort(h, kind="stable")
            self.order.append(o)
            self.keys.append(h[o])

    def _ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, where the strings that share `depth` leading bits with each query begin and end."""
        keep = np.where(depth > 0, ~np.uint64(0) << np.uint64(BITS) - np.maximum(depth, 1).astype(np.uint64), np.uint64(0))
        low = strings & keep
        high = low | ~keep
        lo = np.stack([np.searchsorted(k, low[t], "left") for t, k in enumerate(self.keys)])
        hi = np.stack([np.searchsorted(k, high[t], "right") for t, k in enumerate(self.keys)])
        return lo, hi

    def strings(self, queries: np.ndarray) -> np.ndarray:
        x = np.column_stack([queries, np.zeros(len(queries))])
        return np.stack([hash_strings(x, t, self.seed) for t in range(1, self.trees + 1)])

    def candidates(self, strings: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query, vectors that share with it, in some tree, the longest prefix at which the trees together hold `wanted` or more."""
        n = strings.shape[1]
        # the number held falls as prefixes grow: bisect for the longest length at which it suffices
        low, high = np.zeros(n, np.int64), np.full(n, BITS)
        while (low < high).any():
            mid = (low + high + 1) // 2
            lo, hi = self._ranges(strings, mid)
            enough = (hi - lo).sum(0) >= wanted
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        lo, hi = self._ranges(strings, low)
        seen = np.zeros(len(self.vectors), bool)
        for q in range(n):
            if low[q] == 0:
                yield np.arange(len(self.vectors))
                continue
            seen[:] = False
            for t in range(self.trees):
                seen[self.order[t][lo[t, q] : hi[t, q]]] = True
            yield np.flatnonzero(seen)

    def nearest(self, queries: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of each query's best k candidates, the row of its own id apart; ids ascend."""
        found = list(self.candidates(self.strings(queries), wanted))
        dense = np.mean([len(f) for f in found]) * 4 > len(ids) if found else False
        for lo in range(0, len(found), 64):
            # where most rows are candidates, one product is cheaper than gathering rows for each query
            table = queries[lo : lo + 64] @ self.vectors.T if dense else None
            for q in range(lo, min(lo + 64, len(found))):
                rows = found[q][ids[found[q]] != query_ids[q]]
                rough = table[q - lo, rows] if dense else self.vectors[rows] @ queries[q]
                if len(rows) > k:
                    # products may round equal vectors apart: what is near the k-th is scored again, row by row
                    edge = np.partition(rough, len(rows) - k)[len(rows) - k]
                    rows = rows[rough >= edge - 1e-9 * (1 + np.abs(rough).max())]
                score = (self.vectors[rows] * queries[q]).sum(1)
                best = np.lexsort((ids[rows], -score))[:k]
                yield rows[best], score[best]


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _clean(df: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of usable vectors, one per vec_id."""
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    counts = rows.select("vec_id").agg(F.count("*"), F.count_distinct("vec_id")).first()
    if counts[0] == counts[1]:
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("m")).select("vec_id", "m.v", "m.dim")


@dataclass
class Plan:
    """The work that was found to be enough: ranges visited, entries per row of a segment, and the share of the sample's neighbours that they find."""

    bounds: np.ndarray
    visits: int
    share: float
    recall: float


def _costs(code: np.ndarray, margin: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What it costs each query to reach each range: margins of the bits in which it differs from the prefix that the range's strings share."""
    low = np.concatenate([[np.uint64(0)], bounds])
    high = np.concatenate([bounds - np.uint64(1), [~np.uint64(0)]])
    out = np.zeros((len(code), len(low)))
    for j, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        shared = BITS - (a ^ b).bit_length()
        if shared:
            apart = np.unpackbits((code ^ np.uint64(a)).astype(">u8")[:, None].view(np.uint8), axis=1)[:, :shared]
            out[:, j] = (apart * margin[:, :shared]).sum(1)
    return out


def _visited(queries: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """Ranges from the cheapest to reach on, for each query."""
    x = np.column_stack([queries, np.zeros(len(queries))])
    margin = np.abs(x @ _planes(0, seed, x.shape[1]))
    return np.argsort(_costs(hash_strings(x, 0, seed), margin, bounds), axis=1, kind="stable")


def _stacked(parts: pd.Series) -> np.ndarray:
    return np.stack(parts.to_numpy()).astype(float)


def _segments(data: DataFrame, top: float, segment_rows: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """data, written, with its range and segment in the range; and the bounds of the ranges."""

    @F.pandas_udf("long")
    def code(v: pd.Series, dim: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.uint64)
        for d in np.unique(dim):
            rows = np.flatnonzero(dim == d)
            out[rows] = hash_strings(lifted(_stacked(v.iloc[rows]), top), 0, seed)
        return pd.Series((out ^ np.uint64(1 << 63)).view(np.int64))  # signed, in the same order

    coded = stage(data.withColumn("code", code("v", "dim")), "vectors")
    n = coded.count()
    ranges = min(RANGES, max(1, math.ceil(n / segment_rows)))
    cuts = sorted(set(coded.agg(F.percentile_approx("code", [i / ranges for i in range(1, ranges)], 100_000)).first()[0])) if ranges > 1 else []
    per = max(1, math.ceil(n / (len(cuts) + 1) / segment_rows))
    cuts = np.array(cuts, np.int64)
    held = coded.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def place(code: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, code.to_numpy(np.int64), "right").astype(np.int32))

    placed = coded.withColumn("range", place("code") if len(cuts) else F.lit(0)).withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.lit(per)).cast("int"))
    return placed, cuts.view(np.uint64) ^ np.uint64(1 << 63)


def measure(data: DataFrame, queries: DataFrame, bounds: np.ndarray, top: float, k: int, trees: int, target: float, seed: int, sample: int = 64, segments: int = 3) -> Plan:
    """The least work that finds the share `target` of the neighbours of `sample` queries.

    Their neighbours are found by brute force over all rows; the forests that
    are tried are those of at most `segments` segments, by a hash.
    """
    spark = data.sparkSession
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(asked):
        return Plan(bounds, 1, 1.0, 1.0)
    held = spark.sparkContext.broadcast(asked)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = held.value
        for pdf in frames:
            out = []
            for d in np.unique(pdf["dim"]):
                x, q = pdf[pdf["dim"] == d].reset_index(drop=True), asked[asked["dim"] == d]
                if not len(q):
                    continue
                score = _stacked(q["v"]) @ _stacked(x["v"]).T
                score[q["vec_id"].to_numpy()[:, None] == x["vec_id"].to_numpy()[None, :]] = -np.inf
                for i, query in enumerate(q["vec_id"]):
                    top = np.argsort(-score[i], kind="stable")[: k + 1]
                    top = top[np.isfinite(score[i][top])][:k]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": x["vec_id"].to_numpy()[top], "score": score[i][top], "range": x["range"].to_numpy()[top], "sub": x["sub"].to_numpy()[top]}))
            if out:
                yield pd.concat(out, ignore_index=True)
        released()

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    truth = data.select("vec_id", "v", "dim", "range", "sub").mapInPandas(best, "query_id long, vec_id long, score double, range int, sub int").withColumn("rank", rank).filter(F.col("rank") <= k).toPandas()
    if not len(truth):
        return Plan(bounds, 1, 1.0, 1.0)
    # how many ranges must be visited
    place = np.zeros(len(truth), np.int64)
    for d in asked["dim"].unique():
        q = asked[asked["dim"] == d]
        order = np.argsort(_visited(_stacked(q["v"]), bounds, seed), axis=1)
        row = {v: i for i, v in enumerate(q["vec_id"])}
        mine = truth["query_id"].isin(row).to_numpy()
        place[mine] = order[truth["query_id"][mine].map(row).to_numpy(), truth["range"][mine].to_numpy()]
    within = target if not len(bounds) else math.sqrt(target)
    visits = int(np.sort(place)[min(len(place) - 1, math.ceil(within * len(place)) - 1)]) + 1
    reached = float((place < visits).mean())
    # what share of a segment must be offered
    some = truth[["range", "sub"]].drop_duplicates().sort_values(["range", "sub"])
    some = some.sample(min(segments, len(some)), random_state=seed)
    wanted = spark.createDataFrame(some.astype("int32"), "range int, sub int")
    wants = spark.sparkContext.broadcast(truth)

    def tried(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x, q = x.sort_values("vec_id"), held.value[held.value["dim"] == key[2]]
        goal = wants.value[(wants.value["range"] == key[0]) & (wants.value["sub"] == key[1])]
        q = q[q["vec_id"].isin(goal["query_id"])]
        if not len(q):
            return pd.DataFrame({"step": [], "hits": [], "total": []}).astype("int64")
        ids, forest = x["vec_id"].to_numpy(), Forest(_stacked(x["v"]), trees, seed, top)
        strings, out = forest.strings(_stacked(q["v"])), []
        for s, share in enumerate(SHARES):
            hits = total = 0
            for query, rows in zip(q["vec_id"], forest.candidates(strings, _entries(share, len(ids), trees, k)), strict=True):
                mine = goal["vec_id"][goal["query_id"] == query].to_numpy()
                mine = mine[np.isin(mine, ids)]
                hits, total = hits + int(np.isin(mine, ids[rows]).sum()), total + len(mine)
            out.append((s, hits, total))
        return pd.DataFrame(out, columns=["step", "hits", "total"])

    steps = data.join(F.broadcast(wanted), ["range", "sub"]).select("vec_id", "v", "dim", "range", "sub").groupBy("range", "sub", "dim").applyInPandas(tried, "step long, hits long, total long")
    found = steps.groupBy("step").agg((F.sum("hits") / F.sum("total")).alias("recall")).orderBy("step").collect()
    for r in found:
        if r["recall"] >= within:
            return Plan(bounds, visits, SHARES[r["step"]], reached * r["recall"])
    return Plan(bounds, visits, SHARES[-1], reached)


def _entries(share: float, rows: int, trees: int, k: int) -> int:
    """Entries that all trees of a segment offer together; never fewer than k + 1 from each."""
    return max(trees * (k + 1), int(share * rows))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 64, target: float = 0.96, segment_rows: int = 8192, query_rows: int = 2048, seed: int = 7, sample: int = 64, plan: list[Plan] | None = None) -> DataFrame:
    """The k nearest of `vectors` found for each row of `queries`, the row itself apart: query_id, rank, vec_id, score.

    Both have vec_id and an array of numbers `embedding`; other columns are not
    read. Nearness is the inner product in double precision, ties go to the
    smaller vec_id. target is the recall that must be measured on `sample`
    queries (see measure); every row is indexed and every query answered. The
    plan that was chosen is appended to `plan`.

    Vectors null, zero or with null or non-finite components take no part, nor
    do rows of null vec_id. Vectors of another length than the query's are not
    its candidates. Of rows that repeat a vec_id, the shortest vector counts, of
    equally long ones the smallest by components. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    data, asked = _clean(vectors), stage(_clean(queries), "queries")
    top = data.agg(F.max(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, b: a + b))).first()[0]
    if top is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    data, bounds = _segments(data, top, segment_rows, seed)
    chosen = measure(data, asked, bounds, top, k, trees, target, seed, sample)
    if plan is not None:
        plan.append(chosen)
    bounds, visits, share = spark.sparkContext.broadcast(chosen.bounds), chosen.visits, chosen.share

    @F.pandas_udf("array<int>")
    def goes(v: pd.Series, dim: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        for d in np.unique(dim):
            rows = np.flatnonzero(dim == d)
            for i, r in zip(rows, _visited(_stacked(v.iloc[rows]), bounds.value, seed)[:, :visits].astype(np.int32), strict=True):
                out[i] = r
        return pd.Series(out)

    blocks = max(1, math.ceil(asked.count() * visits / (len(chosen.bounds) + 1) / query_rows))
    subs = data.agg(F.max("sub")).first()[0] + 1
    to = goes("v", "dim") if len(chosen.bounds) else F.array(F.lit(0))
    q = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("range", F.explode(to)).withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))
    x = data.select("vec_id", "v", "dim", "range", "sub").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x = x.sort_values("vec_id")
        ids, asked = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        forest = Forest(_stacked(x["v"]), trees, seed, top)
        found = list(forest.nearest(_stacked(q["v"]), ids, asked, k, _entries(share, len(ids), trees, k)))
        rows = np.concatenate([f[0] for f in found])
        return pd.DataFrame({"query_id": np.repeat(asked, [len(f[0]) for f in found]), "vec_id": ids[rows], "score": np.concatenate([f[1] for f in found])})

    on = ("range", "sub", "block", "dim")
    found = x.groupBy(*on).cogroup(q.groupBy(*on)).applyInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> np.ndarray:
    """Brute force, to measure recall against: ids of the k nearest."""
    score = vectors @ query
    score = np.where(ids == query_id, -np.inf, score)
    return ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]]
