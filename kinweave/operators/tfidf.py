"""Token weights, cosines and weighted overlaps of pairs, and hashed text vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def idf_table(docs: DataFrame, tokens: Column, smooth: bool = True) -> DataFrame:
    """(token, idf): ln((1+n)/(1+df)) + 1 if smooth, else ln(n/df), over rows of docs."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1 if smooth else F.log(F.col("n") / F.col("df"))
    return df.select("token", idf.alias("idf"))


def unit_weights(docs: DataFrame, key: str, tokens: Column, idf: DataFrame) -> DataFrame:
    """(key, token, w): (1 + ln tf) * idf, scaled to length 1 per row; tokens without idf are left out."""
    tf = docs.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "token").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "token", (F.col("w") / F.col("norm")).alias("w"))


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """pairs (q, t) with the cosine of their unit weights (q, token, w) and (t, token, w); 0 if they share nothing."""
    ids = pairs.select("q", "t").distinct()
    shared = ids.join(left.withColumnRenamed("w", "wq"), "q").join(right.withColumnRenamed("w", "wt"), ["t", "token"])
    cos = shared.groupBy("q", "t").agg(F.sum(F.col("wq") * F.col("wt")).alias(name))
    return pairs.join(cos, ["q", "t"], "left").na.fill(0.0, [name])


def weighted_jaccard(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str, idf: DataFrame | None = None) -> DataFrame:
    """pairs (q, t) with sum of shared over sum of all token weights (1, or idf); left is (q, token), right (t, token), distinct."""

    def side(df: DataFrame, key: str) -> DataFrame:
        df = df.select(key, "token").distinct()
        return df.withColumn("w", F.lit(1.0)) if idf is None else df.join(idf.withColumnRenamed("idf", "w"), "token").select(key, "token", "w")

    a, b = side(left, "q"), side(right, "t")
    sums = [s.groupBy(k).agg(F.sum("w").alias(f"s{k}")) for s, k in ((a, "q"), (b, "t"))]
    ids = pairs.select("q", "t").distinct()
    shared = ids.join(a, "q").join(b.drop("w"), ["t", "token"]).groupBy("q", "t").agg(F.sum("w").alias("both"))
    out = pairs.join(sums[0], "q", "left").join(sums[1], "t", "left").join(shared, ["q", "t"], "left").na.fill(0.0, ["sq", "st", "both"])
    return out.withColumn(name, F.coalesce(F.try_divide(F.col("both"), F.col("sq") + F.col("st") - F.col("both")), F.lit(0.0))).drop("sq", "st", "both")


# --- fitted text vectors -------------------------------------------------------

_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def hashed_grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character 3- and 4-grams inside words framed by spaces, hashed: row, bucket and count, sorted by row; whole batches at once.

    A word of one letter, too short for a 4-gram, counts its 3-gram twice.
    """
    framed = [f" {' '.join((t or '').lower().split())} " for t in texts]
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row_of = np.repeat(np.arange(len(texts)), [len(f) for f in framed])
    rows, codes = [], []
    for n in (3, 4):
        if len(points) < n:
            continue
        part = [points[i : len(points) - n + 1 + i] for i in range(n)]
        inside = np.all([p != 32 for p in part[1:-1]], axis=0)  # framing spaces of two texts never meet inside a gram
        code = sum(p * m for p, m in zip(part, _MIX, strict=False)) + _U(n)
        at = np.flatnonzero(inside)
        rows.append(row_of[at])
        codes.append(code[at])
        if n == 3:
            alone = at[(part[0][at] == 32) & (part[2][at] == 32)]
            rows.append(row_of[alone])
            codes.append(code[alone])
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    code = np.concatenate(codes)
    code = (code ^ (code >> _U(29))) * _MIX[1]
    key, count = np.unique(np.concatenate(rows) * buckets + ((code >> _U(33)) % _U(buckets)).astype(np.int64), return_counts=True)
    return key // buckets, key % buckets, count


@dataclass
class Embedder:
    """idf of each bucket, and the components (buckets x dim) of the fitted space."""

    idf: np.ndarray
    components: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.idf)

    def weights(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and TF-IDF weight (sublinear, rows of length 1) of each text's grams."""
        row, bucket, count = hashed_grams(texts, self.buckets)
        w = (1 + np.log(np.maximum(count, 1))) * self.idf[bucket]
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(texts)))
        return row, bucket, w / np.maximum(norm[row], 1e-300)

    def encode(self, texts: list[str]) -> np.ndarray:
        """Unit vectors; a text without grams has the zero vector."""
        out = project(self.weights(texts), self.components, len(texts))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def project(sparse: tuple[np.ndarray, np.ndarray, np.ndarray], matrix: np.ndarray, n: int) -> np.ndarray:
    """A sparse matrix of n rows, sorted by row, times a dense one."""
    row, bucket, w = sparse
    out = np.zeros((n, matrix.shape[1]))
    edges = np.searchsorted(row, np.arange(n + 1))
    for i in range(n):
        lo, hi = edges[i], edges[i + 1]
        if hi > lo:
            out[i] = w[lo:hi] @ matrix[bucket[lo:hi]]
    return out


def fit_embedder(docs: DataFrame, dim: int = 128, buckets: int = 1 << 14, sample: int = 400_000, passes: int = 4, seed: int = 42) -> Embedder:
    """Hashed TF-IDF and truncated SVD of the texts, by a randomized range finder.

    docs has text. At most about `sample` texts, by a hash, are fitted on; each
    pass multiplies them by a (buckets x dim + 10) matrix on the executors, so
    only matrices of that size reach the driver, in parts.
    """
    spark, one = docs.sparkSession, 1 << 30
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    share = int(min(1.0, sample / max(1, texts.count())) * one)
    texts = texts.filter(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(one)) < share)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            _, bucket, _ = hashed_grams(batch.column("text").to_pylist(), buckets)
            total += np.bincount(bucket, minlength=buckets)
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    found = texts.mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = int(found.loc[found["bucket"] < 0, "n"].sum())
    held = np.zeros(buckets)
    held[found.loc[found["bucket"] >= 0, "bucket"]] = found.loc[found["bucket"] >= 0, "n"]
    idf = np.log((1 + n) / (1 + held)) + 1
    wide = min(buckets, dim + 10)

    def gathered(step, height: int) -> np.ndarray:
        """The sum over all tasks of step's matrices, merged part by part."""
        size = max(1, height // 16)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, wide))
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    step(batch.column("text").slice(lo, 512).to_pylist(), total)
            parts = range(0, height, size)
            yield pa.RecordBatch.from_arrays([pa.array([p // size for p in parts], pa.int32()), pa.array([total[p : p + size].tobytes() for p in parts], pa.binary())], names=["part", "m"])

        def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum(np.frombuffer(m) for pdf in frames for m in pdf["m"])
            yield pd.DataFrame({"part": [key[0]], "m": [total.tobytes()]})

        rows = texts.mapInArrow(run, "part int, m binary").groupBy("part").applyInPandas(add, "part int, m binary").collect()
        return np.concatenate([np.frombuffer(r["m"]) for r in sorted(rows, key=lambda r: r["part"])]).reshape(height, wide) if rows else np.zeros((height, wide))

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, wide)))[0]
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(Embedder(idf, basis))

        def power(texts: list[str], total: np.ndarray, shared=shared) -> None:
            model = shared.value
            row, bucket, w = model.weights(texts)
            np.add.at(total, bucket, w[:, None] * project((row, bucket, w), model.components, len(texts))[row])

        basis = np.linalg.qr(gathered(power, buckets))[0]
    shared = spark.sparkContext.broadcast(Embedder(idf, basis))

    def gram(texts: list[str], total: np.ndarray) -> None:
        y = project(shared.value.weights(texts), shared.value.components, len(texts))
        total += y.T @ y

    values, vectors = np.linalg.eigh(gathered(gram, wide))
    return Embedder(idf, basis @ vectors[:, np.argsort(-values)[:dim]])


def encoder(model: Embedder):
    """An Arrow UDF from text to the model's unit vector."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        out = [model.encode(texts.iloc[lo : lo + 512].tolist()) for lo in range(0, len(texts), 512)]
        return pd.Series(list(np.concatenate(out).astype(np.float32)) if out else [])

    return encode
