"""A learned encoder of records, trained on linked pairs.

Names and addresses are bags of hashed tokens (character 3- and 4-grams and
whole words). Each bag sums its tokens' vectors; both sums and two flags for
empty fields go through one linear layer, and the result has length 1. Training
draws the two records of a link together and pushes the other records of its
batch away (a softmax over the batch in both directions); batches hold records
of one country and first word, so that these others are look-alikes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tfidf import _MIX, _U, hashed_grams

SCALE = 20.0


def tokens(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct token of each text, sorted by row."""
    row, bucket, _ = hashed_grams(texts, buckets)
    rows, codes = [row], [bucket]
    split = [(t or "").lower().split() for t in texts]
    words = [w for s in split for w in s]
    if words:
        size = np.array(list(map(len, words)))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.cumsum(size) - size
        power = np.full(int(size.max()), _MIX[0])
        power[0] = 1
        hashed = np.add.reduceat(points * np.multiply.accumulate(power)[np.arange(len(points)) - np.repeat(start, size)], start)
        hashed = (hashed ^ (hashed >> _U(29))) * _MIX[2]
        rows.append(np.repeat(np.arange(len(texts)), list(map(len, split))))
        codes.append(((hashed >> _U(33)) % _U(buckets)).astype(np.int64))
    key = np.unique(np.concatenate(rows) * buckets + np.concatenate(codes))
    return key // buckets, key % buckets


@dataclass
class Encoder:
    """Token vectors of names and of addresses, and the layer that joins them."""

    name: np.ndarray
    address: np.ndarray
    layer: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.name)

    def inputs(self, bags: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """What goes into the layer, and how often each row's tokens count."""
        parts, scales, empty = [], [], []
        for (row, bucket), table in zip(bags, (self.name, self.address), strict=True):
            size = np.bincount(row, minlength=n)
            total = np.zeros((n, table.shape[1]))
            np.add.at(total, row, table[bucket])
            scale = 1 / np.sqrt(np.maximum(size, 1))
            parts.append(total * scale[:, None])
            scales.append(scale)
            empty.append((size == 0).astype(float))
        return np.column_stack([*parts, *empty]), scales

    def encode(self, names: list[str], addresses: list[str]) -> np.ndarray:
        x, _ = self.inputs([tokens(names, self.buckets), tokens(addresses, self.buckets)], len(names))
        z = x @ self.layer
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def _pick(bag: tuple[np.ndarray, np.ndarray], rows: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag's tokens of some rows, renumbered."""
    size = edges[rows + 1] - edges[rows]
    at = np.repeat(edges[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.repeat(np.arange(len(rows)), size), bag[1][at]


def _batches(keys: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows in batches; rows of one key come together, keys in random order."""
    order = np.lexsort((rng.random(len(keys)), rng.permutation(int(keys.max()) + 1)[keys]))
    return [order[i : i + size] for i in range(0, len(order), size) if len(order[i : i + size]) > 1]


def train(sides: list[tuple[list[str], list[str]]], keys: np.ndarray, dim: int = 64, bag: int = 64, buckets: int = 1 << 14, epochs: int = 4, batch: int = 256, rate: float = 0.1, seed: int = 42) -> Encoder:
    """Fit on pairs: sides holds names and addresses of the first and of the second records, keys what batches are grouped by in every other epoch."""
    rng, n = np.random.default_rng(seed), len(sides[0][0])
    model = Encoder(*(rng.normal(0, 0.1, (buckets, bag)) for _ in range(2)), rng.normal(0, 1 / np.sqrt(2 * bag), (2 * bag + 2, dim)))
    seen = [np.full(x.shape, 1e-8) for x in (model.name, model.address, model.layer)]
    bags = [[tokens(field, buckets) for field in side] for side in sides]
    edges = [[np.searchsorted(b[0], np.arange(n + 1)) for b in side] for side in bags]
    for epoch in range(epochs):
        for rows in _batches(keys if epoch % 2 else rng.permutation(n), batch, rng):
            picked = [[_pick(b, rows, e) for b, e in zip(side, edge, strict=True)] for side, edge in zip(bags, edges, strict=True)]
            given = [model.inputs(p, len(rows)) for p in picked]
            z = [x @ model.layer for x, _ in given]
            length = [np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in z]
            u = [v / m for v, m in zip(z, length, strict=True)]
            s = SCALE * u[0] @ u[1].T
            wish = np.zeros_like(s)
            for axis in (0, 1):
                e = np.exp(s - s.max(axis=axis, keepdims=True))
                wish += e / e.sum(axis=axis, keepdims=True)
            wish = SCALE * (wish - 2 * np.eye(len(rows))) / (2 * len(rows))
            layer, tables = np.zeros_like(model.layer), [{}, {}]
            for i, du in enumerate((wish @ u[1], wish.T @ u[0])):
                dz = (du - (du * u[i]).sum(1, keepdims=True) * u[i]) / length[i]
                layer += given[i][0].T @ dz
                dx = dz @ model.layer.T
                for f, (row, bucket) in enumerate(picked[i]):
                    part = dx[:, f * bag : (f + 1) * bag] * given[i][1][f][:, None]
                    tables[f][i] = (bucket, part[row])
            for f, table in enumerate((model.name, model.address)):
                bucket, grad = (np.concatenate([tables[f][i][k] for i in (0, 1)]) for k in (0, 1))
                own, at = np.unique(bucket, return_inverse=True)
                total = np.zeros((len(own), bag))
                np.add.at(total, at, grad)
                seen[f][own] += total**2
                table[own] -= rate * total / np.sqrt(seen[f][own])
            seen[2] += layer**2
            model.layer -= rate * layer / np.sqrt(seen[2])
    return model


def fit_encoder(pairs: DataFrame, most: int = 200_000, **options) -> Encoder:
    """Fit on linked pairs (q_name, q_address, t_name, t_address, country).

    At most about `most` pairs, by a hash, go to the driver; tables are of a
    fixed size. Missing text is ''.
    """
    one = 1 << 30
    share = int(min(1.0, most / max(1, pairs.count())) * one)
    fields = ("q_name", "q_address", "t_name", "t_address")
    rows = pairs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in fields], F.coalesce("country", F.lit("")).alias("country")).filter(F.pmod(F.xxhash64(*fields), F.lit(one)) < share)
    pdf = rows.orderBy(F.xxhash64(*fields), *fields).toPandas()
    if len(pdf) < 2:
        raise ValueError("an encoder needs two linked pairs")
    first = pdf["q_name"].str.split().str[0].fillna("")
    keys = pd.factorize(pdf["country"] + "|" + first)[0]
    return train([(pdf[f"{s}_name"].tolist(), pdf[f"{s}_address"].tolist()) for s in "qt"], keys, **options)


def encode(model: Encoder):
    """An Arrow UDF from name and address to the model's unit vector."""

    @F.pandas_udf("array<float>")
    def run(names: pd.Series, addresses: pd.Series) -> pd.Series:
        out = [model.encode(names.iloc[lo : lo + 512].tolist(), addresses.iloc[lo : lo + 512].tolist()) for lo in range(0, len(names), 512)]
        return pd.Series(list(np.concatenate(out).astype(np.float32)) if out else [])

    return run
