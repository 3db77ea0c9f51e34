"""Nearest-neighbour joins over array columns, within groups.

Queries and targets carry (id, vector, group columns). Exact joins multiply
blocks of bounded size: each task holds one block of queries and one of
targets, keeps the best k per query, and a window merges them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))


def exact_knn(queries: DataFrame, targets: DataFrame, k: int, by: list[str], q: str = "q", t: str = "t", v: str = "v", apart: bool = False, block: int = 8192, floor: float | None = None) -> DataFrame:
    """(by..., q, t, score, rank): the k targets of largest inner product per query and group; ties by t.

    apart leaves out targets whose id equals the query's; scores below floor do
    not count. A group is dealt into
    blocks of about `block` rows by hash, so none is bound to one task.
    """
    sizes = targets.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("__tb"))
    asked = queries.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("__qb"))
    shape = sizes.join(asked, by)
    right = targets.select(*by, F.col(t).alias("t"), F.col(v).cast("array<double>").alias("tv")).join(shape, by).withColumn("__i", F.pmod(F.xxhash64("t"), F.col("__tb"))).withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__qb").cast("long") - 1)))
    left = queries.select(*by, F.col(q).alias("q"), F.col(v).cast("array<double>").alias("qv")).join(shape, by).withColumn("__j", F.pmod(F.xxhash64("q"), F.col("__qb"))).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tb").cast("long") - 1)))
    # names anew, so that sides of one origin can meet
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    kinds = {f.name: f.dataType for f in left.schema}
    out = ", ".join([*(f"{c} {kinds[c].simpleString()}" for c in by), f"q {kinds['q'].simpleString()}", f"t {right.schema['t'].dataType.simpleString()}", "score double"])

    least = -np.inf if floor is None else floor

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype=object) for c in [*by, "q", "t", "score"]})
        if not len(a) or not len(b):
            return empty
        b = b.sort_values("t", kind="stable")
        ids, matrix = b["t"].to_numpy(), np.stack(b["tv"].to_numpy()).T
        parts = []
        for lo in range(0, len(a), 512):
            some = a.iloc[lo : lo + 512]
            score = np.stack(some["qv"].to_numpy()) @ matrix
            names = some["q"].to_numpy()
            if apart:
                score = np.where(names[:, None] == ids[None, :], -np.inf, score)
            most = min(k, len(ids))
            # the k-th best score decides; ties at it go by id
            edge = np.partition(score, len(ids) - most, axis=1)[:, len(ids) - most]
            for i in range(len(some)):
                near = np.flatnonzero((score[i] >= edge[i]) & (score[i] > -np.inf) & (score[i] >= least))
                near = near[np.lexsort((near, -score[i][near]))[:most]]
                parts.append((np.repeat(names[i : i + 1], len(near)), ids[near], score[i][near]))
        found = pd.DataFrame({c: np.concatenate([p[j] for p in parts]) for j, c in enumerate(("q", "t", "score"))})
        for c in by:
            found[c] = a[c].iloc[0]
        return found[[*by, "q", "t", "score"]]

    keys = [*by, "__i", "__j"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(multiply, out)
    rank = F.row_number().over(Window.partitionBy(*by, "q").orderBy(F.round("score", 12).desc(), "t"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def second_hop(first: DataFrame, targets: DataFrame, k: int, floor: float, by: list[str]) -> DataFrame:
    """(q, t, score, rank): neighbours of each query's rank-1 hits of score >= floor, best score per pair, 2k kept.

    first is (by..., q, t, score, rank) of a kNN join; targets (by..., t, v).
    """
    seeds = first.filter((F.col("rank") == 1) & (F.col("score") >= floor)).select(*by, "q", F.col("t").alias("seed"))
    ids = seeds.select(*by, "seed").distinct()
    asked = targets.join(ids, [*(targets[c] == ids[c] for c in by), targets["t"] == ids["seed"]], "left_semi").withColumnRenamed("t", "q")
    near = exact_knn(asked, targets, k + 1, by).select(*by, F.col("q").alias("seed"), "t", "score")
    hops = seeds.join(near, [*by, "seed"]).groupBy("q", "t").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 12).desc(), "t"))
    return hops.withColumn("rank", rank).filter(F.col("rank") <= 2 * k)


def reverse_knn(fields: list[tuple[DataFrame, DataFrame]], k: int, by: list[str]) -> DataFrame:
    """(q, t, score, rank, fields): for each target its k nearest queries in each field's vectors; best score, best rank, number of fields.

    fields holds (queries, targets) with (by..., q, v) and (by..., t, v).
    """
    found = None
    for queries, targets in fields:
        one = exact_knn(targets.withColumnRenamed("t", "q"), queries.withColumnRenamed("q", "t"), k, by).select(F.col("t").alias("q"), F.col("q").alias("t"), "score", "rank")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("q", "t").agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.count("*").alias("fields"))


def look_alike(queries: DataFrame, by: list[str], attributes: dict[str, object]) -> DataFrame:
    """Each query's nearest other query of its group: q, nn, nn_cos and nn_<attribute> with defaults where there is none.

    queries is (by..., q, v, attributes...).
    """
    near = exact_knn(queries, queries.withColumnRenamed("q", "t"), 1, by, apart=True).select("q", F.col("t").alias("nn"), F.col("score").alias("nn_cos"))
    held = queries.select(F.col("q").alias("nn"), *[F.col(a).alias(f"nn_{a}") for a in attributes])
    out = queries.select("q").join(near.join(held, "nn", "left"), "q", "left")
    return out.withColumns({"nn_cos": F.coalesce("nn_cos", F.lit(0.0)), **{f"nn_{a}": F.coalesce(f"nn_{a}", F.lit(d)) for a, d in attributes.items()}})


def in_cells(queries: DataFrame, targets: DataFrame, cells: int, probes: int, seed: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """queries and targets with `cell`: targets in the cell of their nearest k-means centre, queries once in each of their `probes` nearest.

    The centres come from a bounded sample of targets; every target is in a cell.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = _sampled(targets, sample, seed)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(some.select(array_to_vector(F.col("v").cast("array<double>")).alias("f")))
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    distance = lambda v: F.transform(centres, lambda c, i: F.struct(F.aggregate(F.zip_with(c, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d).alias("d"), i.alias("i")))
    order = lambda n: F.transform(F.slice(F.array_sort(distance(F.col("v").cast("array<double>"))), 1, n), lambda x: x["i"])
    return queries.withColumn("cell", F.explode(order(probes))), targets.withColumn("cell", F.get(order(1), F.lit(0)))


def _sampled(targets: DataFrame, sample: int, seed: int) -> DataFrame:
    total = targets.count()
    return targets.filter(F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, sample / max(1, total)) * (1 << 20)))


def cell_knn(queries: DataFrame, targets: DataFrame, k: int, cells: int = 64, probes: int = 8, seed: int = 7, sample: int = 20_000) -> DataFrame:
    """Approximate kNN (q, t, score, rank): exact inside the cells that a query probes (see in_cells)."""
    left, right = in_cells(queries, targets, cells, probes, seed, sample)
    found = exact_knn(left, right, k, ["cell"]).select("q", "t", "score")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 12).desc(), "t"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def fit_codebooks(x: np.ndarray, parts: int, codes: int = 256, rounds: int = 10, seed: int = 7) -> list[np.ndarray]:
    """For each of `parts` slices of the components, the centres of a k-means of its own."""
    rng, books = np.random.default_rng(seed), []
    for own in np.array_split(x, parts, axis=1):
        centres = own[rng.permutation(len(own))[: min(codes, len(own))]].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(1)[None, :] - 2 * own @ centres.T).argmin(1)
            size = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, own)
            centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        books.append(centres)
    return books


def quantise(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """One byte for each slice of each vector: the number of its nearest centre."""
    slices = np.split(x, np.cumsum([b.shape[1] for b in books])[:-1], axis=1)
    return np.stack([((b**2).sum(1)[None, :] - 2 * s @ b.T).argmin(1) for s, b in zip(slices, books, strict=True)], axis=1).astype(np.uint8)


def quantised_knn(queries: DataFrame, targets: DataFrame, k: int, cells: int = 64, probes: int = 8, parts: int = 16, keep: int = 8, seed: int = 7, sample: int = 20_000, block: int = 65_536) -> DataFrame:
    """Approximate kNN (q, t, score, rank) over an inverted file of product-quantised vectors.

    In the cells that a query probes, targets are scored by their codes alone,
    `parts` bytes each, from tables of the query's products with the centres;
    the best keep * k of all cells are scored again on their vectors. Centres
    and codebooks come from a bounded sample; every target is coded. A cell of
    more than `block` targets is dealt to several tasks.
    """
    spark = targets.sparkSession
    some = np.stack(_sampled(targets, sample, seed).select(F.col("v").cast("array<double>").alias("v")).toPandas()["v"].to_numpy())
    books = spark.sparkContext.broadcast(fit_codebooks(some, parts, seed=seed))
    left, right = in_cells(queries, targets, cells, probes, seed, sample)

    @F.pandas_udf("binary")
    def code(v: pd.Series) -> pd.Series:
        return pd.Series([c.tobytes() for c in quantise(np.stack(v.to_numpy()).astype(float), books.value)])

    coded = right.select("t", "cell", code(F.col("v").cast("array<double>")).alias("code"))
    subs = right.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("subs"))
    coded = coded.join(subs, "cell").withColumn("sub", F.pmod(F.xxhash64("t"), F.col("subs")).cast("int"))
    asked = left.select("q", F.col("v").cast("array<double>").alias("v"), "cell").join(subs, "cell").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    # names anew, since both sides come from one join with subs
    asked, coded = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (asked, coded))
    kinds = [queries.schema["q"].dataType.simpleString(), targets.schema["t"].dataType.simpleString()]

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(a) and len(b):
            codes, ids = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1), b["t"].to_numpy()
            for name, v in zip(a["q"].to_numpy(), a["v"], strict=True):
                slices = np.split(np.asarray(v), np.cumsum([x.shape[1] for x in books.value])[:-1])
                rough = sum((x @ s)[codes[:, i]] for i, (x, s) in enumerate(zip(books.value, slices, strict=True)))
                best = np.argpartition(-rough, min(len(ids), keep * k) - 1)[: keep * k]
                found.append((np.repeat(np.array([name], dtype=a["q"].dtype), len(best)), ids[best], rough[best]))
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) if found else [] for i, c in enumerate(("q", "t", "rough"))})

    rough = asked.groupBy("cell", "sub").cogroup(coded.groupBy("cell", "sub")).applyInPandas(scan, f"q {kinds[0]}, t {kinds[1]}, rough double")
    first = rough.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rough"), "t"))).filter(F.col("r") <= keep * k)
    scored = first.select("q", "t").join(queries.select("q", F.col("v").alias("qv")), "q").join(targets.select("t", F.col("v").alias("tv")), "t").select("q", "t", dot(F.col("qv"), F.col("tv")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 12).desc(), "t"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (q, t) among those found."""
    row = exact.select("q", "t").join(found.select("q", "t", F.lit(1).alias("hit")), ["q", "t"], "left").agg(F.count("*"), F.count("hit")).first()
    return row[1] / row[0] if row[0] else 1.0


def vector_features(pairs: DataFrame, queries: DataFrame, targets: DataFrame, by: list[str], near: DataFrame | None = None) -> DataFrame:
    """pairs (q, t) with dl_cos, dl_t_gap (the target's best similarity to any query minus dl_cos) and dl_nn_margin (dl_cos minus the target's similarity to the query's look-alike).

    queries is (by..., q, v), targets (by..., t, v); near is (q, nn), 0 margin without.
    """
    best = exact_knn(targets.withColumnRenamed("t", "q"), queries.withColumnRenamed("q", "t"), 1, by).select(F.col("q").alias("t"), F.col("score").alias("__best"))
    df = pairs.join(queries.select("q", F.col("v").alias("__qv")), "q").join(targets.select("t", F.col("v").alias("__tv")), "t").join(best, "t", "left")
    df = df.withColumn("dl_cos", dot(F.col("__qv"), F.col("__tv"))).withColumn("dl_t_gap", F.coalesce(F.col("__best") - F.col("dl_cos"), F.lit(0.0)))
    if near is not None:
        other = near.join(queries.select(F.col("q").alias("nn"), F.col("v").alias("__nv")), "nn").select("q", "__nv")
        df = df.join(other, "q", "left").withColumn("dl_nn_margin", F.coalesce(F.col("dl_cos") - dot(F.col("__nv"), F.col("__tv")), F.lit(0.0))).drop("__nv")
    else:
        df = df.withColumn("dl_nn_margin", F.lit(0.0))
    return df.drop("__qv", "__tv", "__best")
