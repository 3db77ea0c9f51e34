"""Stable samples, splits and pools. Random order means order by a hash of id and seed, so every run agrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(entity: Column, seed: int) -> Column:
    return F.md5(F.concat(entity.cast("string"), F.lit(str(seed))))


def bernoulli(df: DataFrame, entity: str, fraction: float, seed: int) -> DataFrame:
    """Rows of about a fraction of the ids, the same ones whatever the partitioning."""
    draw = F.conv(F.substring(order_of(F.col(entity), seed), 1, 7), 16, 10).cast("long")
    return df.filter(draw < int(fraction * (1 << 28)))


def systematic(df: DataFrame, step: int, column: str = "line_idx") -> DataFrame:
    return df.filter(F.pmod(F.col(column), F.lit(step)) == 0)


def held_out(column: Column, step: int) -> Column:
    return F.pmod(column, F.lit(step)) == 0


def stratified_split(entities: DataFrame, targets: dict[str, int], seed: int) -> DataFrame:
    """entities (q, country, n_true) with split: of each stratum (country, 0..4 or 5+ matches) disjoint shares, rounded half to even.

    Rows beyond all shares have a null split.
    """
    category = F.when(F.col("n_true") >= 5, "5+").otherwise(F.col("n_true").cast("string"))
    df = entities.withColumn("category", category)
    sizes = df.groupBy("country", "category").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    sizes = sizes.crossJoin(F.broadcast(total))
    offset = F.lit(0).cast("long")
    bounds = {}
    for name, n in targets.items():
        take = F.bround(F.lit(float(n)) * F.col("size") / F.col("total")).cast("long")
        bounds[name] = (offset, offset + take)
        offset = offset + take
    sizes = sizes.select("country", "category", *[b.alias(f"__{name}_{i}") for name, pair in bounds.items() for i, b in enumerate(pair)])
    place = F.row_number().over(Window.partitionBy("country", "category").orderBy(order_of(F.col("q"), seed), "q")) - 1
    df = df.withColumn("__place", place).join(F.broadcast(sizes), ["country", "category"])
    split = F.coalesce(*[F.when((F.col("__place") >= F.col(f"__{n}_0")) & (F.col("__place") < F.col(f"__{n}_1")), F.lit(n)) for n in targets])
    return df.withColumn("split", split).drop(*[c for c in df.columns if c.startswith("__")], *sizes.columns[2:])


def fresh_split(entities: DataFrame, used: DataFrame, n: int, seed: int) -> DataFrame:
    """n entities (q) never used: a stratified share first, then filled or cut to n by random order."""
    free = entities.join(used.select("q"), "q", "left_anti")
    drawn = stratified_split(free, {"fresh": n}, seed).withColumn("late", F.col("split").isNull().cast("int"))
    return drawn.orderBy("late", order_of(F.col("q"), seed), "q").limit(n).select("q")


def cascade(rows: DataFrame, quotas: dict[str, int], order: tuple[str, ...] = ("line_idx",), eligible: str = "splits") -> DataFrame:
    """(row columns..., split): splits in order take the first `quota` rows, by `order`, of those whose array `splits` names them and that no earlier split took.

    Equals a greedy pass over the rows in order that gives each to the first open split.
    """
    left, taken = rows, []
    for name, quota in quotas.items():
        mine = left.filter(F.array_contains(eligible, name))
        first = mine.orderBy(*order).limit(quota).withColumn("split", F.lit(name))
        taken.append(first)
        left = left.join(first.select(*order), list(order), "left_anti")
    return reduce(DataFrame.unionByName, taken)


def random_quota(rows: DataFrame, quotas: dict[str, int], step: int, order: str = "line_idx") -> DataFrame:
    """Rows at multiples of `step`, in order, given to the splits one after the other up to their quotas."""
    total = sum(quotas.values())
    first = rows.filter(F.pmod(F.col(order), F.lit(step)) == 0).orderBy(order).limit(total)
    ranked = first.withColumn("__r", F.row_number().over(Window.orderBy(order)))
    split, end = F.lit(None).cast("string"), 0
    for name, quota in quotas.items():
        split, end = F.coalesce(split, F.when(F.col("__r") <= end + quota, F.lit(name))), end + quota
    return ranked.withColumn("split", split).drop("__r")


def crowd_match(entities: DataFrame, sample: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """Entities (q, country) outside the sample to hide, so that targets per entity equal those of `wanted` (country, n_targets, ratio)."""
    sizes = entities.groupBy("country").agg(F.count("*").alias("n"))
    free = entities.join(sample.select("q"), "q", "left_anti")
    room = free.groupBy("country").agg(F.count("*").alias("room"))
    hide = sizes.join(wanted, "country").join(room, "country", "left").na.fill(0, ["room"])
    hide = hide.select("country", F.greatest(F.lit(0), F.least("room", F.bround(F.col("n") - F.col("n_targets") / F.col("ratio")).cast("long"))).alias("hide"))
    place = F.row_number().over(Window.partitionBy("country").orderBy(order_of(F.col("q"), seed), "q"))
    return free.withColumn("__p", place).join(F.broadcast(hide), "country").filter(F.col("__p") <= F.col("hide")).select("q", "country")


def folds(df: DataFrame, k: int, seed: int, by: str = "q") -> DataFrame:
    """df with fold 0..k-1, the same for all rows of a query."""
    draw = F.conv(F.substring(order_of(F.col(by), seed), 1, 7), 16, 10).cast("long")
    return df.withColumn("fold", (draw % k).cast("int"))


def hard_negatives(pairs: DataFrame, ranks: list[str], blocker_ranks: list[str], share: float, seed: int, feature_rank: int = 10, blocker_rank: int = 3) -> DataFrame:
    """Positives, negatives near the top by any feature or blocker, and a random share of the rest."""
    near = [F.col(c) <= feature_rank for c in ranks] + [F.col(c) <= blocker_rank for c in blocker_ranks]
    draw = F.conv(F.substring(order_of(F.concat_ws("|", "q", "t"), seed), 1, 7), 16, 10).cast("long") < int(share * (1 << 28))
    return pairs.filter(reduce(lambda a, b: a | b, near, (F.col("label") == 1) | draw))


def mined_negatives(scored: DataFrame, floor: float = 0.01, most: int = 10) -> DataFrame:
    """Of each query the `most` negatives that a warm model finds likeliest, from `floor` up."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p"), "t"))
    return scored.filter((F.col("label") == 0) & (F.col("p") >= floor)).withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")


def pool_composition(pool: DataFrame) -> DataFrame:
    """(split, src, kind, n) of a pool's rows, with sums over kinds (null kind) and sources (null src)."""
    return pool.rollup("split", "src", "kind").agg(F.count("*").alias("n")).filter("split is not null")


def merged_pools(pool: DataFrame, extra: DataFrame, key: str = "entity_id") -> DataFrame:
    """A stress pool: pool's rows and extra's; of a key in both, extra's row counts."""
    return pool.join(extra.select(key), key, "left_anti").unionByName(extra)


def dictionary_part(truth: DataFrame, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """truth (q, t) of the sampled entities (q), and of the others, from which alone dictionaries may be learned."""
    ids = sample.select("q").distinct()
    return truth.join(ids, "q", "left_semi"), truth.join(ids, "q", "left_anti")
