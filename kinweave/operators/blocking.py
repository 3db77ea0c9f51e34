"""Candidate generation by blocking keys and rare tokens.

Records are DataFrames of (id, business_name, business_address, country, ...).
Postings are capped before any join, so a frequent key never meets itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

ROUTES = ("prefix", "compact", "dba", "address")
TRUSTED_V1 = ("p2", "s2", "pin")
TRUSTED_V2 = ("p2", "s2", "pb", "cmp")


def _key(route: str, condition: Column, *parts: Column) -> Column:
    return F.when(condition, F.struct(F.lit(route).alias("route"), F.concat_ws("_", *parts).alias("key")))


def _token_keys(tokens: Column, head: Column, mark: Column | None = None) -> list[Column]:
    """First two tokens in order and sorted, a lone token, and the first word."""
    a, b = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    lead = [head] if mark is None else [head, mark]
    two = F.size(tokens) >= 2
    return [
        _key("p2", two, *lead, F.lit("p2"), a, b),
        _key("s2", two, *lead, F.lit("s2"), F.least(a, b), F.greatest(a, b)),
        _key("p1", F.size(tokens) == 1, *lead, F.lit("p1"), a),
        _key("w1", (F.size(tokens) >= 1) & (F.length(a) >= 3), *lead, F.lit("w1"), a),
    ]


def keys_v1(name: Column, address: Column, country: Column) -> Column:
    """Array of (route, key) of the first generation."""
    t = tx.clean_tokens_v1(name)
    raw = F.substring(F.regexp_replace(F.lower(tx.filled(name)), "[^a-z0-9]+", ""), 1, 5)
    pin = F.get(tx.postal_codes(address), F.lit(0))
    none = F.size(t) == 0
    found = [
        _key("raw", none & (raw != ""), country, F.lit("raw"), raw),
        _key("empty", none & (raw == ""), country, F.lit("empty")),
        *_token_keys(t, country),
        _key("pin", ~none & pin.isNotNull(), country, F.lit("pin"), pin, F.substring(F.get(t, F.lit(0)), 1, 2)),
    ]
    return F.array_compact(F.array(*found))


def keys_v2(name: Column, address: Column, country: Column, routes: tuple[str, ...] = ROUTES, shared_aliases: bool = False) -> Column:
    """Array of distinct (route, key) of the second generation.

    Keys of trade names live apart from those of full names, as `dba`;
    shared_aliases puts both into one name space, so that they can meet.
    """
    aliases = tx.name_aliases(name) if "dba" in routes else F.array(F.lower(tx.filled(name)))
    parts = []
    if "prefix" in routes:

        def of(alias: Column, i: Column) -> Column:
            t = tx.clean_tokens_v2(alias)
            mark = F.when((i > 0) & F.lit(not shared_aliases), F.lit("dba"))
            return F.array_compact(F.array(*_token_keys(t, country, mark)))

        parts.append(F.flatten(F.transform(aliases, of)))
    compact = tx.compact_name(name)
    if "compact" in routes:
        parts.append(F.array_compact(F.array(_key("cmp", F.length(compact) >= 6, country, F.lit("cmp"), F.substring(compact, 1, 8)))))
    if "address" in routes:
        pin, house = F.get(tx.postal_codes(F.trim(tx.filled(address))), F.lit(0)), tx.building(address)
        initial = tx.first(tx.clean_tokens_v2(name))
        initial = F.when(initial != "", F.substring(initial, 1, 2)).otherwise("xx")
        found = [_key("pin", pin.isNotNull(), country, F.lit("pin"), pin, initial), _key("pb", pin.isNotNull() & (house != "") & (house != pin), country, F.lit("pb"), pin, F.substring(house, 1, 6))]
        parts.append(F.array_compact(F.array(*found)))
    empty = F.array().cast("array<struct<route:string,key:string>>")
    return F.array_distinct(F.concat(empty, *parts))


def exploded(records: DataFrame, keys: Column, *keep: str) -> DataFrame:
    """(keep..., route, key), one row per key."""
    return records.select(*keep, F.explode(keys).alias("k")).select(*keep, "k.route", "k.key")


def capped_postings(pool: DataFrame, cap: int, trusted: tuple[str, ...], order: tuple[str, ...] = ("src", "line_idx")) -> DataFrame:
    """Postings (key, route, id, ...) of keys that are short enough; of trusted longer ones the first `cap`.

    Sizes come from an aggregate that combines before the shuffle; other long
    keys go before anything is ranked, and ranks beyond the cap are cut off
    before the exchange by the window's group limit. pool is read twice and
    should be a written table.
    """
    sizes = pool.groupBy("key").agg(F.count("*").alias("size"))
    held = pool.join(sizes, "key").filter((F.col("size") <= cap) | F.col("route").isin(*trusted)).drop("size")
    position = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return held.withColumn("position", position).filter(F.col("position") <= cap).drop("position")


def block_join(queries: DataFrame, pool: DataFrame, cap: int, trusted: tuple[str, ...], q: str = "q", t: str = "t") -> DataFrame:
    """Distinct (q, t) that share a key, given exploded keys of both sides."""
    postings = capped_postings(pool, cap, trusted).select("key", t)
    return queries.select(q, "key").join(postings, "key").select(q, t).distinct()


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "q") -> DataFrame:
    """The first k rows of each query with their rank; the order must be total."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def top_k_v2(scored: DataFrame, k: int) -> DataFrame:
    """Top k by rounded score, rounded name ratio, difference of name lengths and a hash; expects rank_v2, name_ratio, len_diff, tie."""
    score, name = F.bround("rank_v2", 4), F.bround(F.col("name_ratio") / 100, 4)
    return top_k(scored, k, score.desc(), name.desc(), F.col("len_diff"), F.col("tie")).withColumn("score", score)


def rare_token_join(queries: DataFrame, pool: DataFrame, max_df: int, k: int, by: tuple[str, ...] = ("src",)) -> DataFrame:
    """Per query and group, the k records with the largest summed idf of shared tokens of document frequency 1..max_df.

    queries is (q, tokens array, join columns...), pool is (t, tokens array,
    src, join columns...); shared columns other than tokens, q, t and src (such
    as country) must agree. Frequencies are counted per group.
    """
    also = [c for c in pool.columns if c in queries.columns and c != "tokens"]
    total = pool.groupBy(*by).agg(F.count("*").alias("n"))
    posts = pool.select("t", *by, *[c for c in also if c not in by], F.explode(F.array_distinct("tokens")).alias("token"))
    df = posts.groupBy(*by, "token").agg(F.count("*").alias("df")).filter(F.col("df") <= max_df)
    weighted = df.join(total, list(by)).withColumn("idf", F.log(F.col("n") / F.col("df")))
    posts = posts.join(weighted.select(*by, "token", "idf"), [*by, "token"])
    asked = queries.select("q", *also, F.explode(F.array_distinct("tokens")).alias("token"))
    scored = asked.join(posts, ["token", *also]).groupBy("q", "t", *by).agg(F.sum("idf").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q", *by).orderBy(F.round("score", 9).desc(), "t"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def merge_blockers(blockers: dict[str, DataFrame]) -> DataFrame:
    """Union of blockers' (q, t, score, rank) with a score (0 if absent) and rank (99) column for each: one shuffle, whatever their number."""
    tagged = [df.select("q", "t", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"), F.lit(name).alias("blocker")) for name, df in blockers.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    aggs = []
    for name in blockers:
        mine = F.col("blocker") == name
        aggs += [F.coalesce(F.max(F.when(mine, F.col("score"))), F.lit(0.0)).alias(f"{name}_score"), F.coalesce(F.min(F.when(mine, F.col("rank"))), F.lit(99)).alias(f"{name}_rank")]
    return rows.groupBy("q", "t").agg(*aggs)


def keyword_join(distractors: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distractors (t, keyword) whose keyword is in a split's set (split, keyword), with the split."""
    return distractors.filter("keyword <> ''").join(keywords.distinct(), "keyword").select("split", "t", "keyword")


def aligned_words(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Words of two names by position, where both have as many: pairs' other columns, tok, eng."""
    x, y = tx.words(F.col(a)), tx.words(F.col(b))
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.filter(F.size(x) == F.size(y)).select(*rest, F.explode(F.arrays_zip(x.alias("tok"), y.alias("eng"))).alias("z")).select(*rest, F.col("z.tok").alias("tok"), F.col("z.eng").alias("eng"))
