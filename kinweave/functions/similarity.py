"""String similarities and pair features.

Kernels without a Spark built-in are Arrow UDFs over whole batches; everything
else is a column expression.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & where.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / total length; two empty strings are equal."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best of comparing the common words with either side's words; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = x & y
    if common and (x <= y or y <= x):
        return 100.0
    base, left, right = (" ".join(sorted(s)) for s in (common, x - y, y - x))
    one, two = (" ".join(p for p in (base, side) if p) for side in (left, right))
    best = indel_ratio(one, two)
    if base:
        best = max(best, indel_ratio(base, one), indel_ratio(base, two))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter string with a window of its length, or a shorter one at either end, of the longer."""
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(short: str, long: str) -> float:
    if not short:
        return 100.0 if not long else 0.0
    n, chars = len(short), set(short)
    if short in long:
        return 100.0
    best = 0.0
    spans = [(0, k) for k in range(1, n)] + [(k, k + n) for k in range(len(long) - n + 1)] + [(k, len(long)) for k in range(len(long) - n + 1, len(long))]
    for lo, hi in spans:
        # a best window begins or ends on a character of the shorter string
        if (long[hi - 1] in chars if lo == 0 or hi - lo == n else long[lo] in chars) and 200.0 * min(n, hi - lo) / (n + hi - lo) > best:
            best = max(best, indel_ratio(short, long[lo:hi]))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four if it is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _batched(kernel):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernel(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    return run


ratio, token_sort, token_set, partial, jaro_winkler_sim = map(_batched, (indel_ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler))


# --- built-in similarities -------------------------------------------------


def levenshtein_sim(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def trigram_jaccard(a: Column, b: Column) -> Column:
    return jaccard(*[F.transform(tx.ngrams_of(x, 3), F.lower) for x in (a, b)])


def length_difference(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def blank(c: Column) -> Column:
    return F.trim(c) == ""


def address_jaccard(a: Column, b: Column) -> Column:
    return F.when(blank(a) | blank(b), 0.0).otherwise(jaccard(tx.words(F.lower(a)), tx.words(F.lower(b))))


def ternary(present: Column, agrees: Column) -> Column:
    """1 if both sides are present and agree, -1 if they differ, 0 if one is absent."""
    return F.when(~present, 0).when(agrees, 1).otherwise(-1)


def agree(a: Column, b: Column) -> Column:
    return ternary((a != "") & (b != ""), a == b)


def postal_match(a: Column, b: Column) -> Column:
    x, y = tx.postal_codes(a), tx.postal_codes(b)
    return ternary((F.size(x) > 0) & (F.size(y) > 0), F.arrays_overlap(x, y))


def numeric_overlap(a: Column, b: Column) -> Column:
    x, y = tx.numbers(a), tx.numbers(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def numeric_conflict(a: Column, b: Column) -> Column:
    x, y = tx.numbers(a), tx.numbers(b)
    return ((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)).cast("double")


def number_relation(a: Column, b: Column) -> Column:
    """Best relation of the first six numbers of either side: 3 equal, 2 one begins or ends the other, 1 a digit apart or equal digits, -1 none, 0 if a side has none."""
    x, y = F.slice(tx.words(a), 1, 6), F.slice(tx.words(b), 1, 6)

    def one(p: Column, q: Column) -> Column:
        shorter = F.least(F.length(p), F.length(q))
        apart = F.size(F.filter(F.sequence(F.lit(1), F.length(p)), lambda i: F.substr(p, i, F.lit(1)) != F.substr(q, i, F.lit(1))))
        held = p.startswith(q) | p.endswith(q) | q.startswith(p) | q.endswith(p)
        return F.when(p == q, F.when(F.length(p) >= 2, 3).otherwise(1)).when((shorter >= 2) & held, 2).when((F.length(p) == F.length(q)) & (F.length(p) >= 2) & (apart == 1), 1).otherwise(-1)

    best = F.array_max(F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: one(p, q)))))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0).otherwise(best)


def acronym_match(core_a: Column, acr_a: Column, core_b: Column, acr_b: Column) -> Column:
    joined = [F.replace(c, F.lit(" "), F.lit("")) for c in (core_a, core_b)]
    one = (acr_a != "") & ((acr_a == joined[1]) | (acr_a == acr_b))
    two = (acr_b != "") & ((acr_b == joined[0]) | (acr_b == acr_a))
    return (one | two).cast("byte")


# --- feature sets ----------------------------------------------------------


def pair_features_v1(df: DataFrame, q: str = "q_", t: str = "t_") -> DataFrame:
    """df of pairs with the twelve features of the first generation; sides are <prefix>name, _address, and t_id."""
    a, b, x, y = (tx.filled(p + s) for s in ("name", "address") for p in (q, t))
    missing = blank(x) | blank(y)
    whole = [F.concat_ws(" ", n, d) for n, d in ((a, x), (b, y))]
    return df.withColumns({
        "name_ratio": ratio(a, b), "name_token_sort": token_sort(a, b), "name_token_set": token_set(a, b), "name_jaro_winkler": jaro_winkler_sim(a, b) * 100,
        "name_jaccard_3gram": trigram_jaccard(a, b), "name_len_diff": length_difference(a, b),
        "addr_missing_either": missing.cast("double"), "addr_token_jaccard": address_jaccard(x, y), "addr_sort_ratio": F.when(missing, 0.0).otherwise(token_sort(F.lower(x), F.lower(y))),
        "numeric_overlap": numeric_overlap(*whole), "numeric_conflict": numeric_conflict(*whole), "is_source_3": F.col(t + "id").startswith("S3-").cast("double"),
    })


def pair_features_v2(df: DataFrame, q: str = "q_", t: str = "t_") -> DataFrame:
    """df with the fifteen features of the second generation."""
    a, b, x, y = (tx.filled(p + s) for s in ("name", "address") for p in (q, t))
    out = pair_features_v1(df, q, t)
    return out.withColumns({"compact_ratio": ratio(tx.compact_text(a), tx.compact_text(b)), "addr_missing_both": (blank(x) & blank(y)).cast("double"), "pin_match": postal_match(x, y).cast("double")})


def composite_rank(df: DataFrame, q: str = "q_", t: str = "t_") -> DataFrame:
    """df with the pre-rank scores of both generations."""
    a, b, x, y = (F.lower(tx.filled(p + s)) for s in ("name", "address") for p in (q, t))
    df = df.withColumns({"__s": token_sort(a, b), "__r": ratio(a, b), "__d": token_sort(x, y)})
    with_address = 0.70 * F.col("__s") + 0.15 * F.col("__r") + 0.15 * F.col("__d")
    score = F.when(~blank(x) & ~blank(y), with_address).otherwise(0.85 * F.col("__s") + 0.15 * F.col("__r"))
    return df.withColumns({"rank_v1": F.col("__s") / 100, "rank_v2": score / 100, "name_ratio": F.col("__r")}).drop("__s", "__r", "__d")


def rule_score(df: DataFrame, q: str = "q_", t: str = "t_") -> Column:
    """Rule baseline: 0 on conflicting numbers; the name alone if an address is missing; else 0.7 name, 0.3 address."""
    a, b, x, y = (tx.filled(p + s) for s in ("name", "address") for p in (q, t))
    conflict = numeric_conflict(F.concat_ws(" ", a, x), F.concat_ws(" ", b, y)) > 0
    name = token_sort(a, b) / 100
    return F.when(conflict, 0.0).when(blank(x) | blank(y), name).otherwise(0.7 * name + 0.3 * token_sort(F.lower(x), F.lower(y)) / 100)


def full_features(df: DataFrame, q: str = "q_", t: str = "t_") -> DataFrame:
    """Features over normalized records (see text.normalized_record) with columns prefixed by q and t."""
    c = lambda name: (F.col(q + name), F.col(t + name))
    squeeze = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    n, core, ph, addr, alt = c("name_n"), c("name_core"), c("name_ph"), c("addr_n"), c("name_alt")
    tight = tuple(map(squeeze, n))
    out = {f"n_{k}": f(*n) for k, f in (("ratio", ratio), ("tset", token_set), ("tsort", token_sort), ("partial", partial), ("jw", jaro_winkler_sim))}
    out |= {"nc_ratio": ratio(*core), "nc_tset": token_set(*core), "nc_jw": jaro_winkler_sim(*core), "nc_lev": levenshtein_sim(*core)}
    out |= {"nsp_ratio": ratio(*tight), "nsp_partial": partial(*tight), "nph_ratio": ratio(*ph), "nph_tset": token_set(*ph)}
    out |= {"a_tset": token_set(*addr), "a_partial": partial(*addr), "a_ratio": ratio(*addr)}
    best = [F.when(x != "", x).otherwise(y) for x, y in zip(alt, n, strict=True)]
    out |= {"nalt_raw": token_set(*best)}
    out |= {"first_tok_eq": (tx.first(tx.words(core[0])) == tx.first(tx.words(core[1]))).cast("byte"), "core_eq": (core[0] == core[1]).cast("byte"), "acr_match": acronym_match(core[0], F.col(q + "acronym"), core[1], F.col(t + "acronym"))}
    out |= {"web_any": F.greatest(*c("is_web")), "indic_any": F.greatest(*c("is_indic")), "postal_agree": agree(*c("postal")), "first_num_agree": agree(*c("first_num")), "nums_seq": agree(*c("nums")), "num_rel": number_relation(*c("nums"))}
    out |= {"a_empty": ((addr[0] == "") | (addr[1] == "")).cast("byte"), "len_diff": F.abs(F.length(n[0]) - F.length(n[1])), "ntok_diff": F.abs(F.size(tx.words(n[0])) - F.size(tx.words(n[1])))}
    df = df.withColumns(out)
    has_alt = (alt[0] != "") | (alt[1] != "")
    return df.withColumn("nalt_tset", F.when(has_alt, F.greatest("n_tset", "nalt_raw")).otherwise(F.col("n_tset"))).drop("nalt_raw")


#: How close a pair's target is to the query's look-alike, and how much closer to the query.
LOOK_ALIKE = ["nn_cos", "nn_nc_tset", "nn_a_tset", "nn_a_ratio", "nn_nums_seq", "nn_num_rel", "nc_margin", "a_margin", "num_margin"]


def look_alike_features(df: DataFrame, t: str = "t_", nn: str = "nn_") -> DataFrame:
    """df of pairs with nc_tset, a_tset, num_rel and nn_cos gets the other eight features of LOOK_ALIKE.

    The target's and the look-alike's name_core, addr_n and nums are prefixed by
    t and nn; a query without a look-alike has '' there.
    """
    c = lambda name: (F.col(nn + name), F.col(t + name))
    df = df.withColumns({"nn_nc_tset": token_set(*c("name_core")), "nn_a_tset": token_set(*c("addr_n")), "nn_a_ratio": ratio(*c("addr_n")), "nn_nums_seq": agree(*c("nums")), "nn_num_rel": number_relation(*c("nums"))})
    return df.withColumns({"nc_margin": F.col("nc_tset") - F.col("nn_nc_tset"), "a_margin": F.col("a_tset") - F.col("nn_a_tset"), "num_margin": F.col("num_rel") - F.col("nn_num_rel")})
