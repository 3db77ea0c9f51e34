"""Queries of record normalization, pair features and look-alikes, with SQL for every column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import blocking, knn
from . import adapters as ad
from . import kernels as k
from .adapters import REC, VEC
from .queries import _GRAMS, _NUMS, _PARTS, _REC_PAIRS, _jaccard, _part_pairs, _rec_pairs
from .registry import query, rounded


def _sql_round(c: str) -> str:
    return f"round({c}, 6) AS {c}"


# --- normalization ------------------------------------------------------------

_NORMALIZED = "country_key, name_n, name_alt, name_core, acronym, name_ph, addr_n, postal, first_num, nums, is_web, is_indic"


@query(f"WITH {REC}, {k.normalized('rec', 'src, entity_id, line_idx, country')} SELECT src, entity_id, line_idx, country, {_NORMALIZED} FROM norm")
def normalized_records(spark: SparkSession, d: str) -> DataFrame:
    return tx.normalized_record(ad.rec(spark, d)).drop("business_name", "business_address", "copy")


#: A record spelt with what normalization repairs: digits in words, a title, a trade name, ordinals, zeros, split postal codes, states.
_ODD_NAME = ("'Dr ' || replace(a, 'l', '1') || ' Co dba ' || b", lambda a, b: F.concat(F.lit("Dr "), F.replace(a, F.lit("l"), F.lit("1")), F.lit(" Co dba "), b))
_ODD_ADDRESS = ("'0' || k || ' ' || (k % 90 + 1) || 'th St 110 ' || (100 + k % 900) || ' new york, Tamil Nadu'", lambda key: F.concat(F.lit("0"), key.cast("string"), F.lit(" "), (key % 90 + 1).cast("string"), F.lit("th St 110 "), (F.lit(100) + key % 900).cast("string"), F.lit(" new york, Tamil Nadu")))


@query(f"WITH {_PARTS}, odd AS (SELECT k, {_ODD_NAME[0]} || CASE WHEN k % 3 = 0 THEN '.com' ELSE '' END AS name, {_ODD_ADDRESS[0]} AS address, 'US' AS country FROM x), {k.normalized('odd', 'k', 'name', 'address', 'country')} SELECT k, {_NORMALIZED} FROM norm")
def normalized_odd_spellings(spark: SparkSession, d: str) -> DataFrame:
    x = _part_pairs(spark, d)
    odd = x.select("k", F.concat(_ODD_NAME[1](F.col("a"), F.col("b")), F.when(F.col("k") % 3 == 0, ".com").otherwise("")).alias("name"), _ODD_ADDRESS[1](F.col("k")).alias("address"), F.lit("US").alias("country"))
    return tx.normalized_record(odd, "name", "address", "country").drop("name", "address", "country")


@query(rf"""WITH {REC}, w AS (SELECT entity_id, list_filter(list_transform(list_filter({k.words(k.base_norm("business_name"))}, lambda w: regexp_matches(w, '^\p{{L}}+$') AND length(w) >= 3), lambda w: {k.phonetic_word("w")}), lambda w: length(w) >= 3) AS t FROM rec)
    SELECT entity_id, 'F' || unnest(t) AS key FROM w UNION ALL SELECT entity_id, 'G' || t[i] || '_' || t[i + 1] FROM (SELECT entity_id, t, unnest(range(1, len(t))) AS i FROM w WHERE len(t) >= 2)""")
def phonetic_keys(spark: SparkSession, d: str) -> DataFrame:
    return ad.rec(spark, d).select("entity_id", F.explode(tx.phonetic_tokens(tx.base_norm(F.col("business_name")))).alias("key"))


_LATIN, _DEVANAGARI = "aeiouklmnprst", "अएइओउकलमनपरसत"


@query(rf"""WITH {_PARTS}, s AS (SELECT k, a || ' ' || translate(a, '{_LATIN}', '{_DEVANAGARI}') || ' | ' || translate(b, '{_LATIN}', '{_DEVANAGARI}') AS t FROM x)
    SELECT k, regexp_matches(t, '[\x{{0900}}-\x{{0DFF}}]') AS indic, array_to_string(list_transform(regexp_extract_all(t, '[\x{{0900}}-\x{{0DFF}}][\x{{0900}}-\x{{0DFF}}\x{{200C}}\x{{200D}} ]*'), lambda x: trim(x)), ',') AS runs FROM s""")
def indic_runs(spark: SparkSession, d: str) -> DataFrame:
    put = lambda c: F.translate(c, _LATIN, _DEVANAGARI)
    t = _part_pairs(spark, d).select("k", F.concat_ws(" | ", F.concat_ws(" ", "a", put(F.col("a"))), put(F.col("b"))).alias("t"))
    return t.select("k", tx.indic(F.col("t")).alias("indic"), F.array_join(tx.indic_runs(F.col("t")), ",").alias("runs"))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), g AS (
        SELECT p_partkey, substr(' ' || w || ' ', i, n) AS token FROM w, (VALUES (3), (4)) v(n), range(1, 64) r(i) WHERE w <> '' AND i <= greatest(length(w) + 2 - n + 1, 1)
        UNION ALL SELECT p_partkey, 'W' || w FROM w WHERE w <> '' UNION ALL SELECT p_partkey, 'N' || replace(lower(p_name), ' ', '') FROM part
    ) SELECT p_partkey, token, count(*) AS n FROM g GROUP BY ALL""")
def encoder_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = ad.table(spark, d, "part").select("p_partkey", F.explode(tx.encoder_tokens(F.col("p_name"))).alias("token"))
    return t.groupBy("p_partkey", "token").agg(F.count("*").alias("n"))


@query(f"WITH {REC} SELECT entity_id, business_name || ' ' || business_address AS whole, business_name || ' | ' || business_address || ' | ' || country AS record, md5(lower(business_name) || '|' || lower(business_address) || '|' || entity_id) AS tie FROM rec")
def record_texts(spark: SparkSession, d: str) -> DataFrame:
    n, a, e = (F.col(c) for c in ("business_name", "business_address", "entity_id"))
    return ad.rec(spark, d).select("entity_id", tx.full_text(n, a).alias("whole"), tx.record_text(n, a, F.col("country")).alias("record"), tx.tie_break(n, a, e).alias("tie"))


# --- kernels ------------------------------------------------------------------


def _select(ids: str, kinds: list[str]) -> str:
    return f"SELECT {ids}, " + ", ".join(_sql_round(c) for c in kinds) + " FROM wide"


@query(f"WITH {_PARTS}, {k.compare('x', 'k', {'ratio': ('a', 'b')}, {'token_sort': ('a', 'b')}, {'token_set': ('a', 'b')}, {'partial': ('a', 'b')})}, {k.pivoted('k', ['ratio', 'token_sort', 'token_set', 'partial'])} {_select('k', ['ratio', 'token_sort', 'token_set', 'partial'])}")
def token_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_part_pairs(spark, d).select("k", sim.ratio("a", "b").alias("ratio"), sim.token_sort("a", "b").alias("token_sort"), sim.token_set("a", "b").alias("token_set"), sim.partial("a", "b").alias("partial")))


def _compact(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({c}), '{lx.WEB_PARTS}', '', 'g'), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


_PAIR_RATIOS = k.compare("x", "q, t", {"name_ratio": ("qn", "tn"), "compact_ratio": (_compact("qn"), _compact("tn"))}, {"name_token_sort": ("qn", "tn"), "addr_sort": ("lower(qa)", "lower(ta)")}, {"name_token_set": ("qn", "tn")})
_MISSING = "(trim(qa) = '' OR trim(ta) = '')"
_PAIR_V1 = f"""SELECT q, t, round(name_ratio, 6) AS name_ratio, round(name_token_sort, 6) AS name_token_sort, round(name_token_set, 6) AS name_token_set, round(100 * {k.jaro_winkler("qn", "tn")}, 6) AS name_jaro_winkler,
    round({_jaccard("g1", "g2")}, 6) AS name_jaccard_3gram, round(abs(length(qn) - length(tn))::DOUBLE / greatest(length(qn), length(tn), 1), 6) AS name_len_diff, {_MISSING}::INTEGER::DOUBLE AS addr_missing_either,
    CASE WHEN {_MISSING} THEN 0 ELSE round({_jaccard("w1", "w2")}, 6) END AS addr_token_jaccard, CASE WHEN {_MISSING} THEN 0 ELSE round(addr_sort, 6) END AS addr_sort_ratio,
    CASE WHEN len(n1) = 0 OR len(n2) = 0 THEN 0 ELSE round({_jaccard("n1", "n2")}, 6) END AS numeric_overlap, (len(n1) > 0 AND len(n2) > 0 AND len(list_intersect(n1, n2)) = 0)::INTEGER::DOUBLE AS numeric_conflict, starts_with(t, 'S3-')::INTEGER::DOUBLE AS is_source_3"""
_PAIR_SIDES = f"sides_of AS (SELECT *, {_GRAMS.format('qn')} AS g1, {_GRAMS.format('tn')} AS g2, {k.words('lower(qa)')} AS w1, {k.words('lower(ta)')} AS w2, {_NUMS.format('qn', 'qa')} AS n1, {_NUMS.format('tn', 'ta')} AS n2, regexp_extract_all(qa, '\\b\\d{{5,6}}\\b') AS p1, regexp_extract_all(ta, '\\b\\d{{5,6}}\\b') AS p2 FROM x JOIN wide USING (q, t))"
_PAIR_WIDE = f"{_REC_PAIRS}, {_PAIR_RATIOS}, {k.pivoted('q, t', ['name_ratio', 'compact_ratio', 'name_token_sort', 'addr_sort', 'name_token_set'])}, {_PAIR_SIDES}"


@query(f"WITH {_PAIR_WIDE} {_PAIR_V1} FROM sides_of")
def pair_features_v1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sim.pair_features_v1(_rec_pairs(spark, d)).drop("q_name", "q_address", "t_name", "t_address", "t_id"))


@query(f"WITH {_PAIR_WIDE} {_PAIR_V1}, round(compact_ratio, 6) AS compact_ratio, (trim(qa) = '' AND trim(ta) = '')::INTEGER::DOUBLE AS addr_missing_both, CASE WHEN len(p1) = 0 OR len(p2) = 0 THEN 0 WHEN len(list_intersect(p1, p2)) > 0 THEN 1 ELSE -1 END::DOUBLE AS pin_match FROM sides_of")
def pair_features_v2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sim.pair_features_v2(_rec_pairs(spark, d)).drop("q_name", "q_address", "t_name", "t_address", "t_id"))


_LOWERED = k.compare("x", "q, t", {"r": ("lower(qn)", "lower(tn)")}, {"s": ("lower(qn)", "lower(tn)"), "d": ("lower(qa)", "lower(ta)"), "rs": ("qn", "tn")}, {})


@query(
    f"""WITH {_REC_PAIRS}, {_LOWERED}, {k.pivoted("q, t", ["r", "s", "d", "rs"])}, y AS (SELECT *, {_NUMS.format("qn", "qa")} AS n1, {_NUMS.format("tn", "ta")} AS n2 FROM x JOIN wide USING (q, t)),
    z AS (SELECT q, t, s / 100 AS rank_v1, (CASE WHEN {_MISSING} THEN 0.85::DOUBLE * s + 0.15::DOUBLE * r ELSE 0.70::DOUBLE * s + 0.15::DOUBLE * r + 0.15::DOUBLE * d END) / 100 AS rank_v2, r / 100 AS nr, abs(length(qn) - length(tn)) AS len_diff, md5(lower(tn) || '|' || lower(ta) || '|' || t) AS tie,
        CASE WHEN len(n1) > 0 AND len(n2) > 0 AND len(list_intersect(n1, n2)) = 0 THEN 0 WHEN {_MISSING} THEN rs / 100 ELSE 0.7::DOUBLE * (rs / 100) + 0.3::DOUBLE * d / 100 END AS rule FROM y)
    SELECT q, t, round_even(rank_v2, 4) AS score, row_number() OVER (PARTITION BY q ORDER BY round_even(rank_v2, 4) DESC, round_even(nr, 4) DESC, len_diff, tie)::INTEGER AS rank, round(rank_v1, 6) AS rank_v1, round(rule, 6) AS rule FROM z QUALIFY rank <= 50"""
)
def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    df = _rec_pairs(spark, d).withColumns({"len_diff": F.abs(F.length("q_name") - F.length("t_name")), "tie": tx.tie_break(F.col("t_name"), F.col("t_address"), F.col("t"))})
    scored = sim.composite_rank(df).withColumn("rule", sim.rule_score(df))
    return rounded(blocking.top_k_v2(scored, 50).select("q", "t", "score", "rank", "rank_v1", "rule"))


# --- the full feature set -------------------------------------------------------

_PART_REC = "prec AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' dba ' || p_type || ' inc' ELSE p_name || ' corp' END AS name, p_partkey || ' ' || p_type || ' 5600' || (p_size + 10) AS address, p_brand AS country FROM part)"


def _part_records(spark: SparkSession, d: str) -> DataFrame:
    p = ad.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" dba "), "p_type", F.lit(" inc"))).otherwise(F.concat("p_name", F.lit(" corp")))
    address = F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_type", F.lit(" 5600"), (F.col("p_size") + 10).cast("string"))
    return tx.normalized_record(p.select("p_partkey", name.alias("name"), address.alias("address"), F.col("p_brand").alias("country")), "name", "address", "country").drop("name", "address", "country")


def _num_rel(a: str, b: str) -> str:
    """Best relation of the first six numbers of either side."""
    apart = "len(list_filter(range(1, length(p) + 1), lambda i: substr(p, i, 1) <> substr(u, i, 1)))"
    one = f"CASE WHEN p = u THEN CASE WHEN length(p) >= 2 THEN 3 ELSE 1 END WHEN least(length(p), length(u)) >= 2 AND (starts_with(p, u) OR ends_with(p, u) OR starts_with(u, p) OR ends_with(u, p)) THEN 2 WHEN length(p) = length(u) AND length(p) >= 2 AND {apart} = 1 THEN 1 ELSE -1 END"
    return f"coalesce(list_max(flatten(list_transform({k.words(a)}[1:6], lambda p: list_transform({k.words(b)}[1:6], lambda u: {one})))), 0)"


def _agree(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 1 ELSE -1 END"


_SQUEEZED = lambda c: f"replace({c}, ' ', '')"
_FULL_PAIRS = f"{_PART_REC}, {k.normalized('prec', 'p_partkey', 'name', 'address', 'country')}, f AS (SELECT a.p_partkey AS k, " + ", ".join(f"a.{c} AS q_{c}, b.{c} AS t_{c}" for c in _NORMALIZED.split(", ")) + " FROM norm a JOIN norm b ON a.p_partkey = b.p_partkey - 1)"
_BOTH = lambda c: (f"q_{c}", f"t_{c}")
_ALT = tuple(f"CASE WHEN {s}_name_alt <> '' THEN {s}_name_alt ELSE {s}_name_n END" for s in "qt")
_FULL_RATIOS = k.compare(
    "f", "k",
    {"n_ratio": _BOTH("name_n"), "nc_ratio": _BOTH("name_core"), "nph_ratio": _BOTH("name_ph"), "a_ratio": _BOTH("addr_n"), "nsp_ratio": tuple(map(_SQUEEZED, _BOTH("name_n")))}, {"n_tsort": _BOTH("name_n")},
    {"n_tset": _BOTH("name_n"), "nc_tset": _BOTH("name_core"), "nph_tset": _BOTH("name_ph"), "a_tset": _BOTH("addr_n"), "nalt": _ALT},
    {"n_partial": _BOTH("name_n"), "nsp_partial": tuple(map(_SQUEEZED, _BOTH("name_n"))), "a_partial": _BOTH("addr_n")},
)
_FULL_KINDS = ["n_ratio", "nc_ratio", "nph_ratio", "a_ratio", "nsp_ratio", "n_tsort", "n_tset", "nc_tset", "nph_tset", "a_tset", "n_partial", "nsp_partial", "a_partial"]


@query(
    f"WITH {_FULL_PAIRS}, {_FULL_RATIOS}, {k.pivoted('k', [*_FULL_KINDS, 'nalt'])} SELECT k, " + ", ".join(_sql_round(c) for c in _FULL_KINDS)
    + f""", round(CASE WHEN q_name_alt <> '' OR t_name_alt <> '' THEN greatest(n_tset, nalt) ELSE n_tset END, 6) AS nalt_tset, round(jaro_winkler_similarity(q_name_n, t_name_n), 6) AS n_jw, round(jaro_winkler_similarity(q_name_core, t_name_core), 6) AS nc_jw,
    CASE WHEN greatest(length(q_name_core), length(t_name_core)) = 0 THEN 1 ELSE round(1 - levenshtein(q_name_core, t_name_core)::DOUBLE / greatest(length(q_name_core), length(t_name_core)), 6) END AS nc_lev,
    (coalesce({k.words("q_name_core")}[1], '') = coalesce({k.words("t_name_core")}[1], ''))::TINYINT AS first_tok_eq, (q_name_core = t_name_core)::TINYINT AS core_eq,
    ((q_acronym <> '' AND (q_acronym = replace(t_name_core, ' ', '') OR q_acronym = t_acronym)) OR (t_acronym <> '' AND (t_acronym = replace(q_name_core, ' ', '') OR t_acronym = q_acronym)))::TINYINT AS acr_match,
    greatest(q_is_web, t_is_web) AS web_any, greatest(q_is_indic, t_is_indic) AS indic_any, {_agree("q_postal", "t_postal")} AS postal_agree, {_agree("q_first_num", "t_first_num")} AS first_num_agree, {_agree("q_nums", "t_nums")} AS nums_seq, {_num_rel("q_nums", "t_nums")} AS num_rel,
    (q_addr_n = '' OR t_addr_n = '')::TINYINT AS a_empty, abs(length(q_name_n) - length(t_name_n)) AS len_diff, abs(len({k.words("q_name_n")}) - len({k.words("t_name_n")})) AS ntok_diff FROM f JOIN wide USING (k)"""
)
def full_pair_features(spark: SparkSession, d: str) -> DataFrame:
    r = _part_records(spark, d)
    side = lambda p, key: r.select(key.alias("k"), *[F.col(c).alias(f"{p}_{c}") for c in r.columns if c != "p_partkey"])
    out = sim.full_features(side("q", F.col("p_partkey")).join(side("t", F.col("p_partkey") - 1), "k"))
    return rounded(out.select("k", *[c for c in out.columns if c[:2] not in ("q_", "t_") and c != "k"]))


# --- look-alikes and vectors ----------------------------------------------------

_NEAR = "near AS (SELECT a.vec_id AS q, b.vec_id AS nn, list_dot_product(a.v, b.v) AS s FROM vec a JOIN vec b ON a.country = b.country AND a.src = 1 AND b.src = 1 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.vec_id) = 1)"
#: Pairs of a vector of source 1 with the next of source 2, with the records of the parts of the same number.
_NN_PAIRS = f"""{_PART_REC}, {k.normalized("prec", "p_partkey", "name", "address", "country")}, {VEC}, pvec AS (SELECT vec.* FROM vec JOIN norm ON p_partkey = vec_id), {_NEAR.replace("JOIN vec", "JOIN pvec").replace("FROM vec", "FROM pvec")},
    f AS (SELECT v.vec_id AS q, v.vec_id + 1 AS t, coalesce(s, 0) AS nn_cos, b.name_core AS core, b.addr_n AS addr, b.nums AS nums, a.name_core AS q_core, a.addr_n AS q_addr, a.nums AS q_nums,
        coalesce(n.name_core, '') AS nn_core, coalesce(n.addr_n, '') AS nn_addr, coalesce(n.nums, '') AS nn_nums
        FROM vec v JOIN norm a ON a.p_partkey = v.vec_id JOIN norm b ON b.p_partkey = v.vec_id + 1 LEFT JOIN near ON near.q = v.vec_id LEFT JOIN norm n ON n.p_partkey = nn WHERE v.src = 1)"""
_NN_RATIOS = k.compare("f", "q, t", {"nn_a_ratio": ("nn_addr", "addr")}, {}, {"nn_nc_tset": ("nn_core", "core"), "nn_a_tset": ("nn_addr", "addr"), "nc_tset": ("q_core", "core"), "a_tset": ("q_addr", "addr")})


@query(f"WITH {_NN_PAIRS}, {_NN_RATIOS}, {k.pivoted('q, t', ['nn_a_ratio', 'nn_nc_tset', 'nn_a_tset', 'nc_tset', 'a_tset'])} SELECT q, t, round(nn_cos, 6) AS nn_cos, round(nn_nc_tset, 6) AS nn_nc_tset, round(nn_a_tset, 6) AS nn_a_tset, round(nn_a_ratio, 6) AS nn_a_ratio, {_agree('nn_nums', 'nums')} AS nn_nums_seq, {_num_rel('nn_nums', 'nums')} AS nn_num_rel, round(nc_tset - nn_nc_tset, 6) AS nc_margin, round(a_tset - nn_a_tset, 6) AS a_margin, {_num_rel('q_nums', 'nums')} - {_num_rel('nn_nums', 'nums')} AS num_margin FROM f JOIN wide USING (q, t)")
def look_alike_features(spark: SparkSession, d: str) -> DataFrame:
    r = _part_records(spark, d).select("p_partkey", "name_core", "addr_n", "nums")
    v = ad.vec(spark, d).filter("src = 1").select(F.col("vec_id").alias("q"), "country", "v")
    near = knn.look_alike(v.join(r.withColumnRenamed("p_partkey", "q"), "q"), ["country"], {"name_core": "", "addr_n": "", "nums": ""})
    side = lambda p, key: r.select(F.col("p_partkey").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("name_core", "addr_n", "nums")])
    pairs = near.withColumn("t", F.col("q") + 1).join(side("q", "q"), "q").join(side("t", "t"), "t")
    a = lambda c: (F.col(f"q_{c}"), F.col(f"t_{c}"))
    pairs = pairs.withColumns({"nc_tset": sim.token_set(*a("name_core")), "a_tset": sim.token_set(*a("addr_n")), "num_rel": sim.number_relation(*a("nums"))})
    out = sim.look_alike_features(pairs)
    return rounded(out.select("q", "t", *sim.LOOK_ALIKE))


_FLOOR = 0.25


@query(f"WITH {VEC}, near AS (SELECT a.vec_id AS q, b.vec_id AS t, list_dot_product(a.v, b.v) AS score FROM vec a JOIN vec b ON a.country = b.country AND a.src = 1 AND b.src > 1 WHERE list_dot_product(a.v, b.v) >= {_FLOOR}) SELECT q, t, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, t)::INTEGER AS rank FROM near QUALIFY rank <= 10")
def knn_floor(spark: SparkSession, d: str) -> DataFrame:
    v = ad.vec(spark, d)
    found = knn.exact_knn(v.filter("src = 1").select(F.col("vec_id").alias("q"), "country", "v"), v.filter("src > 1").select(F.col("vec_id").alias("t"), "country", "v"), 10, ["country"], floor=_FLOOR)
    return rounded(found.select("q", "t", "score", "rank"))


@query(f"WITH {VEC}, {_NEAR}, best AS (SELECT b.vec_id AS t, max(list_dot_product(a.v, b.v)) AS best FROM vec a JOIN vec b ON a.country = b.country AND a.src = 1 AND b.src > 1 GROUP BY 1) SELECT a.vec_id AS q, b.vec_id AS t, round(list_dot_product(a.v, b.v), 6) AS dl_cos, round(coalesce(best - list_dot_product(a.v, b.v), 0), 6) AS dl_t_gap, round(coalesce(list_dot_product(a.v, b.v) - list_dot_product(n.v, b.v), 0), 6) AS dl_nn_margin FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1 AND a.src = 1 LEFT JOIN best ON best.t = b.vec_id LEFT JOIN near ON near.q = a.vec_id LEFT JOIN vec n ON n.vec_id = nn")
def vector_features(spark: SparkSession, d: str) -> DataFrame:
    v = ad.vec(spark, d)
    q, t = v.filter("src = 1").select(F.col("vec_id").alias("q"), "country", "v"), v.filter("src > 1").select(F.col("vec_id").alias("t"), "country", "v")
    pairs = q.select("q", (F.col("q") + 1).alias("t")).join(t.select("t"), "t", "left_semi")
    near = knn.look_alike(q, ["country"], {}).select("q", "nn")
    return rounded(knn.vector_features(pairs, q, t, ["country"], near).select("q", "t", "dl_cos", "dl_t_gap", "dl_nn_margin"))


@query(f"WITH {VEC}, near AS (SELECT a.vec_id AS q, b.vec_id AS t, list_dot_product(a.v, b.v) AS score FROM vec a JOIN vec b ON a.src = 1 AND b.src > 1) SELECT q, t, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, t)::INTEGER AS rank FROM near QUALIFY rank <= 10")
def knn_all_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cell index with every cell probed: nothing may be lost between cells."""
    v = ad.vec(spark, d)
    q, t = v.filter("src = 1").select(F.col("vec_id").alias("q"), "v"), v.filter("src > 1").select(F.col("vec_id").alias("t"), "v")
    return rounded(knn.cell_knn(q, t, 10, cells=16, probes=16).select("q", "t", "score", "rank"))


@query(f"WITH {VEC} SELECT count(*) AS queries, 10 * count(*) AS neighbours, true AS enough FROM vec WHERE src = 1")
def knn_quantised_recall(spark: SparkSession, d: str) -> DataFrame:
    """The quantised index against brute force: it must find nine tenths of the neighbours, and score them exactly."""
    v = ad.vec(spark, d)
    q, t = v.filter("src = 1").select(F.col("vec_id").alias("q"), "v"), v.filter("src > 1").select(F.col("vec_id").alias("t"), "v")
    found = knn.quantised_knn(q, t, 10, cells=8, probes=7, keep=10)
    exact = knn.exact_knn(q.withColumn("g", F.lit(0)), t.withColumn("g", F.lit(0)), 10, ["g"])
    n = found.agg(F.count_distinct("q"), F.count("*")).first()
    return spark.createDataFrame([(n[0], n[1], knn.recall(found, exact) >= 0.9)], "queries long, neighbours long, enough boolean")
