"""Queries of sources, sinks, validation, pools, dictionaries, searches and models, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import audit, blocking, decide, encoder, evaluate, learn, sampling, tfidf
from ..sources import tsv
from . import adapters as ad
from . import kernels as k
from . import linkage
from .adapters import EDGES, REC, REC_TRUTH, SCORES
from .features import _DEVANAGARI, _LATIN
from .queries import _PARTS, _draw, _part_pairs, _scores, _truth_lists
from .registry import query, rounded

# --- sources and sinks ----------------------------------------------------------

_HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry"


def _lines(rows: DataFrame):
    """A writer of lines as they are, with the column's name as the header."""
    return rows.write.option("sep", "\x01").option("quote", "").option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def _text_files(rows: DataFrame, path: str, header: str) -> str:
    """Files of lines (value), each with a header."""
    _lines(rows.select(F.col("value").alias(header))).csv(path)
    return path


def _source_file(spark: SparkSession, d: str, odd: bool) -> str:
    """Records as a folder of tab-separated files in order of line_idx; odd rows are short or have columns too many."""
    r = ad.rec(spark, d).orderBy("line_idx")
    line = F.concat_ws("\t", "entity_id", "business_name", "business_address", "country")
    if odd:
        line = F.when(F.col("line_idx") % 5 == 0, F.concat_ws("\t", "entity_id", "business_name")).when(F.col("line_idx") % 7 == 0, F.concat(line, F.lit("\tmore\tand more"))).otherwise(line)
    return _text_files(r.select(line.alias("value")), f"{tsv.scratch(spark, 'source')}/s.tsv", _HEADER)


@query(f"WITH {REC} SELECT entity_id, business_name, CASE WHEN line_idx % 5 = 0 THEN '' ELSE business_address END AS business_address, CASE WHEN line_idx % 5 = 0 THEN '' ELSE country END AS country, CASE WHEN line_idx % 5 <> 0 AND line_idx % 7 = 0 THEN 2 ELSE 0 END AS n_extra, row_number() OVER (ORDER BY line_idx) - 1 AS line_idx FROM rec")
def tsv_positional(spark: SparkSession, d: str) -> DataFrame:
    return tsv.read_positional(spark, _source_file(spark, d, True), numbered=True)


@query(f"WITH {REC} SELECT entity_id, business_name, business_address, country FROM rec")
def tsv_typed(spark: SparkSession, d: str) -> DataFrame:
    return tsv.read_tsv(spark, _source_file(spark, d, False))


@query("SELECT count(*) AS lines, count(*) AS parsed, true AS ok FROM documents")
def parse_check(spark: SparkSession, d: str) -> DataFrame:
    return tsv.parse_check(spark, _source_file(spark, d, False))


@query(f"WITH {REC} SELECT DISTINCT entity_id FROM rec")
def source_ids(spark: SparkSession, d: str) -> DataFrame:
    return tsv.read_ids(spark, _source_file(spark, d, False))


@query(f"WITH {REC} SELECT src, country, count(*) AS n FROM rec GROUP BY ALL")
def parquet_cache(spark: SparkSession, d: str) -> DataFrame:
    path = f"{tsv.scratch(spark, 'cache')}/rec"
    tsv.cached(ad.rec(spark, d), path)
    return tsv.cached(ad.rec(spark, d).limit(0), path).groupBy("src", "country").agg(F.count("*").alias("n"))  # the copy is there and counts


@query(f"WITH {REC}, {REC_TRUTH} SELECT q, t FROM rec_truth")
def truth_scan(spark: SparkSession, d: str) -> DataFrame:
    lists = _truth_lists(ad.rec(spark, d))
    value = F.concat(F.lit(" "), "source1_entity_id", F.lit("\t"), F.array_join("ids", " , "), F.when(F.size("ids") % 2 == 1, ",").otherwise(""))
    path = _text_files(lists.select(value.alias("value")), f"{tsv.scratch(spark, 'truth')}/t.tsv", "source1_entity_id\tmatched_entity_ids")
    return tsv.truth_edges(tsv.read_truth(spark, path))


@query(f"SELECT ({_draw('o_orderkey', 42)} % 4)::INTEGER::BIGINT AS fold, count(*) AS n, list_sort(list(o_orderkey))[1:3] AS first FROM orders GROUP BY 1")
def manifest_json(spark: SparkSession, d: str) -> DataFrame:
    e = sampling.folds(ad.entities(spark, d), 4, 42)
    first = e.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy("q"))).filter("r <= 3").groupBy("fold").agg(F.sort_array(F.collect_list("q")).alias("first"))
    path = f"{tsv.scratch(spark, 'manifest')}/m"
    tsv.write_json(e.groupBy("fold").agg(F.count("*").alias("n")).join(first, "fold"), path)
    return spark.read.json(path).select("fold", "n", "first")


@query(f"WITH {EDGES} SELECT e.country, e.q::VARCHAR AS source1_entity_id, coalesce(string_agg(t::VARCHAR, ',' ORDER BY p DESC, t), '') AS matched_entity_ids FROM entities e LEFT JOIN (SELECT * FROM scored WHERE p >= 0.5) USING (q) GROUP BY e.country, e.q")
def result_chunks(spark: SparkSession, d: str) -> DataFrame:
    e = ad.entities(spark, d)
    rows = tsv.result_rows(e.select("q"), ad.scored(spark, d).filter("p >= 0.5")).join(e.select(F.col("q").alias("source1_entity_id"), "country"), "source1_entity_id")
    path = f"{tsv.scratch(spark, 'results')}/r"
    tsv.write_chunks(rows.filter("country < '3'"), path, "country")
    tsv.write_chunks(rows, path, "country")  # goes on with what is not there
    return spark.read.csv(path, sep="\t", quote="", header=True, schema="source1_entity_id string, matched_entity_ids string, country string", emptyValue="").na.fill("")


# --- validation -------------------------------------------------------------------

_ODD_IDS = "(CASE WHEN t % 7 = 0 THEN 'S1-' WHEN t % 11 = 0 THEN 'X-' ELSE 'S2-' END) || (t % 50)"


def _odd_id():
    t = F.col("t")
    return F.concat(F.when(t % 7 == 0, "S1-").when(t % 11 == 0, "X-").otherwise("S2-"), (t % 50).cast("string"))


#: Result rows with every kind of fault: by q, no tab (13), a row twice (17), an entity that must not be there (19), one that is missing (below 0.5).
_FAULTY = f"""{EDGES}, lists AS (SELECT q, list({_ODD_IDS} ORDER BY t) AS ids FROM predicted GROUP BY q),
    file AS (SELECT q, CASE WHEN q % 19 = 0 THEN 'S1-x' || q ELSE 'S1-' || q END AS entity, ids, q % 13 <> 0 AS has_tab FROM lists UNION ALL SELECT q, CASE WHEN q % 19 = 0 THEN 'S1-x' || q ELSE 'S1-' || q END, ids, true FROM lists WHERE q % 17 = 0),
    ok AS (SELECT * FROM file WHERE has_tab), each AS (SELECT entity, unnest(ids) AS id FROM ok), found AS (
        SELECT 'no tab' AS rule, entity AS x FROM file WHERE NOT has_tab UNION ALL SELECT 'repeated id in a list', entity FROM ok WHERE len(ids) <> len(list_distinct(ids))
        UNION ALL SELECT 'self match', id FROM each WHERE starts_with(id, 'S1-') UNION ALL SELECT 'wrong prefix', id FROM each WHERE starts_with(id, 'X-')
        UNION ALL SELECT 'repeated row', entity FROM ok GROUP BY entity HAVING count(*) > 1
        UNION ALL SELECT 'missing row', 'S1-' || q FROM entities WHERE 'S1-' || q NOT IN (SELECT entity FROM ok)
        UNION ALL SELECT 'extra row', entity FROM ok WHERE entity NOT IN (SELECT 'S1-' || q FROM entities)
        UNION ALL SELECT 'unknown id', id FROM each WHERE regexp_matches(id, '^S[23]-') AND right(id, 1) = '3'
    ), rules AS (SELECT rule, count(*) AS n, list_sort(list_distinct(list(x)))[1:5] AS examples FROM found GROUP BY rule)"""


def _faulty_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.scored(spark, d).filter("p >= 0.5").groupBy("q").agg(F.array_join(F.sort_array(F.collect_list(F.struct("t", _odd_id().alias("id"))))["id"], ",").alias("ids"))
    entity = F.when(F.col("q") % 19 == 0, F.concat(F.lit("S1-x"), F.col("q").cast("string"))).otherwise(F.concat(F.lit("S1-"), F.col("q").cast("string")))
    whole = F.concat(entity, F.lit("\t"), "ids")
    return rows.select(F.when(F.col("q") % 13 == 0, entity).otherwise(whole).alias("value")).unionAll(rows.filter("q % 17 = 0").select(whole.alias("value")))


def _required(spark: SparkSession, d: str) -> DataFrame:
    return ad.entities(spark, d).select(F.concat(F.lit("S1-"), F.col("q").cast("string")).alias("entity_id"))


def _known(spark: SparkSession) -> DataFrame:
    return spark.range(50).filter("id % 10 <> 3").select(F.concat(F.lit("S2-"), F.col("id").cast("string")).alias("entity_id"))


@query(f"WITH {_FAULTY} SELECT rule, n, examples FROM rules")
def validate_every_rule(spark: SparkSession, d: str) -> DataFrame:
    return audit.violations(audit.parse_result_file(_faulty_lines(spark, d)), _required(spark, d), _known(spark))


_GOOD = "cands AS (SELECT q, list('S2-' || t ORDER BY t) AS ids FROM scored WHERE p >= 0.3 GROUP BY q)"


@query(
    f"""WITH {_FAULTY} SELECT 'faulty' AS file, 'error' AS level, rule || ': ' || n || ', such as ' || array_to_string(examples, ', ') AS finding FROM rules
    UNION ALL SELECT 'faulty', 'warning', 'no candidate file' UNION ALL SELECT 'header', 'error', 'file is comma-separated, not tab-separated' UNION ALL SELECT 'header', 'warning', 'no candidate file'
    UNION ALL SELECT 'absent', 'error', 'cannot be read' UNION ALL SELECT 'absent', 'warning', 'no candidate file' UNION ALL SELECT 'latin', 'error', 'not valid UTF-8 in ' || (SELECT count(*) FROM entities) || ' lines' UNION ALL SELECT 'latin', 'warning', 'no candidate file'
    UNION ALL SELECT 'outside', 'warning', (SELECT count(*) FROM scored WHERE p >= 0.5 AND p < 0.6) || ' matches are not among the candidates'
    UNION ALL SELECT 'outside, strict', 'error', (SELECT count(*) FROM scored WHERE p >= 0.5 AND p < 0.6) || ' matches are not among the candidates'"""
)
def validate_files(spark: SparkSession, d: str) -> DataFrame:
    base, required, heads = tsv.scratch(spark, "validate"), _required(spark, d), ("source1_entity_id\tmatched_entity_ids", "source1_entity_id\tcandidate_entity_ids")
    s = ad.scored(spark, d)
    listed = lambda p: tsv.result_rows(ad.entities(spark, d).select("q"), s.filter(F.col("p") >= p).withColumn("t", F.concat(F.lit("S2-"), F.col("t").cast("string")))).select(F.concat(F.lit("S1-"), F.col("source1_entity_id").cast("string"), F.lit("\t"), "matched_entity_ids").alias("value"))
    faulty, good, few = _text_files(_faulty_lines(spark, d), f"{base}/faulty", heads[0]), _text_files(listed(0.5), f"{base}/good", heads[0]), _text_files(listed(0.6), f"{base}/few", heads[1])
    header = _text_files(listed(0.5), f"{base}/header", heads[0].replace("\t", ","))
    latin = f"{base}/latin"
    _lines(listed(0.5).select(F.concat(F.lit("é"), "value").alias(heads[0]))).option("encoding", "ISO-8859-1").csv(latin)
    targets = s.select(F.concat(F.lit("S2-"), F.col("t").cast("string")).alias("entity_id")).distinct()
    runs = [("faulty", faulty, None, _known(spark), False), ("header", header, None, targets, False), ("absent", f"{base}/absent", None, targets, False), ("latin", latin, None, targets, False), ("outside", good, few, targets, False), ("outside, strict", good, few, targets, True)]
    rows = []
    for name, matching, candidate, known, strict in runs:
        errors, warnings = linkage.validate(spark, matching, candidate, required, known, strict)
        rows += [(name, level, x.split(": ", 1)[1] if x.startswith(base) else x) for level, found in (("error", errors), ("warning", warnings)) for x in found]
    return spark.createDataFrame(rows, "file string, level string, finding string")


@query(f"WITH {EDGES} SELECT q::VARCHAR AS entity, 'S2-' || t AS id FROM scored WHERE p >= 0.5 AND p < 0.6")
def outside_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = ad.scored(spark, d)
    listed = lambda p: s.filter(F.col("p") >= p).groupBy(F.col("q").cast("string").alias("entity")).agg(F.collect_list(F.concat(F.lit("S2-"), F.col("t").cast("string"))).alias("ids"))
    return audit.outside_candidates(listed(0.5), listed(0.6))


# --- filters and pools --------------------------------------------------------------


@query(f"WITH {EDGES} SELECT q, t, round(p, 6) AS p, row_number() OVER (PARTITION BY q ORDER BY p DESC, t)::INTEGER AS p_rank, count(*) OVER (PARTITION BY q) AS n_kept FROM scored WHERE p >= 0.3")
def kept_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decide.competitors(decide.keep(ad.scored(spark, d), 0.3)).select("q", "t", "p", "p_rank", "n_kept"))


@query("SELECT o_orderkey AS q, o_orderkey % 20 = 0 AS held_out FROM orders")
def held_out_rows(spark: SparkSession, d: str) -> DataFrame:
    return ad.entities(spark, d).select("q", sampling.held_out(F.col("q"), 20).alias("held_out"))


@query(f"WITH {EDGES} SELECT q, t, round(p, 6) AS p, NULL::DOUBLE AS reverse_score, NULL::DOUBLE AS reverse_rank FROM scored")
def missing_features(spark: SparkSession, d: str) -> DataFrame:
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return rounded(learn.with_missing(ad.scored(spark, d).select("q", "t", "p"), ["p", "reverse_score", "reverse_rank"]))


def _keyword(c: str) -> str:
    spaced = rf"regexp_replace(regexp_replace(lower({c}), '[''’]s\b', '', 'g'), '[^a-z0-9\x{{0900}}-\x{{097f}}\x{{00c0}}-\x{{017f}}]+', ' ', 'g')"
    return rf"coalesce(list_filter(regexp_split_to_array({spaced}, '\s+'), lambda w: length(w) >= 3 AND NOT list_contains({k.listed(lx.STOP_KEYWORD_V1)}, w))[1], '')"


@query(f"WITH {REC}, key AS (SELECT *, {_keyword('business_name')} AS keyword FROM rec), splits AS (SELECT DISTINCT CASE WHEN line_idx % 2 = 0 THEN 'train' ELSE 'tune' END AS split, keyword FROM key WHERE src = 1 AND line_idx % 6 < 3) SELECT split, entity_id AS t, keyword FROM key JOIN splits USING (keyword) WHERE src > 1 AND keyword <> ''")
def keyword_pool(spark: SparkSession, d: str) -> DataFrame:
    r = ad.rec(spark, d).withColumn("keyword", tx.keyword_v1(F.col("business_name")))
    split = F.when(F.col("line_idx") % 2 == 0, "train").otherwise("tune")
    return blocking.keyword_join(r.filter("src > 1").select(F.col("entity_id").alias("t"), "keyword"), r.filter("src = 1 and line_idx % 6 < 3").select(split.alias("split"), "keyword"))


_POOL = f"{REC}, pool AS (SELECT CASE WHEN line_idx % 3 = 0 THEN 'train' ELSE 'tune' END AS split, src, CASE WHEN line_idx % 4 = 0 THEN 'hard' ELSE 'random' END AS kind, entity_id, line_idx FROM rec WHERE src > 1)"


def _pool(spark: SparkSession, d: str) -> DataFrame:
    r = ad.rec(spark, d).filter("src > 1")
    return r.select(F.when(F.col("line_idx") % 3 == 0, "train").otherwise("tune").alias("split"), "src", F.when(F.col("line_idx") % 4 == 0, "hard").otherwise("random").alias("kind"), "entity_id", "line_idx")


@query(f"WITH {_POOL} SELECT split, src, kind, count(*) AS n FROM pool GROUP BY GROUPING SETS ((split, src, kind), (split, src), (split))")
def pool_composition(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pool_composition(_pool(spark, d))


@query(f"WITH {_POOL} SELECT split, src, CASE WHEN line_idx % 10 = 0 THEN 'extra' ELSE kind END AS kind, entity_id FROM pool WHERE split = 'tune' OR line_idx % 10 = 0")
def stress_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    extra = pool.filter("line_idx % 10 = 0").withColumn("kind", F.lit("extra"))
    return sampling.merged_pools(pool.filter("split = 'tune'"), extra).select("split", "src", "kind", "entity_id")


@query(f"WITH {EDGES} SELECT q, t, {_draw('q', 7)} < 26843545 AS sampled FROM truth")
def dictionary_hold_out(spark: SparkSession, d: str) -> DataFrame:
    e, s = ad.entities(spark, d), ad.scored(spark, d).filter("label = 1").select("q", "t")
    own, others = sampling.dictionary_part(s, sampling.bernoulli(e, "q", 0.1, 7))
    return own.withColumn("sampled", F.lit(True)).unionByName(others.withColumn("sampled", F.lit(False)))


# --- dictionaries ---------------------------------------------------------------------

_STATE_PAIRS = "rows AS (SELECT o_orderkey AS entity, [o_orderpriority, o_orderstatus] AS runs, ['x' || (o_custkey % 3), CASE WHEN o_orderstatus = 'F' THEN 'fin' ELSE 'x' || (o_custkey % 5) END] AS codes FROM orders)"


@query(f"WITH {_STATE_PAIRS}, each AS (SELECT entity, unnest(runs) AS tok, codes FROM rows), al AS (SELECT DISTINCT entity, tok, eng FROM (SELECT entity, tok, unnest(codes) AS eng FROM each) WHERE tok <> '5-LOW'), n AS (SELECT tok, eng, count(*) AS n FROM al GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY tok) AS purity, row_number() OVER (PARTITION BY tok ORDER BY n DESC, eng) AS r FROM n) SELECT tok, eng, n, round(purity, 6) AS purity FROM p WHERE r = 1 AND n >= 20 AND purity >= 0.2 AND tok <> eng")
def learned_states(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders")
    code = lambda m: F.concat(F.lit("x"), (F.col("o_custkey") % m).cast("string"))
    pairs = o.select(F.col("o_orderkey").alias("entity"), F.array("o_orderpriority", "o_orderstatus").alias("runs"), F.array(code(3), F.when(F.col("o_orderstatus") == "F", "fin").otherwise(code(5))).alias("codes"))
    return rounded(learn.learned_states(pairs, ["5-LOW"], 20, 0.2))


#: Names written in Devanagari letters that stand for one Latin letter each, and the words that follow them in the next part's name.
_LEARNED = f"""{_PARTS}, al AS (SELECT DISTINCT unnest(string_split(a, ' ')) AS tok, unnest(string_split(b, ' ')) AS eng, k AS entity FROM x WHERE k % 2 = 0 AND len(string_split(a, ' ')) = len(string_split(b, ' '))),
    n AS (SELECT tok, eng, count(*) AS n FROM al GROUP BY ALL), pure AS (SELECT *, n / sum(n) OVER (PARTITION BY tok) AS purity, row_number() OVER (PARTITION BY tok ORDER BY n DESC, eng) AS r FROM n),
    dict AS (SELECT tok, eng FROM pure WHERE r = 1 AND n >= 3 AND purity >= 0.05 AND tok <> eng),
    spelt AS (SELECT k, b, a AS plain, translate(a, '{_LATIN}', '{_DEVANAGARI}') <> a AND k % 3 <> 0 AS indic FROM x),
    w AS (SELECT k, indic, unnest(string_split(plain, ' ')) AS w, unnest(range(len(string_split(plain, ' ')))) AS i FROM spelt), m AS (SELECT k, string_agg(CASE WHEN indic THEN coalesce(eng, w) ELSE w END, ' ' ORDER BY i) AS name FROM w LEFT JOIN dict ON tok = w GROUP BY k),
    named AS (SELECT k, b, plain, {k.map_words("name", lx.NAME_WORDS)} AS name_n, {k.map_words("plain", lx.NAME_WORDS)} AS before FROM m JOIN spelt USING (k))"""


def _translated(spark: SparkSession, d: str) -> DataFrame:
    x = _part_pairs(spark, d).select("k", "a", "b")
    aligned = blocking.aligned_words(x.filter("k % 2 = 0").select(F.col("k").alias("entity"), "a", "b"), "a", "b")
    table = {r["tok"]: r["eng"] for r in learn.learned_dictionary(aligned, 3, 0.05).collect()}  # one row per word of the vocabulary that is pure enough
    spelt = x.withColumn("name", F.when(F.col("k") % 3 != 0, F.translate("a", _LATIN, _DEVANAGARI)).otherwise(F.col("a"))).withColumns({"address": F.lit(""), "country": F.lit("India")})
    return tx.normalized_record(spelt, "name", "address", "country", translate=table).withColumn("before", tx.normalized_name(F.col("name")))


@query(f"WITH {_LEARNED} SELECT k, name_n FROM named")
def translated_names(spark: SparkSession, d: str) -> DataFrame:
    return _translated(spark, d).select("k", "name_n")


@query(f"WITH {_LEARNED}, {k.compare('named', 'k', {}, {'before': ('before', 'b'), 'after': ('name_n', 'b')}, {})}, {k.pivoted('k', ['before', 'after'])} SELECT count(*) AS n, round(avg(before), 6) AS before, round(avg(after), 6) AS after FROM wide")
def dictionary_effect(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linkage.dictionary_effect(_translated(spark, d), "before", "name_n", "b"))


@query("WITH t AS (SELECT p_type AS name, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1), m AS (SELECT p_retailprice AS p FROM part WHERE p_size > 40) SELECT (SELECT round(avg((coalesce(n, 0) > 90)::INTEGER), 6) FROM part LEFT JOIN t ON p_type = name) AS common_share, [round(x, 6) FOR x IN (SELECT quantile_cont(p, [0.1, 0.25, 0.5, 0.75, 0.9]) FROM m)] AS quantiles")
def name_profile(spark: SparkSession, d: str) -> DataFrame:
    p = ad.table(spark, d, "part")
    named = p.select(F.col("p_partkey").alias("q"), F.col("p_type").alias("name"), "p_size", F.col("p_retailprice").alias("p"))
    out = linkage.name_profile(named.select("q", "name"), named.filter("p_size > 25"), named.filter("p_size > 40"), 90)
    return rounded(out).withColumn("quantiles", F.transform("quantiles", lambda x: F.round(x, 6)))


# --- decisions ------------------------------------------------------------------------


@query(f"WITH {SCORES}, wrong AS (SELECT s.q, s.t, round(s.p, 6) AS p, CASE WHEN p >= 0.5 AND label = 0 THEN 'wrong' WHEN p < 0.5 AND label = 1 THEN 'missed' ELSE 'right' END AS kind FROM scored s JOIN scores e USING (q) WHERE e.f05 < 1) SELECT q, t, p, kind FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, t) AS rank FROM wrong WHERE kind <> 'right') WHERE rank <= 2 ORDER BY q, rank LIMIT 25")
def error_cases(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when((F.col("p") >= 0.5) & (F.col("label") == 0), "wrong").when((F.col("p") < 0.5) & (F.col("label") == 1), "missed").otherwise("right")
    return rounded(linkage.error_cases(_scores(spark, d), ad.scored(spark, d).select("q", "t", "p", kind.alias("kind")), 2, 25))


def _search_sql(country: str) -> str:
    """The four passes of the search, for each value of the expression `country` over entities."""
    f = "CASE WHEN n_true = 0 AND n = 0 THEN 1.0::DOUBLE WHEN h = 0 THEN 0.0::DOUBLE ELSE 1.25 * (h::DOUBLE / n) * (h::DOUBLE / n_true) / (0.25 * h::DOUBLE / n + h::DOUBLE / n_true) END"
    head = f"""{EDGES}, ents AS MATERIALIZED (SELECT q, {country} AS country FROM entities), nt AS MATERIALIZED (SELECT q, count(*) AS n_true FROM truth GROUP BY q),
    base AS MATERIALIZED (SELECT country, count(*) AS n_all, count(*) FILTER (WHERE n_true IS NULL) AS alone FROM ents LEFT JOIN nt USING (q) GROUP BY country),
    pairs AS MATERIALIZED (SELECT e.country, s.q, s.t, s.p, s.label, coalesce(n_true, 0) AS n_true FROM scored s JOIN ents e USING (q) LEFT JOIN nt USING (q))"""

    def best(name: str, grid: str) -> str:
        return f""", {name}_g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY country ORDER BY o, m, e, a) AS setting FROM (SELECT DISTINCT country, o, m, e, a FROM ({grid}))),
        {name}_1 AS (SELECT g.*, q, t, p, label, n_true, row_number() OVER (PARTITION BY g.country, setting, t ORDER BY p DESC, q) AS place FROM pairs x JOIN {name}_g g ON g.country = x.country AND x.p >= g.m),
        {name}_2 AS (SELECT *, max(p) OVER (PARTITION BY country, setting, q) AS top FROM {name}_1 WHERE place = 1 OR NOT o),
        {name}_3 AS (SELECT country, setting, q, n_true, count(*) AS n, sum(label) AS h FROM {name}_2 WHERE p >= a * top AND top >= e GROUP BY ALL),
        {name}_4 AS (SELECT country, setting, sum({f} - CASE WHEN n_true = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS gain FROM {name}_3 GROUP BY ALL),
        {name} AS MATERIALIZED (SELECT g.*, n_all, (coalesce(gain, 0) + alone) / n_all AS f05 FROM {name}_g g JOIN base USING (country) LEFT JOIN {name}_4 USING (country, setting) QUALIFY row_number() OVER (PARTITION BY country ORDER BY round(f05, 12) DESC, setting) = 1)"""

    steps = lambda lo, hi, by: f"list_transform(range(0, round(({hi} - {lo}) / {by})::BIGINT + 1), lambda i: round({lo} + i * {by}, 6))"
    one = f"SELECT country, o, m, 0.0::DOUBLE AS e, 0.0::DOUBLE AS a FROM base, (VALUES (true), (false)) v(o), (SELECT unnest({steps('0.05::DOUBLE', '0.95::DOUBLE', '0.025::DOUBLE')}) AS m)"
    two = f"SELECT country, o, unnest({steps('greatest(0.0::DOUBLE, m - 0.05::DOUBLE)', '(m + 0.05::DOUBLE)', '0.005::DOUBLE')}) AS m, 0.0::DOUBLE AS e, 0.0::DOUBLE AS a FROM p1"
    three = f"SELECT country, o, m, unnest(list_concat([0.0::DOUBLE], {steps('m', 'least(0.95::DOUBLE, m + 0.3::DOUBLE)', '0.05::DOUBLE')})) AS e, v.a FROM p2, (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(a)"
    four = "SELECT country, o, m, e, unnest([a, greatest(0.0::DOUBLE, a - 0.1::DOUBLE), greatest(0.0::DOUBLE, a + 0.1::DOUBLE)]) AS a FROM (SELECT country, o, m, unnest([e, greatest(0.0::DOUBLE, e - 0.025::DOUBLE), greatest(0.0::DOUBLE, e + 0.025::DOUBLE)]) AS e, a FROM (SELECT country, o, unnest([m, greatest(0.0::DOUBLE, m - 0.01::DOUBLE), greatest(0.0::DOUBLE, m + 0.01::DOUBLE)]) AS m, e, a FROM p3))"
    return head + best("p1", one) + best("p2", two) + best("p3", three) + best("p4", four)


_TUNED = "o AS one_to_one, round(m, 6) AS t_match, round(e, 6) AS t_empty, round(a, 6) AS alpha, round(f05, 6) AS macro_f05"
_TUNED_SCHEMA = "one_to_one boolean, t_match double, t_empty double, alpha double, macro_f05 double"


@query(f"WITH {_search_sql(chr(39) + 'all' + chr(39))} SELECT {_TUNED} FROM p4")
def tuned_decision(spark: SparkSession, d: str) -> DataFrame:
    s = ad.scored(spark, d)
    best = decide.tune(ad.entities(spark, d), s.filter("label = 1").select("q", "t"), s)
    return rounded(spark.createDataFrame([tuple(best[c] for c in (*decide.SETTINGS, "macro_f05"))], _TUNED_SCHEMA))


@query(f"WITH {_search_sql('country')} SELECT country, n_all AS n, {_TUNED} FROM p4")
def tuned_by_country(spark: SparkSession, d: str) -> DataFrame:
    s = ad.scored(spark, d)
    best = decide.tune_by_country(ad.entities(spark, d), s.filter("label = 1").select("q", "t"), s)
    return rounded(spark.createDataFrame([(c, b["n"], *(b[x] for x in (*decide.SETTINGS, "macro_f05"))) for c, b in best.items()], f"country string, n long, {_TUNED_SCHEMA}"))


_OPTIONS = "options AS (SELECT country, count(*) * 1.0::DOUBLE AS cands, avg(label) AS recall FROM scored JOIN entities USING (q) GROUP BY country)"


@query(f"WITH RECURSIVE {EDGES}, {_OPTIONS}, ranked AS (SELECT *, row_number() OVER (ORDER BY cands, country) AS i FROM options), walk AS (SELECT i, country, recall FROM ranked WHERE i = 1 UNION ALL SELECT r.i, CASE WHEN r.recall - w.recall >= 0.0005 THEN r.country ELSE w.country END, CASE WHEN r.recall - w.recall >= 0.0005 THEN r.recall ELSE w.recall END FROM walk w JOIN ranked r ON r.i = w.i + 1) SELECT country FROM walk ORDER BY i DESC LIMIT 1")
def auto_blocking(spark: SparkSession, d: str) -> DataFrame:
    by = ad.scored(spark, d).join(ad.entities(spark, d), "q").groupBy("country").agg(F.count("*").alias("cands"), F.avg("label").alias("recall")).orderBy("country").collect()
    chosen = evaluate.auto_blocking([r.asDict() for r in by], 1e18, 0.0005)
    return spark.createDataFrame([(chosen["country"],)], "country string")


@query(
    f"WITH {_PARTS}, c AS (SELECT a.k // 4 AS q, a.k AS t, a.a AS x, a.b AS y FROM x a), {k.compare('c', 'q, t', {'ce': ('x', 'y')}, {}, {})}, s AS (SELECT q, t, r / 100 AS ce FROM compared) SELECT q, t, round(ce, 6) AS ce, round(max(ce) OVER (PARTITION BY q), 6) AS ce_max, round(max(ce) OVER (PARTITION BY q) - ce, 6) AS ce_gap, row_number() OVER (PARTITION BY q ORDER BY ce DESC, t)::INTEGER AS ce_rank, count(*) FILTER (WHERE ce >= 0.5) OVER (PARTITION BY q) AS ce_n_hi FROM s"
)
def rerank_context(spark: SparkSession, d: str) -> DataFrame:
    """A pair scorer plugged in; here the ratio of two names takes the place of a trained one."""
    pairs = _part_pairs(spark, d).select(F.floor(F.col("k") / 4).cast("long").alias("q"), F.col("k").alias("t"), "a", "b")
    return rounded(learn.rerank(pairs, lambda a, b: sim.ratio(a, b) / 100, "a", "b").drop("a", "b"))


# --- models: trees have no SQL, so only what is exact about them has ------------------

_FEATURES = ["p_rank", "p_gap", "p_rel", "p_sum", "n_kept", "n_hi", "p_2nd", "is_s3"]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return sampling.folds(decide.competitors(ad.scored(spark, d)), 2, 42)


@query()
def gbt_oof(spark: SparkSession, d: str) -> DataFrame:
    return learn.out_of_fold(_pairs(spark, d), _FEATURES, iterations=5).select("q", "t", "label", "fold", "p")


@query(f"WITH {EDGES} SELECT count(*) AS n, count(*) AS n_equal FROM scored")
def model_files(spark: SparkSession, d: str) -> DataFrame:
    """A model and a configuration written and read again score alike."""
    pairs, path = _pairs(spark, d), tsv.scratch(spark, "model")
    model = learn.train_gbt(pairs.filter("fold = 0"), _FEATURES, iterations=3)
    learn.save_model(model, f"{path}/gbt")
    both = [learn.score(m, pairs, _FEATURES).select("q", "t", F.col("p").alias(f"p{i}")) for i, m in enumerate((model, learn.load_model(f"{path}/gbt")))]
    return both[0].join(both[1], ["q", "t"]).agg(F.count("*").alias("n"), F.count_if(F.col("p0") == F.col("p1")).alias("n_equal"))


@query(f"WITH {EDGES} SELECT country, count(*) AS n, true AS scored FROM scored JOIN entities USING (q) GROUP BY country")
def leave_one_country_out(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d).join(ad.entities(spark, d), "q")
    out = learn.leave_one_out(pairs, _FEATURES, iterations=2)
    return out.groupBy("country").agg(F.count("*").alias("n"), F.bool_and(F.col("p").between(0, 1)).alias("scored"))


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    model = learn.train_gbt(_pairs(spark, d), _FEATURES, iterations=5)
    return spark.createDataFrame(learn.importances(model, _FEATURES), "feature string, importance double")


@query(f"WITH {EDGES}, b AS (SELECT *, label = 1 OR {_draw('concat_ws(chr(124), q, t)', 42)} < 53687091 AS base FROM scored) SELECT count(*) FILTER (WHERE base) AS n_base, true AS mined, true AS better_or_equal FROM b")
def mined_training(spark: SparkSession, d: str) -> DataFrame:
    """The second pass learns from the base and from what the first pass took for links; on all rows it must rank no worse than chance."""
    s = _pairs(spark, d)
    draw = F.conv(F.substring(sampling.order_of(F.concat_ws("|", "q", "t"), 42), 1, 7), 16, 10).cast("long") < 53687091
    pairs = s.withColumn("base", (F.col("label") == 1) | draw)
    model, n_base, n_mined = learn.train_mined(pairs, _FEATURES, 3, 5)
    auc = evaluate.roc_auc(learn.score(model, pairs, _FEATURES)).first()["auc"]
    return spark.createDataFrame([(n_base, n_mined > 0, auc >= 0.5)], "n_base long, mined boolean, better_or_equal boolean")


@query()
def second_stage(spark: SparkSession, d: str) -> DataFrame:
    """Which of the second stage's parts the gates let through, and the score that results."""
    e, s = ad.entities(spark, d), sampling.folds(ad.scored(spark, d), 2, 42)
    out = learn.second_stage(e, s.filter("label = 1").select("q", "t"), s, ["p_rank", "p_gap", "p_rel", "p_sum", "n_kept", "n_hi", "p_2nd"], iterations=3)
    return spark.createDataFrame([(out["stage2"], out["per_country"], out["column"], float(out["f05"]), out["pairs"].count())], "stage2 boolean, per_country boolean, column string, f05 double, n long")


_URL = "CASE page_id % 3 WHEN 0 THEN 'https://x.org/file/d/' || substr(md5(url), 1, 12) || '/view' WHEN 1 THEN 'https://x.org/open?a=1&id=' || substr(md5(url), 1, 15) ELSE url END"


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN substr(md5(url), 1, 12) WHEN 1 THEN substr(md5(url), 1, 15) ELSE '' END AS file_id FROM pages")
def shared_file_ids(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "pages").select("page_id", tx.shared_file_id(F.expr(_URL)).alias("file_id"))


@query(f"WITH {REC} SELECT entity_id, true AS unit FROM rec")
def learned_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of records by an encoder trained on pairs of one text, one side of which lost every fifth word."""
    r = ad.rec(spark, d)
    n, a = F.col("business_name"), F.col("business_address")
    fewer = lambda c: F.array_join(F.filter(tx.words(c), lambda w, i: i % 5 != 2), " ")
    pairs = r.select(n.alias("q_name"), a.alias("q_address"), fewer(n).alias("t_name"), fewer(a).alias("t_address"), "country")
    model = encoder.fit_encoder(pairs, most=2000, dim=16, bag=16, buckets=1 << 12, epochs=2)
    v = r.select("entity_id", encoder.encode(model)("business_name", "business_address").alias("v"))
    return v.select("entity_id", (F.abs(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) - 1) < 1e-4).alias("unit"))


@query()
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    p = ad.table(spark, d, "part").select("p_partkey", "p_name")
    model = tfidf.fit_embedder(p.select(F.col("p_name").alias("text")), dim=16)
    return p.select("p_partkey", tfidf.encoder(model)(F.col("p_name")).alias("v"))

