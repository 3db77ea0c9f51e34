"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import histogram_sort

    out = histogram_sort(_table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "p_text", "p_meta", "score", "keep")


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import link_quotes

    out = link_quotes(_table(spark, sf_dir, "conversations"))
    return out.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op5_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, learn_filters

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = learn_filters(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_seed_and_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op8_blocked_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    out = jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op9_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages, page_of

    r = F.col("response")
    captures = archive_pages(_table(spark, sf_dir, "pages"), min_payload=100)
    return captures.select(page_of(F.col("record_id")).alias("page_id"), r["payload_bytes"].alias("payload_bytes"), r["digest"].alias("payload_digest"), r["type"].alias("record_type"), page_of(r["refers_to"]).alias("refers_to"), F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, window=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_histogram_sort, op2_co_training, op3_line_runs, op4_quotation_links, op5_bitmask_filters, op6_seed_and_align, op7_prefix_forest, op8_blocked_product, op9_transactions, op10_best_fit)
}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_STRING = "coalesce(length({0}) || ':' || {0}, '-')"

ORACLE_SQL: dict[str, str] = {
    "op4_quotation_links": rf"""
        WITH RECURSIVE m AS (
            SELECT DISTINCT conv_id, turn, role, text, md5(coalesce(conv_id::VARCHAR, '-') || '|' || coalesce(turn::VARCHAR, '-') || '|' || {_STRING.format("role")} || '|' || {_STRING.format("text")}) AS message
            FROM conversations
        ), split AS (
            SELECT message, conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS l FROM m WHERE regexp_matches(coalesce(text, ''), '(?m)^[ \t]{{0,3}}>')
        ), lines AS (
            SELECT message, conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS line FROM split
        ), marked AS (
            SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]{{0,3}}>)+)[ \t]?', 1), '[^>]', '', 'g')) AS marks FROM lines
        ), levelled AS (
            SELECT *, CASE WHEN marks = 0 AND regexp_matches(line, '(?i)^\s*(on\b.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$') AND lead(marks) OVER (PARTITION BY message ORDER BY pos) > 0 THEN -1 ELSE marks END AS level
            FROM marked
        ), changes AS (
            SELECT *, CASE WHEN level <> lag(level) OVER (PARTITION BY message ORDER BY pos) THEN 1 ELSE 0 END AS changed FROM levelled
        ), runs AS (
            SELECT *, sum(changed) OVER (PARTITION BY message ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM changes
        ), found AS (
            SELECT message, run, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(level) AS level, string_agg(regexp_replace(line, '^((?:[ \t]{{0,3}}>)+)[ \t]?', ''), chr(10) ORDER BY pos) AS passage
            FROM runs GROUP BY message, run
            UNION ALL
            SELECT message, 0, conv_id, turn, 0, coalesce(text, '') FROM m WHERE NOT regexp_matches(coalesce(text, ''), '(?m)^[ \t]{{0,3}}>')
        ), parts AS (
            SELECT message, conv_id, turn, level, unnest(list_concat([passage], string_split(passage, chr(10)), regexp_split_to_array(passage, '\n[ \t]*\n'))) AS part FROM found WHERE level >= 0
        ), keys AS (
            SELECT message, conv_id, turn, norm, level > 0 AS quoted, min(level) AS level, max(length(norm)) AS weight
            FROM (SELECT *, {_NORM.format("part")} AS norm FROM parts) WHERE norm <> '' GROUP BY message, conv_id, turn, norm, level > 0
        ), owners AS (
            SELECT *, last_value(CASE WHEN NOT quoted THEN {{'turn': turn, 'origin': message}} END IGNORE NULLS) OVER (
                PARTITION BY conv_id, norm ORDER BY turn NULLS FIRST, quoted DESC, message ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM keys
        ), links AS (
            SELECT message, o.origin AS origin, any_value(o.turn) AS origin_turn, min(level) AS level, sum(weight) AS weight FROM owners WHERE quoted AND o IS NOT NULL AND o.origin <> message GROUP BY message, o.origin
        ), replies AS (
            SELECT message, origin, origin_turn AS reply_turn, count(*) OVER (PARTITION BY message) AS n_linked FROM links
            QUALIFY row_number() OVER (PARTITION BY message ORDER BY level, weight DESC, coalesce(origin_turn, 0) DESC, origin) = 1
        ), up AS (
            SELECT message, origin AS root, 1 AS depth FROM replies
            UNION ALL
            SELECT up.message, r.origin, up.depth + 1 FROM up JOIN replies r ON r.message = up.root
        ), roots AS (
            SELECT up.message, up.root, up.depth, m.turn AS root_turn FROM up JOIN m ON m.message = up.root WHERE up.root NOT IN (SELECT message FROM replies)
        ), own AS (
            SELECT message, regexp_replace(coalesce(string_agg(passage, chr(10) ORDER BY run) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS body, count(*) FILTER (WHERE level > 0) AS n_quotes
            FROM found WHERE message IN (SELECT message FROM found WHERE level <> 0 OR run > 0) GROUP BY message
        ), laid AS (
            SELECT m.conv_id, m.turn, m.role, m.text, m.message, body, n_quotes, n_linked, reply_turn, depth, coalesce(root, m.message) AS root, CASE WHEN root IS NULL THEN m.turn ELSE root_turn END AS root_turn
            FROM m LEFT JOIN own USING (message) LEFT JOIN replies USING (message) LEFT JOIN roots USING (message)
        )
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, root, turn NULLS FIRST, message)::INTEGER AS position, turn, role, reply_turn, root_turn,
            coalesce(depth, 0)::BIGINT AS depth, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, CASE WHEN text IS NOT NULL THEN sha256(coalesce(body, text)) END AS text_sha256
        FROM laid
    """,
    "op3_line_runs": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents
        ), keyed AS (
            SELECT *, {_ASCII_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM lines
        ), often AS (
            SELECT key, max(doc_id) AS top FROM (SELECT DISTINCT doc_id, key FROM keyed WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3
        )
        SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE o.key IS NOT NULL AND o.top <> k.doc_id)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL OR o.top = k.doc_id), '')) AS kept_sha256
        FROM keyed k LEFT JOIN often o ON o.key = k.key GROUP BY k.doc_id
    """,
    "op8_blocked_product": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS s FROM w
        ), k AS (
            SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS k FROM s
        ), sets AS (
            SELECT k, min(doc_id) AS doc, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY k
        ), grams AS (
            SELECT k, n, unnest(s) AS g FROM sets
        ), pairs AS (
            SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.k < b.k AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (na + nb - shared)
        ), ways AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach(k, o) AS (
            SELECT k, k FROM sets UNION SELECT r.k, w.b FROM reach r JOIN ways w ON w.a = r.o
        ), comps AS (
            SELECT r.k, min(doc) AS least FROM reach r JOIN sets ON sets.k = r.o GROUP BY r.k
        ), degrees AS (
            SELECT a AS k, count(*) AS n_links FROM ways GROUP BY a
        )
        SELECT doc_id, n::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM k LEFT JOIN comps USING (k) LEFT JOIN degrees USING (k)
    """,
    "op9_transactions": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, first_value(page_id) OVER w AS first, payload_bytes >= 100 AND row_number() OVER w > 1 AS again FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, 1 AS n_requests, 1 AS n_metadata
        FROM f
    """,
}
