"""Views of the driver's tables as record-linkage inputs, in Spark and in SQL.

rec: documents as records of three sources; the first eight words are the name
and the next twelve the address; records with the same text are true matches.
edges: orders as entities; line items as scored links, returned ones true.
vec: embeddings as vectors of three sources, grouped by label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("w", words(F.coalesce("text", F.lit(""))))
    src = (F.pmod("doc_id", F.lit(3)) + 1).cast("int")
    return d.select(src.alias("src"), F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.col("doc_id").alias("line_idx"), F.array_join(F.slice("w", 1, 8), " ").alias("business_name"), F.array_join(F.slice("w", 9, 12), " ").alias("business_address"), F.col("lang").alias("country"), F.md5(F.trim(F.lower("text"))).alias("copy"))


REC = r"""rec AS (
    SELECT (doc_id % 3 + 1)::INTEGER AS src, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, doc_id AS line_idx,
        array_to_string(w[1:8], ' ') AS business_name, coalesce(array_to_string(w[9:20], ' '), '') AS business_address, lang AS country, md5(trim(lower(text))) AS copy
    FROM (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)
)"""


def rec_truth(r: DataFrame) -> DataFrame:
    """(q, t) of records of source 1 and others with the same text."""
    one = r.filter("src = 1").select(F.col("entity_id").alias("q"), "copy")
    return one.join(r.filter("src > 1").select(F.col("entity_id").alias("t"), "copy"), "copy").select("q", "t")


REC_TRUTH = "rec_truth AS (SELECT a.entity_id AS q, b.entity_id AS t FROM rec a JOIN rec b ON a.copy = b.copy AND a.src = 1 AND b.src > 1)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("country"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, t, p, is_s3, label): a line item's part, the largest quantity over 50, and whether any was returned."""
    li = table(spark, sf_dir, "lineitem")
    by = li.groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("t")).agg((F.max("l_quantity") / 50).alias("p"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    return by.withColumn("is_s3", F.pmod("t", F.lit(2)).cast("int"))


EDGES = """entities AS (SELECT o_orderkey AS q, o_orderpriority AS country FROM orders),
scored AS (
    SELECT l_orderkey AS q, l_partkey AS t, max(l_quantity) / 50 AS p, max((l_returnflag = 'R')::INTEGER) AS label, (l_partkey % 2)::INTEGER AS is_s3
    FROM lineitem GROUP BY l_orderkey, l_partkey
), truth AS (SELECT q, t FROM scored WHERE label = 1), predicted AS (SELECT q, t FROM scored WHERE p >= 0.5)"""

SCORES = (
    EDGES
    + """, counts AS (
    SELECT e.q, e.country, coalesce(n_true, 0)::BIGINT AS n_true, coalesce(n_pred, 0)::BIGINT AS n_pred, coalesce(tp, 0)::BIGINT AS tp, coalesce(found, 0)::BIGINT AS found
    FROM entities e LEFT JOIN (
        SELECT q, sum(label) AS n_true, sum((p >= 0.5)::INTEGER) AS n_pred, sum(label * (p >= 0.5)::INTEGER) AS tp, sum(label * (p >= 0.25)::INTEGER) AS found FROM scored GROUP BY q
    ) USING (q)
), scores AS (
    SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / greatest(n_pred, 1) END AS precision,
        CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / greatest(n_true, 1) END AS recall,
        CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE
            ELSE 1.25 * (tp::DOUBLE / n_pred) * (tp::DOUBLE / n_true) / (0.25 * tp::DOUBLE / n_pred + tp::DOUBLE / n_true) END AS f05
    FROM counts
)"""
)


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.pmod("vec_id", F.lit(3)) + 1).cast("int").alias("src"), F.col("label").alias("country"), F.col("embedding").alias("v"))


VEC = "vec AS (SELECT vec_id, (vec_id % 3 + 1)::INTEGER AS src, label AS country, embedding::DOUBLE[] AS v FROM embeddings)"
