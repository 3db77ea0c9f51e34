"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.decontam import decontaminate
from kinweave.llm.jaccard import jaccard_components
from kinweave.llm.linededup import dedup_lines
from kinweave.llm.packing import pack_documents
from kinweave.llm.quality import fit_quality, score_quality
from kinweave.llm.queries import TOKENIZER
from kinweave.llm.shared import drop, stage


#: What operators read; other columns of a table pass by under names that clash with none of theirs.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def hidden(docs: DataFrame) -> DataFrame:
    return docs.select([F.col(f"`{c}`").alias(c if c in READ else f"__other_{i}") for i, c in enumerate(docs.columns)])


def shown(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return out.select([F.col(c if c in READ else f"__other_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, as they are.

    Texts without a word, and all documents where no classifier can be learned,
    stay; rows that repeat a doc_id are judged one by one.
    """
    rows = hidden(docs)
    model = fit_quality(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return shown(score_quality(rows, model).filter("keep"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines, n_chars counted anew where text went.

    Null texts stay null; a document that loses every line stays with an empty text.
    """
    out = dedup_lines(hidden(docs))
    return shown(out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))), docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group that five-word shingles link at a similarity of 0.8.

    Documents without words have no copies and stay. Rows that repeat a doc_id
    are judged by their texts; rows equal in both are one document, and stay or
    go together; a null doc_id is the smallest.
    """
    out = jaccard_components(hidden(docs), n=5, percent=80)
    return shown(out.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item; null and empty texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens; null and empty texts hold the end id alone."""
    return pack_documents(docs, TOKENIZER, window=1024)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Neither the classifier nor the tokens can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, function) in enumerate(STAGES):
        out = function(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out  # read when it is evaluated, so what it reads stays
        docs = stage(out, "stage")
        if before is not None:
            drop(before)
        before = docs
    return docs
