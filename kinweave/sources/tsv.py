"""Tab-separated sources and sinks, ground truth, and JSON reports."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ["entity_id", "business_name", "business_address", "country"]
#: How result files are written: values as they are, with a header.
TSV = {"sep": "\t", "quote": "", "emptyValue": "", "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share; it goes when the application ends.

    Only where the setting is absent and Spark runs in one process is a folder
    of this machine taken instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"kinweave-{os.getpid()}")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that scratch gave."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df through a Parquet copy in the shared folder, for what several branches of a plan read: it is computed once, and lost executors cost none of it."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_positional(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """The first four columns by position; short rows are padded with '', each file's header line is dropped, extra columns are counted in n_extra.

    numbered adds line_idx, 0 for the first row after the header, in the order
    of file names and lines: lines are counted in each split of a file, and what
    precedes a split is one small row per split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    heads = lines.filter("__block = 0").groupBy("__file").agg(F.min("__at").alias("__at"))  # one row per file
    rows = lines.join(F.broadcast(heads.select("__at")), "__at", "left_anti")
    parts = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t", -1)
    out = rows.select("__at", "__file", "__block", *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(FIELDS)], F.greatest(F.size(parts) - 4, F.lit(0)).alias("n_extra"))
    if numbered:
        sizes = out.groupBy("__file", "__block").agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        within = F.row_number().over(Window.partitionBy("__file", "__block").orderBy("__at")) - 1
        out = out.withColumn("__w", within).join(F.broadcast(sizes.select("__file", "__block", before.alias("__b"))), ["__file", "__block"]).withColumn("line_idx", F.col("__w") + F.col("__b")).drop("__w", "__b")
    return out.drop("__at", "__file", "__block")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, no quoting, missing values as ''."""
    return spark.read.csv(path, sep="\t", quote="", escape="", header=True, schema=SCHEMA, enforceSchema=True, emptyValue="").na.fill("")


def parse_check(spark: SparkSession, path: str) -> DataFrame:
    """(lines, parsed, ok): lines of the files but their headers against parsed rows; a difference of one is allowed."""
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_path")).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    parsed = read_tsv(spark, path).agg(F.count("*").alias("parsed"))
    return lines.crossJoin(F.broadcast(parsed)).withColumn("ok", F.abs(F.col("lines") - F.col("parsed")) <= 1)


def parsed_ids(listed) -> F.Column:
    """Ids of a comma-joined list: trimmed, empties dropped."""
    return F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ",", -1), lambda x: F.trim(x)), lambda x: x != "")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(source1_entity_id, ids array) of a ground-truth file."""
    lines = spark.read.csv(path, sep="\t", quote="", header=True, schema="source1_entity_id string, matched_entity_ids string")
    return lines.select(F.trim("source1_entity_id").alias("source1_entity_id"), parsed_ids(F.col("matched_entity_ids")).alias("ids"))


def truth_edges(truth: DataFrame) -> DataFrame:
    return truth.select(F.col("source1_entity_id").alias("q"), F.explode("ids").alias("t"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct entity ids of a source; blank lines are skipped."""
    return read_tsv(spark, path).select("entity_id").filter(F.trim("entity_id") != "").distinct()


def result_rows(entities: DataFrame, links: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, column): one row per entity (q), ids by falling score p, then id; '' without any."""
    listed = links.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("p"), "t"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["t"]), ",")
    return entities.join(listed, "q", "left").select(F.col("q").alias("source1_entity_id"), F.coalesce(joined, F.lit("")).alias(column))


def write_results(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Tab-separated with a header; with `by`, one folder per value, of which a rerun replaces only its own."""
    writer = rows.write.mode("overwrite").options(**TSV)
    if by:
        writer = writer.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    writer.csv(path)


def cached(df: DataFrame, path: str) -> DataFrame:
    """df through a Parquet copy, written if it is not there yet."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_chunks(rows: DataFrame, path: str, by: str) -> list:
    """Write rows in one folder per value of `by`, leaving out those that are there already; returns the values written.

    A value's folder appears whole or not at all, so a job that broke off goes
    on where it stopped.
    """
    spark, done = rows.sparkSession, []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for value in [r[0] for r in rows.select(by).distinct().orderBy(by).collect()]:
        where, part = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}{by}={value}") for name in ("", "_writing_"))
        files = where.getFileSystem(conf)
        if files.exists(where):
            continue
        rows.filter(F.col(by) == F.lit(value)).drop(by).write.mode("overwrite").options(**TSV).csv(part.toString())
        if not files.rename(part, where):
            raise OSError(f"cannot move {part.toString()}")
        done.append(value)
    return done


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_config(config: dict, path: str) -> None:
    """A small report or configuration as JSON, on the driver."""
    Path(path).write_text(json.dumps(config, indent=2, sort_keys=True), encoding="utf-8")


def load_config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def find_base(root: str, marker: str = "source_1.tsv") -> str | None:
    """The first folder under root, in order of depth, that holds the marker file."""
    found = sorted(Path(root).rglob(marker), key=lambda p: (len(p.parts), str(p)))
    return str(found[0].parent) if found else None
