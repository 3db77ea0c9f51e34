"""Audits of sources and ground truth, and validation of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("entity_id", "business_name", "business_address", "country")
HEADERS = {"matched_entity_ids": "matching", "candidate_entity_ids": "candidate"}


def audit_source(records: DataFrame, prefix: str | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """Rows, distinct and repeated ids, wrong prefixes, missing values per field: one row, or one per group of the columns `per`. Repeated counts ids, not rows.

    The right prefix is given, or is `S<src>-` of the row's own src.
    """
    missing = [F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "").alias(f"m_{c}") for c in FIELDS]
    head = F.lit(prefix) if prefix is not None else F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"))
    by_id = records.groupBy(*per, "entity_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("entity_id"), F.lit("")).startswith(head)).alias("bad"), *missing)
    return by_id.groupBy(*per).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_ids"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad_prefix"), *[F.coalesce(F.sum(f"m_{c}"), F.lit(0)).alias(f"missing_{c}") for c in FIELDS],
    )


def first_examples(rows: DataFrame, by: str, x: str, most: int = 5) -> DataFrame:
    """(by, n, examples): rows of each group and the first few distinct values in order.

    Values are made distinct and ranked under a window group limit, so only
    `most` of each task meet, however many there are.
    """
    counts = rows.groupBy(by, x).agg(F.count("*").alias("n"))
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(x))).filter(F.col("r") <= most)
    listed = first.groupBy(by).agg(F.sort_array(F.collect_list(x)).alias("examples"))
    return counts.groupBy(by).agg(F.sum("n").alias("n")).join(listed, by).select(by, "n", "examples")


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def audit_truth(truth: DataFrame) -> DataFrame:
    """One row over (source1_entity_id, ids array): sizes, empties, inner repeats, distinct matches per source, and where matches come from."""
    size, s2, s3 = F.size("ids"), F.exists("ids", lambda x: x.startswith("S2-")), F.exists("ids", lambda x: x.startswith("S3-"))
    rows = truth.agg(
        F.count("*").alias("n_rows"), F.count_distinct("source1_entity_id").alias("n_ids"), F.count_if(size == 0).alias("n_empty"), F.count_if(size != F.size(F.array_distinct("ids"))).alias("n_inner_repeats"),
        F.count_if(s2 & s3).alias("in_both"), F.count_if(s2 & ~s3).alias("s2_only"), F.count_if(~s2 & s3).alias("s3_only"), F.count_if(~s2 & ~s3).alias("in_none"), F.max(size).alias("most_matches"),
    )
    ids = truth.select(F.explode("ids").alias("id")).distinct()
    kinds = ids.agg(F.count_if(F.col("id").startswith("S2-")).alias("n_s2"), F.count_if(F.col("id").startswith("S3-")).alias("n_s3"), F.count_if(~F.col("id").rlike("^S[23]-")).alias("n_other"))
    return rows.crossJoin(F.broadcast(kinds))


def cardinality(truth: DataFrame) -> DataFrame:
    return truth.groupBy(F.size("ids").alias("matches")).agg(F.count("*").alias("n"))


def cross_reference(truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, n_missing, n_unmatched): truth ids that a source lacks, and source rows that no truth names."""
    named = truth.select(F.explode("ids").alias("entity_id")).distinct()
    pieces = []
    for name, own, ids in (("S1", s1, truth.select(F.col("source1_entity_id").alias("entity_id")).distinct()), *((s, targets.filter(F.col("entity_id").startswith(f"{s}-")), named.filter(F.col("entity_id").startswith(f"{s}-"))) for s in ("S2", "S3"))):
        here = own.select("entity_id").distinct().withColumn("a", F.lit(1))
        both = here.join(ids.withColumn("b", F.lit(1)), "entity_id", "full")
        pieces.append(both.agg(F.lit(name).alias("source"), F.count_if(F.col("a").isNull()).alias("n_missing"), F.count_if(F.col("b").isNull()).alias("n_unmatched")))
    return pieces[0].unionByName(pieces[1]).unionByName(pieces[2])


def parse_result_file(lines: DataFrame) -> DataFrame:
    """Non-blank lines (value) of a result file, without its header, as (entity, ids, has_tab). Ids are split at commas, not trimmed; an empty list has none."""
    tab = F.instr("value", "\t")
    listed = F.when(tab > 0, F.expr("substring(value, instr(value, '\t') + 1)")).otherwise("")
    ids = F.when(F.trim(listed) == "", F.array().cast("array<string>")).otherwise(F.split(listed, ",", -1))
    return lines.filter(F.trim(F.regexp_replace("value", r"[\t\r]", " ")) != "").select(F.when(tab > 0, F.expr("substring(value, 1, instr(value, '\t') - 1)")).otherwise(F.col("value")).alias("entity"), ids.alias("ids"), (tab > 0).alias("has_tab"))


def check_header(line: str | None, column: str) -> str | None:
    """What is wrong with a header line, or None."""
    if line is None or not line.strip():
        return "file is empty"
    wanted = f"source1_entity_id\t{column}"
    got = line.strip("\r\n").strip().lower()
    if got != wanted and "," in got and "\t" not in got:
        return "file is comma-separated, not tab-separated"
    return None if got == wanted else f"header is {got!r}, not {wanted!r}"


def violations(parsed: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, n, examples) of every rule that parsed rows (entity, ids, has_tab) break.

    required (entity_id) lists the S1 ids that must each have one row; known
    (entity_id), if given, lists all valid ids.
    """
    # one pass over the file gives every rule that looks at a row alone
    tab, i = F.col("has_tab"), lambda c: F.filter("ids", c)
    of_row = lambda rule, when: F.when(when, F.array(F.struct(F.lit(rule).alias("rule"), F.col("entity").alias("x"))))
    of_ids = lambda rule, c: F.when(tab, F.transform(i(c), lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("x"))))
    found = [of_row("no tab", ~tab), of_row("repeated id in a list", tab & (F.size("ids") != F.size(F.array_distinct("ids")))), of_ids("self match", lambda x: x.startswith("S1-")), of_ids("wrong prefix", lambda x: ~x.rlike("^S[123]-"))]
    out = parsed.select(F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("f")).select("f.rule", "f.x")
    # another compares the rows with the entities that must be there
    sides = parsed.filter(tab).select("entity", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(required.select("entity_id", F.lit(0), F.lit(1)))
    rows = sides.groupBy("entity").agg(F.sum("a").alias("a"), F.max("b").alias("b"))
    per_row = F.array_compact(F.array(F.when(F.col("a") > 1, F.struct(F.lit("repeated row").alias("rule"), F.lit(1).alias("n"))), F.when(F.col("a") == 0, F.struct(F.lit("missing row").alias("rule"), F.lit(1).alias("n"))), F.when(F.col("b") == 0, F.struct(F.lit("extra row").alias("rule"), F.col("a").cast("int").alias("n")))))
    out = out.unionAll(rows.select(F.explode(per_row).alias("f"), "entity").select(F.col("f.rule").alias("rule"), F.explode(F.sequence(F.lit(1), "f.n")).alias("i"), "entity").select("rule", F.col("entity").alias("x")))
    if known is not None:
        ids = parsed.filter(tab).select(F.explode("ids").alias("id")).filter(F.col("id").rlike("^S[23]-"))
        out = out.unionAll(ids.join(known.select("entity_id"), F.col("id") == F.col("entity_id"), "left_anti").select(F.lit("unknown id"), "id"))
    return first_examples(out, "rule", "x")


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(entity, id) of matches that are not among the candidates: a warning, or an error where results are checked before writing."""
    pairs = lambda df: df.select("entity", F.explode("ids").alias("id"))
    return pairs(matches).join(pairs(candidates), ["entity", "id"], "left_anti")


def submission_summary(entities: DataFrame, predicted: DataFrame) -> DataFrame:
    """(country, n, mean_matches, no_match_percent)."""
    n = entities.join(predicted.groupBy("q").agg(F.count("*").alias("m")), "q", "left").na.fill(0, ["m"])
    return n.groupBy("country").agg(F.count("*").alias("n"), F.avg("m").alias("mean_matches"), (F.avg((F.col("m") == 0).cast("double")) * 100).alias("no_match_percent"))
