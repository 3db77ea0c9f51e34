"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches, from the largest doc_ids down. A run is a table
bucketed and sorted by the 128-bit hash of a line's key; a batch's own hashes
are merge-joined with the runs of every level without moving the runs: hashes
that no run knows (the anti-join) enter with the document that keeps the line,
the others only add to the number of documents. The batch's run joins level 0;
as soon as a level holds `fanout` runs, they are merged into one of the next.
At the end the levels are merged once more and give the repeated lines.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWEST, OWN, join_counted, released, small_batches, stage, without

BLANK = " \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_ADDED = ("n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class LineRuns:
    """Levels of sorted runs (h1, h2, n, top): n documents hold the line; top, the keeper, is set in one run only."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, max(2, fanout)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.name = f"kinweave_run_{uuid.uuid4().hex}"
        self.made, self.tables = 0, []

    def _write(self, df: DataFrame, level: int) -> None:
        self.made += 1
        name = f"{self.name}_{self.made}"
        self.tables.append(name)
        df.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """Merge runs pairwise; both sides are sorted and bucketed alike, so nothing is exchanged."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("h1", "h2", F.col("n").alias("n2"), F.col("top").alias("top2"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            return a.join(b, ["h1", "h2"], "full").select("h1", "h2", n.alias("n"), F.coalesce("top", "top2").alias("top"))

        return reduce(two, [self.spark.table(x) for x in names])

    def _drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")
            self.tables.remove(x)

    def close(self) -> None:
        """Drop the runs that are left, as after a failure."""
        self._drop([*self.tables])

    def add(self, keys: DataFrame) -> None:
        """Add a batch: (doc, h1, h2) with each line hash once per document."""
        new = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("top"))
        for name in [x for level in self.levels for x in level]:
            run = self.spark.table(name).filter("top is not null").select("h1", "h2", F.lit(True).alias("known"))
            new = new.join(run, ["h1", "h2"], "left").select("h1", "h2", "n", F.when(F.col("known").isNull(), F.col("top")).alias("top"))
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._write(self._merged(names), level + 1)
            self._drop(names)
            level += 1

    def finish(self, least: int) -> DataFrame:
        """(h1, h2, top, n) of lines in at least so many documents, n of them."""
        names = [x for level in self.levels for x in level]
        return stage(self._merged(names).filter(F.col("n") >= least).select("h1", "h2", "top", "n"), "lines")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with repeated lines removed from text, and n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.
    Keys of at least min_chars code points in at least min_docs documents lose
    all their lines except in the largest doc_id that holds them.

    Each row is a document; rows that share a doc_id are kept or lose lines
    alike, and a null doc_id counts as the smallest. A null text has one empty
    line and stays null. Columns of docs named like the added ones are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, _ADDED).withColumn(f"{OWN}d", F.coalesce("doc_id", F.lit(LOWEST)))
    lines = F.split(F.col("text"), "\n", -1)
    hashed = F.transform(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars), lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2")))
    keys = docs.select(F.col(f"{OWN}d").alias("doc"), F.explode(F.array_distinct(hashed)).alias("k")).select("doc", "k.h1", "k.h2")
    keys = stage(keys, "linekeys")
    cuts = docs.agg(F.percentile_approx(f"{OWN}d", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    runs, above = LineRuns(spark, fanout), None
    try:
        for cut in [*sorted(set(cuts), reverse=True), None]:
            part = keys if cut is None else keys.filter(F.col("doc") > cut)
            runs.add(part if above is None else part.filter(F.col("doc") <= above))
            above = cut
        often = runs.finish(min_docs)
    finally:
        runs.close()
    gone = join_counted(keys, often, ["h1", "h2"], "n", keys.count()).filter("doc <> top").groupBy("doc").agg(F.collect_set("h1").alias(f"{OWN}gone"))

    @F.pandas_udf("text string, n int")
    def rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in parts:
            rows = []
            for text, drop in zip(texts, gone, strict=True):
                if text is None or drop is None:
                    rows.append((None, 0))
                    continue
                drop, kept, n = set(drop.tolist()), [], 0
                for line in text.split("\n"):
                    key = line.strip(BLANK)
                    if len(key) >= min_chars and _signed(xxhash.xxh64_intdigest(key.encode().translate(_LOWER), seed=42)) in drop:
                        n += 1
                    else:
                        kept.append(line)
                rows.append(("\n".join(kept), n))
            yield pd.DataFrame(rows, columns=["text", "n"])
        released()

    out = docs.join(gone, F.col(f"{OWN}d") == F.col("doc"), "left")
    out = out.withColumn(f"{OWN}new", rewrite(F.when(F.col(f"{OWN}gone").isNotNull(), F.col("text")), F.col(f"{OWN}gone")))
    changed = F.col(f"{OWN}new.n") > 0
    out = out.withColumns({"n_lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"), "n_dropped": F.coalesce(f"{OWN}new.n", F.lit(0)).cast("long")})
    return out.withColumn("text", F.when(changed, F.col(f"{OWN}new.text")).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith(OWN)], *_ADDED)
