"""Places that every executor can reach, and steps that several operators share."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of columns that operators add for their own use.
OWN = "__kw_"
LOWEST = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where the setting is absent and Spark runs in one process is a folder
    of this machine taken instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"kinweave-{os.getpid()}")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Let at most so many texts, and about so many bytes, go to Python workers at a time, unless the session sets its own numbers.

    Spark's defaults are 10,000 rows and 64 MB, held several times over on
    their way. The settings stay with the session, since results are evaluated
    later.
    """
    for key, usual, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", f"{size}b")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)


def released(keep: str = "") -> None:
    """Give back what a worker has freed, and what other operators' tasks left for reuse: workers outlive a task, and their memory adds up.

    `keep` names a module whose tables stay.
    """
    for name, tables in (("kinweave.llm.tokens", "encoder"),):
        if name != keep and name in sys.modules:
            getattr(sys.modules[name], tables).cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def tidy(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """A task's generator that releases memory before it begins and when all that it held is gone."""

    def outer(batches: Iterator) -> Iterator:
        released(keep)
        yield from run(batches)
        released(keep)

    return outer


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def until_exit(spark: SparkSession, path: str) -> None:
    """Let a path that was written go when the application ends."""
    where, files = _place(spark, path)
    files.deleteOnExit(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    where, files = _place(spark, path)
    files.delete(where, True)


#: Rows of a file of a narrow table, and tasks that write even a small one.
FILE_ROWS, LEAST_FILES = 1 << 18, 8
#: Spark then deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there.

    Where it is known that a table is narrow and has no more than `rows` rows,
    it is written as files of FILE_ROWS, not as one for every partition.
    Results are evaluated after an operator has returned, so the copy stays
    until the application ends, or until `drop` is called with it.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    usual = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    except BaseException:
        remove(spark, path)
        raise
    finally:
        spark.conf.set(SHUFFLES_GO, usual)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete copies that `stage` made and nothing reads any more."""
    for df in staged:
        remove(df.sparkSession, df._kinweave_path)


def text_key(doc_id: str, text: str) -> Column:
    """128 bits for a row's id and text; ids and texts that are null count as such."""
    absent = F.concat(F.when(F.col(doc_id).isNull(), "n").otherwise("i"), F.when(F.col(text).isNull(), "n").otherwise("t"))
    return F.unhex(F.md5(F.concat(absent, F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def without(df: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """df without the columns that an operator is about to add under these names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Bits of a filter: 16 for each hash, within these bounds (128 KB and 64 MB), made and shipped in parts of 64 KB.
LEAST_BITS, MOST_BITS, PART_BITS = 1 << 20, 1 << 29, 1 << 19


class HashFilter:
    """Bloom filter with two positions per 64-bit hash."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def _has(self, p: np.ndarray) -> np.ndarray:
        p = (p & self.mask).astype(np.int64)
        return (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where hashes are that may be in the filter."""
        at = np.flatnonzero(self._has(hashes))
        return at[self._has(hashes[at] >> np.uint64(32))]

    @classmethod
    def of(cls, hashes: DataFrame, count: int) -> HashFilter:
        """The filter of a table of distinct hashes; each of its parts is made by one task."""
        bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, count)).bit_length())))

        def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column("hash").to_numpy().view(np.uint64)
                at = np.concatenate([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at // PART_BITS).astype(np.int32)), pa.array((at % PART_BITS).astype(np.int32))], names=["part", "at"])

        def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            on = np.zeros(PART_BITS, bool)
            on[pdf["at"].to_numpy()] = True
            return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

        out = np.zeros(bits >> 3, np.uint8)
        for row in hashes.select("hash").mapInArrow(positions, "part int, at int").groupBy("part").applyInPandas(fold, "part int, bits binary").toLocalIterator():
            out[row["part"] * (PART_BITS >> 3) : (row["part"] + 1) * (PART_BITS >> 3)] = np.frombuffer(row["bits"], np.uint8)
        return cls(out)


#: A table of so many rows may be joined on a key that all of them bear.
FEW_ROWS = 1 << 18


def join_counted(big: DataFrame, small: DataFrame, on: list[str], weight: str, total: int, hubs: int = 1000) -> DataFrame:
    """big inner joined with small, which has one row per key and in `weight` how many of big's rows (`total` at most) bear it.

    Keys of more than a share 1 / hubs of `total`, of which there are fewer than
    `hubs`, are broadcast, so their rows stay where they are; the others meet by
    hash. A big of few rows is joined as it is. `weight` is not returned.
    """
    if total <= FEW_ROWS:
        return big.join(small.drop(weight), on)
    cut = total // hubs
    hot = F.broadcast(small.filter(F.col(weight) > cut).drop(weight))
    usual = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.filter(F.col(weight) <= cut).drop(weight), on)
    return big.join(hot, on).unionByName(usual)


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the graph (a, b), and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (x, y):
            np.minimum.at(root, root[side], low)
        root = root[root]
        if (root == before).all() and (root[x] == root[y]).all():
            return nodes, nodes[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the smallest of its component, among the edges of a part of the table."""

    def fold(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, root = local_roots(*(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("u", "v")))
        far = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(p.num_rows for p in held) > 1 << 19:
            held = [fold(held)]
            if held[0].num_rows > 1 << 18:
                yield held.pop()
    if held:
        yield fold(held)


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """Connected components of long-typed edges, at most `rows` if that is known, as (node, component) with the smallest node as component.

    Every part of the table is folded into stars first; then large-star and
    small-star steps alternate until no edge changes, which takes a number of
    rounds that grows with the logarithm of the longest path (more than 60
    raise an error; none is lost). A step is a minimum per node, combined before
    the shuffle, and a join of edges with it in which nodes of many edges stay
    spread out; every round is written to the shared folder and the one before
    it removed. `drop` of the result removes the last.
    """
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").mapInArrow(_stars, "u long, v long").distinct(), "components", rows)
    before = None
    for _ in range(60):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
            out._kinweave_path = e._kinweave_path
            return out
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both, low, ["u"], "n", 2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = join_counted(large, low, ["u"], "n", 2 * now[0]).select(F.col("v").alias("x"), "m", "u")
        small = met.select(F.col("x").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stage(small, "components", 2 * now[0])
        drop(e)
        e, before = after, now
    raise RuntimeError("components did not settle")
