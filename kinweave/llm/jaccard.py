"""Exact Jaccard join of documents over word n-grams, as a blocked sparse product.

Rows of the incidence matrix are documents (documents of equal sets share one
row), columns are hashed n-grams. A pair that meets the threshold must share
`depth` of the columns that come first in each row, if the rows agree on an
order of columns; with frequent columns last, almost no other pair does. Which
columns are held by one document alone is counted over all columns, in parts of
bounded size, and reaches the workers as a filter of bounded bits that lacks
none of the others; those columns come first and, since no pair shares them,
go no further. The order of the others comes from a count sketch, a fixed
number of counters. Both decide only the work, never the result.

- Columns held by few rows are expanded into pairs of rows of compatible size;
  the products are accumulated per pair, and pairs below the bound are dropped.
- Rows that have `depth` columns held by many rows, and so may share nothing but
  those, form crowds; other pairs share a rarer column, and what they share of
  frequent ones is counted once they have met there. A crowd is cut into
  blocks by size band and hash; blocks of compatible bands are multiplied in
  memory, and only edges that span the links found are returned, with the number
  of links of each row, so a group of copies never becomes a list of pairs. Any
  two rows of a crowd that may link meet in one product, so pairs within a crowd
  are left out of the other route.

What is left is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import LOWEST, OWN, HashFilter, components, drop, join_counted, local_roots, small_batches, stage, tidy, without

#: Parts that the sketch is merged in.
PARTS = 64
#: Columns that a task sorts at a time, columns of a part that are counted together, and bits by which a part tells columns apart.
RUN, TOGETHER, MARK_BITS = 1 << 22, 1 << 21, 28
#: Bits of the filter for a column; the most bits, and the fewest for a column before rarer columns are left out.
COLUMN_BITS, FILTER_BITS, TIGHT_BITS = 8, 1 << 29, 3
#: How many documents a column must be in to be left in, the first that makes the filter fit.
LEAST = (2, 3, 4, 8, 16, 32, 64, 128)


def _sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a batch."""
    values, first = tv.ngrams(tv.words(batch.column("text")), n)
    return tv.distinct(values, first)


def column_ranks(docs: DataFrame, n: int, slots: int) -> tuple[np.ndarray, int]:
    """Frequency class, one byte, of every slot hash(column) mod slots, and how many columns were counted.

    Columns are counted per slot, over all documents and wherever they stand in
    them, and the counts are merged part by part; only the classes reach the
    driver.
    """
    width = slots // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(slots, np.uint32), False
        for batch in batches:
            seen = True
            values, _ = tv.ngrams(tv.words(batch.column("text")), n)
            np.add.at(total, (values & tv.U(slots - 1)).astype(np.int64), np.uint32(1))
        if seen:
            packed = [pa.compress(total[p * width : (p + 1) * width].tobytes(), codec="zstd", asbytes=True) for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, np.uint64)
        for pdf in parts:
            for blob in pdf["counts"]:
                total += np.frombuffer(pa.decompress(blob, decompressed_size=4 * width, codec="zstd"), np.uint32)
        yield pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()], "total": [float(total.sum())]})

    parts = stage(docs.select("text").mapInArrow(tidy(count), "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary, total double"), "sketch")
    counted = parts.agg(F.sum("total")).first()[0] or 0.0
    usual = counted / slots

    def classes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["ranks"] = [column_rank(np.frombuffer(x, np.uint64), usual).tobytes() for x in pdf["counts"]]
            yield pdf[["part", "ranks"]]

    out = np.zeros((PARTS, width), np.uint8)
    for row in parts.mapInPandas(classes, "part int, ranks binary").toLocalIterator():
        out[row["part"]] = np.frombuffer(row["ranks"], np.uint8)
    drop(parts)
    return out.reshape(-1), int(counted)


def column_rank(counts: np.ndarray, usual: float) -> np.ndarray:
    """Frequency class of counts: 64 at the usual load, eight more per doubling.

    A column that is a little more frequent than others shows above the load
    of its slot only if classes are narrow, all the more on large tables.
    """
    return np.clip(np.floor(8 * np.log2(counts / max(1.0, usual) + 1e-9)) + 64, 0, 255).astype(np.uint8)


class SharedColumns:
    """Filter with two positions per column: it holds every column of at least `least` documents, and few others.

    A column's first bits name its part, the MARK_BITS that follow its mark
    there; a part has `width` bits.
    """

    def __init__(self, bits: np.ndarray, parts: int, width: int, least: int):
        self.bits, self.parts, self.width, self.least = bits, parts, width, least

    @staticmethod
    def keys(cols: np.ndarray, parts: int) -> np.ndarray:
        """Part and mark of columns, as one number in their order."""
        return cols >> tv.U(64 - MARK_BITS - (parts.bit_length() - 1))

    @staticmethod
    def positions(marks: np.ndarray, width: int, second: bool) -> np.ndarray:
        """The first or the second position of marks within a part."""
        marks = tv.mix(marks) >> tv.U(64 - MARK_BITS) if second else marks
        return (marks * tv.U(width) >> tv.U(MARK_BITS)).astype(np.int64)

    def holds(self, cols: np.ndarray) -> np.ndarray:
        """Which columns are in the filter."""
        keys = self.keys(cols, self.parts)
        marks, base = keys & tv.U((1 << MARK_BITS) - 1), (keys >> tv.U(MARK_BITS)).astype(np.int64) * self.width
        at = np.arange(len(cols))
        for second in (False, True):
            p = base[at] + self.positions(marks[at], self.width, second)
            at = at[(self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(cols), bool)
        out[at] = True
        return out


def _packed(values: np.ndarray, parts: int) -> pa.RecordBatch:
    """Columns of a run of documents, by part: sorted marks as differences, and how many documents hold each (255 at most)."""
    keys, counts = np.unique(SharedColumns.keys(values, parts), return_counts=True)
    marks, counts = (keys & tv.U((1 << MARK_BITS) - 1)).astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
    ends = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << tv.U(MARK_BITS))
    found = np.flatnonzero(np.diff(ends))
    blobs = []
    for p in found:
        steps = np.diff(marks[ends[p] : ends[p + 1]], prepend=np.uint32(0))
        planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes()  # bytes of one weight stand together, which compresses
        blobs.append(pa.compress(planes + counts[ends[p] : ends[p + 1]].tobytes(), codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.diff(ends)[found], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "size", "columns"])


def _unpacked(size: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=5 * size, codec="zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw[: 4 * size].reshape(4, size).T).view(np.uint32).reshape(-1), dtype=np.uint32), raw[4 * size :]


def shared_columns(docs: DataFrame, n: int, total: int, together: int = TOGETHER, most_bits: int = FILTER_BITS) -> SharedColumns:
    """The filter of columns held by at least two documents, of `total` columns or fewer.

    Runs of columns are sent to their parts sorted and compressed, and counted
    there whole; of a part only the bits of the filter reach the driver. If the
    filter would get fewer than TIGHT_BITS bits for a column, it holds columns of
    more documents only; its `least` says of how many.
    """
    parts = max(64, 1 << max(0, -(-total // together) - 1).bit_length())

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += _sets(batch, n)
            if sum(map(len, held)) >= RUN:
                yield _packed(np.concatenate(held), parts)
                held = []
        if held:
            yield _packed(np.concatenate(held), parts)

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = [_unpacked(k, x) for pdf in frames for k, x in zip(pdf["size"], pdf["columns"], strict=True)]
        marks, counts = (np.concatenate([x[i] for x in both]) for i in range(2))
        order = np.argsort(marks, kind="stable")
        marks, counts = marks[order], counts[order]
        first = np.flatnonzero(np.diff(marks, prepend=marks[0] + np.uint32(1)))
        counts = np.minimum(np.add.reduceat(counts, first, dtype=np.int64), 255)
        marks, counts = marks[first][counts > 1], counts[counts > 1]
        yield pd.DataFrame({"part": [key[0]], "marks": [marks.tobytes()], "counts": [counts.astype(np.uint8).tobytes()], "held": [[int((counts >= k).sum()) for k in LEAST]]})

    counted = docs.select("text").mapInArrow(tidy(runs), "part int, size int, columns binary").groupBy("part").applyInPandas(add, "part int, marks binary, counts binary, held array<long>")
    counted = stage(counted, "columns")
    held = [x or 0 for x in counted.agg(*[F.sum(F.col("held")[i]) for i in range(len(LEAST))]).first()]
    at = next((i for i, k in enumerate(held) if TIGHT_BITS * k <= most_bits), len(LEAST) - 1)
    least, width = LEAST[at], -(-max(1 << 20, min(most_bits, COLUMN_BITS * held[at])) // parts // 8) * 8

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for marks, counts in zip(pdf["marks"], pdf["counts"], strict=True):
                marks, on = np.frombuffer(marks, np.uint32)[np.frombuffer(counts, np.uint8) >= least].astype(np.uint64), np.zeros(width, bool)
                for second in (False, True):
                    on[SharedColumns.positions(marks, width, second)] = True
                made.append(np.packbits(on, bitorder="little").tobytes())
            yield pd.DataFrame({"part": pdf["part"], "bits": made})

    out = np.zeros(parts * width >> 3, np.uint8)
    for row in counted.select("part", "marks", "counts").mapInPandas(bits, "part int, bits binary").toLocalIterator():
        out[row["part"] * (width >> 3) : (row["part"] + 1) * (width >> 3)] = np.frombuffer(row["bits"], np.uint8)
    drop(counted)
    return SharedColumns(out, parts, width, least)


def _meets(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def product_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked sets: of `left` among themselves (i < j), or of `left` with `right`.

    A product of 0/1 rows in tiles: columns of a tile of `rows` sets that occur
    on the other side are numbered, overlaps are summed by matrix products over
    a bounded number of columns at a time.
    """
    other = left if right is None else right
    sizes, size2 = np.array([len(s) for s in left]), np.array([len(s) for s in other])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(left), rows):
        tile = left[lo : lo + rows]
        for lo2 in range(lo if right is None else 0, len(other), rows):
            tile2 = other[lo2 : lo2 + rows]
            a, b = sizes[lo : lo + rows][:, None], size2[lo2 : lo2 + rows][None, :]
            fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            if right is None:
                fits &= (lo + np.arange(len(tile)))[:, None] < (lo2 + np.arange(len(tile2)))[None, :]
            if not fits.any():
                continue
            common = np.intersect1d(np.concatenate(tile), np.concatenate(tile2))
            overlap = np.zeros(fits.shape, np.float32)
            for c in range(0, len(common), 4096):
                cols = common[c : c + 4096]
                overlap += _incidence(tile, cols) @ _incidence(tile2, cols).T
            i, j = np.nonzero(fits & _meets(overlap.astype(np.int64), a, b, percent))
            found.append((i + lo, j + lo2))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _incidence(sets: list[np.ndarray], cols: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(cols)), np.float32)
    for r, s in enumerate(sets):
        part = s[np.searchsorted(s, cols[0]) : np.searchsorted(s, cols[-1], "right")]
        at = np.searchsorted(cols, part)
        out[r, at[cols[at] == part]] = 1
    return out


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _marks(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    return tuple(int(tv.mix(x).sum(dtype=np.uint64).astype(np.int64)) for x in (s, s ^ tv.U(0xA5A5A5A5A5A5A5A5)))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, slots: int = 1 << 22, depth: int = 4, few: int = 48, block: int = 512, block_columns: int = 1 << 19) -> DataFrame:
    """docs with n_shingles, component_id and n_links.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lower-cased; a
    document's set holds its distinct n-word shingles, or with fewer words the
    whole sequence as one. Documents link when
    100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable by links, n_links counts the distinct other sets that the
    document's set links with.

    Null or empty texts have no shingles and stand alone; rows of equal sets are
    one row of the matrix. Rows that repeat a doc_id are told apart by their
    texts; null is a doc_id like others, and the smallest (as component_id it
    stays null). Sets are told apart by two 64-bit hashes, shingles by one;
    more than 60 rounds of connected components raise an error. `few`, `block`,
    `block_columns` and `slots` steer the work alone: none drops a link or
    changes a result. Columns of docs named like the added ones are replaced.
    """
    docs = without(docs, ("n_shingles", "component_id", "n_links"))
    spark = docs.sparkSession
    small_batches(spark)
    ranks, total = column_ranks(docs, n, slots)
    rank = spark.sparkContext.broadcast(ranks)
    common = spark.sparkContext.broadcast(shared_columns(docs, n, total))
    mask = tv.U(slots - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, several = rank.value, common.value
        for batch in batches:
            sets = _sets(batch, n)
            size, marks, heads = [], [], []
            held = np.split(several.holds(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1]) if sets else []
            for s, h in zip(sets, held, strict=True):
                size.append(len(s))
                marks.append(_marks(s))
                must = -(-percent * len(s) // 100)
                head = min(len(s), len(s) - must + depth)
                # columns that the filter lacks come first; if these are of one document alone, no pair shares them
                first = np.argsort(np.where(h, np.maximum(order[(s & mask).astype(np.int64)], 1), 0), kind="stable")[:head]
                heads.append(s[first[h[first]] if several.least == 2 else first].astype(np.int64))
            first = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(h) for h in heads], out=first[1:])
            head = pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
            marks = [pa.array([m[k] for m in marks], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(size, pa.int64()), *marks, head], names=["doc", "key", "n", "s1", "s2", "head"])

    own = (F.coalesce("doc_id", F.lit(LOWEST)).alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("key"))
    keyed = docs.select(*own, "text")
    matrix = stage(keyed.mapInArrow(tidy(rows), "doc long, key long, n long, s1 long, s2 long, head array<long>"), "matrix")
    for sent in (rank, common):
        sent.unpersist()
    # documents of equal sets are one row, which bears a number; the document of smallest doc_id stands for them
    solid = matrix.filter("n > 0")
    alike = solid.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc", "key", "head")).alias("m"), F.count("*").alias("copies"))
    reps = stage(alike.select(F.monotonically_increasing_id().alias("rep"), "m.doc", "m.key", "n", "s1", "s2", "copies", "m.head"), "reps")
    size = [x or 0 for x in reps.agg(F.sum(F.size("head")), F.sum("copies"), F.count("*")).first()]
    entries = reps.select("rep", "n", F.explode("head").alias("col"))
    held = entries.groupBy("col").agg(F.count("*").alias("held"), F.min("rep").alias("centre")).filter("held > 1")
    held = held.select("col", "held", F.when(F.col("held") > few, F.col("centre")).alias("centre"), F.col("held").alias("weight"))
    entries = stage(join_counted(entries, held, ["col"], "weight", size[0]), "entries", size[0])

    # k: how many columns of many rows a row has; such a pair, if less than `least` in either, shares other columns too
    must = lambda n: F.ceil(F.lit(percent) * n / 100)
    some = lambda has: F.collect_list(F.when(has, F.col("col")))
    lines = entries.groupBy("rep").agg(some(F.col("centre").isNull()).alias("light"), some(F.col("centre").isNotNull()).alias("cols"), F.min("n").alias("n")).withColumn("k", F.size("cols"))
    # the least that it may share with any row of compatible size
    lines = stage(lines.withColumn("full", F.col("k") >= F.least(F.lit(depth), must(must(F.col("n"))))), "lines")
    heavy = lines.filter("k > 0")
    full = heavy.filter("full").select("rep")
    together = components(entries.filter("centre is not null").join(full, "rep", "left_semi").groupBy("col").agg(F.min("rep").alias("centre")).join(entries.select("col", "rep"), "col").join(full, "rep", "left_semi").select("rep", "centre"), "rep", "centre", size[0])
    crowds = stage(together.select(F.col("node").alias("rep"), F.col("component").alias("crowd")), "crowds", size[2])
    drop(together, entries)
    # a row, not each of its columns, meets its crowd
    lists = lines.filter(F.size("light") > 0).join(crowds, "rep", "left").select("rep", "n", "k", "crowd", must(F.col("n")).cast("int").alias("must"), F.explode("light").alias("col"))
    lists = lists.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("n", "rep", "must", "k", "crowd"))).alias("r"))
    ordered = lists.select("r", F.posexplode("r").alias("i", "a"))
    ordered = ordered.select("a", F.explode(F.filter(F.expr("slice(r, i + 2, size(r))"), lambda b: (b["n"] * percent <= F.col("a.n") * 100) & ~F.coalesce(b["crowd"] == F.col("a.crowd"), F.lit(False)))).alias("b"))
    # rows of different crowds share no column of many rows; of others, no more than the fewer of either row
    beside = F.when(F.col("a.crowd").isNotNull() & F.col("b.crowd").isNotNull(), 0).otherwise(F.least("a.k", "b.k"))
    shared = ordered.groupBy(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least(F.lit(depth), "a.must", "b.must")).alias("least"), F.min(beside).alias("beside"))
    near = stage(shared.filter("shared + beside >= least"), "near")
    cols = heavy.select("rep", "cols")
    unsure = near.filter("shared < least").join(cols.withColumnsRenamed({"rep": "a", "cols": "ca"}), "a").join(cols.withColumnsRenamed({"rep": "b", "cols": "cb"}), "b")
    unsure = unsure.filter(F.col("shared") + F.size(F.array_intersect("ca", "cb")) >= F.col("least"))
    pairs = stage(near.filter("shared >= least").select("a", "b").union(unsure.select("a", "b")), "pairs")
    drop(lines, near)

    # whole sets of the rows that are left; only texts that may be among them move
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(crowds.select("rep")).distinct()
    wanted = stage(reps.join(wanted, "rep", "left_semi").select("rep", "doc", "key", "n", "s1", "s2"), "wanted", size[2])
    here = wanted.select(F.xxhash64("doc", "key").alias("hash")).distinct()
    may = spark.sparkContext.broadcast(HashFilter.of(here, here.count()))

    @F.pandas_udf("boolean")
    def chosen(hashes: pd.Series) -> pd.Series:
        out = np.zeros(len(hashes), bool)
        out[may.value.places(hashes.to_numpy(np.int64).view(np.uint64))] = True
        return pd.Series(out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch, n)
            right = [i for i, (s, *m) in enumerate(zip(sets, batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)) if _marks(s) == tuple(m)]
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())], names=["rep", "set"])

    texts = keyed.filter(F.col("text").isNotNull() & chosen(F.xxhash64("doc", "key"))).join(wanted, ["doc", "key"]).select("rep", "s1", "s2", "text")
    sets = stage(texts.mapInArrow(tidy(whole), "rep long, set binary").dropDuplicates(["rep"]), "sets")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = _unpack(x), _unpack(y)
            inter = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * inter >= percent * (len(x) + len(y) - inter))
        return pd.Series(out, dtype=bool)

    one = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    links = pairs.join(one, "a").join(two, "b").filter(linked("sa", "sb")).select("a", "b", F.lit(1).cast("long").alias("n_links"))

    # crowds: bands of size, blocks in a band, and products of blocks that may hold links
    width = -math.log(percent / 100) * 1.001 if percent < 100 else 1e-9
    banded = wanted.select("rep", "n").join(crowds, "rep").select("rep", "n", "crowd", F.floor(F.log(F.col("n").cast("double")) / width).alias("band"))
    banded = stage(banded, "bands", size[2])
    per = banded.groupBy("crowd", "band").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_columns)).cast("int").alias("blocks"), F.count("*").alias("weight"))
    above = per.select("crowd", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = per.select("crowd", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    per = per.join(above, ["crowd", "band"], "left").join(below, ["crowd", "band"], "left").na.fill(0)
    placed = join_counted(banded, per, ["crowd", "band"], "weight", banded.count()).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a task is (crowd, band, block, other band, other block); each row goes to the tasks of its block
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(span(F.col("blocks")), lambda o: F.struct(F.col("band").alias("x"), F.least("mine", o).alias("i"), F.col("band").alias("y"), F.greatest("mine", o).alias("j"), (F.col("mine") > o).alias("second")))
    up = F.transform(span(F.col("above")), lambda o: F.struct(F.col("band").alias("x"), F.col("mine").alias("i"), (F.col("band") + 1).alias("y"), o.alias("j"), F.lit(False).alias("second")))
    down = F.transform(span(F.col("below")), lambda o: F.struct((F.col("band") - 1).alias("x"), o.alias("i"), F.col("band").alias("y"), F.col("mine").alias("j"), F.lit(True).alias("second")))
    tasks = placed.select("crowd", "rep", F.explode(F.concat(within, up, down)).alias("t")).select("crowd", "rep", "t.*")
    tasks = tasks.join(sets, "rep")

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == key[3] and key[2] == key[4]
        second = pdf["second"].to_numpy()
        names, blobs = pdf["rep"].to_numpy(), [_unpack(x) for x in pdf["set"]]
        if same:
            i, j = product_links(blobs, None, percent)
        else:
            order = np.argsort(second, kind="stable")
            names, left = names[order], int((~second).sum())
            blobs = [blobs[k] for k in order]
            i, j = product_links(blobs[:left], blobs[left:], percent) if 0 < left < len(blobs) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            j = j + left
        # links become edges to the smallest row reached, which count none; rows (x, x) hold the number of x's links here
        each = np.bincount(np.concatenate([i, j]), minlength=len(names))
        some = np.flatnonzero(each)
        nodes, roots = local_roots(i, j) if len(i) else (i, j)
        far = nodes != roots
        a, b = np.concatenate([names[nodes[far]], names[some]]), np.concatenate([names[roots[far]], names[some]])
        return pd.DataFrame({"a": a, "b": b, "n_links": np.concatenate([np.zeros(int(far.sum()), np.int64), each[some]])}, dtype="int64")

    spans = tasks.groupBy("crowd", "x", "i", "y", "j").applyInPandas(multiply, "a long, b long, n_links long")
    edges = stage(links.unionByName(spans), "links")
    drop(pairs, wanted, sets, crowds, banded)
    found = components(edges.filter("a <> b"))
    joined = stage(found, "joined", size[2])
    drop(found)
    degree = edges.select("a", "n_links").union(edges.filter("a <> b").select("b", "n_links")).groupBy("a").agg(F.sum("n_links").alias("n_links"))
    # components take the smallest doc_id of their documents
    members = joined.withColumnRenamed("node", "rep").join(reps.select("rep", "doc"), "rep")
    least = members.groupBy("component").agg(F.min("doc").alias("least"), F.count("*").alias("weight"))
    named = join_counted(members, least, ["component"], "weight", joined.count()).select("rep", "least")
    named = reps.join(named, "rep", "left").join(degree.withColumnRenamed("a", "rep"), "rep", "left")
    named = named.select("n", "s1", "s2", F.coalesce("least", "doc").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies")
    classes = join_counted(solid.select("doc", "key", "n", "s1", "s2"), named, ["n", "s1", "s2"], "copies", size[1]).select(F.col("doc").alias(f"{OWN}d"), F.col("key").alias(f"{OWN}k"), F.col("n").alias(f"{OWN}n"), F.col("component_id").alias(f"{OWN}c"), F.col("n_links").alias(f"{OWN}l"))
    # equal rows of docs have equal classes
    classes = stage(classes.groupBy(f"{OWN}d", f"{OWN}k").agg(*[F.min(f"{OWN}{c}").alias(f"{OWN}{c}") for c in "ncl"]), "classes", size[1])
    drop(matrix, reps, edges, joined)
    out = docs.withColumns({f"{OWN}d": own[0], f"{OWN}k": own[1]}).join(classes, [f"{OWN}d", f"{OWN}k"], "left")
    component = F.coalesce(f"{OWN}c", f"{OWN}d")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(f"{OWN}n", F.lit(0)).cast("long").alias("n_shingles"), F.when((component != LOWEST) | F.col("doc_id").isNotNull() & F.col(f"{OWN}c").isNull(), component).alias("component_id"), F.coalesce(f"{OWN}l", F.lit(0)).cast("long").alias("n_links"))
