import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import linededup, sharding

SF = "/root/testdata/sf0.01"


def place(spark, rows, schema="doc_id long, text string", **options):
    return sharding.histogram_sort(spark.createDataFrame(rows, schema), **options).collect()


def test_bucket_of_orders_pairs():
    bh, bd = np.array([3, 5, 5, 5, 9]), np.array([sharding.LOW, sharding.LOW, 4, 8, sharding.LOW])
    h, d = np.array([2, 3, 5, 5, 5, 5, 10]), np.array([0, 0, 3, 4, 7, 9, 0])
    assert sharding.bucket_of(h, d, bh, bd).tolist() == [0, 1, 2, 3, 3, 4, 5]


def test_shards_are_near_equal_and_slots_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for task_bytes in (256 << 20, 20_000):
        rows = sharding.histogram_sort(docs, task_bytes=task_bytes).select("doc_id", "size", "shard", "slot").toPandas()
        assert len(rows) == 1000 and set(rows["shard"]) == set(range(24))
        total = rows.groupby("shard")["size"].sum()
        assert total.max() - total.min() < 2 * rows["size"].max()
        for _, g in rows.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g)))


def test_groups_stay_together_unless_too_large(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, "copy") for i in range(5)] + [(2000 + i, "hot copy of many") for i in range(300)]
    out = place(spark, rows, shards=6)
    by = defaultdict(set)
    total = defaultdict(int)
    for r in out:
        by[r["text"]].add(r["shard"])
        total[r["shard"]] += r["size"]
    assert len(by["copy"]) == 1 and len(by["hot copy of many"]) > 1
    assert max(total.values()) / min(total.values()) < 1.2


def test_sharding_edge_cases(spark):
    assert place(spark, []) == []
    rows = [(None, None, 1), (1, None, 1), (1, "", 2), (1, "", 2), (2, "x" * 50_000, 3)]
    out = place(spark, rows, "doc_id long, text string, SIZE int", shards=3)
    assert len(out) == 5 and sorted(r["size"] for r in out) == [8, 8, 8, 8, 50_008]
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def brute_lines(rows, least=20, docs=3):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blank))
    held = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                held[k].append(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and max(held[key(x)]) != doc)]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_equal_brute_force(spark, batches, fanout):
    common = ["  A line that many hold, é\t", "a line that many hold, É", "another line of twenty chars", "short", "x" * 5000, ""]
    rng = np.random.default_rng(3)
    rows = [(int(i), "\n".join(rng.choice([*common, f"own line of document {i}"], rng.integers(0, 9)))) for i in rng.permutation(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_lines int")
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in linededup.dedup_lines(docs, batches=batches, fanout=fanout).collect()}
    assert out == brute_lines(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("kinweave_run")]


def test_lines_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(empty).count() == 0
    line = "one and the same line of text"
    rows = [(None, line), (None, line), (1, line), (5, f"{line}\n{line}")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_dropped").collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in out) == [(0, 1), (0, 1), (1, 1), (5, 0)]
    kept = F.sha2(F.lit("").cast("binary"), 256)
    assert spark.range(1).select(kept).first()[0] == hashlib.sha256(b"").hexdigest()
