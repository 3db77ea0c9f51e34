import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import shared


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_counted_join_equals_a_plain_one(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW_ROWS", few)
    rng = random.Random(3)
    keys = [0] * 300 + [1] * 200 + [rng.randrange(2, 400) for _ in range(700)]
    big = spark.createDataFrame([(k, k % 7, i) for i, k in enumerate(keys)], "k int, m int, i int")
    small = big.filter("k % 5 <> 3").groupBy("k", "m").agg(F.count("*").alias("w"), F.max("i").alias("top"))
    out = shared.join_counted(big, small, ["k", "m"], "w", len(keys), hubs=20)
    assert out.columns == ["k", "m", "i", "top"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, big.join(small.drop("w"), ["k", "m"]).collect()))


def brute_components(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        parent[max(p, q)] = min(p, q)
    return {x: top(x) for x in parent}


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_hubs_chains_and_trees(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW_ROWS", few)
    rng = random.Random(1)
    edges = [(5000, i) for i in range(200)] + [(i, i + 1) for i in range(6000, 6100)] + [(9000 + i, 9000 + i // 2) for i in range(1, 60)]
    edges += [(rng.randrange(20_000, 20_080), rng.randrange(20_000, 20_080)) for _ in range(60)]
    edges += [(i, i - 100) for i in range(30_000, 31_000, 100)] + [(150, 6050), (7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    wanted = {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}
    for rows in (None, len(edges)):
        out = {r["node"]: r["component"] for r in shared.components(df, rows=rows).collect()}
        assert out == wanted
    assert shared.components(df.limit(0)).count() == 0


def test_local_roots():
    nodes, roots = shared.local_roots(np.array([5, 9, 2, 7]), np.array([9, 2, 11, 8]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {2: 2, 5: 2, 9: 2, 11: 2, 7: 7, 8: 7}


def test_filters_hold_what_they_were_made_of(spark):
    rng = np.random.default_rng(2)
    held, others = (rng.integers(-(1 << 63), 1 << 63, 50_000, dtype=np.int64) for _ in range(2))
    f = shared.HashFilter.of(spark.createDataFrame([(int(x),) for x in held], "hash long"), len(held))
    assert len(f.places(held.view(np.uint64))) == len(held)
    assert len(f.places(others.view(np.uint64))) < 0.02 * len(others)


def test_stages_write_few_files(spark):
    df = spark.range(0, 4000, 1, 100)
    out = shared.stage(df, "narrow", rows=4000)
    assert len(out.inputFiles()) <= shared.LEAST_FILES and out.count() == 4000
    assert sorted(r["id"] for r in out.collect()) == list(range(4000))


def test_a_tidy_task_gives_what_its_generator_gives():
    assert list(shared.tidy(lambda xs: (x + 1 for x in xs))([1, 2])) == [2, 3]
