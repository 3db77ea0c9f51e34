from collections import defaultdict

import numpy as np
import pytest

from kinweave.llm import forest


@pytest.mark.parametrize("n", [3000, 5000, 8192])
def test_recall_of_the_defaults_in_one_segment(spark, n):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in forest.search(df, df.filter("vec_id % 20 = 0")).collect():
        found[r["query_id"]].add(r["vec_id"])
    recall = [len(found[q] & set(forest.exact(x, np.arange(n), x[q], q, 20).tolist())) / 20 for q in range(0, n, 20)]
    print(n, "recall", np.mean(recall))
    assert np.mean(recall) >= 0.93


def clustered(rng, n, dim=32, centres=400):
    c = rng.standard_normal((centres, dim))
    return c[rng.integers(0, centres, n)] + 0.15 * rng.standard_normal((n, dim))


def test_clusters_are_found_with_little_work(spark):
    """Vectors in clusters, over several ranges: the measured plan visits few of them and offers few of their rows."""
    x, plan = clustered(np.random.default_rng(1), 20_000), []
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in forest.search(df, df.filter("vec_id % 50 = 0"), segment_rows=1000, plan=plan).collect():
        found[r["query_id"]].add(r["vec_id"])
    recall = [len(found[q] & set(forest.exact(x, np.arange(len(x)), x[q], q, 20).tolist())) / 20 for q in range(0, len(x), 50)]
    print("clusters", np.mean(recall), plan)
    assert len(plan[0].bounds) > 10 and np.mean(recall) >= 0.9


def test_equal_vectors_tie_by_id(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((7, 24))
    x = base[rng.integers(0, 7, 900)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for r in sorted(forest.search(df, df.filter("vec_id % 30 = 0"), k=5).collect(), key=lambda r: r["rank"]):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    for q, hits in out.items():
        assert len(hits) == 5 and hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        assert [h for h, _ in hits] == np.lexsort((np.arange(900), -score))[:5].tolist()
