import os
import random

import numpy as np

from kinweave.llm.jaccard import column_rank, jaccard_components
from kinweave.llm.shared import shared_dir, stage


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith((".data", ".parquet")))


def test_shuffle_files_go_with_their_stage(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    before = sum(_bytes(d) for d in local)
    out = stage(spark.range(200_000).selectExpr("id", "hash(id) as h").repartition(4, "h"), "shuffled")
    assert out.count() == 200_000
    assert sum(_bytes(d) for d in local) - before < 100_000


def test_only_classes_outlive_the_join(spark):
    draw = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(draw.choice("abcdefghij") for _ in range(12))) for i in range(60)], "doc_id long, text string")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    jaccard_components(docs, n=2, percent=60)
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["classes"]


def test_columns_a_little_above_the_load_rank_later():
    counts = np.array([400, 480, 600, 900], np.uint64)
    assert (np.diff(column_rank(counts, 400.0).astype(int)) > 0).all()


def test_rows_with_some_columns_of_many_rows_link_as_by_brute_force(spark):
    draw = random.Random(11)
    common = [f"c{i} c{i}x" for i in range(6)]
    texts = []
    for i in range(90):
        words = [draw.choice(common) for _ in range(draw.randint(0, 4))] + [f"w{draw.randint(0, 40)}" for _ in range(draw.randint(1, 6))]
        texts.append(" ".join(words))
        if i % 3 == 0:
            texts.append(" ".join([*words, f"w{i}"]))
    for percent in (50, 80):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_components(docs, n=1, percent=percent, few=3, block=8).collect()}
        sets = [frozenset(t.split()) for t in texts]
        links = lambda i, j: 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])  # noqa: B023, E731
        root = list(range(len(sets)))
        for _ in root:
            low = [min(root[j] for j in range(len(sets)) if links(i, j)) for i in range(len(sets))]
            if low == root:
                break
            root = low
        assert got == {i: (root[i], len({sets[j] for j in range(len(sets)) if sets[j] != sets[i] and links(i, j)})) for i in range(len(sets))}
