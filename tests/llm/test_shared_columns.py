import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinweave.llm import jaccard
from kinweave.llm import textvec as tv


def _brute(sets, percent):
    root, links = list(range(len(sets))), {i: [j for j in range(len(sets)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(sets))}
    for _ in root:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(sets))]
    return root


def _texts(seed, rows):
    """Texts of words of their own among words of a few texts, and near copies of every tenth."""
    draw = random.Random(seed)
    texts = []
    for i in range(rows):
        words = [f"own{i}x{k}" for k in range(30)] + [f"many{draw.randint(0, 399)}" for _ in range(8)]
        draw.shuffle(words)
        texts.append(" ".join(words))
        if i % 10 == 0:
            texts.append(" ".join([*words, "more"]))
    return texts


@pytest.mark.parametrize("together,most_bits", [(1 << 21, 1 << 29), (50, 1 << 29), (1 << 21, 300), (1 << 21, 16)])
def test_filter_lacks_no_column_of_least_documents(spark, together, most_bits):
    draw = random.Random(3)
    texts = [" ".join(f"w{int(300 * draw.random() ** 2)}" for _ in range(30)) for _ in range(20)] + ["w1 w1 w1", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = jaccard.shared_columns(docs, 1, 1 << 14 if together == 50 else 600, together, most_bits)
    sets = jaccard._sets(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), 1)
    held = Counter(int(c) for s in sets for c in s)
    cols = np.array(list(held), tv.U)
    many = np.array([held[int(c)] >= found.least for c in cols])
    least = next((k for k in jaccard.LEAST if 3 * sum(x >= k for x in held.values()) <= most_bits), 128)
    assert found.least == least and (least == 2) == (most_bits == 1 << 29)
    assert found.holds(cols)[many].all()
    assert found.holds(cols)[~many].mean() < 0.05


def test_columns_of_one_document_go_no_further(spark, monkeypatch):
    rows, texts = {}, _texts(7, 120)
    usual = jaccard.stage

    def counted(df, label, *a):
        out = usual(df, label, *a)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # a sketch so full that it tells nothing
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, n=1, percent=80, slots=64).collect()}
    assert got == dict(enumerate(_brute([frozenset(t.split()) for t in texts], 80)))
    # only the 24 near copies share columns that come first, of which each row has 12 at most
    assert rows["entries"] <= 24 * 12
    assert rows["near"] <= 12


def test_result_where_the_filter_leaves_out_rare_columns(spark, monkeypatch):
    usual = jaccard.shared_columns
    monkeypatch.setattr(jaccard, "shared_columns", lambda docs, n, total: usual(docs, n, total, most_bits=16))
    texts = _texts(9, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, n=1, percent=80, few=3, block=8).collect()}
    assert got == dict(enumerate(_brute([frozenset(t.split()) for t in texts], 80)))
