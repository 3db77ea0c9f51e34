import re

import numpy as np
import pytest

from kinweave.llm import decontam
from kinweave.llm.decontam import seed_plan

SF = "/root/testdata/sf0.01"


def words(text):
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if w]


def brute_score(item, doc):
    """Best Smith-Waterman score over twice the item's words, by the full matrix."""
    a, b = np.array(item, dtype=object), np.array(doc, dtype=object)
    if not len(a) or not len(b):
        return 0.0
    above, best = np.zeros(len(b) + 1, int), 0
    for w in a:
        diagonal = above[:-1] + np.where(b == w, 2, -1)
        row = np.maximum(np.maximum(np.concatenate([[0], diagonal]), above - 1), 0)
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1] - 1)
        best, above = max(best, int(row.max())), row
    return best / (2 * len(a))


def edited(rng, item, rate, kinds):
    out = []
    for w in item:
        kind = rng.choice(kinds) if rng.random() < rate else "keep"
        if kind == "replace":
            out.append(f"x{rng.integers(0, 10**6)}")
        elif kind == "insert":
            out += [w, f"x{rng.integers(0, 10**6)}"]
        elif kind == "keep":
            out.append(w)
    return out


def test_random_edits_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(12)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"v{rng.integers(0, 400)}"
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate([3, 4, 6, 9, 10, 11, 14, 20, 31, 45])]
    items.append((3, [word() for _ in range(12)]))
    docs = []
    for d in range(260):
        _, item = items[d % len(items)]
        passage = edited(rng, item, rng.uniform(0, 0.8), [["replace"], ["insert"], ["drop"], ["replace", "insert", "drop"]][d % 4])
        docs.append((d, [word() for _ in range(25)] + passage + [word() for _ in range(25)]))
    wanted = {}
    for d, doc in docs:
        for k, item in items:
            s = brute_score(item, doc)
            if s >= 0.6 - 1e-9:
                wanted[d, k] = max(s, wanted.get((d, k), 0))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in items], "item_id long, text string")
    table = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_leaks(table, bench).collect()}
    assert len(wanted) > 150 and set(out) == set(wanted)
    assert all(abs(out[k] - wanted[k]) < 1e-9 for k in wanted)


@pytest.mark.parametrize("least", [0.4, 0.6, 0.8])
def test_an_alignment_holds_the_seeds_of_the_plan(least):
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 9, 10, 13, 30):
        n, given, needed = seed_plan(size, least)
        assert needed >= 1 and given + needed <= size - n + 1
        item = [f"w{i}" for i in range(size)]
        for _ in range(150):
            doc = edited(rng, item, rng.uniform(0, 1), ["replace", "insert", "drop"])
            if brute_score(item, doc) >= least:
                held = {tuple(doc[i : i + n]) for i in range(len(doc) - n + 1)} & {tuple(item[i : i + n]) for i in range(size - n + 1)}
                assert len(held) >= given + needed


def test_a_word_after_every_second_one(spark):
    item = [f"w{i}" for i in range(30)]
    doc = [x for i in range(0, 30, 2) for x in (item[i], item[i + 1], f"n{i}")]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(5, " ".join(["a"] * 50 + doc[:-1] + ["b"] * 50))], "doc_id long, text string")
    (row,) = decontam.find_leaks(docs, bench).collect()
    assert abs(row["score"] - brute_score(item, doc)) < 1e-9 and (row["start"], row["end"]) == (50, 94)


def test_repeated_and_null_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(3, one), (3, two), (None, two), (-(1 << 63), one), (4, None), (5, " .,")], "item_id long, text string")
    rows = [(1, "x " + one), (2, two + " y"), (None, "clean text here"), (None, "x y " + one), (-(1 << 63), "also clean"), (7, "clean"), (7, two), (8, None), (9, ""), (1, "x " + one)]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, item_id string")
    out = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    low = -(1 << 63)
    assert out == {(1, 3), (1, low), (2, 3), (2, None), (None, 3), (None, low), (7, 3), (7, None)}
    kept = sorted(((r["doc_id"], r["text"]) for r in decontam.decontaminate(docs, bench).collect()), key=repr)
    assert kept == sorted([(None, "clean text here"), (low, "also clean"), (7, "clean"), (8, None), (9, "")], key=repr)


def test_a_long_text_with_many_passages(spark):
    item = [f"w{i}" for i in range(25)]
    text = " ".join(" ".join(item if k % 3 == 0 else [f"z{k}"] * 30) for k in range(3000))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    (row,) = decontam.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).collect()
    assert row["score"] == 1.0 and (row["start"], row["end"]) == (0, 25)


def test_the_table_equals_brute_force_on_a_part(spark):
    """All items against every fortieth document, the whole matrix; the search runs over the whole table."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], words(r["text"])) for r in bench.collect()][::4]
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    leaking = {d for d, _ in found}
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 4000 and (r["doc_id"] % 40 == 0 or r["doc_id"] in leaking)]
    wanted = {(r["doc_id"], k) for r in rows for k, item in items if len(set(words(r["text"])) & set(item)) >= 0.6 * len(set(item)) - 6 and brute_score(item, words(r["text"])) >= 0.6 - 1e-9}
    ids, some = {r["doc_id"] for r in rows}, {k for k, _ in items}
    assert {f for f in found if f[0] in ids and f[1] in some} == wanted
