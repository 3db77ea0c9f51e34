"""Cases of nulls, repeated ids, ties, clashes and very long texts that the other files leave out."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from kinweave.llm import forest, langid, packing, quality, queries, sharding, shared, tokens

SF = "/root/testdata/sf0.01"


def test_added_tokens_are_those_of_the_tokenizer():
    direct = Tokenizer.from_file(queries.TOKENIZER)
    added = [t["content"] for t in json.load(open(queries.TOKENIZER, encoding="utf-8"))["added_tokens"]]
    assert added
    texts = ["hello world", f"hello {added[0]} world", added[0] * 3, f"a{added[0].upper()}b", "plain", "", "日本 " + added[0], added[0][:-1]]
    for text, ids in zip(texts, tokens.encoder(queries.TOKENIZER).encode(texts)):
        assert ids.tolist() == direct.encode(text, add_special_tokens=False).ids


def test_packing_of_one_repeated_id(spark):
    docs = spark.createDataFrame([(None, "a b c " * (1 + i % 3)) for i in range(300)] + [(7, "same text")] * 300, "doc_id long, text string").repartition(3)
    out = packing.pack_documents(docs, queries.TOKENIZER, window=64, group_rows=50).collect()
    assert len(out) == 600 and len({r["sequence_id"] >> 32 for r in out}) > 6
    filled = {}
    for r in out:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def brute_shards(sizes, keys, shards):
    """Ideal places to cut: after how many rows of the order each shard's share of the bytes is met."""
    order = np.lexsort(keys[::-1])
    below = np.concatenate([[0], np.cumsum(sizes[order])])
    return order, below, [below[-1] * i / shards for i in range(1, shards)]


@pytest.mark.parametrize("group", [1, 400])
def test_splitters_equal_those_of_the_whole_order(spark, group):
    rng = np.random.default_rng(group)
    texts = [f"t{rng.integers(0, 10**9)} " * int(rng.integers(1, 30)) for _ in range(2500)] + ["copy " * 40] * group
    docs = spark.createDataFrame([(int(i), t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(7)
    shards, tolerance, loose = 8, 0.01, 0.05
    out = sharding.histogram_sort(docs, shards=shards, tolerance=tolerance, group_tolerance=loose, task_bytes=8000).withColumn("h", F.xxhash64("text")).collect()
    sizes, h, d = (np.array([r[c] for r in out], dtype=np.int64) for c in ("size", "h", "doc_id"))
    order, below, wanted = brute_shards(sizes, [h, d], shards)
    shard = np.array([r["shard"] for r in out])[order]
    assert (np.diff(shard) >= 0).all()
    share = below[-1] / shards
    for i, target in enumerate(wanted):
        cut = int(np.searchsorted(shard, i, "right"))
        inside = 0 < cut < len(order) and h[order[cut - 1]] == h[order[cut]]
        edges = [k for k in range(len(order) + 1) if k in (0, len(order)) or h[order[k - 1]] != h[order[k]]]
        best = min(abs(below[k] - target) for k in edges)
        if inside:  # a group is cut only where no place between groups is near enough
            assert best > loose * share and abs(below[cut] - target) <= tolerance * share + sizes.max()
        else:
            assert abs(below[cut] - target) <= max(loose * share, best + tolerance * share)
    for s in range(shards):
        rows = [r for r in out if r["shard"] == s]
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["size"] == len(r["text"].encode()) + 8 for r in out)


def test_many_languages(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(80):
        letters = [chr(c) for c in rng.choice(np.arange(0x100, 0x250), 12)]
        for i in range(12):
            rows.append((k * 100 + i, " ".join("".join(rng.choice(letters, 6)) for _ in range(30)), f"l{k:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn_filters(docs.filter("doc_id % 4 <> 0"))
    assert len(filters.languages) == 80 and filters.masks.shape == (2, langid.SLOTS)
    out = langid.identify(docs.filter("doc_id % 4 = 0"), filters).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    hits, total, _ = filters.counts([rows[0][1]])
    assert hits.shape == (1, 80) and 0 < hits[0, 0] == hits.max() <= total[0]


def test_language_predictions_equal_brute_force(spark):
    rows = [(0, "der Hund der Hund und", "de"), (1, "der Hund der Hund und", "de"), (2, "der Hund", "de"), (3, "the dog the dog and", "en"), (4, "the dog the dog and", "en"), (5, "the dog", "en"), (6, "the dog", "en"), (7, None, "fr"), (8, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn_filters(docs)
    assert filters.languages == ["de", "en"]  # of the two, en has more texts
    grams = {}
    for name in filters.languages:
        codes = np.concatenate([langid.grams([t])[0] for _, t, lang in rows if lang == name])
        seen, n = np.unique(codes, return_counts=True)
        grams[name] = set(seen[(n >= 3) & (n >= 5e-6 * n.sum())].tolist())
    asked = [*{t for _, t, _ in rows}, "der dog", "und", "zzz", "42", "", "the the der", "DOG hund"]
    out = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame([(t, 0.5) for t in asked], "text string, score double"), filters).collect()}
    for text in asked:
        codes = langid.grams([text or ""])[0].tolist()
        if not any(c.isalpha() for c in text or ""):
            assert out[text] == ("und", 0.0)
            continue
        share = {k: sum(c in g for c in codes) / len(codes) for k, g in grams.items()}
        best = max(share, key=lambda k: (round(share[k], 6), k == "en"))
        assert out[text][0] == best and abs(out[text][1] - share[best]) < 1e-4


def test_labelled_rows_are_bounded_whatever_ids_repeat(spark):
    docs = spark.createDataFrame([(1 if i % 2 else None, f"text {i} " * (i % 9 + 1), "en", f"s{i % 3}", i, 0.5) for i in range(600)] + [(2, "same", "en", "s", 4, 0.5)] * 300, "doc_id long, text string, lang string, source string, n_chars long, label double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0)], "doc_id long, quality int")
    assert quality.fit_quality(docs, labels, sample=40, pool=40) is None  # one class has a single row
    out = quality.score_quality(docs, None)
    assert out.count() == 900 and out.columns == [*docs.columns, "p_text", "p_meta", "score", "keep"]


def test_views_keep_apart():
    meta = quality.meta_view(["en", None], ["s", None], [100, None])
    assert meta.shape == (2, quality.LANGS + quality.SOURCES + quality.SIZES + 2) and not np.array_equal(meta[0], meta[1])


def test_vectors_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.5, 0.5, 0.5]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (3, [0.0, 3.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in forest.search(df, df.filter("vec_id % 2 = 0"), k=5).collect()}
    # the smallest of a repeated id's vectors counts, by length, then component by component
    assert out == {(2, 1): (4, 2.0), (2, 2): (1, 0.0), (2, 3): (3, 0.0), (4, 1): (3, 3.0), (4, 2): (2, 2.0), (4, 3): (1, 1.0)}


ROWS = [(None, None, None, None, None, "k"), (1, "", "en", "s", 0, "k"), (2, "one line here that is long enough to count\nand more words of it", "en", "s", 70, "k"), (2, "another text that shares the number two", "de", None, None, "k"), (2, "another text that shares the number two", "de", None, None, "k"), (None, "plain words without a number", "en", "s", 28, "k"), (3, "word " * 60_000, "en", "s", 300_000, "k")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a passage of the test that none of the rows holds in any way"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name,function", cp.STAGES)
def test_stages_take_odd_rows(spark, odd, name, function):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    out = function(spark, docs, odd)
    assert function(spark, docs.limit(0), odd).count() == 0
    if name == "packing":
        assert sum(r["start"] == 0 for r in out.collect()) == len(ROWS)
        return
    assert out.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert kept == sorted(((r[0], r[1]) for r in ROWS), key=repr)


def test_stage_copies_can_go(spark):
    df = shared.stage(spark.range(5).toDF("x"), "gone")
    assert df.count() == 5
    shared.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._kinweave_path).count()


def test_crc_is_little_endian():
    assert tokens.crc(np.array([1, 2], np.uint32)) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
