import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    direct = Tokenizer.from_file(PATH)
    direct.encode_special_tokens = True
    return direct, tokens.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sdtmrelv!?.,9²Zé　​\x85\x1c<|>"), st.characters(blacklist_categories=["Cs"])), max_size=30), max_size=4))
def test_ids_equal_the_tokenizer(both, texts):
    direct, enc = both
    assert [x.tolist() for x in enc.encode(texts)] == [direct.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_starts_anew(both, monkeypatch):
    direct, _ = both
    monkeypatch.setattr(tokens, "CACHE", 5)
    enc = tokens.Encoder(PATH)
    for t in ("one two three", "four five six seven", "one nine ten"):
        assert enc.encode([t])[0].tolist() == direct.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60))
def test_best_fit_takes_the_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets, made = packing.best_fit(np.array(lengths, np.int64), 32)
    room: list[int] = []
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        fitting = [r for r in room if r >= n]
        if fitting:
            assert 32 - o == room[b] == min(fitting)
        else:
            assert b == len(room) and o == 0
            room.append(32)
        room[b] -= n
    assert made == len(room)


def test_packed_documents_round_trip(spark, both):
    direct, _ = both
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 3000), (None, "x"), (1, "a b c"), (5, "é漢 " * 100)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, length string")
    rows = packing.pack_documents(docs, PATH, window=64, group_rows=10).collect()
    ids = {t: direct.encode(t or "", add_special_tokens=False).ids + [0] for _, t in texts}
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for doc, text in texts:
        own = ids[text]
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc and r["doc_tokens"] == len(own))
        copies = sum(1 for d, t in texts if d == doc and t == text)
        assert sum(x[1] for x in mine) == copies * len(own)
        for start, length, crc in mine:
            assert crc == zlib.crc32(np.array(own[start : start + length], "<u4").tobytes())


def test_empty_table_and_little_padding(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, PATH).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, PATH).toPandas()
    assert rows["length"].sum() / (rows["sequence_id"].nunique() * 1024) > 0.99
