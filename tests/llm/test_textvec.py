import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import textvec as tv

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zé\n\t\x0b,.", max_size=40)), max_size=8)


def plain(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_ngrams_agree_with_split(texts):
    w = tv.words(pa.array(texts, pa.string()))
    lists = [plain(t) for t in texts]
    assert w.counts.tolist() == [len(x) for x in lists]
    flat = [x for words in lists for x in words]
    assert len(set(w.hash.tolist())) == len(set(flat))
    grams, first = tv.ngrams(w, 3)
    for i, words in enumerate(lists):
        wanted = [tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        own = grams[first[i] : first[i + 1]].tolist()
        assert len(own) == len(wanted)
        assert len(set(own)) == len(set(wanted))


def test_hash_does_not_depend_on_place_or_chunk(monkeypatch):
    text = "alpha beta " * 50
    alone = tv.words(pa.array(["alpha"], pa.string())).hash[0]
    monkeypatch.setattr(tv, "CHUNK", 7)
    w = tv.words(pa.array(["x", text, None, "Alpha"], pa.string()))
    assert w.counts.tolist() == [1, 100, 0, 1]
    assert set(w.hash[1::2][:50].tolist()) == {alone} and w.hash[-1] == alone


def test_slices_and_empty_batches():
    column = pa.array(["a b", "c", None, ""], pa.string()).slice(1)
    assert tv.words(column).counts.tolist() == [1, 0, 0]
    assert tv.words(pa.array([], pa.string())).counts.tolist() == []


def test_marks_separate_words():
    w = tv.words(pa.array(["a,b.c!! d", "é-é"], pa.string()), marks=True)
    assert w.counts.tolist() == [4, 2]
