import re

import numpy as np
import pytest

from kinweave.llm import jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_links(sets, percent):
    """Other different sets that each set links with."""
    sets = set(sets) - {frozenset()}
    return {x: sum(x is not y and 100 * len(x & y) >= percent * len(x | y) for y in sets) for x in sets}


def groups(sizes, n_words=150):
    rng, out = np.random.default_rng(8), []
    for g, size in enumerate(sizes):
        base = [f"g{g}w{i}" for i in range(n_words)]
        for c in range(size):
            words = list(base)
            for at in rng.integers(0, n_words, rng.integers(0, 4)):
                words[at] = f"c{rng.integers(0, 9)}"
            out.append(" ".join(words[: n_words - int(rng.integers(0, 12))]))
    return out + [out[0], "", None, "a b", out[1].upper()]


@pytest.mark.parametrize("few,block", [(2, 4), (2, 512), (48, 512), (48, 16)])
def test_link_counts_equal_brute_force(spark, few, block):
    texts = groups([60, 40, 3])
    sets = [shingles(t, 3) for t in texts]
    wanted = brute_links(sets, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_components(docs, n=3, percent=90, few=few, block=block, slots=1 << 12).collect()}
    assert max(wanted.values()) > 20
    assert out == {d: wanted.get(s, 0) for d, s in enumerate(sets)}
