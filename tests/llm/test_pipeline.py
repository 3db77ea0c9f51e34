import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from kinweave.llm import queries as q
from kinweave.llm.shared import stage

from test_leaks import brute_score, words

SF = "/root/testdata/sf0.01"


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    """Texts without the lines that at least three documents hold, but for the largest doc_id."""
    key = lambda x: x.strip(BLANK).translate(LOW)
    held = {}
    for doc, text in rows.items():
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, set()).add(doc)
    top = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return {d: t if t is None else "\n".join(x for x in t.split("\n") if top.get(key(x), d) == d) for d, t in rows.items()}


def brute_groups(rows):
    """The smallest doc_id of each group linked by five-word shingles at 0.8, and documents without words."""
    sets = {}
    for doc, text in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, ids = {d: d for d in sets}, sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, o = top(a), top(b)
                parent[max(p, o)] = min(p, o)
    return {d for d in sets if top(d) == d}


def brute_leaks(rows, items):
    """Documents in which an item is aligned at 0.6; a pair that shares too few different words cannot be."""
    found = set()
    for doc, text in rows.items():
        w = words(text)
        held = set(w)
        if any(len(own & held) >= len(own) - 0.4 * len(item) - 1e-9 and brute_score(item, w) >= 0.6 - 1e-9 for item, own in items):
            found.add(doc)
    return found


def test_stages_equal_brute_force(spark):
    """Every stage on all that its predecessor kept; the classifier against its labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 0").fetchall()}
    good = {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 1").fetchall()}
    items = [(w, set(w)) for w in (words(r[0]) for r in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()) if w]
    direct = Tokenizer.from_file(q.TOKENIZER)
    for name, function in cp.STAGES:
        docs = stage(function(spark, docs, SF), "test")
        if name == "packing":
            pieces = {}
            for r in docs.collect():
                pieces.setdefault(r["doc_id"], []).append(r)
            assert set(pieces) == set(rows)
            windows = {}
            for doc, text in rows.items():
                ids, at = [*direct.encode(text or "", add_special_tokens=False).ids, 0], 0
                for r in sorted(pieces[doc], key=lambda r: r["start"]):
                    part = np.array(ids[at : at + r["length"]], "<u4")
                    assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
                    windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
                    at += r["length"]
                assert at == len(ids)
            for spans in windows.values():
                spans.sort()
                assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= 1024
            assert len(windows) <= 1.02 * sum(n for s in windows.values() for _, n in s) / 1024 + 1
            continue
        assert docs.columns == columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality classifier":
            assert len(good - set(kept)) <= 0.02 * len(good) and len(bad & set(kept)) <= 0.1 * len(bad)
            assert all(kept[d] == rows[d] for d in kept)
        elif name == "line dedup":
            assert kept == brute_lines(rows) and kept != rows
        elif name == "n-gram Jaccard join":
            wanted = brute_groups(rows)
            assert kept == {d: rows[d] for d in wanted} and len(wanted) < len(rows)
        else:
            gone = brute_leaks(rows, items)
            assert kept == {d: t for d, t in rows.items() if d not in gone} and gone
        rows = kept


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(q.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    wanted = sorted(cur.fetchall(), key=repr)
    df = q.QUERIES[name](spark, SF)
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == wanted and sorted(df.columns) == sorted(names)


def test_every_operator_is_registered():
    found = entry.queries()
    assert {n.split("_")[0] for n in found if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)} and "pipeline" in found
