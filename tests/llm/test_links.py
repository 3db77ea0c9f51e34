import re
from collections import defaultdict

import numpy as np
import pytest

from kinweave.llm import decontam, forest, jaccard, shared, warc

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows, n, percent):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append((doc, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), top(d)) for d, s in sets}


def near_copies(seed, groups=6, size=12, n_words=120):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 400, n_words)]
        for _ in range(size):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 6)):
                words[at] = f"n{rng.integers(0, 1000)}"
            rows.append(" ".join(words[: len(words) - int(rng.integers(0, 12))]))
    rows += ["", None, "a", "A", "a b", "a  B", "  ", rows[0], rows[0].upper()]
    return list(enumerate(rows))


@pytest.mark.parametrize("n,percent,few,block", [(3, 90, 48, 512), (3, 90, 2, 4), (5, 80, 3, 5), (1, 100, 2, 3)])
def test_components_equal_brute_force(spark, n, percent, few, block):
    rows = near_copies(n)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int")
    out = jaccard.jaccard_components(docs, n=n, percent=percent, few=few, block=block, slots=1 << 12).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, n, percent)


def test_jaccard_edge_cases(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), slots=1 << 12).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), slots=1 << 12).collect()
    assert len(out) == 4 and sorted(r["n_shingles"] for r in out) == [0, 2, 2, 2] and {r["component_id"] for r in out} == {None}
    # rows that repeat a doc_id are judged by their texts; a clashing component_id is replaced
    rows = [(None, "a b c d e f", 9), (-(1 << 63), "x y z u v w", 9), (7, "p q r s t u", 9), (7, "k l m n o p", 9), (3, "K l m n o p", 9), (None, "p q r s t u", 9)]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, component_id int"), slots=1 << 12).collect()
    assert {(r["doc_id"], r["text"]): r["component_id"] for r in out} == {(None, "a b c d e f"): None, (-(1 << 63), "x y z u v w"): None, (7, "p q r s t u"): None, (7, "k l m n o p"): 3, (3, "K l m n o p"): 3, (None, "p q r s t u"): None}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (200, 200)]
    out = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_alignment_scores():
    a = np.arange(20, dtype=np.uint64)
    assert decontam.align(a, np.concatenate([a + 100, a, a + 200])) == (40, 20, 40)
    edited = np.concatenate([a[:10], [np.uint64(99)], a[10:]]).astype(np.uint64)
    assert decontam.align(a, edited)[0] == 39
    replaced = a.copy()
    replaced[5] = 77
    assert decontam.align(a, replaced)[0] == 37
    assert decontam.align(a, np.zeros(0, np.uint64)) == (0, 0, 0)


def slow_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            best = max(best, h[i + 1, j + 1])
    return best


def test_alignment_equals_the_full_matrix():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64) for _ in range(2))
        score, start, end = decontam.align(a, b)
        assert score == slow_align(a, b)
        if score:
            assert slow_align(a, b[start:end]) == score


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = np.random.default_rng(11)
    word = lambda: f"v{rng.integers(0, 3000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 17, 45, 60, 25])]
    items += [(50, None), (51, ""), (52, "two words")]
    rows, wanted = [], set()
    for i in range(120):
        words = [word() for _ in range(200)]
        if i % 4 == 0:
            k = (i // 4) % 5
            passage = items[k][1].split()
            if i % 8 == 0:  # edited: every seventh word replaced
                passage = [word() if j % 7 == 3 else w for j, w in enumerate(passage)]
            if i % 12 == 0:
                passage = [w.upper() + "," for w in passage]
            words[50:50] = passage
            wanted.add((i, k))
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(docs, bench).collect()}
    assert set(out) == wanted
    assert all(r["start"] <= 51 and r["end"] >= 60 for r in out.values())
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in wanted}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, empty).count() == 0
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_forest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 32))
    x *= rng.uniform(0.5, 2, (3000, 1))
    x[5] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [1.0, None]), (None, [1.0] * 32), (9005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = forest.search(df, df.filter("vec_id % 50 = 0 or vec_id >= 9000"), k=20, segment_rows=1000).collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 50))
    recall = []
    for q, hits in found.items():
        best = forest.exact(x, np.arange(3000), x[q], q, 20)
        recall.append(len({h for h, _ in hits} & set(best.tolist())) / 20)
        assert [h for h, _ in hits] == [h for h, _ in sorted(hits, key=lambda h: (-h[1], h[0]))] and q not in dict(hits)
        assert all(abs(s - x[h] @ x[q]) < 1e-9 for h, s in hits)
    assert np.mean(recall) >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert forest.search(few, few, k=20).count() == 6
    assert forest.search(few.limit(0), few.limit(0)).count() == 0


def test_forest_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas().sort_values("vec_id")
    x, ids = np.stack(p["embedding"].to_numpy()).astype(float), p["vec_id"].to_numpy()
    out = forest.search(df, df.filter("vec_id % 20 = 0")).toPandas()
    recall = [len(set(g["vec_id"]) & set(forest.exact(x, ids, x[ids == q][0], q, 20).tolist())) / 20 for q, g in out.groupby("query_id")]
    assert np.mean(recall) >= 0.9


def test_archives_round_trip(spark, tmp_path):
    long, tricky = "x" * 150, "é WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n\r\n" + "y" * 100
    rows = [(3, "http://a/3", long), (1, "http://a/1", long), (2, "bad url\r\nX: y", tricky), (4, None, None), (5, "http://a/5", "short"), (6, "http://a/6", "short"), (None, "http://n", long), (7, "http://a/7", "é" * 60), (1, "http://a/1", long)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    out = warc.archive_pages(pages, f"file://{tmp_path}/warc").collect()
    assert len(out) == 9 and len({r["record_id"] for r in out}) == 9
    again = next(r for r in out if r["record_id"].endswith(":2"))  # the row that repeats page 1
    assert again["response"]["type"] == "revisit" and again["response"]["payload_bytes"] == 150 and len(again["requests"]) == 1
    by = {r["record_id"].split(":")[2]: r for r in out if r is not again}
    assert again["response"]["refers_to"] == by["1"]["record_id"]
    assert by["1"]["response"]["type"] == "response" and bytes(by["1"]["response"]["payload"]) == long.encode()
    for k in ("3", "null"):
        r = by[k]["response"]
        assert r["type"] == "revisit" and r["refers_to"] == by["1"]["record_id"] and r["payload_bytes"] == 150 and r["digest"] == by["1"]["response"]["digest"]
    assert bytes(by["2"]["response"]["payload"]) == tricky.encode()
    assert by["4"]["response"]["payload_bytes"] == 0 and by["5"]["response"]["type"] == by["6"]["response"]["type"] == "response"
    assert all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in out)
    assert warc.decode_url(by["2"]["metadata"][0]["fields"]["page-url-base64"]) == "bad url\r\nX: y"
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_equal_rows_are_captures_of_their_own(spark):
    long = "z" * 120
    rows = [(1, "u", long)] * 3 + [(2, "u", "short")] * 2 + [(None, None, None)] * 2 + [(3, "u", long)] + [(9, "v", "w" * 300_000)]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    kinds = sorted((warc_page(r), r["response"]["type"], r["response"]["payload_bytes"]) for r in out)
    assert kinds == [("1", "response", 120), ("1", "revisit", 120), ("1", "revisit", 120), ("2", "response", 5), ("2", "response", 5), ("3", "revisit", 120), ("9", "response", 300_000), ("null", "response", 0), ("null", "response", 0)]
    assert {warc_page({"record_id": r["response"]["refers_to"]}) for r in out if r["response"]["type"] == "revisit"} == {"1"}
    assert all(len(r["requests"]) == len(r["metadata"]) == 1 for r in out)


def warc_page(row):
    return row["record_id"].split(":")[2]


def test_reading_other_archives(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"\xff\xfe\r\n\r\n" * 400 + b"end"
    record = lambda i, b: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    parts = [record(i, block[: 20 + 37 * i] if i else b"HTTP/1.1 200 OK\r\n\r\n") for i in range(40)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:20]))  # a member per record
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(parts[20:30])))
    (tmp_path / "c.warc").write_bytes(b"".join(parts[30:]))
    out = {r["record_id"]: bytes(r["payload"]) for r in warc.read_records(spark, f"file://{tmp_path}").collect()}
    body = lambda i: (block[: 20 + 37 * i] if i else b"HTTP/1.1 200 OK\r\n\r\n").partition(b"\r\n\r\n")[2]
    assert out == {f"r{i}": body(i) for i in range(40)}
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "d.warc.gz").write_bytes(gzip.compress(b"".join(parts[:3])[:-30]))
    with pytest.raises(Exception, match="before its record does|ends in the headers"):
        warc.read_records(spark, f"file://{cut}").collect()
    (cut / "d.warc.gz").write_bytes(gzip.compress(parts[39])[:-20])
    with pytest.raises(Exception, match="(?i)eof|unexpected end|FAILED_READ_FILE"):
        warc.read_records(spark, f"file://{cut}").collect()


def test_assembly_of_odd_links(spark):
    schema = warc.RECORDS
    row = lambda i, kind, to=None: (i, kind, to, None, None, None, None, 0, None, {})
    records = spark.createDataFrame([row("r1", "response"), row("q1", "request", "r1"), row("m1", "metadata", "q1"), row("m1", "metadata", "q1"), row("r2", "response", "q2"), row("q2", "request"), row("q3", "request", "gone"), row("info", "warcinfo")], schema)
    out = {r["record_id"]: r for r in warc.assemble(records).collect()}
    assert set(out) == {"r1", "r2", "gone"}
    assert [x["record_id"] for x in out["r1"]["metadata"]] == ["m1"] and [x["record_id"] for x in out["r2"]["requests"]] == ["q2"]
    assert out["gone"]["response"] is None and [x["record_id"] for x in out["gone"]["requests"]] == ["q3"]
