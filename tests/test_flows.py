import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.__main__ import main
from kinweave.operators import audit, decide, evaluate, learn, sampling, tfidf
from kinweave.plans import linkage
from kinweave.sources import tsv


def test_folders_of_files_lose_each_header_and_keep_their_order(spark, tmp_path):
    folder, wanted = tmp_path / "s", []
    folder.mkdir()
    for name, rows in (("b.tsv", 70), ("a.tsv", 3), ("c.tsv", 1)):
        lines = [f"S2-{name[0]}{i}\tn{i}" + ("\ta\tUS\tmore" if i % 2 else "") for i in range(rows)]
        (folder / name).write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(x + "\n" for x in lines))
    for name, rows in (("a", 3), ("b", 70), ("c", 1)):
        wanted += [f"S2-{name}{i}" for i in range(rows)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # splits in the middle of files
    try:
        out = sorted(tsv.read_positional(spark, str(folder), numbered=True).collect(), key=lambda r: r["line_idx"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["entity_id"] for r in out] == wanted and [r["line_idx"] for r in out] == list(range(74))
    assert all((r["n_extra"], r["country"]) == ((1, "US") if int(r["entity_id"][4:]) % 2 else (0, "")) for r in out)
    check = tsv.parse_check(spark, str(folder)).first()
    assert (check["lines"], check["parsed"], check["ok"]) == (74, 74, True)


def test_chunks_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "b , a ", "x"), ("q2", "", "y")], "id string, ids string, country string")
    path = f"file://{tmp_path}/out"
    assert tsv.write_chunks(rows.filter("country = 'x'"), path, "country") == ["x"]
    assert tsv.write_chunks(rows, path, "country") == ["y"]
    text = {(p.parent.name, line) for p in (tmp_path / "out").rglob("part-*.csv") for line in p.read_text().splitlines()}
    assert text == {("country=x", "id\tids"), ("country=x", "q1\tb , a "), ("country=y", "id\tids"), ("country=y", "q2\t")}


def test_validator_exit_status(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    source, good, bad, latin = (tmp_path / n for n in ("s1.tsv", "good.tsv", "bad.tsv", "latin.tsv"))
    source.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\tb\tUS\nS1-2\ta\tb\tUS\n")
    good.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\n")
    latin.write_bytes("source1_entity_id\tmatched_entity_ids\nS1-1\té\nS1-2\t\n".encode("latin-1"))
    cands = tmp_path / "c.tsv"
    cands.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-9\nS1-2\t\n")
    run = lambda *a: (main(["validate", "-s", str(source), "-m", *map(str, a)]), capsys.readouterr().out)
    assert run(good)[0] == 0 and "PASS" in run(good)[1]
    code, said = run(bad)
    assert code == 1 and "repeated id" in said and "missing row" in said
    assert run(latin)[0] == 1 and "UTF-8" in run(latin)[1]
    assert run(good, "-c", cands)[0] == 0 and run(good, "-c", cands, "--strict")[0] == 1
    assert run(tmp_path / "none.tsv")[0] == 1


def test_examples_are_few_and_distinct(spark):
    rows = spark.createDataFrame([("r", f"x{i % 40:02d}") for i in range(400)] + [("s", "a")], "rule string, x string")
    out = {r["rule"]: (r["n"], r["examples"]) for r in audit.first_examples(rows, "rule", "x").collect()}
    assert out == {"r": (400, ["x00", "x01", "x02", "x03", "x04"]), "s": (1, ["a"])}


def test_embedder_spans_the_top_singular_vectors(spark):
    rng = random.Random(2)
    parts = ["park", "road", "steel", "green", "bright", "river", "stone", "a", "él"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(300)] + [None, "", "  "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = tfidf.fit_embedder(docs, dim=6, buckets=1 << 9)
    dense = np.zeros((len(texts), 1 << 9))
    row, bucket, w = model.weights(texts)
    dense[row, bucket] = w
    right = np.linalg.svd(dense, full_matrices=False)[2][:6]
    # the spaces agree: the projection of one basis on the other loses nothing
    assert np.linalg.svd(right @ model.components, compute_uv=False).min() > 0.999
    out = np.array([r["v"] for r in docs.select("text", tfidf.encoder(model)("text").alias("v")).collect()])
    norm = np.linalg.norm(out, axis=1)
    assert ((abs(norm - 1) < 1e-5) | (norm == 0)).all() and (norm == 0).sum() == 3
    got, _, n = tfidf.hashed_grams(["ab a"], 1 << 20)
    assert n.sum() == 2 + 1 + 2 and set(got) == {0}  # ' ab', 'ab ', ' ab ', and ' a ' twice


def scored_pairs(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for q in range(n):
        for t in range(3):
            label = rng.random() < 0.4
            rows.append((q, rng.randrange(900), min(0.99, max(0.01, rng.gauss(0.62 if label else 0.42, 0.15))), int(t % 2), int(label), q % 2))
    return spark.createDataFrame(rows, "q long, t long, p double, is_s3 int, label int, fold int").dropDuplicates(["q", "t"])


def test_second_pass_learns_from_mined_negatives(spark):
    pairs = scored_pairs(spark).withColumn("base", (F.col("label") == 1) | (F.col("q") % 10 == 0))
    model, n_base, n_mined = learn.train_mined(pairs, ["p", "is_s3"], 3, 5, least=2)
    wanted = learn.mined_negatives(pairs, 0.0, 10).filter("not base").count()
    assert n_base == pairs.filter("base").count() and 0 < n_mined <= wanted
    assert evaluate.roc_auc(learn.score(model, pairs, ["p", "is_s3"])).first()["auc"] > 0.7


@pytest.mark.parametrize("better,stage2", [(-1.0, True), (1.0, False)])
def test_gates_of_the_second_stage(spark, better, stage2):
    s = scored_pairs(spark, 120)
    entities = s.select("q").distinct().withColumn("country", F.when(F.col("q") % 2 == 0, "US").otherwise("India"))
    truth = s.filter("label = 1").select("q", "t")
    out = learn.second_stage(entities, truth, s, ["p_rank", "p_gap"], better, better, iterations=2, least=2)
    assert out["stage2"] is stage2 and out["per_country"] is stage2 and out["column"] == ("p2" if stage2 else "p")
    first = decide.tune(entities, truth, s)
    if not stage2:
        assert out["f05"] == pytest.approx(first["macro_f05"]) and out["by_country"] == {}
    else:
        assert set(out["by_country"]) == {"US", "India"}
    assert out["pairs"].count() == s.count()


def test_missing_features_warn(spark):
    df = spark.createDataFrame([(1, 0.5)], "q int, a double")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert learn.with_missing(df, ["a", "b"]).first()["b"] is None
    assert any("b" in str(w.message) for w in seen)


def test_pools_and_dictionary_parts(spark):
    pool = spark.createDataFrame([("a", 1), ("b", 1)], "entity_id string, k int")
    extra = spark.createDataFrame([("b", 2), ("c", 2)], "entity_id string, k int")
    assert sorted(map(tuple, sampling.merged_pools(pool, extra).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    truth = spark.createDataFrame([("x", "1"), ("y", "2")], "q string, t string")
    own, rest = sampling.dictionary_part(truth, truth.filter("q = 'x'"))
    assert [r["q"] for r in own.collect()] == ["x"] and [r["q"] for r in rest.collect()] == ["y"]


def test_validation_finds_all_in_one_pass(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n")
    s1 = spark.createDataFrame([("S1-1",)], "entity_id string")
    assert linkage.validate(spark, str(path), None, s1, spark.createDataFrame([("S2-1",)], "entity_id string")) == ([], ["no candidate file"])
    errors, found = linkage.validate(spark, str(tmp_path / "none"), None, s1)
    assert len(errors) == 1 and len(found) == 2
