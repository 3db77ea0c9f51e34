import random

import pytest

from kinweave.operators import knn
from kinweave.plans import linkage

COLS = "entity_id string, business_name string, business_address string, country string, src int, line_idx int"


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(3))
    s1, pool, truth = [], [], []
    for i in range(160):
        name, address = f"{word()} {word()} Ltd", f"{rng.randint(1, 99)} {word()} Road {rng.randint(100000, 999999)}"
        country = rng.choice(["US", "IN"])
        s1.append((f"S1-{i}", name, address, country, 1, i))
        for src in (2, 3):
            if rng.random() < 0.7:
                noisy = name.replace("Ltd", rng.choice(["Limited", "ltd.", ""])).upper()
                pool.append((f"S{src}-{i}", noisy, rng.choice([address, ""]), country, src, i))
                truth.append((f"S1-{i}", f"S{src}-{i}"))
        pool.append((f"S2-{1000 + i}", f"{name.split()[0]} {word()}", f"1 {word()}", country, 2, 1000 + i))
    return spark.createDataFrame(s1, COLS), spark.createDataFrame(pool, COLS), spark.createDataFrame(truth, "q string, t string")


def test_end_to_end(spark, sources):
    s1, pool, truth = sources
    out = linkage.run(s1.select("entity_id", "business_name", "business_address", "country"), pool, truth, linkage.Settings(splits={"train": 70, "tune": 40, "holdout": 40}, iterations=4, least_leaf=2))
    assert out["recall"]["holdout"]["recall_at_50"] > 0.9
    assert out["scores"]["holdout"]["all"]["macro_f05"] > 0.8 and 0.1 <= out["threshold"] <= 0.94
    assert out["links"].count() > 0


def test_validator(spark, sources, tmp_path):
    s1, pool, _ = sources
    need = s1.filter("line_idx < 3").select("entity_id")
    good, bad, cand = tmp_path / "m.tsv", tmp_path / "b.tsv", tmp_path / "c.tsv"
    good.write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-1000\nS1-1\t\nS1-2\t\n")
    cand.write_text("source1_entity_id\tcandidate_entity_ids\nS1-0\tS2-1001\nS1-1\t\nS1-2\t\n")
    bad.write_text("source1_entity_id,matched_entity_ids\n")
    errors, warnings = linkage.validate(spark, str(good), str(cand), need, pool)
    assert errors == [] and warnings == ["1 matches are not among the candidates"]
    errors, warnings = linkage.validate(spark, str(bad), None, need)
    assert len(errors) == 1 and "comma" in errors[0] and len(warnings) == 2
    assert linkage.validate(spark, str(tmp_path / "none.tsv"), None, need)[0]


def test_small_reports(spark):
    scores = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "q string, f05 double")
    pairs = spark.createDataFrame([("a", "x", 0.9, "wrong"), ("a", "y", 0.8, "missed"), ("a", "z", 0.7, "wrong"), ("b", "x", 0.9, "wrong")], "q string, t string, p double, kind string")
    assert [r["t"] for r in linkage.error_cases(scores, pairs).collect()] == ["x", "y"]
    names = spark.createDataFrame([("lksmi shop", "lakshmi shop", "lakshmi shop")], "a string, b string, c string")
    r = linkage.dictionary_effect(names, "a", "b", "c").first()
    assert r["before"] < r["after"] == 100
    profile = linkage.name_profile(spark.createDataFrame([("q", "n")], "q string, name string"), spark.createDataFrame([("n",)] * 13, "name string"), pairs).first()
    assert profile["common_share"] == 1 and len(profile["quantiles"]) == 5


def test_vector_features(spark):
    q = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [0.6, 0.8])], "q string, g int, v array<double>")
    t = spark.createDataFrame([("x", 1, [0.0, 1.0])], "t string, g int, v array<double>")
    pairs = spark.createDataFrame([("a", "x"), ("b", "x")], "q string, t string")
    near = spark.createDataFrame([("a", "b")], "q string, nn string")
    rows = {r["q"]: r for r in knn.vector_features(pairs, q, t, ["g"], near).collect()}
    assert rows["a"]["dl_cos"] == 0 and rows["a"]["dl_t_gap"] == pytest.approx(0.8) and rows["a"]["dl_nn_margin"] == pytest.approx(-0.8)
    assert rows["b"]["dl_t_gap"] == 0 and rows["b"]["dl_nn_margin"] == 0
