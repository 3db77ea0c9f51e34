import numpy as np
from pyspark.sql import functions as F

from kinweave.llm import langid, quality, quotes

SF = "/root/testdata/sf0.1"


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    model = quality.fit_quality(docs, seen)
    scored = quality.score_quality(docs, model).join(labels.join(seen, "doc_id", "left_anti"), "doc_id")
    good, bad = (scored.filter(F.col("quality") == k).agg(F.avg(F.col("keep").cast("double"))).first()[0] for k in (1, 0))
    assert good > 0.995 and bad < 0.05
    assert all(sum(moved[k] for moved in model.exchanged) > 0 for k in (0, 1))  # both views teach


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 0.1), (2, "", "en", "s", 0, 0.2), (None, "some words here", "en", "s", 15, 0.3), (3, "x " * 100_000, "en", "s", 200_000, 0.4), (3, "x", "en", "s", 1, 0.5)], "doc_id long, text string, lang string, source string, n_chars long, SCORE double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit_quality(docs, labels) is None
    out = quality.score_quality(docs, None).collect()
    assert len(out) == 5 and all(r["keep"] and r["score"] == 0.5 for r in out)
    assert quality.score_quality(docs.limit(0), None).count() == 0


def test_co_training_exchanges_labels():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    view = lambda: np.column_stack([y * 3.0 + rng.standard_normal(4000), rng.standard_normal(4000)])
    a, b = view(), view()
    model = quality.co_train(a[:800], b[:800], y[:800], a[800:2000], b[800:2000])
    assert model.exchanged[0][0] > 0 and model.exchanged[0][1] > 0
    p = model.score(a[2000:], b[2000:])
    right = [((x > 0.5) == y[2000:]).mean() for x in p]
    assert right[2] > max(right[:2]) and right[2] > 0.97


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.held_out(F.col("doc_id"))
    filters = langid.learn_filters(docs.filter(~held))
    out = langid.identify(docs, filters).filter(held)
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.99 and right[1] >= 0 and right[2] <= 1


def test_filters_hold_every_ngram_and_count_as_brute_force():
    texts = ["der Hund und die Katze", "the dog and the cat", "à bientôt, ça va"]
    masks, sets = np.zeros((1, langid.SLOTS), np.int64), []
    for b, t in enumerate(texts):
        codes, _, _ = langid.grams([t])
        sets.append(set(codes.tolist()))
        for k in range(langid.HASHES):
            np.bitwise_or.at(masks[0], langid.slots_of(codes, k), 1 << b)
    f = langid.Filters(["de", "en", "fr"], masks, np.zeros(3), np.ones(3) / 3)
    mixed = [*texts, "the Hund", "", "42 !?", "A", "x" * 200_000]
    hits, total, letters = f.counts(mixed)
    for i, t in enumerate(mixed):
        codes = langid.grams([t])[0].tolist()
        assert total[i] == len(codes)
        assert hits[i].tolist() == [sum(c in s for c in codes) for s in sets]
    assert letters.tolist() == [True] * 4 + [False, False, True, True]
    names, score = f.decide(mixed)
    assert names[:3] == ["de", "en", "fr"] and names[4:6] == ["und", "und"] and score[4] == 0


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "words", None), (3, "some words", "en"), (None, "encore des mots", "fr")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    out = langid.identify(docs, langid.learn_filters(docs)).collect()
    assert len(out) == 4 and [r["lang_pred"] for r in out if r["doc_id"] == 1] == ["und"]
    assert langid.learn_filters(docs.limit(0)).languages == []
    assert langid.identify(docs, langid.learn_filters(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


CHAT = [
    (1, 0, "user", "Hello there.\nWhat is the plan for Monday?"),
    (1, 1, "assistant", "> What is the plan for\n> Monday?\nWe ship the release."),
    (1, 2, "user", "On Tue, X wrote:\n> > what is the PLAN for monday\n> We ship the release.\n\nFine with me."),
    (1, 3, "user", "Something new entirely"),
    (1, 4, "assistant", ">hello there\n>>nobody wrote this\nHi!"),
    (2, 0, "user", "> Hello there.\nquoted from elsewhere"),
    (2, 1, "user", None),
    (None, 0, "user", "no conversation"),
    (3, 5, "user", ""),
    (3, 5, "user", ""),
    (3, None, "user", "> "),
]


def test_quotes_become_replies(spark):
    df = spark.createDataFrame([(*r, 1) for r in CHAT], "conv_id long, turn long, role string, text string, position int")
    out = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    assert len(out) == 10
    at = lambda c, t: out[(c, t)]
    assert at(1, 1)["reply_turn"] == 0 and at(1, 1)["text"] == "We ship the release." and at(1, 1)["n_quotes"] == 1
    assert at(1, 2)["reply_turn"] == 1 and at(1, 2)["text"] == "Fine with me." and at(1, 2)["depth"] == 2 and at(1, 2)["n_quotes"] == 2 and at(1, 2)["n_linked"] == 2
    assert at(1, 3)["reply_turn"] is None and at(1, 3)["depth"] == 0 and at(1, 3)["root_turn"] == 3
    assert at(1, 4)["reply_turn"] == 0 and at(1, 4)["n_linked"] == 1 and at(1, 4)["text"] == "Hi!"
    assert [at(1, t)["position"] for t in (0, 1, 2, 4, 3)] == [1, 2, 3, 4, 5]
    assert at(2, 0)["n_quotes"] == 1 and at(2, 0)["n_linked"] == 0 and at(2, 0)["text"] == "quoted from elsewhere" and at(2, 1)["text"] is None
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_long_chains_and_hot_phrases(spark):
    rows = [(1, t, "user", (f"> message number {t - 1}\n" if t else "") + f"message number {t}") for t in range(40)]
    rows += [(2, t, "user", "> thanks a lot\nthanks a lot") for t in range(300)]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in out:
        assert r["depth"] == r["turn"] and r["root_turn"] == 0 and r["position"] == r["turn"] + 1
        assert r["reply_turn"] == (r["turn"] - 1 if r["turn"] else None)


def test_native_plan(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    plan = quotes.link_quotes(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
