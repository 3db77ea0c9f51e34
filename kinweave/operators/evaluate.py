"""Evaluation of links and candidates.

Edges are (q, t) rows; entities are one row per S1 record, so that records
without any match count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of one entity: 1 if both lists are empty, 0 if nothing is right."""
    p, r = tp / F.greatest(predicted, F.lit(1)), tp / F.greatest(true, F.lit(1))
    return F.when((true == 0) & (predicted == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * p * r / F.greatest(0.25 * p + r, F.lit(1e-300)))


def per_entity(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """entities (q, ...) with n_true, n_pred, tp, precision, recall and f05."""
    edges = truth.select("q", "t", F.lit(1).alias("a"), F.lit(0).alias("b")).union(predicted.select("q", "t", F.lit(0), F.lit(1)))
    pairs = edges.groupBy("q", "t").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = pairs.groupBy("q").agg(F.sum("a").alias("n_true"), F.sum("b").alias("n_pred"), F.sum(F.col("a") * F.col("b")).alias("tp"))
    out = entities.join(counts, "q", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    both = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    return out.withColumns({"precision": F.when(both, 1.0).otherwise(F.col("tp") / F.greatest("n_pred", F.lit(1))), "recall": F.when(both, 1.0).otherwise(F.col("tp") / F.greatest("n_true", F.lit(1))), "f05": f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))})


def summary_columns() -> list[Column]:
    alone = F.col("n_true") == 0
    return [
        F.count("*").alias("n"), F.avg("f05").alias("macro_f05"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.count_if(alone).alias("n_singletons"), F.avg(F.when(alone, (F.col("n_pred") == 0).cast("double"))).alias("singleton_accuracy"),
        F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_true") - F.col("tp")).alias("fn"),
    ]


def macro(scores: DataFrame) -> DataFrame:
    """Overall summary of per_entity."""
    return scores.agg(*summary_columns())


def macro_by(scores: DataFrame, column: str = "country") -> DataFrame:
    """Summaries by a column, and one over all rows, where it is null: one pass of grouping sets."""
    return scores.rollup(column).agg(*summary_columns())


def recall_at_k(truth: DataFrame, ranked: DataFrame, entities: DataFrame, ks: list[int]) -> DataFrame:
    """One row: pooled recall at each k over true pairs, with mean and 95th percentile of list lengths over all entities."""
    hits = truth.join(ranked.select("q", "t", "rank"), ["q", "t"], "left")
    recalls = hits.agg(F.count("*").alias("n_true"), *[F.try_divide(F.count_if(F.col("rank") <= k), F.count("*")).alias(f"recall_at_{k}") for k in ks])
    sizes = entities.join(ranked.groupBy("q").agg(F.count("*").alias("n")), "q", "left").na.fill(0, ["n"])
    lengths = sizes.agg(F.avg("n").alias("avg_candidates"), F.percentile("n", 0.95).alias("p95_candidates"))
    return recalls.crossJoin(F.broadcast(lengths))


def blocker_recall(labelled: DataFrame, n_true: int | Column, blockers: list[str]) -> DataFrame:
    """(blocker, pairs, recall) of each blocker alone, from a merged candidate table with label and <blocker>_rank."""
    alone = [F.struct(F.lit(b).alias("blocker"), F.col(f"{b}_rank").alias("rank")) for b in blockers]
    rows = labelled.select("label", F.explode(F.array(*alone)).alias("b")).filter("b.rank < 99")
    n = n_true if isinstance(n_true, Column) else F.lit(n_true)
    return rows.groupBy("b.blocker").agg(F.count("*").alias("pairs"), (F.sum("label") / n).alias("recall"))


def matched_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, nq, nt, both: rows (src, ...) of source 1 and of others per value, and how many pairs those are; null matches nothing."""
    own = F.col("src") == 1
    out = rows.dropna(subset=by).groupBy(*by).agg(F.count_if(own).alias("nq"), F.count_if(~own).alias("nt"))
    return out.withColumn("both", F.col("nq") * F.col("nt"))


def key_recall(rows: DataFrame) -> DataFrame:
    """(blocker, pairs, found) of blockers that give a record (src, entity_id, copy, blocker, key) at most one key.

    Pairs of one key are a product of two counts, and true pairs among them
    (those of one copy) are as well, so no pair is made. An entity_id of several
    rows is paired once per key, and once more for each further true pair; its
    rows, and those that they meet, are compared one by one.
    """
    odd = rows.groupBy("blocker", "entity_id").agg(F.count("*").alias("n")).filter("n > 1").select("blocker", "entity_id")
    usual = rows.join(odd, ["blocker", "entity_id"], "left_anti")
    pairs = matched_counts(usual, ["blocker", "key"]).groupBy("blocker").agg(F.sum("both").alias("pairs"), F.sum(F.lit(0)).alias("found"))
    found = matched_counts(usual, ["blocker", "key", "copy"]).groupBy("blocker").agg(F.sum(F.lit(0)).alias("pairs"), F.sum("both").alias("found"))
    # pairs with an odd side: distinct ones, each with its number of true pairs
    some = rows.join(odd.withColumn("odd", F.lit(True)), ["blocker", "entity_id"], "left").na.fill(False, ["odd"])
    q = some.filter("src = 1").select("blocker", "key", F.col("entity_id").alias("q"), F.col("odd").alias("oq"))
    t = some.filter("src > 1").select("blocker", "key", F.col("entity_id").alias("t"), F.col("odd").alias("ot"))
    met = q.filter("oq").join(t, ["blocker", "key"]).select("blocker", "q", "t").unionByName(q.join(t.filter("ot"), ["blocker", "key"]).select("blocker", "q", "t")).distinct()
    copies = rows.select("src", "entity_id", "copy", "blocker").join(odd.select("blocker").distinct(), "blocker", "left_semi")
    one = copies.filter("src = 1").groupBy("blocker", F.col("entity_id").alias("q")).agg(F.collect_list("copy").alias("cq"))
    two = copies.filter("src > 1").groupBy("blocker", F.col("entity_id").alias("t")).agg(F.collect_list("copy").alias("ct"))
    true = F.aggregate("cq", F.lit(0).cast("long"), lambda n, c: n + F.size(F.filter("ct", lambda x: x == c)))
    odds = met.join(one, ["blocker", "q"]).join(two, ["blocker", "t"]).withColumn("true", true).groupBy("blocker").agg(F.sum(F.greatest("true", F.lit(1))).alias("pairs"), F.sum("true").alias("found"))
    return pairs.unionByName(found).unionByName(odds).groupBy("blocker").agg(F.sum("pairs").cast("long").alias("pairs"), F.sum("found").cast("long").alias("found")).filter("pairs > 0")


def ceiling(entities: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per entity, the F0.5 of a perfect classifier on the candidates: q, n_true, found, ceiling."""
    found = truth.join(candidates.select("q", "t").distinct().withColumn("hit", F.lit(1)), ["q", "t"], "left").groupBy("q").agg(F.count("*").alias("n_true"), F.count("hit").alias("found"))
    out = entities.select("q").join(found, "q", "left").na.fill(0, ["n_true", "found"])
    r = F.col("found") / F.greatest("n_true", F.lit(1))
    return out.withColumn("ceiling", F.when(F.col("n_true") == 0, 1.0).when(F.col("found") == 0, 0.0).otherwise(1.25 * r / (0.25 + r)))


def threshold_sweep(entities: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(tau, macro_f05) for each threshold, without scoring or joining anew per threshold.

    Each pair is counted from its own threshold down: per entity and threshold
    step, pairs and hits are summed and accumulated, so rows grow with entities
    that change, not with entities times thresholds times pairs.
    """
    taus = F.array(*map(F.lit, thresholds))
    pairs = scored.select("q", "t", "p").join(truth.select("q", "t").distinct().withColumn("label", F.lit(1)), ["q", "t"], "left")
    steps = pairs.withColumn("step", F.size(F.filter(taus, lambda x: F.col("p") >= x))).filter("step > 0")
    n_true = truth.distinct().groupBy("q").agg(F.count("*").alias("n_true"))
    # an entity changes where a pair enters: at step s and below
    change = steps.groupBy("q", "step").agg(F.count("*").alias("n"), F.count("label").alias("h"))
    w = Window.partitionBy("q").orderBy(F.desc("step"))
    state = change.withColumns({"n_pred": F.sum("n").over(w), "tp": F.sum("h").over(w), "until": F.coalesce(F.lead("step").over(w), F.lit(0))})
    state = state.join(n_true, "q", "left").na.fill(0, ["n_true"]).withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))
    empty = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    # steps until+1..step have this state; relative to an entity that predicts nothing
    gain = state.select(F.explode(F.sequence(F.col("until") + 1, F.col("step"))).alias("step"), (F.col("f") - empty).alias("gain")).groupBy("step").agg(F.sum("gain").alias("gain"))
    base = entities.select("q").join(n_true, "q", "left").agg(F.count("*").alias("n"), F.count_if(F.col("n_true").isNull()).alias("alone"))
    grid = entities.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(thresholds)], "step int, tau double")
    return F.broadcast(grid).join(gain, "step", "left").crossJoin(F.broadcast(base)).select("tau", ((F.coalesce("gain", F.lit(0.0)) + F.col("alone")) / F.col("n")).alias("macro_f05"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold of the best F0.5 to four decimals."""
    return sweep.withColumn("macro_f05", F.round("macro_f05", 4)).orderBy(F.desc("macro_f05"), "tau").limit(1)


def error_taxonomy(scores: DataFrame, found: DataFrame) -> DataFrame:
    """(country, category, n, lost_points, share) of per_entity with country; found is (q, found): true pairs among the candidates."""
    s = scores.join(found.select("q", "found"), "q", "left").na.fill(0, ["found"])
    true, pred, tp = F.col("n_true"), F.col("n_pred"), F.col("tp")
    alone = F.when(pred == 0, "singleton OK").otherwise("singleton but matched")
    silent = F.when(F.col("found") == 0, "nothing predicted, blocking missed all").otherwise("nothing predicted, model rejected")
    complete = F.when(pred == tp, "perfect").otherwise("all found + extra wrong")
    short = F.when(pred != tp, "missed some + extra wrong").when(F.col("found") > tp, "missed some, model rejected").otherwise("missed some, blocking missed")
    s = s.withColumn("category", F.when(true == 0, alone).when(pred == 0, silent).when(tp == true, complete).otherwise(short))
    total = s.agg(F.count("*").alias("all_n"), F.sum(1 - F.col("f05")).alias("all_loss"))
    by = s.groupBy("country", "category").agg(F.count("*").alias("n"), F.sum(1 - F.col("f05")).alias("loss"))
    return by.crossJoin(F.broadcast(total)).select("country", "category", "n", (F.col("loss") / F.col("all_n") * 100).alias("lost_points"), F.coalesce(F.try_divide("loss", "all_loss") * 100, F.lit(0.0)).alias("share"))


def roc_auc(scored: DataFrame, p: str = "p", label: str = "label", cells: int = 4096) -> DataFrame:
    """Exact area under the curve from counts per distinct score in [0, 1], ties at half.

    Running counts are taken inside cells of scores; what lies below a cell comes from one row per cell.
    """
    by = scored.groupBy(F.col(p).alias("p")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")).withColumn("cell", F.floor(F.col("p") * cells))
    whole = by.groupBy("cell").agg(F.sum("neg").alias("neg"))
    start = whole.select("cell", F.coalesce(F.sum("neg").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = by.withColumn("below", below).join(F.broadcast(start), "cell")
    return area.agg(F.try_divide(F.sum(F.col("pos") * (F.col("start") + F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def drift(entities: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """(country, now_mean, now_none, before_mean, before_none): predicted matches per entity, and the share without any, of two prediction sets."""

    def side(predicted: DataFrame, name: str) -> DataFrame:
        n = entities.join(predicted.groupBy("q").agg(F.count("*").alias("n")), "q", "left").na.fill(0, ["n"])
        return n.groupBy("country").agg(F.avg("n").alias(f"{name}_mean"), F.avg((F.col("n") == 0).cast("double")).alias(f"{name}_none"))

    return side(now, "now").join(side(before, "before"), "country", "full")


def orphan_share(own: DataFrame, orphans: DataFrame, seen: DataFrame, bins: int = 200) -> DataFrame:
    """(country, share): weight w of the orphans' density in the seen density, of similarities `s` in [0, 1], by least squares, clipped to 0..1."""

    def density(df: DataFrame, name: str) -> DataFrame:
        cell = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).alias("cell")
        n = df.select("country", cell).groupBy("country", "cell").agg(F.count("*").alias("n"))
        return n.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy("country"))).drop("n")

    h = density(seen, "h").join(density(own, "a"), ["country", "cell"], "full").join(density(orphans, "b"), ["country", "cell"], "full").na.fill(0.0)
    d = F.col("b") - F.col("a")
    w = F.coalesce(F.try_divide(F.sum((F.col("h") - F.col("a")) * d), F.sum(d * d)), F.lit(0.0))
    return h.groupBy("country").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)).alias("share"))


def name_counts(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """queries (q, country, name) with s1_same_name and t_same_name: records of either side with the same name and country."""
    tagged = queries.select("country", "name", F.lit(1).alias("a"), F.lit(0).alias("b")).union(targets.select("country", "name", F.lit(0), F.lit(1)))
    counts = tagged.groupBy("country", "name").agg(F.sum("a").alias("s1_same_name"), F.sum("b").alias("t_same_name"))
    return queries.join(counts, ["country", "name"])


def candidate_gaps(pairs: DataFrame, columns: list[str], by: str = "q") -> DataFrame:
    """pairs with, for each column, its rank in the query (ties share the least) and its distance to the best, and n_cands."""
    w = Window.partitionBy(by)
    out = {"n_cands": F.count("*").over(w)}
    for c in columns:
        out |= {f"{c}_rank": F.rank().over(w.orderBy(F.desc(c))), f"{c}_gap": F.max(c).over(w) - F.col(c)}
    return pairs.withColumns(out)


def auto_blocking(options: list[dict], most: float, least_gain: float) -> dict:
    """Of options with cands and recall, the costliest worth it: from the cheapest up within `most`, moving only for a gain of least_gain."""
    fitting = sorted((o for o in options if o["cands"] <= most), key=lambda o: o["cands"]) or sorted(options, key=lambda o: o["cands"])[:1]
    chosen = fitting[0]
    for o in fitting[1:]:
        if o["recall"] - chosen["recall"] >= least_gain:
            chosen = o
    return chosen
