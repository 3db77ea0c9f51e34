"""Record linkage from sources to links: split, block, rank, score, tune, decide, evaluate; and the checks around it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import audit, blocking, decide, evaluate, learn, sampling
from ..sources import tsv

FEATURES = [
    "name_ratio", "name_token_sort", "name_token_set", "name_jaro_winkler", "name_jaccard_3gram", "name_len_diff", "addr_missing_either", "addr_token_jaccard", "addr_sort_ratio",
    "numeric_overlap", "numeric_conflict", "is_source_3", "compact_ratio", "addr_missing_both", "pin_match",
]


@dataclass
class Settings:
    """Sizes of splits, caps and model of a run."""

    splits: dict[str, int] = field(default_factory=lambda: {"train": 5000, "tune": 2000, "holdout": 2000})
    cap: int = 1000
    most: int = 50
    routes: tuple[str, ...] = blocking.ROUTES
    iterations: int = 150
    least_leaf: int = 20
    seed: int = 42
    ks: tuple[int, ...] = (5, 10, 20, 30, 50, 100)


def candidates(queries: DataFrame, pool: DataFrame, s: Settings) -> DataFrame:
    """Ranked candidate pairs (q, t, score, rank, features' inputs) of source records."""
    keys = lambda df: blocking.keys_v2(F.col("business_name"), F.col("business_address"), F.col("country"), s.routes)
    asked = blocking.exploded(queries, keys(queries), "entity_id").withColumnRenamed("entity_id", "q")
    posts = tsv.written(blocking.exploded(pool, keys(pool), "entity_id", "src", "line_idx").withColumnRenamed("entity_id", "t"), "postings")
    pairs = blocking.block_join(asked, posts, s.cap, blocking.TRUSTED_V2)
    side = lambda df, p: df.select(F.col("entity_id").alias(p), F.col("business_name").alias(f"{p}_name"), F.col("business_address").alias(f"{p}_address"))
    pairs = pairs.join(side(queries, "q"), "q").join(side(pool, "t"), "t")
    pairs = pairs.withColumns({"len_diff": F.abs(F.length("q_name") - F.length("t_name")), "tie": tx.tie_break(F.col("t_name"), F.col("t_address"), F.col("t"))})
    return blocking.top_k_v2(sim.composite_rank(pairs), s.most).withColumn("t_id", F.col("t")).drop("tie", "len_diff", "rank_v1", "rank_v2", "name_ratio")


def run(s1: DataFrame, pool: DataFrame, truth: DataFrame, settings: Settings | None = None) -> dict:
    """Train on one split, choose the threshold on the next, report on the others.

    s1 is (entity_id, business_name, business_address, country), pool the same
    with src and line_idx, truth (q, t). Returns recall at K and scores by
    split, the threshold, the model and the held-out links (a DataFrame).
    """
    s = settings or Settings()
    counts = truth.groupBy("q").agg(F.count("*").alias("n_true"))
    entities = s1.select(F.col("entity_id").alias("q"), "country").join(counts, "q", "left").na.fill(0, ["n_true"])
    split = sampling.stratified_split(entities, s.splits, s.seed).filter("split is not null").select("q", "country", "split").persist()
    own = s1.join(split.select(F.col("q").alias("entity_id"), "split"), "entity_id")
    ranked = candidates(own, pool, s).persist()
    featured = sim.pair_features_v2(ranked).join(truth.withColumn("label", F.lit(1)), ["q", "t"], "left").na.fill(0, ["label"]).join(split, "q").persist()
    out: dict = {"recall": {}, "scores": {}}
    try:
        model = learn.train_gbt(featured.filter("split = 'train'"), FEATURES, s.iterations, s.least_leaf, s.seed)
        scored = learn.score(model, featured.filter("split <> 'train'"), FEATURES).select("q", "t", "split", "country", "p", "label").persist()
        part = lambda df, name: df.filter(F.col("split") == name)
        mine = lambda name: truth.join(part(split, name).select("q"), "q", "left_semi")
        taus = [round(0.10 + 0.02 * i, 2) for i in range(43)]
        sweep = evaluate.threshold_sweep(part(split, "tune"), mine("tune"), part(scored, "tune"), taus)
        out["threshold"] = evaluate.best_threshold(sweep).first()["tau"]
        links = decide.decide(scored, out["threshold"], 0.0, 0.0, one_to_one=False)
        for name in s.splits:
            here = part(split, name)
            out["recall"][name] = evaluate.recall_at_k(mine(name), ranked.join(here.select("q"), "q", "left_semi"), here, list(s.ks)).first().asDict()
            if name != "train":
                rows = evaluate.macro_by(evaluate.per_entity(here.select("q", "country"), mine(name), part(links, name))).collect()
                out["scores"][name] = {r["country"] or "all": r.asDict() for r in rows}
        out["model"], out["links"] = model, links
        return out
    finally:
        for df in (split, ranked, featured):
            df.unpersist()


def error_cases(scores: DataFrame, pairs: DataFrame, per_query: int = 2, most: int = 5) -> DataFrame:
    """The first wrong or missed pairs (q, t, p, kind) of the lowest q's: at most per_query of each, `most` in all."""
    wrong = pairs.join(scores.filter("f05 < 1").select("q"), "q", "left_semi").filter("kind <> 'right'")
    ranked = blocking.top_k(wrong, per_query, F.desc("p"), F.col("t"))
    return ranked.orderBy("q", "rank").limit(most).drop("rank")


def dictionary_effect(pairs: DataFrame, before: str, after: str, other: str) -> DataFrame:
    """(n, before, after): mean similarity of names to their matches without and with a learned dictionary."""
    return pairs.agg(F.count("*").alias("n"), F.avg(sim.token_sort(F.col(before), F.col(other))).alias("before"), F.avg(sim.token_sort(F.col(after), F.col(other))).alias("after"))


def name_profile(queries: DataFrame, targets: DataFrame, missed: DataFrame, common: int = 12) -> DataFrame:
    """(common_share, quantiles): share of queries (q, name) whose name more than `common` targets bear, and quantiles of the scores of missed pairs."""
    n = queries.join(targets.groupBy("name").agg(F.count("*").alias("n")), "name", "left").na.fill(0, ["n"])
    share = n.agg(F.avg((F.col("n") > common).cast("double")).alias("common_share"))
    return share.crossJoin(F.broadcast(missed.agg(F.percentile("p", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("quantiles"))))


def validate(spark: SparkSession, matching: str, candidate: str | None, s1: DataFrame, targets: DataFrame | None = None, strict: bool = False) -> tuple[list[str], list[str]]:
    """Errors and warnings of result files; a file is valid if there are no errors.

    All rules of audit.violations, unreadable files, wrong headers and lines
    that are not UTF-8 are errors. An absent candidate file and unchecked ids
    are warnings, and so are matches outside the candidates unless strict.
    """
    errors, warnings, parsed = [], [], {}
    if targets is None:
        warnings.append("ids are not checked against the sources")
    for path, column in ((matching, "matched_entity_ids"), (candidate, "candidate_entity_ids")):
        if path is None:
            warnings.append("no candidate file")
            continue
        try:
            lines = spark.read.text(path)
            head = lines.first()
        except Exception:  # a missing or unreadable file is a finding, not a crash
            errors.append(f"{path}: cannot be read")
            continue
        broken = lines.filter(~F.is_valid_utf8("value")).count()
        if broken:
            errors.append(f"{path}: not valid UTF-8 in {broken} lines")
            continue
        wrong = audit.check_header(head["value"] if head else None, column)
        if wrong:
            errors.append(f"{path}: {wrong}")
            continue
        rows = audit.parse_result_file(lines.filter(F.lower(F.trim(F.regexp_replace("value", "\r", ""))) != f"source1_entity_id\t{column}"))
        parsed[column] = rows.filter("has_tab")
        for r in audit.violations(rows, s1, targets).orderBy("rule").collect():
            errors.append(f"{path}: {r['rule']}: {r['n']}, such as {', '.join(r['examples'])}")
    if len(parsed) == 2:
        n = audit.outside_candidates(*parsed.values()).count()
        if n:
            (errors if strict else warnings).append(f"{n} matches are not among the candidates")
    return errors, warnings


def read_sources(spark: SparkSession, s1: str, s2: str, s3: str, truth: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(s1, pool, truth) of the four files; the pool has src and line_idx in file order."""
    pool = [tsv.read_positional(spark, p, numbered=True).drop("n_extra").withColumn("src", F.lit(i)) for i, p in ((2, s2), (3, s3))]
    return tsv.read_positional(spark, s1).drop("n_extra"), pool[0].unionByName(pool[1]), tsv.truth_edges(tsv.read_truth(spark, truth))
