"""Evaluation runs: out of time, cross-validation, unseen wording, rolling backtest, challengers, switches.

All folds of a scheme are fitted and scored in one job (see ``operators.splits``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import clean as C
from ..operators import evidence as E
from ..operators import metrics as M
from ..operators import splits as S
from ..operators import stats as T
from ..operators.lookups import lookup
from ..operators.repair import corrupt
from ..operators.route import first_rule, majority_fallback, readings_of, route, same_readings
from ..session import publish


# ------------------------------------------------------------------------------------ schemes
def out_of_time(history: DataFrame) -> tuple[DataFrame, S.Splits]:
    return history.withColumn("bucket", S.out_of_time_bucket(F.col("created_at"))), S.OUT_OF_TIME


def rolling(history: DataFrame) -> tuple[DataFrame, S.Splits]:
    return history.withColumn("bucket", S.quarter_bucket(F.col("created_at"))), S.rolling()


def cross_validation(history: DataFrame, k: int = 5) -> tuple[DataFrame, S.Splits]:
    return S.stratified_bucket(history, "final_team_cur", "request_id", k), S.k_fold(k)


def held_out(history: DataFrame, group: Column, k: int = 5) -> tuple[DataFrame, S.Splits]:
    """Folds by wording: no wording of a scored row is in the history it is scored from."""
    grouped = history.withColumn("_group", group)
    buckets = S.group_buckets(grouped, "_group", k)
    return lookup(grouped, buckets, ["_group"], ["request_id"]).drop("_group"), S.k_fold(k)


def run(scheme: tuple[DataFrame, S.Splits], features=L.DEFAULT_FEATURES, rules=None, fallback=majority_fallback,
        paraphrases: DataFrame | None = None, evidence: E.Evidence | None = None, teams: DataFrame | None = None,
        where: Column | None = None, readings: DataFrame | None = None) -> DataFrame:
    """Fit (unless ``evidence`` is given) and decide all scored rows of a scheme; the history is already parsed."""
    history, splits = scheme
    evidence = evidence or E.fit(history, splits=splits, features=features, paraphrases=paraphrases, teams=teams, parsed=True)
    rows = splits.scored(history if where is None else history.where(where))
    return route(rows, evidence, features, rules, fallback, parsed=True, readings=readings)


def check_no_leak(decided: DataFrame) -> DataFrame:
    """Rows of a held-out scheme that were decided from known wording; must be empty."""
    return decided.where((F.col("route_type") == "seen") & (F.col("route_detail") == "exact"))


# ------------------------------------------------------------------------------------ vague rules
def vague_override(decided: DataFrame, new: Column, out: str) -> DataFrame:
    """Another decision for vague requests only."""
    return decided.withColumn(out, F.when(F.col("route_type") == "vague", F.coalesce(new, F.col("team"))).otherwise(F.col("team")))


def top_team(values: Column) -> Column:
    return F.try_element_at(E.ranked(values), F.lit(1))["team"]


def pooled_vague(evidence: E.Evidence) -> DataFrame:
    """(split) -> pooled_team, pooled counts; one row per split."""
    return evidence.stats.select("split", "pooled_team", "pooled_counts", "pooled_n")


def recent_vague(history: DataFrame, splits: S.Splits, months: int = 6) -> DataFrame:
    """(split) -> most common outcome of vague requests in the last months before the split's cut."""
    rows = history.withColumn("split", F.explode(splits.learners(F.col("bucket")))).select("split", "created_at", "vague", "final_team_cur")
    until = rows.groupBy("split").agg(F.max("created_at").alias("_until"))
    recent = rows.where("vague").join(F.broadcast(until), "split").where(  # one row per split
        F.col("created_at") >= F.col("_until") - F.make_ym_interval(F.lit(0), F.lit(months)))
    return E.with_majority(E.team_counts(recent.withColumn("n", F.lit(1)), ["split"], "final_team_cur")).select(
        "split", F.col("team").alias("recent_team"))


def with_vague_rules(decided: DataFrame, evidence: E.Evidence, recent: DataFrame | None = None) -> DataFrame:
    """Adds one column per decision rule for vague requests (they differ on vague rows only)."""
    post1 = publish(E.shrunk_posterior(evidence.base, ["product_family"]).select("split", "product_family", F.col("post").alias("post1")), "post1")
    post2 = publish(E.shrunk_posterior(evidence.base, ["product_family", "warranty_status"]).select(
        "split", "product_family", "warranty_status", F.col("post").alias("post2")), "post2")
    key = ["split", "request_id"]
    rows = decided.join(F.broadcast(pooled_vague(evidence)), "split")  # one row per split
    rows = lookup(rows, post1, ["split", "product_family"], key)
    rows = lookup(rows, post2, ["split", "product_family", "warranty_status"], key)
    prior = F.transform("pooled_counts", lambda c: c / F.col("pooled_n"))
    rows = rows.withColumns({"post1": F.coalesce("post1", prior), "post2": F.coalesce("post2", prior)})
    rows = vague_override(rows, F.col("pooled_team"), "rule_pooled")
    rows = vague_override(rows, top_team(F.col("post1")), "rule_product")
    rows = vague_override(rows, top_team(F.col("post2")), "rule_product_warranty")
    for gamma, name in ((0.5, "rule_rebalanced_half"), (1.0, "rule_rebalanced_full")):
        rows = vague_override(rows, top_team(E.rebalanced(F.col("post1"), F.col("pooled_counts"), F.col("pooled_n"), gamma)), name)
    rows = vague_override(rows, random_team(F.col("request_id"), F.col("pooled_counts"), F.col("pooled_n")), "rule_random")
    if recent is not None:
        rows = vague_override(rows.join(F.broadcast(recent), "split", "left"), F.col("recent_team"), "rule_recent")
    return rows.drop("post1", "post2", "pooled_team", "pooled_counts", "pooled_n", "recent_team")


def random_team(row_id: Column, counts: Column, n: Column, seed: int = 0) -> Column:
    """A team drawn in proportion to past outcomes; the draw is a hash of the row."""
    u = (S.stable_hash(row_id, F.lit(seed)) % 1_000_000) / 1e6 * n
    cum = F.transform(counts, lambda c, i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return F.element_at(F.array(*map(F.lit, L.TEAMS)), F.size(F.filter(cum, lambda c: c <= u)) + 1)


VAGUE_RULES = {
    "pooled": "rule_pooled",
    "by product": "rule_product",
    "by product, half rebalanced": "rule_rebalanced_half",
    "by product, fully rebalanced": "rule_rebalanced_full",
    "hashed draw": "rule_random",
}


def reported(decided: DataFrame) -> DataFrame:
    """A decision without its reasons, its question and the parsed text: what reports count. Those columns are then not worked out."""
    return decided.drop("reasons", "clarifying_question", "deciding_request", "alternatives_basis", "model_version", "norm", "first",
                        "last", "n_clauses")


def as_long(decided: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per (request, model): the decision columns side by side become rows."""
    return decided.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(c).alias("pred")) for name, c in columns.items()])).alias("m")).select(
        *keep, "m.model", "m.pred")


def vague_rule_table(ruled: DataFrame, cost_per_miss: DataFrame) -> DataFrame:
    """Accuracy, macro-F1, vague accuracy and misroute cost per 1,000 requests, per rule for vague requests."""
    long = as_long(ruled, VAGUE_RULES, ["split", "request_id", "final_team_cur", "route_type"])
    ok = M.right("pred")
    acc = long.groupBy("model").agg(F.avg(ok).alias("accuracy"), M.mean_where(ok, F.col("route_type") == "vague").alias("vague_accuracy"))
    f1 = M.macro_f1(long, "pred", ["model"])
    one = F.lit(1)
    out = acc.join(f1, "model").withColumn("_k", one).join(F.broadcast(cost_per_miss.withColumn("_k", one)), "_k")  # one row
    return out.select(F.col("model").alias("rule"), "accuracy", "macro_f1", "vague_accuracy",
                      ((1 - F.col("accuracy")) * 1000 * F.col("cost_per_miss")).alias("cost_per_1000"))


# ------------------------------------------------------------------------------------ challengers
def compare(long: DataFrame, champion: str, by: list[str] = ()) -> DataFrame:
    """Champion against challengers on the same requests: accuracy, wins, losses, exact p, Holm p.

    ``long`` has split, request_id, model, pred, final_team_cur, route_type. Rows that carry the champion's decision
    (``champion``) are paired already; others meet the champion's row by request, never by row positions.
    """
    ok = M.right("pred") == 1
    key = [*by, "split", "request_id"]
    if "champion" in long.columns:
        paired = long.withColumns({"ok": ok, "champion_ok": M.right("champion") == 1})
    else:
        paired = long.withColumn("ok", ok).join(long.where(F.col("model") == champion).select(*key, ok.alias("champion_ok")), key, "left")
    out = paired.groupBy(*by, "model").agg(
        F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("pooled_acc"),
        M.mean_where(F.col("ok").cast("int"), F.col("route_type") != "vague").alias("clear"),
        M.mean_where(F.col("ok").cast("int"), F.col("route_type") == "vague").alias("vague"),
        (100 * (F.avg(F.col("ok").cast("int")) - F.avg(F.col("champion_ok").cast("int")))).alias("delta_pts"),
        *T.paired_counts(F.col("ok"), F.col("champion_ok")))
    challengers = T.holm(out.where(F.col("model") != champion).withColumn("p", T.paired_p(F.col("wins"), F.col("losses"))), "p", by)
    return challengers.unionByName(out.where(F.col("model") == champion), allowMissingColumns=True)


def fold_accuracy(long: DataFrame) -> DataFrame:
    """One row per model, one accuracy column per quarter."""
    cols = {i: name for i, (name, _, _) in enumerate(L.QUARTERS)}
    return long.groupBy("model").agg(*[F.avg(F.when(F.col("split") == i, M.right("pred"))).alias(
        "acc_" + name.lower().replace("-", "_").replace(" ", "_")) for i, name in cols.items()])


def beats_champion(table: DataFrame) -> DataFrame:
    """The decision rule: more accurate, and significantly so after correction."""
    return table.where((F.col("delta_pts") > 0) & (F.col("p_holm") < 0.05))


def majority_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.when(b == c, b).otherwise(a)


def challenger_rows(history: DataFrame, features=L.DEFAULT_FEATURES, fallback=majority_fallback) -> DataFrame:
    """Rolling backtest of the champion and the count-based challengers, long form."""
    scheme = rolling(history)
    evidence = E.fit(scheme[0], splits=scheme[1], features=features, parsed=True)
    decided = publish(reported(run(scheme, features, fallback=fallback, evidence=evidence)).withColumn("champion", F.col("team")), "champion")
    ruled = with_vague_rules(decided, evidence, recent_vague(*scheme))
    keep = ["split", "request_id", "final_team_cur", "route_type", "champion"]
    long = as_long(ruled, {
        "cascade": "team", "unclear: product": "rule_product",
        "unclear: half a year": "rule_recent", "unclear: product and cover": "rule_product_warranty",
    }, keep)
    # the other minimum supports re-read the same counts; the route type stays the champion's
    for k in (1, 10):
        other = run(scheme, features, fallback=fallback, evidence=evidence.with_support(k)).select(
            "split", "request_id", F.col("team").alias("pred"))
        long = long.unionByName(decided.select(*keep).join(other, ["split", "request_id"]).withColumn("model", F.lit(f"support {k}")))
    return long


# ------------------------------------------------------------------------------------ simple models
def baseline_rules(history: DataFrame, rules=None) -> DataFrame:
    """Rules on the deciding request, no training; what matches nothing goes to the default team."""
    return history.withColumn("team", F.coalesce(first_rule(F.col("last"), rules or L.BASELINE_RULES), F.lit(L.BASELINE_DEFAULT)))


def lookup_model(scheme: tuple[DataFrame, S.Splits], fallback: Column | None = None) -> DataFrame:
    """Majority outcome per deciding request over all rows (no minimum support); else the fallback, else the most common team."""
    history, splits = scheme
    learned = history.withColumn("split", F.explode(splits.learners(F.col("bucket")))).groupBy("split", "last", "final_team_cur").agg(
        F.count("*").alias("n"))
    table = publish(E.with_majority(E.team_counts(learned, ["split", "last"], "final_team_cur")).select(
        "split", "last", F.col("team").alias("known_team")), "lookup_model")
    overall = E.with_majority(E.team_counts(learned, ["split"], "final_team_cur")).select("split", F.col("team").alias("majority_team"))
    rows = lookup(splits.scored(history), table, ["split", "last"], ["split", "request_id"])
    rows = rows.join(F.broadcast(overall), "split")  # one row per split
    return rows.withColumn("team", F.coalesce(*([F.col("known_team")] + ([fallback] if fallback is not None else []) + [F.col("majority_team")])))


def simple_models(scheme: tuple[DataFrame, S.Splits]) -> DataFrame:
    """Accuracy per simple model: mean and spread over the splits of a scheme."""
    history, splits = scheme
    evidence = E.fit(history, splits=splits, features=frozenset(), parsed=True)
    rows = publish(splits.scored(history), "scored_rows")
    looked_up = lookup_model(scheme)
    cascade = publish(run(scheme, frozenset(), [], evidence=evidence).select(
        "split", "request_id", "last", "vague", "final_team_cur", "bot_team", "route_type", "team"), "hybrid")

    def hybrid(rules):
        ruled = F.coalesce(first_rule(F.col("last"), rules), F.lit(L.BASELINE_DEFAULT))
        return cascade.withColumn("team", F.when(F.col("route_type").isin("new_wording", "empty"), ruled).otherwise(F.col("team")))

    models = {
        "rules on the last request": baseline_rules(rows), "lookup on the last request": looked_up,
        "most common team": looked_up.withColumn("team", F.col("majority_team")),
        "hybrid, shipped words": hybrid(L.BASELINE_RULES), "hybrid, team words": hybrid(L.TEAM_WORD_RULES),
        "vendor bot": rows.withColumn("team", F.col("bot_team")),
    }
    out = None
    for name, decided in models.items():
        one = M.accuracy(decided, ["split"], vague=F.col("vague")).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("model").agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("vs_outcome", "vs_bot", "clear", "vague")],
                                    F.stddev_samp("vs_outcome").alias("sd"))


def robustness(scheme: tuple[DataFrame, S.Splits], rules) -> DataFrame:
    """Mean and spread over folds of the decision rules for vague requests."""
    evidence = E.fit(scheme[0], splits=scheme[1], features={"A1"}, parsed=True)
    ruled = with_vague_rules(publish(reported(run(scheme, {"A1"}, rules, evidence=evidence)), "robust"), evidence)
    long = as_long(ruled, {"cascade": "team", "pooled": "rule_pooled", "unclear: product": "rule_product",
                           "unclear: product and cover": "rule_product_warranty"},
                   ["split", "request_id", "final_team_cur", "route_type"])
    per = long.groupBy("model", "split").agg(F.avg(M.right("pred")).alias("acc"))
    return per.groupBy("model").agg(F.avg("acc").alias("acc"), F.stddev_samp("acc").alias("sd"))


# ------------------------------------------------------------------------------------ switches
VARIANTS = {
    "plain": frozenset(),
    "A1": frozenset({"A1"}),
    "B1": frozenset({"B1"}),
    "B2": frozenset({"B2"}),
    "B3": frozenset({"B3"}),
    "B4": frozenset({"B4"}),
    "B1 to B4": frozenset({"B1", "B2", "B3", "B4"}),
    "all switches": L.ALL_FEATURES,
}
BASE_VARIANT = "plain"


def switch_rows(scheme: tuple[DataFrame, S.Splits], paraphrases: DataFrame | None, variants=None, rules=None,
                where: Column | None = None, fallback=majority_fallback) -> DataFrame:
    """Decisions of every variant on the same rows, long form. The history is learned from once.

    Rows carry the plain variant's decision (``champion``), so that the variants need not meet it by request.
    """
    variants = variants or VARIANTS
    every = frozenset().union(*variants.values())
    evidence = E.fit(scheme[0], splits=scheme[1], features=every, paraphrases=paraphrases, parsed=True)
    rows = scheme[1].scored(scheme[0] if where is None else scheme[0].where(where))
    read = []

    def decided(frame: DataFrame, features) -> DataFrame:
        own = evidence if "B3" in features else without_paraphrases(evidence)
        readings = next((r for f, r in read if same_readings(f, features)), None)
        if readings is None:
            readings = readings_of(frame, own, features, fallback)
            read.append((features, readings))
        return route(frame, own, features, rules, fallback, parsed=True, readings=readings)

    kept = ["split", "request_id", "final_team_cur", "product_family", "text", "norm", "first", "last", "n_clauses", "vague"]
    rows = publish(decided(rows, VARIANTS[BASE_VARIANT]).select(*[c for c in kept if c in rows.columns], F.col("team").alias("champion")), "champion")
    out = None
    for name, features in variants.items():
        one = decided(rows, features).select("split", "request_id", "final_team_cur", "route_type", "route_detail", "auto_route",
                                             F.col("team").alias("pred"), F.lit(name).alias("model"), "champion")
        out = one if out is None else out.unionByName(one)
    return out


def without_paraphrases(evidence: E.Evidence) -> E.Evidence:
    from dataclasses import replace
    return replace(evidence, paraphrases=None)


def decider_breakdown(decided: DataFrame, pred: str = "team") -> DataFrame:
    """Which step decided, how often, and how often it was right."""
    n = decided.groupBy("route_detail").agg(F.count("*").alias("n"), F.avg(M.right(pred)).alias("accuracy"))
    from pyspark.sql import Window
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per step


def typo_test(history: DataFrame, levels=(("clean", 0.0), ("light", 0.15), ("heavy", 0.30)),
              features=(frozenset(), frozenset({"B4"})), fallback=majority_fallback, evidence: E.Evidence | None = None) -> DataFrame:
    """Accuracy on clear later requests when words are corrupted, per level and feature set."""
    from ..functions import parse as P
    scheme = out_of_time(history)
    evidence = evidence or E.fit(scheme[0], splits=scheme[1], features=frozenset().union(*features), parsed=True)
    later = scheme[1].scored(scheme[0].where(~F.col("vague"))).select("split", "request_id", "product_family", "final_team_cur", "text")
    texts = later.select("split", "product_family", "final_team_cur", F.col("request_id").alias("source_id"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("level"), (corrupt(F.col("text"), F.col("request_id"), p, seed) if p else F.col("text")).alias("text"))
        for seed, (name, p) in enumerate(levels)])).alias("v")).select(
        "split", "product_family", "final_team_cur", "v.level", "v.text", F.concat_ws("/", "source_id", "v.level").alias("request_id"))
    texts = publish(P.with_phrases(texts).drop("core", "clauses"), "typos")
    out = None
    for f in features:
        one = route(texts, evidence, f, fallback=fallback, parsed=True).select(
            "level", "request_id", "team", "final_team_cur", F.lit("+".join(sorted(f)) or "none").alias("switches"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("switches", "level").agg(F.count("*").alias("n"), F.avg(M.right()).alias("accuracy"))


def rewritten_test(history: DataFrame, rewritten: DataFrame, features=(frozenset(), frozenset({"B4"})),
                   fallback=majority_fallback, evidence: E.Evidence | None = None) -> DataFrame:
    """Accuracy on the same requests in their original and their rewritten wording."""
    scheme = out_of_time(history)
    evidence = evidence or E.fit(scheme[0], splits=scheme[1], features=frozenset().union(*features), parsed=True)
    texts = rewritten.select("request_id", "product_family", "final_team_cur", F.explode(F.array(
        F.struct(F.lit("original").alias("wording"), F.col("text").alias("request_text")),
        F.struct(F.lit("rewritten").alias("wording"), F.col("hinglish").alias("request_text")))).alias("v")).select(
        F.concat_ws("/", "request_id", "v.wording").alias("request_id"), "product_family", "final_team_cur", "v.*")
    out = None
    for f in features:
        one = route(texts, evidence, f, fallback=fallback).select(
            "wording", "team", "final_team_cur", F.lit("+".join(sorted(f)) or "none").alias("switches"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("switches", "wording").agg(F.count("*").alias("n"), F.avg(M.right()).alias("accuracy"))


# ------------------------------------------------------------------------------------ corrections
def corrections_curve(history: DataFrame, k_folds: int = 5, steps=tuple(L.CORRECTION_STEPS), fallback=majority_fallback) -> DataFrame:
    """Accuracy on a new wording after k confirmed examples of it were added to the history.

    Rows are ranked by time within their wording family; every step is scored on the same rows, those
    of rank 10 and later. A split is a (fold, step) pair, so the whole curve is one fit and one scoring.
    """
    by_family = history.withColumn("family", C.phrase_family(F.col("last")))
    buckets = S.group_buckets(by_family, "family", k_folds)
    rows = lookup(by_family, buckets, ["family"], ["request_id"]).withColumnRenamed("bucket", "fold")
    clear = E.occurrence_rank(rows.where(~F.col("vague")), "family", ["created_at", "request_id"])
    last_class = len(steps)          # rank >= the last step: scored
    rank_class = F.lit(0)
    for s in steps[1:]:
        rank_class = rank_class + (F.col("rank") >= s).cast("int")
    rank_class = rank_class          # 0: rank < steps[1], ... len(steps)-1: rank >= steps[-1]
    width = last_class + 1           # one more class for vague rows
    clear = clear.withColumn("bucket", F.col("fold") * width + rank_class).drop("rank")
    vague = rows.where("vague").withColumn("bucket", F.col("fold") * width + last_class)
    learns, scores = {}, {}
    for f in range(k_folds):
        others = [g * width + c for g in range(k_folds) if g != f for c in range(width)]
        for i, _ in enumerate(steps):
            learns[f * len(steps) + i] = tuple(others + [f * width + c for c in range(i)])
            scores[f * len(steps) + i] = (f * width + len(steps) - 1,)
    ranked = publish(clear.unionByName(vague).drop("family", "fold"), "ranked_history")
    decided = run((ranked, S.Splits(learns, scores)), frozenset(), L.TEAM_WORD_RULES, fallback)
    step = F.element_at(F.array(*map(F.lit, steps)), F.col("split") % len(steps) + 1)
    return decided.groupBy(step.alias("confirmed_examples")).agg(F.count("*").alias("n"), F.avg(M.right()).alias("accuracy"))


# ------------------------------------------------------------------------------------ question order
def option_coverage(scored_vague: DataFrame, evidence: E.Evidence) -> DataFrame:
    """Is the closing team among the first three options, by order of the options?"""
    posts = evidence.products.select("split", "product_family", "post")
    rows = scored_vague.join(F.broadcast(pooled_vague(evidence)), "split")  # one row per split
    rows = lookup(rows, posts, ["split", "product_family"], ["split", "request_id"])
    prior = F.transform("pooled_counts", lambda c: c / F.col("pooled_n"))
    first3 = lambda v: F.transform(F.slice(E.ranked(v), 1, 3), lambda s: s["team"])
    fixed = F.array(*[F.lit(t) for _, t in L.CLARIFY_OPTIONS[:3]])
    orders = [("as listed", fixed), ("pooled shares", first3(prior)),
              ("product shares", first3(F.coalesce("post", prior)))]
    one = rows.agg(F.count("*").alias("n"), *[F.avg(F.array_contains(o, F.col("final_team_cur")).cast("int")).alias(f"c{i}")
                                             for i, (_, o) in enumerate(orders)])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(name).alias("option_order"), F.col(f"c{i}").alias("covered"))
                                               for i, (name, _) in enumerate(orders)])).alias("o")).select("n", "o.*")


# ------------------------------------------------------------------------------------ analyses
def oracle_ceiling(history: DataFrame, by_product: bool = False) -> DataFrame:
    """Best accuracy any rule on the wording could reach: per quarter, the majority outcome of each wording."""
    keys = ["quarter", "last"] + (["product"] if by_product else [])
    rows = history.withColumn("quarter", S.quarter_bucket(F.col("created_at"))).where(F.col("quarter").between(1, len(L.QUARTERS)))
    if by_product:
        rows = rows.withColumn("product", F.when(F.col("vague"), F.col("product_family")))
    counts = rows.groupBy(*keys, "final_team_cur").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg(F.sum("n").alias("n"), (F.sum("best") / F.sum("n")).alias("ceiling"))


def new_wording_share(history: DataFrame) -> DataFrame:
    """Distinct wordings before and after the cut, and the share of later requests whose wording is new."""
    rows = history.where(~F.col("vague")).withColumn("later", S.out_of_time_bucket(F.col("created_at")) == 1)
    per = rows.groupBy("last").agg(F.count_if("later").alias("later_n"), F.count_if(~F.col("later")).alias("earlier_n"))
    return per.agg(
        F.count_if(F.col("earlier_n") > 0).alias("earlier_phrases"), F.count_if(F.col("later_n") > 0).alias("later_phrases"),
        F.try_divide(F.sum(F.when(F.col("earlier_n") == 0, F.col("later_n")).otherwise(0)), F.sum("later_n")).alias("new_share"))


def linked_requests(history: DataFrame) -> DataFrame:
    """Pairs of requests that quote the same number, and the share closed by the same team.

    Pairs are counted, not listed: a number quoted n times makes n(n-1)/2 pairs.
    """
    numbers = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(ko\d{5,}|sr\d{4,})\b"), F.lit(1)))
    counts = history.select(F.explode(numbers).alias("number"), "final_team_cur").groupBy("number", "final_team_cur").agg(F.count("*").alias("n"))
    per = counts.groupBy("number").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return per.agg(F.count_if(F.col("n") > 1).alias("shared_numbers"), pairs.alias("pairs"), F.try_divide(F.sum("same"), pairs).alias("same_team_share"))


def recent_context(history: DataFrame, days=(7, 30, 90)) -> DataFrame:
    """Per product and day: the team that closed most clear requests of the 7 / 30 / 90 days before.

    Requests are counted per day first, so the window runs over days, not over requests.
    """
    from pyspark.sql import Window
    # vague requests weigh nothing, but their days get a context too
    daily = E.team_counts(history.withColumns({
        "day": F.datediff(F.col("created_at").cast("date"), F.lit("2020-01-01").cast("date")),
        "n": (~F.col("vague")).cast("int")}), ["product_family", "day"], "final_team_cur")
    out = daily
    for d in days:
        w = Window.partitionBy("product_family").orderBy("day").rangeBetween(-d, -1)
        sums = [F.coalesce(F.sum(F.col("counts")[i]).over(w), F.lit(0)) for i in range(len(L.TEAMS))]
        out = out.withColumn(f"team_{d}d", top_team(F.array(*sums)))
    return out.select("product_family", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).alias("day"),
                      F.col("n").alias("clear_requests"), *[f"team_{d}d" for d in days])


def recent_context_accuracy(history: DataFrame, days=(7, 30, 90)) -> DataFrame:
    """How often the recent majority of the product is the team that closed a vague request of that day."""
    ctx = publish(recent_context(history, days).drop("clear_requests"), "context")
    vague = history.where("vague").withColumn("day", F.col("created_at").cast("date"))
    rows = lookup(vague, ctx, ["product_family", "day"], ["request_id"])
    return rows.agg(F.count("*").alias("n"), *[F.avg(M.right(f"team_{d}d")).alias(f"accuracy_{d}d") for d in days])
