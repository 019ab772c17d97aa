"""The registered queries: each takes (spark, folder of tables) and returns a DataFrame.

Tables that many reports share (parsed history, scored backtests) are built once per session and
folder and published; each report then reads only the columns it needs.
"""

from __future__ import annotations

import functools
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon as L
from ..functions import clean as C
from ..functions import parse as P
from ..operators import ann as A
from ..operators import business as B
from ..operators import evidence as E
from ..operators import metrics as M
from ..operators import neighbors as N
from ..operators import repair as R
from ..operators import splits as S
from ..operators import stats as ST
from ..operators import textmodel as TM
from ..operators.route import first_rule, matching_teams, readings_of
from ..session import publish, shared_dir, spread
from ..sources import fixtures as X
from ..sources import pack as K
from ..streaming import context as LC
from ..streaming import online as O
from . import backtest as BT
from . import training as TR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# wording of the paraphrase dimension: (known wording, paraphrase)
PARAPHRASES = [
    ("refund of the P advance still pending", "money for the room heater has not come back"),
    ("cartridge for the P is over", "the ceiling fan ran out of its insert"),
    ("can i run the P overnight", "is it fine to leave the air fryer on till morning"),
]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that engines that add in another order still agree."""
    return df.select(*[F.round(f"`{f.name}`", 6).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark, sf):
        return rounded(fn(spark, sf))
    QUERIES[fn.__name__] = run
    return run


# ------------------------------------------------------------------------------------ shared tables
_SHARED: dict[tuple, object] = {}


def shared(fn):
    @functools.wraps(fn)
    def get(spark, sf):
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in _SHARED:
            _SHARED[key] = fn(spark, sf)
        return _SHARED[key]
    return get


@shared
def history(spark, sf) -> DataFrame:
    """Cleaned and parsed history."""
    return publish(TR.parsed_history(*X.history_tables(spark, sf)), "history")


@shared
def oot_evidence(spark, sf) -> E.Evidence:
    scheme = BT.out_of_time(history(spark, sf))
    return E.fit(scheme[0], splits=scheme[1], parsed=True)


@shared
def oot(spark, sf) -> DataFrame:
    """Later requests decided from the earlier ones, default switches."""
    return publish(BT.reported(oot_decisions(spark, sf)), "oot")


@shared
def oot_readings(spark, sf) -> DataFrame:
    scheme = BT.out_of_time(history(spark, sf))
    return readings_of(scheme[1].scored(scheme[0]), oot_evidence(spark, sf), L.DEFAULT_FEATURES)


def oot_decisions(spark, sf) -> DataFrame:
    """The same with every column, not stored."""
    return BT.run(BT.out_of_time(history(spark, sf)), evidence=oot_evidence(spark, sf), readings=oot_readings(spark, sf))


@shared
def rolling_evidence(spark, sf) -> E.Evidence:
    scheme = BT.rolling(history(spark, sf))
    return E.fit(scheme[0], splits=scheme[1], parsed=True)


@shared
def rolling(spark, sf) -> DataFrame:
    return publish(BT.reported(BT.run(BT.rolling(history(spark, sf)), evidence=rolling_evidence(spark, sf))), "rolling")


@shared
def ruled(spark, sf) -> DataFrame:
    scheme = BT.rolling(history(spark, sf))
    ruled = BT.with_vague_rules(rolling(spark, sf), rolling_evidence(spark, sf), BT.recent_vague(*scheme))
    return publish(ruled.select("split", "request_id", "final_team_cur", "route_type", "team", *BT.VAGUE_RULES.values()), "ruled")


@shared
def cross_validated(spark, sf) -> DataFrame:
    return publish(BT.reported(BT.run(BT.cross_validation(history(spark, sf)), features={"A1"})), "cv")


@shared
def whole_base(spark, sf) -> DataFrame:
    return publish(E.evidence_base(history(spark, sf).withColumn("bucket", F.lit(0)), "final_team_cur", S.WHOLE), "base")


@shared
def whole_phrases(spark, sf) -> DataFrame:
    return publish(E.phrase_table(whole_base(spark, sf)), "phrases")


@shared
def switches(spark, sf) -> DataFrame:
    """Every switch alone and together on the later requests."""
    return publish(BT.switch_rows(BT.out_of_time(history(spark, sf)), paraphrases(spark)), "switches")


@shared
def challengers(spark, sf) -> DataFrame:
    return publish(BT.challenger_rows(history(spark, sf)), "challengers")


def paraphrases(spark) -> DataFrame:
    return spark.createDataFrame(PARAPHRASES, "source string, paraphrase string")


def names(alternatives: str) -> F.Column:
    return F.array_join(F.transform(alternatives, lambda a: a["team"]), "|")


def table(spark, sf, name, *columns):
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


# ------------------------------------------------------------------------------------ cleaning and parsing
@query
def history_clean(spark, sf):
    train, log = X.history_tables(spark, sf)
    return K.clean_history(K.join_history(train, log)).select(
        "request_id", "bot_team", "first_team_cur", "final_team_cur", "transfers", "created_at", "resolved_at_ist",
        "hours_to_resolve", "inconsistent", C.hour_of_day(F.col("created_at")).alias("hour"),
        C.day_of_week(F.col("created_at")).alias("weekday"))


@query
def text_fixed(spark, sf):
    return X.labelled(spark, sf).select("request_id", C.fix_text(F.col("request_text")).alias("text"))


@query
def phrase_parse(spark, sf):
    df = X.labelled(spark, sf).select("request_id", C.fix_text(F.col("request_text")).alias("text"))
    return P.with_phrases(df, shown=True).select(
        "request_id", "norm", "core", F.array_join("clauses", "|").alias("clauses"), "n_clauses", "last", "vague",
        F.array_join("shown", "|").alias("shown"), "last_shown", P.payment_remark(F.col("text")).alias("remark"),
        C.redact(F.col("text")).alias("redacted"))


@query
def phrase_families(spark, sf):
    rows = history(spark, sf).where(~F.col("vague")).withColumn("family", C.phrase_family(F.col("last")))
    return E.top_phrase(rows, "family", "last")


@query
def document_families(spark, sf):
    """Lines of the documents, alike but for their numbers: how often each family occurs, and its most frequent line."""
    lines = table(spark, sf, "documents", "text").select(F.explode(F.split(F.col("text"), "\n")).alias("line"))
    return E.top_phrase(lines.withColumn("family", C.phrase_family(F.col("line"))), "family", "line")


@query
def last_user_turn(spark, sf):
    """The last user turn of each conversation as the parser reads it, and how many user turns there are."""
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    last = turns.groupBy("conv_id").agg(F.count("*").alias("user_turns"), F.max(F.struct("turn", "text")).alias("s"))
    parsed = P.with_phrases(last.select("conv_id", "user_turns", F.col("s.turn").alias("turn"),
                                        C.repair_damaged(F.col("s.text")).alias("text")))
    return parsed.select("conv_id", "user_turns", "turn", "norm", "vague", F.length("text").alias("chars"))


# ------------------------------------------------------------------------------------ learned tables
@query
def phrase_team_counts(spark, sf):
    return whole_base(spark, sf).where(~F.col("vague")).groupBy("last", "team").agg(F.sum("n").alias("n"))


@query
def phrase_majority(spark, sf):
    return whole_phrases(spark, sf).select("last", "team", "k", "n", (F.col("k") / F.col("n")).alias("share"),
                                           names("alternatives").alias("alternatives"))


@query
def vague_posterior(spark, sf):
    p = E.shrunk_posterior(whole_base(spark, sf), ["product_family"])
    return p.select("product_family", "n", F.posexplode("post").alias("i", "posterior"), "counts").select(
        "product_family", "n", F.element_at(F.array(*map(F.lit, L.TEAMS)), F.col("i") + 1).alias("team"),
        F.element_at("counts", F.col("i") + 1).alias("c"), "posterior")


@query
def vague_product_warranty(spark, sf):
    p = E.shrunk_posterior(whole_base(spark, sf), ["product_family", "warranty_status"])
    best = F.try_element_at(E.ranked(F.col("post")), F.lit(1))
    return p.select("product_family", "warranty_status", "n", best["team"].alias("team"), best["value"].alias("posterior"))


@query
def vague_recent_prior(spark, sf):
    return BT.recent_vague(*BT.rolling(history(spark, sf))).select(F.col("split").cast("int").alias("split"), "recent_team")


@query
def vague_rebalanced(spark, sf):
    p = E.shrunk_posterior(whole_base(spark, sf), ["product_family"])
    one = lambda g: BT.top_team(E.rebalanced(F.col("post"), F.col("pooled_counts"), F.col("pooled_n"), g))
    return p.select("product_family", one(0.5).alias("team_half"), one(1.0).alias("team_full"))


@query
def source_quality_posterior(spark, sf):
    """Shrunk share of good documents per source and language: the vague-prior formula on labelled documents."""
    docs = table(spark, sf, "documents", "doc_id", "lang", "source").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    cell = docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("int")).alias("good"))
    prior = cell.agg((F.sum("good") / F.sum("n")).alias("prior")).withColumn("_k", F.lit(1))
    joined = cell.withColumn("_k", F.lit(1)).join(F.broadcast(prior), "_k")  # one row
    return joined.select("lang", "source", "n", "good", (
        (F.col("good") + L.VAGUE_ALPHA * F.col("prior")) / (F.col("n") + L.VAGUE_ALPHA)).alias("posterior"))


@query
def two_request_evidence(spark, sf):
    return E.two_request_table(whole_base(spark, sf), whole_phrases(spark, sf)).select("two_k", "two_n")


@query
def payment_evidence(spark, sf):
    return E.payment_table(whole_base(spark, sf), whole_phrases(spark, sf)).select("pay_bot", "pay_closed", "pay_n")


@query
def model_readiness(spark, sf):
    return TR.readiness(oot_evidence(spark, sf))


@query
def vocabulary(spark, sf):
    return E.vocabulary(history(spark, sf).withColumn("bucket", F.lit(0)), S.WHOLE).select("word")


@query
def document_vocabulary(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    return docs.select(F.explode(F.array_distinct(E.words_of(F.col("text")))).alias("word")).groupBy("word").agg(
        F.count("*").alias("documents"))


@query
def product_majority_shift(spark, sf):
    """Wording x product cells whose majority differs from the wording's."""
    rows = history(spark, sf).where(~F.col("vague")).select(
        "last", "product_family", F.col("final_team_cur").alias("team"), F.lit(1).alias("n"))
    cells = E.product_majority(rows, whole_phrases(spark, sf))
    return cells.agg(F.count("*").alias("cells"), F.count_if(F.col("cell_team") != F.col("phrase_team")).alias("differing"))


# ------------------------------------------------------------------------------------ repair
@query
def hinglish_repair(spark, sf):
    return history(spark, sf).select("request_id", R.hinglish_to_english(F.col("text")).alias("english"))


@query
def spelling_repair(spark, sf):
    """Texts with typos against the vocabulary of the clean ones: every unknown word and its correction."""
    h = history(spark, sf)
    typos = h.select(F.lit(0).alias("split"), R.corrupt(F.col("text"), F.col("request_id"), 0.3, 7).alias("text")).distinct()
    vocab = publish(E.vocabulary(h.withColumn("bucket", F.lit(0)), S.WHOLE), "vocab")
    words = publish(R.unknown_words(typos, vocab), "words")
    return words.join(R.best_known_word(words, vocab), ["split", "word"], "left").select("word", "known", "ratio")


@query
def typo_perturbation(spark, sf):
    return history(spark, sf).select("request_id", R.corrupt(F.col("text"), F.col("request_id"), 0.15, 1).alias("light"),
                                     R.corrupt(F.col("text"), F.col("request_id"), 0.30, 2).alias("heavy"))


@query
def typo_stress(spark, sf):
    return BT.typo_test(history(spark, sf), evidence=oot_evidence(spark, sf))


@query
def rewritten_stress(spark, sf):
    """The same later requests in two wordings: as written, and with some phrases in Hindi."""
    late = history(spark, sf).where((S.out_of_time_bucket(F.col("created_at")) == 1) & ~F.col("vague"))
    hindi = F.col("text")
    for english, other in (("not turning on", "chalu nahi ho raha"), ("leaking water", "paani tapak raha hai"),
                           ("invoice not received", "bill nahi mila"), ("want exchange", "badalna")):
        hindi = F.replace(hindi, F.lit(english), F.lit(other))
    return BT.rewritten_test(history(spark, sf), late.select("request_id", "text", hindi.alias("hinglish"), "product_family", "final_team_cur"),
                             evidence=oot_evidence(spark, sf))


# ------------------------------------------------------------------------------------ routing
@query
def rule_match(spark, sf):
    last = F.col("last")
    teams = matching_teams(last, L.KEYWORD_RULES)
    fair = first_rule(last, L.TEAM_WORD_RULES)
    return history(spark, sf).select(
        "request_id", first_rule(last, L.KEYWORD_RULES).alias("rule_team"), F.array_join(teams, "|").alias("all_teams"),
        fair.alias("team_words_team"), F.coalesce(first_rule(last, L.BASELINE_RULES), F.lit(L.BASELINE_DEFAULT)).alias("baseline_team"))


@query
def route_out_of_time(spark, sf):
    """The cascade end to end: parse, learn from the past, decide the later requests."""
    train, log = X.history_tables(spark, sf)
    scheme = BT.out_of_time(publish(TR.parsed_history(train, log), "history"))
    return decision_columns(BT.run(scheme))


def decision_columns(decided):
    return decided.select("request_id", "team", "confidence", "confidence_level", "auto_route", "route_type", "route_detail",
                          "needs_clarification", names("alternatives").alias("alternatives"), "alternatives_basis",
                          "deciding_request", "model_version")


@query
def route_reasons(spark, sf):
    return oot_decisions(spark, sf).select("request_id", F.array_join("reasons", "|").alias("reasons"))


@query
def route_question(spark, sf):
    """With C2: the options in order of likelihood, the first three marked."""
    decided = BT.run(BT.out_of_time(history(spark, sf)), features={"C2"}, evidence=oot_evidence(spark, sf))
    options = F.transform("clarifying_question.options", lambda o: F.concat(o["team"], F.when(o["likely"], "*").otherwise("")))
    return decided.where("needs_clarification").select("request_id", "clarifying_question.question", F.array_join(options, "|").alias("options"))


@query
def route_all_switches(spark, sf):
    decided = BT.run(BT.out_of_time(history(spark, sf)), L.ALL_FEATURES, paraphrases=paraphrases(spark))
    return decided.select("request_id", "team", "confidence", "route_type", "route_detail", "auto_route")


@query
def review_queue(spark, sf):
    return O.review_rows(oot_decisions(spark, sf)).drop("logged_at")


# ------------------------------------------------------------------------------------ metrics
@query
def accuracy_out_of_time(spark, sf):
    return M.accuracy(oot(spark, sf))


@query
def accuracy_by_type(spark, sf):
    return M.by_group(oot(spark, sf), "route_type")


@query
def confidence_levels(spark, sf):
    return M.by_group(oot(spark, sf), "confidence_level")


@query
def decider_breakdown(spark, sf):
    return BT.decider_breakdown(oot(spark, sf))


@query
def team_precision_recall(spark, sf):
    return M.team_report(oot(spark, sf))


@query
def confusion(spark, sf):
    wide = M.confusion_matrix(oot(spark, sf))
    return wide.select("truth", *[F.col(f"`{t}`").alias("to_" + t.split()[0].lower()) for t in L.TEAMS])


@query
def macro_f1(spark, sf):
    return M.macro_f1(oot(spark, sf))


@query
def selective_routing(spark, sf):
    return M.selective_routing(rolling(spark, sf))


@query
def top_k(spark, sf):
    return M.top_k(rolling(spark, sf))


@query
def error_breakdown(spark, sf):
    return M.error_breakdown(oot(spark, sf))


@query
def error_rows(spark, sf):
    return M.error_rows(oot(spark, sf))


@query
def error_sample(spark, sf):
    """The report's sample of twelve stated-need errors."""
    wrong = oot(spark, sf).where((M.right() == 0) & (F.col("route_type") != "vague"))
    return M.sample_rows(wrong, 12, "request_id").select(
        "request_id", C.redact(F.col("text")).alias("shown"), "team", "final_team_cur", "transfers")


@query
def bot_monthly(spark, sf):
    return M.bot_monthly(history(spark, sf))


@query
def bot_by_label(spark, sf):
    return M.bot_by_label(history(spark, sf))


@query
def route_mix(spark, sf):
    return M.mix(oot(spark, sf), "route_type")


@query
def team_mix(spark, sf):
    return M.mix(oot(spark, sf), "team")


@query
def expected_accuracy(spark, sf):
    """The out-of-time mix of route types weighted with cross-validated accuracies."""
    acc = cross_validated(spark, sf).groupBy("route_type").agg(F.avg(M.right()).alias("accuracy"))
    return M.weighted_accuracy(M.mix(oot(spark, sf), "route_type"), acc)


@query
def clarify_projection(spark, sf):
    return M.clarify_projection(oot(spark, sf))


@query
def option_coverage(spark, sf):
    scored = rolling(spark, sf).where("vague")
    return BT.option_coverage(scored, rolling_evidence(spark, sf))


@query
def bootstrap_ci(spark, sf):
    return ST.bootstrap_interval(oot(spark, sf), M.right() == 1, ["route_type"])


# ------------------------------------------------------------------------------------ money
@query
def misroute_costs(spark, sf):
    return B.misroute_costs(history(spark, sf))


@query
def team_volumes(spark, sf):
    return B.team_volumes(history(spark, sf))


@query
def savings(spark, sf):
    vague = F.col("route_type") == "vague"
    rates = oot(spark, sf).agg(F.avg(M.right()).alias("router_right"), F.avg(M.right("bot_team")).alias("bot_right"),
                               M.mean_where(M.right(), ~vague).alias("clear_right"))
    return B.scenarios(history(spark, sf), rates)


@query
def hours_by_source(spark, sf):
    return B.hours_by_source(history(spark, sf))


@query
def vague_rule_costs(spark, sf):
    return BT.vague_rule_table(ruled(spark, sf), B.cost_per_miss(history(spark, sf)))


# ------------------------------------------------------------------------------------ backtests
@query
def cross_validation(spark, sf):
    per = M.accuracy(cross_validated(spark, sf), ["split"])
    out = None
    for c in ("vs_outcome", "clear", "vague", "vague_share"):
        one = M.fold_summary(per, c).withColumn("measure", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


@query
def cross_validation_repaired(spark, sf):
    """The same with every default switch (spelling repair per fold)."""
    return M.fold_summary(M.accuracy(BT.run(BT.cross_validation(history(spark, sf))), ["split"]), "vs_outcome")


@query
def held_out_wording(spark, sf):
    """Unseen wording by fold, with the shipped rules and with the team-description words only."""
    scheme = BT.held_out(history(spark, sf), F.col("last"))
    evidence = E.fit(scheme[0], splits=scheme[1], features={"A1"}, parsed=True)
    out = None
    for name, rules in (("shipped", L.KEYWORD_RULES), ("team words", L.TEAM_WORD_RULES)):
        one = M.accuracy(BT.run(scheme, {"A1"}, rules, evidence=evidence), ["split"]).withColumn("rules", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("rules", F.col("split").cast("int").alias("split"), "n", "vs_outcome", "clear")


@query
def held_out_family(spark, sf):
    """Strict groups (numbers masked), fair rules, spelling repair on: rows decided per step."""
    scheme = BT.held_out(history(spark, sf), C.phrase_family(F.col("last")))
    return BT.decider_breakdown(BT.run(scheme, {"B4"}, L.TEAM_WORD_RULES).where(~F.col("vague")))


@query
def held_out_leaks(spark, sf):
    """Rows of the held-out scheme that known wording decided (there must be none)."""
    scheme = BT.held_out(history(spark, sf), F.col("last"))
    return BT.check_no_leak(BT.run(scheme, frozenset())).agg(F.count("*").alias("leaks"))


@query
def rolling_backtest(spark, sf):
    return M.accuracy(rolling(spark, sf), ["split"]).withColumn("split", F.col("split").cast("int"))


@query
def corrections_curve(spark, sf):
    return BT.corrections_curve(history(spark, sf))


@query
def occurrence_rank(spark, sf):
    """0-based position of each event of a user by time."""
    return E.occurrence_rank(table(spark, sf, "events", "event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select(
        "event_id", "user_id", "rank")


@query
def champion_challengers(spark, sf):
    return BT.compare(challengers(spark, sf), "cascade").select(
        "model", "n", "pooled_acc", "clear", "vague", "delta_pts", "wins", "losses", "p", "p_holm")


@query
def challenger_folds(spark, sf):
    return BT.fold_accuracy(challengers(spark, sf))


@query
def challenger_winners(spark, sf):
    return BT.beats_champion(BT.compare(challengers(spark, sf), "cascade")).select("model", "delta_pts", "p_holm")


@query
def majority_ensemble(spark, sf):
    """Two-of-three vote of the champion, the rules and the plain lookup."""
    scheme = BT.rolling(history(spark, sf))
    key = ["split", "request_id"]
    a = rolling(spark, sf).select(*key, "final_team_cur", F.col("team").alias("a"))
    b = BT.baseline_rules(scheme[1].scored(scheme[0])).select(*key, F.col("team").alias("b"))
    c = BT.lookup_model(scheme).select(*key, F.col("team").alias("c"))
    voted = a.join(b, key).join(c, key).withColumn("team", BT.majority_of_three(F.col("a"), F.col("b"), F.col("c")))
    return voted.agg(F.count("*").alias("n"), F.avg(M.right()).alias("accuracy"), F.avg(M.right("a")).alias("champion"),
                     F.avg(M.right("b")).alias("rules"), F.avg(M.right("c")).alias("lookup"))


def _schemes(spark, sf):
    h = history(spark, sf)
    return {"A out-of-time": BT.out_of_time(h), "B 5-fold CV": BT.cross_validation(h), "C unseen wording": BT.held_out(h, F.col("last"))}


@query
def simple_models(spark, sf):
    """Most common team, rules, lookup, rule hybrids and the baseline under the three schemes."""
    out = None
    for name, scheme in _schemes(spark, sf).items():
        one = BT.simple_models(scheme).withColumn("scheme", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def challenger_robustness(spark, sf):
    """Rules for vague requests under cross-validation and on unseen wording (fair rules)."""
    schemes = _schemes(spark, sf)
    out = None
    for name, rules in (("B 5-fold CV", L.KEYWORD_RULES), ("C unseen wording", L.TEAM_WORD_RULES)):
        one = BT.robustness(schemes[name], rules).withColumn("scheme", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def switch_matrix(spark, sf):
    return BT.compare(switches(spark, sf), BT.BASE_VARIANT).select("model", "n", "pooled_acc", "delta_pts", "wins", "losses", "p")


# ------------------------------------------------------------------------------------ analyses
@query
def oracle_ceiling(spark, sf):
    h = history(spark, sf)
    return BT.oracle_ceiling(h).withColumn("by", F.lit("wording")).unionByName(
        BT.oracle_ceiling(h, True).withColumn("by", F.lit("wording and product")))


@query
def chi_square(spark, sf):
    vague = history(spark, sf).where("vague")
    out = None
    for c in ("channel", "product_family", "warranty_status", "source"):
        one = ST.chi_square(vague, c, "final_team_cur").withColumn("column", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


@query
def linked_requests(spark, sf):
    return BT.linked_requests(history(spark, sf))


@query
def recent_context(spark, sf):
    return BT.recent_context(history(spark, sf))


@query
def recent_context_accuracy(spark, sf):
    return BT.recent_context_accuracy(history(spark, sf))


@query
def new_wording_share(spark, sf):
    return BT.new_wording_share(history(spark, sf))


# ------------------------------------------------------------------------------------ neighbours
@query
def nearest_wording(spark, sf):
    """Every later wording that is new, with the closest known one."""
    scheme = BT.out_of_time(history(spark, sf))
    phrases = oot_evidence(spark, sf).phrases
    later = scheme[1].scored(scheme[0].where(~F.col("vague") & (F.col("last") != ""))).select("split", "last").distinct()
    new = publish(later.join(phrases.select("split", "last"), ["split", "last"], "left_anti"), "new")
    return N.nearest_phrase(new, publish(phrases.select("split", F.col("last").alias("key")), "keys")).select(
        "last", "near_key", "near_sim")


@query
def knn_vote(spark, sf):
    """Each vector's label by a distance-weighted vote of its 25 nearest others."""
    v = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    vec = v.select(F.col("vec_id").alias("id"), N.to_unit(F.col("embedding")).alias("vec"))
    near = N.k_nearest(vec, vec, 25, exclude_self=True)
    vote = N.weighted_vote(near, v.select(F.col("vec_id").alias("p_id"), "label"))
    return vote.select(F.col("q_id").alias("vec_id"), F.col("label").alias("voted"))


@query
def nearest_vectors(spark, sf):
    v = table(spark, sf, "embeddings", "vec_id", "embedding")
    vec = v.select(F.col("vec_id").alias("id"), N.to_unit(F.col("embedding")).alias("vec"))
    return N.k_nearest(vec, vec, 3, exclude_self=True).select(
        F.col("q_id").alias("vec_id"), F.col("p_id").alias("near_id"), "distance", "rank")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), N.to_unit(F.col("embedding")).alias("vec"))


@query
def approximate_vectors(spark, sf):
    """The ten nearest others of every vector, among the cells of its nearest pivots."""
    vec = _vectors(spark, sf)
    return A.k_near(vec, vec, 10, exclude_self=True).select(F.col("q_id").alias("vec_id"), F.col("p_id").alias("near_id"), "distance", "rank")


@query
def approximate_vectors_recall(spark, sf):
    """Whether the approximate search fills nine tenths of the exact places, for each twentieth vector against all."""
    vec = _vectors(spark, sf)
    asked = vec.where(F.col("id") % 20 == 0)
    met = A.recall(A.k_near(asked, vec, 10, exclude_self=True), publish(N.k_nearest(asked, vec, 10, exclude_self=True), "exact"))
    return met.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("reached"))


# ------------------------------------------------------------------------------------ text models
@query
def tfidf_terms(spark, sf):
    """Word TF-IDF of the documents: term weights of unit length per document (1-2 grams, in two documents or more)."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    block = TM.Block("text", 1, 2, 2)
    counted = TM.count_words(docs, block, "doc_id")
    idf = TM.idf_table(docs.select("text", F.lit(1).alias("weight")), (block,), indexed=False, counted=counted)
    return publish(TM.weight_sums(docs, idf, block, "doc_id", counted=counted, every=True), "document_weights")


@query
def document_idf(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text").select("text", F.lit(1).alias("weight"))
    return TM.idf_table(docs, (TM.Block("text", 1, 1, 2),), indexed=False).select("term", "df", "idf")


def _learned(spark, sf):
    bucketed, splits = BT.out_of_time(history(spark, sf))
    return bucketed.where("bucket = 0"), splits.scored(bucketed), bucketed.where("bucket = 0 and not vague")


@query
def route_with_text_model(spark, sf):
    """The cascade with the logistic regression as its last resort."""
    train, _, clear = _learned(spark, sf)
    model = TM.fit_text_model(clear)
    decided = BT.run(BT.out_of_time(history(spark, sf)), evidence=oot_evidence(spark, sf), fallback=TM.model_fallback({0: model}))
    return M.by_group(decided, "route_type")


@query
def held_out_text_model(spark, sf):
    """Unseen wording decided by fair rules and, where none fires, by each fold's own text model."""
    scheme = BT.held_out(history(spark, sf), F.col("last"))
    decided = BT.run(scheme, {"A1"}, L.TEAM_WORD_RULES, TM.model_fallback(TM.fit_per_split(*scheme)))
    return M.fold_summary(M.accuracy(decided, ["split"]), "clear")


def _scored(name, fit):
    def run(spark, sf):
        train, rows, clear = _learned(spark, sf)
        return M.accuracy(TM.score(fit(train, clear), rows), vague=F.col("vague"))
    run.__name__ = name
    return query(run)


text_model_lr = _scored("text_model_lr", lambda train, clear: TM.fit_text_model(train, blocks=(TM.FULL,)))
text_model_last = _scored("text_model_last", lambda train, clear: TM.fit_text_model(train))
text_model_chars_meta = _scored("text_model_chars_meta", lambda train, clear: TM.fit_text_model(
    train, blocks=(TM.FULL, TM.CHARS, TM.LAST) + TM.META))
text_model_consistent = _scored("text_model_consistent", lambda train, clear: TM.fit_text_model(train.where(~F.col("inconsistent"))))
text_model_svm = _scored("text_model_svm", lambda train, clear: TM.fit_text_model(train, blocks=(TM.FULL,), kind="svm"))
text_model_nb = _scored("text_model_nb", lambda train, clear: TM.fit_text_model(train, blocks=(TM.FULL,), kind="nb"))
copy_of_baseline = _scored("copy_of_baseline", lambda train, clear: TM.copy_of_baseline(train))


@query
def noise_cleaned(spark, sf):
    train, rows, clear = _learned(spark, sf)
    model, scored = TM.noise_cleaned(clear)
    dropped = scored.agg(F.sum(F.when(F.col("p_own") < 0.10, F.col("weight")).otherwise(0)).alias("dropped_rows")).withColumn("_k", F.lit(1))
    acc = M.accuracy(TM.score(model, rows), vague=F.col("vague")).withColumn("_k", F.lit(1))
    return acc.join(F.broadcast(dropped), "_k").drop("_k")  # one row each


@query
def boosted_trees(spark, sf):
    train, rows, _ = _learned(spark, sf)
    return M.accuracy(TM.boosted(train, rows), vague=F.col("vague"))


@query
def dense_text_model(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("fold", S.stable_hash(F.col("vec_id")) % 5)
    out = TM.dense_model(v.where("fold > 0"), v.where("fold = 0"))
    return out.agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy"))


# ------------------------------------------------------------------------------------ the pack's own files
@query
def corrections_union(spark, sf):
    """History plus confirmed corrections: later unsure requests come back with their closing team."""
    confirmed = oot(spark, sf).where(~F.col("auto_route")).select(
        "request_id", "request_text", "product_family", F.col("final_team_cur").alias("team"), F.col("resolved_at_ist").alias("confirmed_at"))
    both = K.with_corrections(history(spark, sf).where(F.col("created_at") < F.lit(L.OUT_OF_TIME_START).cast("timestamp_ntz")),
                              K.valid_corrections(confirmed))
    return both.groupBy("final_team_cur").agg(F.count("*").alias("n"), F.count("channel").alias("from_history"))


@query
def deliverable_checks(spark, sf):
    decided = oot(spark, sf)
    sample = decided.select("request_id", "team").withColumn("ordinal", F.monotonically_increasing_id())
    pred = publish(K.in_sample_order(sample, decided), "predictions")  # five checks read it
    return K.deliverable_checks(pred, sample, decided.select("request_id"))


# ------------------------------------------------------------------------------------ streams
def _request_stream(spark, sf):
    orders = (spark.readStream.schema("o_orderkey bigint, o_custkey bigint").option("pathGlobFilter", "orders.parquet").parquet(sf))
    return spark.sql(X.requests_sql(True, "{orders}"), orders=orders)


def _run_folder(spark, name):
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


@query
def stream_route(spark, sf):
    """All requests through the scoring stream; the decisions table as the stream left it."""
    out = _run_folder(spark, "route")
    stream = _request_stream(spark, sf).drop("first_team", "final_team", "transfers", "resolved_at", "team_label")
    O.route_stream(stream, oot_evidence(spark, sf), out, f"{out}/offsets").awaitTermination()
    return spark.read.parquet(f"{out}/decisions").select("request_id", "team", "confidence", "route_type", "route_detail", "auto_route")


@query
def stream_review_queue(spark, sf):
    out = _run_folder(spark, "review")
    stream = _request_stream(spark, sf).drop("first_team", "final_team", "transfers", "resolved_at", "team_label")
    O.route_stream(stream, oot_evidence(spark, sf), out, f"{out}/offsets").awaitTermination()
    return O.read_review_queue(spark, out).groupBy("router_team", "route_type").agg(F.count("*").alias("n"))


@query
def stream_corrections(spark, sf):
    """Feedback taken in from a stream: old team names and empty texts are rejected."""
    out = _run_folder(spark, "corrections")
    feedback = _request_stream(spark, sf).select("request_id", "request_text", "product_family", F.col("final_team").alias("team"),
                                                 F.col("resolved_at").alias("confirmed_at"))
    O.corrections_stream(feedback, out, f"{out}/offsets").awaitTermination()
    good = spark.read.parquet(f"{out}/corrections").select("team", F.lit("accepted").alias("outcome"))
    bad = spark.read.parquet(f"{out}/rejected").select("team", F.col("reject_reason").alias("outcome"))
    return good.unionByName(bad).groupBy("team", "outcome").agg(F.count("*").alias("n"))


@query
def stream_event_windows(spark, sf):
    """Daily counts per event type from the event stream (complete mode: open windows are reported too)."""
    events = spark.readStream.schema("event_id bigint, ts timestamp_ntz, event_type string").option(
        "pathGlobFilter", "events.parquet").parquet(sf)
    out = _run_folder(spark, "windows")
    counts = O.counts_by_window(events, "ts", "event_type")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/counts")

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/offsets").foreachBatch(write).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/counts")


@query
def live_event_windows(spark, sf):
    """Daily counts of a live stream in update mode: events arrive in ten batches in the order of time, and an eleventh one brings copies
    of a fifth of the first day's events again, far too late. The watermark drops them."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type")
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    folder, out = _run_folder(spark, "arrivals"), _run_folder(spark, "live")
    share = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(ends.lo).cast("timestamp"))) / F.greatest(
        F.unix_micros(F.lit(ends.hi).cast("timestamp")) - F.unix_micros(F.lit(ends.lo).cast("timestamp")), F.lit(1))
    part = F.least(F.lit(9), F.floor(share * 10)).cast("int")
    late = events.where((F.to_date("ts") == F.lit(ends.lo).cast("date")) & (F.col("event_id") % 5 == 0))
    schema = "event_id bigint, ts timestamp_ntz, event_type string"
    for k in range(11):
        (events.where(part == k) if k < 10 else late).write.parquet(f"{folder}/in={k}")
        stream = spark.readStream.schema(schema).option("basePath", folder).parquet(f"{folder}/in=*")
        O.live_windows(O.counts_by_window(stream, "ts", "event_type"), out, f"{out}/offsets").awaitTermination()
    return O.read_windows(spark, out, ["window_start", "event_type"])


@query
def live_recent_context(spark, sf):
    """``recent_context`` from a stream with keyed state: requests arrive in three batches in the order of time, and a fourth one brings a
    seventh of the oldest third again, far too late. Days that the watermark has not closed are not reported."""
    rows = history(spark, sf).select("request_id", "product_family", "created_at", "final_team_cur", "vague")
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    ends = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    folder, out = _run_folder(spark, "requests"), _run_folder(spark, "context")
    part = F.least(F.lit(2), F.floor((at - F.lit(ends.lo)) * 3 / F.lit(max(1, (ends.hi or 0) - (ends.lo or 0))))).cast("int")
    late = rows.where((part == 0) & (F.pmod(F.xxhash64("request_id"), F.lit(7)) == 0))
    for k in range(4):
        (rows.where(part == k) if k < 3 else late).write.parquet(f"{folder}/in={k}")
        stream = spark.readStream.schema(rows.schema).option("basePath", folder).parquet(f"{folder}/in=*")
        LC.context_stream(stream, out, f"{out}/offsets").awaitTermination()
    return spark.read.parquet(f"{out}/context").drop("batch")


@query
def daily_shares(spark, sf):
    """Vague and new-wording shares per day of the scored later requests."""
    return O.shares_by_window(oot(spark, sf), "created_at")


@query
def first_team_weekly(spark, sf):
    return O.first_team_weekly(history(spark, sf))
