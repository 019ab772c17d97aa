"""The routing cascade: a frame of requests in, a frame of decisions out.

empty -> vague -> seen -> (paraphrase -> similar -> vote ->) rules -> fallback model.

The cascade is one projection over left joins to the learned tables. Costly evidence (repair, nearest
wording, text model) is worked out once per distinct unknown wording and then looked up, so known
requests, nearly all of them, pass through without a shuffle.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import clean as C
from ..functions import parse as P
from ..session import publish
from .evidence import Evidence, ranked
from .lookups import lookup, lookup_where
from .neighbors import nearest_phrase
from .repair import hinglish_to_english, repair

Fallback = Callable[[DataFrame, Evidence], DataFrame]

NO_ALTERNATIVES = "array<struct<team:string,share:double>>"
OPTION = "array<struct<label:string,team:string,likely:boolean>>"


# ------------------------------------------------------------------------------------ rules
def first_rule(last: Column, rules, value: int = 0) -> Column:
    """Team (value=0) or label (value=2) of the first rule that matches, else NULL."""
    out = F
    for rule in rules:
        out = out.when(last.rlike(rule[1]), F.lit(rule[value]))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def matching_teams(last: Column, rules) -> Column:
    """Teams of all matching rules in rule order, each once."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.array(*[F.when(last.rlike(p), F.lit(t)) for t, p, _ in rules])))


# ------------------------------------------------------------------------------------ text of figures
def percent(p: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(p * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def share_text(k: Column, n: Column) -> Column:
    """Percent that never reads 100% (or 0%) unless it is."""
    p = k / n
    return F.when((p >= 0.995) & (p < 1), F.lit(">99%")).when((p > 0) & (p < 0.005), F.lit("<1%")).otherwise(percent(p))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fixed(x: Column, digits: int) -> Column:
    return F.format_number(F.bround(x, digits), digits)


# ------------------------------------------------------------------------------------ fallbacks
def majority_fallback(texts: DataFrame, evidence: Evidence) -> DataFrame:
    """The most common team of all requests that state a need (the majority-class baseline)."""
    stats = evidence.stats.select(
        "split", F.col("clear_team").alias("fb_team"), (F.col("clear_k") / F.col("clear_n")).alias("fb_conf"),
        F.col("clear_alternatives").alias("fb_alternatives"))
    return texts.join(F.broadcast(stats), "split", "left")  # one row per split


# ------------------------------------------------------------------------------------ unknown wording
def read_unknown(unknown: DataFrame, evidence: Evidence, features, fallback: Fallback) -> DataFrame:
    """Everything the cascade needs to know about each distinct unknown (split, text).

    Input: (split, text, norm, last). Output adds: note (the repaired text, or NULL), r_last, r_vague,
    r_n, r_first (how the message reads after repair), the phrase table's view of r_last, and the
    evidence for new wording.
    """
    rows = unknown
    if "B4" in features:
        rows = repair(rows, evidence.vocab, "text", "fixed")
        rows = P.with_phrases(rows, "fixed", "f_")
        rows = rows.withColumn("differs", F.col("fixed") != F.lower("text"))
    else:
        rows = rows.withColumns({
            "fixed": F.col("text"), "f_norm": F.col("norm"), "f_last": F.col("last"), "f_first": F.col("last"),
            "f_n_clauses": F.lit(1), "f_vague": F.lit(False), "differs": F.lit(False)})
    phrases = evidence.phrases.select(
        "split", F.col("last").alias("f_last"), F.col("team").alias("r_team"), F.col("k").alias("r_k"),
        F.col("n").alias("r_count"), F.col("alternatives").alias("r_alternatives"))
    rows = lookup(rows, phrases, ["split", "f_last"], ["split", "text"])
    paraphrased = evidence.paraphrases is not None and "B3" in features
    if paraphrased:
        para = evidence.paraphrases.select("split", F.col("last").alias("f_last"), "para_team", "para_source")
        rows = lookup(rows, para, ["split", "f_last"], ["split", "text"])
    else:
        rows = rows.withColumns({"para_team": F.lit(None).cast("string"), "para_source": F.lit(None).cast("string")})
    known = F.col("r_team").isNotNull()
    # the whole repaired reading is taken when it is vague or known; else only its last request is
    adopt = F.col("differs") & (F.col("f_vague") | known | F.col("para_team").isNotNull())
    keep_last = F.col("differs") & ~adopt & (F.col("f_last") != "")
    rows = rows.withColumns({
        "note": F.when(adopt | keep_last, F.col("fixed")),
        "r_last": F.when(adopt | keep_last, F.col("f_last")).otherwise(F.col("last")),
        "r_norm": F.when(adopt | keep_last, F.col("f_norm")).otherwise(F.col("norm")),
        "r_vague": adopt & F.col("f_vague"),
        "r_n": F.when(adopt, F.col("f_n_clauses")),
        "r_first": F.when(adopt, F.col("f_first")),
    }).select("split", "text", "note", "r_last", "r_norm", "r_vague", "r_n", "r_first", "r_team", "r_k", "r_count",
              "r_alternatives", "para_team", "para_source")
    rows = publish(rows, "readings")

    new = rows.where(~F.col("r_vague") & F.col("r_team").isNull() & (F.col("r_last") != ""))
    # one row per distinct wording, so that a wording in many messages is scored once
    wording = new.select("split", F.col("r_norm").alias("norm"), F.col("r_last").alias("last")).distinct()
    scored = fallback(wording, evidence).select("split", F.col("norm").alias("r_norm"), F.col("last").alias("r_last"),
                                                "fb_team", "fb_conf", "fb_alternatives")
    near = {"B1", "B2"} & set(features)
    if near:
        keys = evidence.phrases.select("split", F.col("last").alias("key"), F.col("team").alias("near_team"))
        if paraphrased:
            keys = keys.unionByName(evidence.paraphrases.select("split", F.col("last").alias("key"),
                                                                F.col("para_team").alias("near_team")))
        keys = publish(keys, "near_keys")
        found = nearest_phrase(publish(wording.select("split", "last").distinct(), "new_wording"),
                               keys.select("split", "key"), "last")
        found = found.join(keys.withColumnRenamed("key", "near_key"), ["split", "near_key"]).select(
            "split", F.col("last").alias("r_last"), "near_key", "near_sim", "near_team")
        scored = lookup(scored, publish(found, "nearest"), ["split", "r_last"], ["split", "r_norm"])
    else:
        scored = scored.withColumns({"near_key": F.lit(None).cast("string"), "near_team": F.lit(None).cast("string"),
                                     "near_sim": F.lit(0.0)})
    scored = publish(scored, "new_evidence")
    return publish(lookup(rows, scored, ["split", "r_norm", "r_last"], ["split", "text"]), "unknown")


def _states_need() -> Column:
    return F.col("text").rlike(r"(?U)\S") & ~F.col("vague")


def readings_of(parsed_rows: DataFrame, evidence: Evidence, features, fallback: Fallback = majority_fallback) -> DataFrame:
    """The distinct texts whose deciding request history does not know, with everything the cascade needs about them."""
    known_phrases = evidence.phrases.select("split", "last", F.lit(True).alias("_known"))
    candidates = parsed_rows.where(_states_need()).select("split", "text", "norm", "last")
    # known requests, nearly all, are left out before the others are made distinct
    unknown = lookup(candidates, known_phrases, ["split", "last"], ["split", "text"]).where("_known is null").drop("_known").distinct()
    if "B4" in features:  # stored with the texts, because the spelling step reads it several times
        unknown = unknown.withColumn("_english", hinglish_to_english(F.col("text")))
    return read_unknown(publish(unknown, "unknown_texts"), evidence, features, fallback)


def same_readings(a, b) -> bool:
    """Whether two feature sets read unknown wording the same way (the other switches only choose among the evidence)."""
    kind = lambda f: ("B3" in f, "B4" in f, bool({"B1", "B2"} & set(f)))
    return kind(a) == kind(b)


# ------------------------------------------------------------------------------------ cascade
def route(requests: DataFrame, evidence: Evidence, features=L.DEFAULT_FEATURES, rules=None,
          fallback: Fallback = majority_fallback, text_col: str = "request_text", row_id: str = "request_id",
          parsed: bool = False, readings: DataFrame | None = None) -> DataFrame:
    """Decide every request. Adds the decision columns to the columns of ``requests``.

    ``requests`` needs the text column and a unique ``row_id``; ``product_family`` and ``split`` are optional.
    ``readings`` may be passed on from ``readings_of`` when several feature sets share it.
    """
    rules = L.KEYWORD_RULES if rules is None else rules
    features = frozenset(features)
    passed = [c for c in requests.columns]
    rows = requests
    if "split" not in rows.columns:
        rows = rows.withColumn("split", F.lit(0))
    if "product_family" not in rows.columns:
        rows = rows.withColumn("product_family", F.lit(None).cast("string"))
    if not parsed:
        rows = P.with_phrases(rows.withColumn("text", C.fix_text(F.col(text_col))), shown=True)
    elif "shown" not in rows.columns:
        rows = P.with_shown(rows)  # a report without quotes leaves these columns out, and then they are not worked out
    # pass 1: the wordings that history does not know
    if readings is None:
        readings = readings_of(rows, evidence, features, fallback)
    # pass 2: joins and one projection
    stated = _states_need()
    phrases = evidence.phrases.select(
        "split", "last", F.col("team").alias("p_team"), F.col("k").alias("p_k"), F.col("n").alias("p_n"),
        F.col("alternatives").alias("p_alternatives"))
    key = ["split", row_id]
    rows = lookup(rows, phrases, ["split", "last"], key)
    rows = rows.withColumn("_unknown_text", F.when(stated & F.col("p_team").isNull(), F.col("text")))
    rows = lookup_where(rows, readings.withColumnRenamed("text", "_unknown_text"), ["split", "_unknown_text"], key,
                        F.col("_unknown_text").isNotNull())
    rows = rows.join(F.broadcast(evidence.stats), "split", "left")  # one row per split
    if {"A1", "C2"} & features:
        products = evidence.products.select("split", "product_family", F.col("n").alias("product_n"),
                                            F.col("post").alias("product_post"), ranked(F.col("post")).alias("_by_product"))
        rows = lookup(rows, products, ["split", "product_family"], key)
    else:
        rows = rows.withColumns({"product_n": F.lit(None).cast("bigint"),
                                 "product_post": F.lit(None).cast("array<double>"), "_by_product": F.lit(None)})

    vague = F.col("vague") | F.coalesce("r_vague", F.lit(False))
    last = F.coalesce("r_last", "last")
    seen_team, seen_k, seen_n = F.coalesce("p_team", "r_team"), F.coalesce("p_k", "r_k"), F.coalesce("p_n", "r_count")
    blank = ~F.col("text").rlike(r"(?U)\S")
    rows = rows.withColumns({
        "route_type": F.when(blank | (last == ""), "empty").when(vague, "vague").when(seen_team.isNotNull(), "seen")
                       .otherwise("new_wording"),
        "_last": last,
        "_repaired": F.col("note").isNotNull(),
        "_n": F.coalesce("r_n", "n_clauses"),
        "_first": F.coalesce("r_first", "first"),
        "_seen_team": seen_team, "_seen_k": seen_k, "_seen_n": seen_n,
        "_seen_alternatives": F.coalesce("p_alternatives", "r_alternatives"),
        "_remark": P.payment_remark(F.col("text")),
    })
    is_new = F.col("route_type") == "new_wording"
    rows = rows.withColumns({
        "rule_team": F.when(is_new, first_rule(F.col("_last"), rules)),
        "rule_label": F.when(is_new, first_rule(F.col("_last"), rules, 2)),
        "rule_teams": F.when(is_new, matching_teams(F.col("_last"), rules)),
    })
    rows = rows.withColumn("rule_others", F.filter("rule_teams", lambda t: t != F.col("rule_team")))

    # ---- new wording: the first step that has an answer
    votes = F.array_compact(F.array("rule_team", "near_team", "fb_team"))
    agree = lambda t: F.coalesce(F.size(F.filter(votes, lambda v: v == t)), F.lit(0))
    rows = rows.withColumn("_agree", F.when(is_new, F.greatest(agree(F.col("rule_team")), agree(F.col("near_team")), agree(F.col("fb_team")))))
    voted = F.when(agree(F.col("rule_team")) == F.col("_agree"), F.col("rule_team")).when(
        agree(F.col("near_team")) == F.col("_agree"), F.col("near_team")).otherwise(F.col("fb_team"))
    steps = []  # (detail, condition, team, confidence)
    if "B3" in features:
        steps.append(("paraphrase", F.col("para_team").isNotNull(), F.col("para_team"), F.lit(0.85)))
    if "B1" in features:
        steps.append(("similar", F.col("near_sim") >= L.FUZZY_MIN_SIM, F.col("near_team"), F.lit(0.8)))
    if "B2" in features:
        steps.append(("vote", F.col("_agree") >= 2, voted,
                      F.when(F.col("_agree") == 3, F.lit(0.85)).otherwise(F.lit(0.75))))
        steps.append(("vote_split", F.lit(True), F.coalesce("rule_team", "near_team", "fb_team"), F.lit(0.55)))
    steps.append(("rules", F.col("rule_team").isNotNull() & (F.size("rule_others") == 0), F.col("rule_team"), F.lit(0.8)))
    steps.append(("rules_conflict", F.col("rule_team").isNotNull(), F.col("rule_team"), F.lit(0.6)))
    steps.append(("model", F.lit(True), F.col("fb_team"), F.least(F.col("fb_conf"), F.lit(0.6))))

    detail = F
    for name, when, _, _ in steps:
        detail = detail.when(F.coalesce(when, F.lit(False)), F.lit(name))
    kind = F.col("route_type")
    rows = rows.withColumn("route_detail", F.when(kind == "seen", F.when(F.col("_repaired"), "repaired").otherwise("exact"))
                           .when(is_new, detail).otherwise(F.lit("")))
    new_team, new_conf = F, F
    for name, _, team, conf in steps:
        new_team = new_team.when(F.col("route_detail") == name, team)
        new_conf = new_conf.when(F.col("route_detail") == name, conf)
    by_product = (F.col("_by_product").isNotNull() if "A1" in features else F.lit(False))
    rows = rows.withColumns({
        "team": F.when(kind == "empty", F.coalesce("pooled_team", "clear_team"))
                 .when((kind == "vague") & by_product, F.try_element_at("_by_product", F.lit(1))["team"] if "A1" in features else F.lit(None))
                 .when(kind == "vague", F.coalesce("pooled_team", "clear_team"))
                 .when(kind == "seen", F.col("_seen_team"))
                 .otherwise(new_team),
        "_conf": F.when(kind == "empty", F.lit(0.0))
                  .when((kind == "vague") & by_product, F.try_element_at("_by_product", F.lit(1))["value"] if "A1" in features else F.lit(None))
                  .when(kind == "vague", F.col("pooled_k") / F.col("pooled_n"))
                  .when(kind == "seen", F.col("_seen_k") / F.col("_seen_n"))
                  .otherwise(new_conf),
        "alternatives": F.when(kind == "empty", F.array().cast(NO_ALTERNATIVES))
                         .when((kind == "vague") & by_product, F.transform(
                             F.slice("_by_product", 1, 3), lambda s: F.struct(s["team"].alias("team"), F.bround(s["value"], 3).alias("share")))
                             if "A1" in features else F.lit(None).cast(NO_ALTERNATIVES))
                         .when(kind == "vague", F.col("pooled_alternatives"))
                         .when(kind == "seen", F.col("_seen_alternatives"))
                         .otherwise(F.col("fb_alternatives")),
    })
    rows = rows.withColumn("needs_clarification", kind.isin("empty", "vague") | (is_new & (F.col("_conf") < 0.7)))
    ask = F.col("needs_clarification")
    rows = rows.withColumns({
        "confidence": F.bround("_conf", 3),
        "confidence_level": F.when((F.col("_conf") >= 0.9) & ~ask, "high").when(F.col("_conf") >= 0.7, "medium").otherwise("low"),
        "auto_route": (F.col("_conf") >= 0.7) & ~ask,
        "clarifying_question": F.when(ask, clarifying_question("C2" in features)),
        "alternatives_basis": _basis(kind),
        "deciding_request": F.col("last_shown"),
        "model_version": F.lit(L.MODEL_VERSION),
    })
    if evidence.teams is not None:
        rows = rows.join(F.broadcast(evidence.teams.select("team", "handles")), "team", "left")  # one row per team
    else:
        rows = rows.withColumn("handles", F.lit(None).cast("string"))
    rows = rows.withColumn("reasons", reasons(features))
    return rows.select(*passed, *[c for c in DECISION if c not in passed])


DECISION = ["team", "confidence", "confidence_level", "auto_route", "route_type", "route_detail", "needs_clarification",
            "clarifying_question", "alternatives", "alternatives_basis", "reasons", "deciding_request", "model_version"]


def _basis(kind: Column) -> Column:
    out = F
    for k, text in L.ALTERNATIVES_BASIS.items():
        out = out.when(kind == k, F.lit(text))
    return out.otherwise(F.lit(""))


def clarifying_question(by_likelihood: bool) -> Column:
    """One question with an option per team; with C2 the options come in order of likelihood, the first three marked."""
    if not by_likelihood:
        options = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(t).alias("team"), F.lit(False).alias("likely"))
                            for l, t in L.CLARIFY_OPTIONS])
    else:
        share = F.map_from_arrays(F.array(*map(F.lit, L.TEAMS)), option_shares())
        scored = F.array_sort(F.array(*[
            F.struct((-F.try_element_at(share, F.lit(t))).alias("minus"), F.lit(i).alias("i"), F.lit(l).alias("label"),
                     F.lit(t).alias("team")) for i, (l, t) in enumerate(L.CLARIFY_OPTIONS)]))
        liked = F.transform(scored, lambda o, i: F.struct(
            o["label"].alias("label"), o["team"].alias("team"),
            (_has_product() & (i < 3)).alias("likely")))
        plain = clarifying_question(False)["options"]
        options = F.when(_has_product(), liked).otherwise(plain)
    return F.struct(F.lit(L.CLARIFY_QUESTION).alias("question"), options.cast(OPTION).alias("options"))


def _has_product() -> Column:
    return F.coalesce(F.col("product_family") != "", F.lit(False))


def option_shares() -> Column:
    """Likelihood of each team for the row's product; the pooled shares when the product is unknown."""
    pooled = F.transform("pooled_counts", lambda c: c / F.col("pooled_n"))
    return F.coalesce("product_post", pooled)


# ------------------------------------------------------------------------------------ reasons
def reasons(features) -> Column:
    """Plain-language reasons in a fixed order; parts that do not apply are left out."""
    kind, detail, team = F.col("route_type"), F.col("route_detail"), F.col("team")
    asked = F.concat(F.lit("Request: “"), F.col("last_shown"), F.lit("”."))
    read_as = F.when(F.col("_repaired"), F.concat(
        F.lit("Taken as “"), C.unmask(F.col("_last")), F.lit("” with spelling and Hindi words put right.")))
    conf_pct = percent(F.col("_conf"))
    product_guess = F.concat(
        F.lit("Unclear message about "), F.col("product_family"), F.lit(": tried first with "), team, F.lit(" ("), conf_pct,
        F.lit(" of "), thousands(F.col("product_n")), F.lit(" like it for "), F.col("product_family"),
        F.lit("). Only a starting point; over all products the usual team is "),
        F.col("pooled_team"), F.lit(", and the words alone do not settle it."))
    pooled_guess = F.concat(
        F.lit("Unclear messages so far: "), thousands(F.col("pooled_n")),
        F.lit("; every team got some, most went to "), team, F.lit(" with "), conf_pct,
        F.lit(". The words alone do not settle it."))
    vague_guess = F.coalesce(F.when(F.col("_by_product").isNotNull(), product_guess), pooled_guess) \
        if "A1" in features else pooled_guess
    checks = F.concat(F.lit("rules say "), F.coalesce("rule_team", F.lit("nothing")), F.lit("; nearest text says "),
                      F.coalesce("near_team", F.lit("none")), F.lit("; fallback says "), F.col("fb_team"))
    new_reason = (
        F.when(detail == "paraphrase", F.concat(
            F.lit("Listed as a rewording of “"), C.unmask(F.col("para_source")), F.lit("”, a matter for "), team, F.lit(".")))
        .when(detail == "similar", F.concat(
            F.lit("Most similar earlier text: “"), C.unmask(F.col("near_key")), F.lit("” (score "), fixed(F.col("near_sim"), 2),
            F.lit("), a matter for "), team, F.lit(".")))
        .when(detail == "vote", F.concat(
            F.lit("Not seen before. "), F.col("_agree").cast("string"), F.lit(" of three votes go to "), team, F.lit(" ("), checks, F.lit(").")))
        .when(detail == "vote_split", F.concat(
            F.lit("Not seen before, and the votes differ ("), checks, F.lit("). Please ask back.")))
        .when(detail == "rules", F.concat(
            F.lit("Not seen before; its words point to "), F.col("rule_label"), F.lit(", so "), team, F.lit(" takes it.")))
        .when(detail == "rules_conflict", F.concat(
            F.lit("Not seen before; its words point to "), F.col("rule_label"), F.lit(" ("), team,
            F.lit(") but also to "), F.array_join("rule_others", ", "), F.lit(". Please ask back.")))
        .when(detail == "model", F.lit(
            "Not seen before and no rule fits; the fallback decided.")))
    two_share = F.when(F.col("two_n") > 0, F.concat(percent(F.col("two_k") / F.col("two_n")), F.lit(" of "),
                                                    thousands(F.col("two_n")))).otherwise(F.lit("most"))
    first_shown = F.when(F.size("shown") >= 2, F.col("first_shown")).otherwise(F.col("_first"))
    two = (
        F.when((F.col("_n") >= 2) & kind.isin("seen", "new_wording"), F.concat(
            F.col("_n").cast("string"), F.lit(" requests in one message (“"), first_shown, F.lit("” before “"),
            F.col("last_shown"), F.lit("”). The later one counts, as in "), two_share,
            F.lit(" earlier cases with two. Pass the first one on to "), team, F.lit(" as well.")))
        .when((F.col("_n") >= 2) & (kind == "vague"), F.concat(
            F.lit("Before that it says “"), F.col("first_shown"),
            F.lit("”; in earlier cases this did not tell who closed an unclear message."))))
    history = F.when(F.col("pay_n") > 0, F.concat(
        F.lit(" First sent to Billing: "), thousands(F.col("pay_bot")), F.lit(" of "), thousands(F.col("pay_n")),
        F.lit(" earlier ones; closed there: "), thousands(F.col("pay_closed")), F.lit("."))).otherwise(F.lit(""))
    paid = F.when(F.col("_remark").isNotNull() & (team != "Billing"), F.concat(
        F.lit("Payment remark “"), F.col("_remark"), F.lit("” does not decide the team."), history))
    handles = F.when(F.col("handles").isNotNull() & (kind != "vague"), F.concat(F.lit("Work of "), team, F.lit(": "), F.col("handles")))
    return F.array_compact(F.array(
        F.when(kind == "empty", F.lit("Empty message. Please ask for the need.")),
        F.when(kind == "vague", F.concat(F.lit("No need is stated (“"), F.col("last_shown"), F.lit("”)."))),
        F.when(kind == "vague", vague_guess),
        F.when(kind == "vague", F.lit("Put the question to the sender first; otherwise correct the team after the first contact.")),
        F.when(kind.isin("seen", "new_wording"), asked),
        F.when(kind.isin("seen", "new_wording"), read_as),
        F.when(kind == "seen", F.concat(thousands(F.col("_seen_n")), F.lit(" earlier requests read the same; "),
                                        share_text(F.col("_seen_k"), F.col("_seen_n")), F.lit(" of them ended at "), team, F.lit("."))),
        F.when(kind == "new_wording", new_reason),
        two, paid, handles))
