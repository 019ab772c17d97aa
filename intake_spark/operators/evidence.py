"""What history teaches: outcome tables learned from closed requests.

One pass over history reduces it to ``base``: counts per distinct (deciding request, outcome, ...).
Every other table is derived from ``base``, which is as large as the wording is varied and not as
history is long. All tables carry the ``split`` they were learned for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import parse as P
from ..session import publish, publish_all
from .lookups import lookup
from .splits import WHOLE, Splits


# ------------------------------------------------------------------------------------ team vectors
def team_counts(df: DataFrame, keys: list[str], team: str = "team", n: str = "n") -> DataFrame:
    """(keys, counts, n): one count per team, in the fixed team order, in a single aggregation.

    Teams are columns of the aggregation, so a key never becomes a list of rows, and the counts are
    combined on the map side before the shuffle.
    """
    sums = [F.coalesce(F.sum(F.when(F.col(team) == t, F.col(n))), F.lit(0)).cast("bigint").alias(f"_t{i}")
            for i, t in enumerate(L.TEAMS)]
    out = df.groupBy(*keys).agg(*sums, F.sum(n).cast("bigint").alias("n"))
    return out.withColumn("counts", F.array(*[F.col(f"_t{i}") for i in range(len(L.TEAMS))])) \
              .drop(*[f"_t{i}" for i in range(len(L.TEAMS))])


def ranked(values: Column) -> Column:
    """Teams with a positive value, largest first; equal values in team order."""
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("minus"),
                                                      F.element_at(F.array(*map(F.lit, L.TEAMS)), i + 1).alias("team")))
    return F.transform(F.filter(F.array_sort(pairs), lambda s: s["minus"] < 0),
                       lambda s: F.struct(s["team"].alias("team"), (-s["minus"]).alias("value")))


def with_majority(df: DataFrame) -> DataFrame:
    """Adds team, k (its count) and alternatives (up to three teams with their shares)."""
    out = df.withColumn("_ranked", ranked(F.col("counts")))
    return out.withColumns({
        "team": F.try_element_at("_ranked", F.lit(1))["team"],
        "k": F.try_element_at("_ranked", F.lit(1))["value"],
        "alternatives": F.transform(F.slice("_ranked", 1, 3), lambda s: F.struct(
            s["team"].alias("team"), F.bround(s["value"] / F.col("n"), 3).alias("share"))),
    }).drop("_ranked")


# ------------------------------------------------------------------------------------ tables
def evidence_base(parsed: DataFrame, target: str, splits: Splits) -> DataFrame:
    """History as counts, once per split that learns from it; requests without an outcome teach nothing."""
    opt = {c: (F.col(c) if c in parsed.columns else F.lit(None).cast("string"))
           for c in ("product_family", "warranty_status", "bot_team")}
    vague = F.col("vague")
    grouped = parsed.where(F.col(target).isNotNull()).groupBy(
        "bucket", "vague", "last",
        F.when(F.col("n_clauses") >= 2, F.col("first")).alias("first"),
        F.when(vague, opt["product_family"]).alias("product_family"),
        F.when(vague, opt["warranty_status"]).alias("warranty_status"),
        P.has_payment_remark(F.col("text")).alias("paid"),
        F.coalesce(opt["bot_team"] == "Billing", F.lit(False)).alias("bot_billing"),
        F.col(target).alias("team"),
    ).agg(F.count("*").alias("n"), F.max("created_at").alias("until"))
    return grouped.withColumn("split", F.explode(splits.learners(F.col("bucket")))).drop("bucket")


def phrase_table(base: DataFrame, min_support: int = L.MIN_SUPPORT) -> DataFrame:
    """(split, last) -> majority team with its count, for wording seen often enough."""
    counted = team_counts(base.where(~F.col("vague")), ["split", "last"]).where(F.col("n") >= min_support)
    return with_majority(counted)


def clear_table(base: DataFrame) -> DataFrame:
    """(split) -> outcome of all requests that state a need."""
    return with_majority(team_counts(base.where(~F.col("vague")), ["split"]))


def vague_table(base: DataFrame) -> DataFrame:
    """(split) -> outcomes of requests that state no need."""
    return with_majority(team_counts(base.where("vague"), ["split"]))


def vague_key_table(base: DataFrame, keys: list[str]) -> DataFrame:
    """(split, keys) -> outcomes of vague requests for one product (or product and warranty)."""
    known = base.where("vague")
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return team_counts(known, ["split"] + keys)


def posterior(counts: Column, n: Column, prior_counts: Column, prior_n: Column, alpha: int = L.VAGUE_ALPHA) -> Column:
    """P(team | vague, key), shrunk towards the pooled outcomes: (n_team + alpha * prior) / (n + alpha)."""
    return F.zip_with(counts, prior_counts, lambda c, p: (c + F.lit(float(alpha)) * (p / prior_n)) / (n + F.lit(alpha)))


def rebalanced(post: Column, prior_counts: Column, prior_n: Column, gamma: float) -> Column:
    """The posterior divided by prior^gamma, which favours rarely predicted teams."""
    return F.zip_with(post, prior_counts,
                      lambda v, p: F.when(p > 0, v / F.pow(p / prior_n, F.lit(gamma))).otherwise(F.lit(0.0)))


def shrunk_posterior(base: DataFrame, keys: list[str]) -> DataFrame:
    """(split, keys) -> counts, n, the pooled counts and the shrunk posterior."""
    pooled = vague_table(base).select("split", F.col("counts").alias("pooled_counts"), F.col("n").alias("pooled_n"))
    # one row per split on the pooled side
    return vague_key_table(base, keys).join(F.broadcast(pooled), "split").withColumn(
        "post", posterior(F.col("counts"), F.col("n"), F.col("pooled_counts"), F.col("pooled_n")))


def two_request_table(base: DataFrame, phrases: DataFrame) -> DataFrame:
    """(split) -> k of n two-request messages whose requests belong to different teams closed with the last one's."""
    two = base.where(~F.col("vague") & F.col("first").isNotNull())
    two = two.groupBy("split", "first", "last", "team").agg(F.sum("n").alias("n"))
    firsts = phrases.select("split", F.col("last").alias("first"), F.col("team").alias("first_team"))
    lasts = phrases.select("split", "last", F.col("team").alias("last_team"))
    row = ["split", "first", "last", "team"]
    known = lookup(lookup(two, firsts, ["split", "first"], row, "inner"), lasts, ["split", "last"], row, "inner")
    differ = known.where("first_team <> last_team")
    return differ.groupBy("split").agg(
        F.coalesce(F.sum(F.when(F.col("team") == F.col("last_team"), F.col("n"))), F.lit(0)).alias("two_k"),
        F.sum("n").alias("two_n"))


def payment_table(base: DataFrame, phrases: DataFrame) -> DataFrame:
    """(split) -> messages with a payment remark whose wording is not a billing one: bot said / closed by Billing, all."""
    paid = base.where("paid").groupBy("split", "last", "bot_billing", "team").agg(F.sum("n").alias("n"))
    majority = phrases.select("split", "last", F.col("team").alias("last_team"))
    rest = lookup(paid, majority, ["split", "last"], ["split", "last", "team"]).where(
        F.coalesce(F.col("last_team") != "Billing", F.lit(True)))
    return rest.groupBy("split").agg(
        F.coalesce(F.sum(F.when(F.col("bot_billing"), F.col("n"))), F.lit(0)).alias("pay_bot"),
        F.coalesce(F.sum(F.when(F.col("team") == "Billing", F.col("n"))), F.lit(0)).alias("pay_closed"),
        F.sum("n").alias("pay_n"))


def meta_table(base: DataFrame) -> DataFrame:
    """(split) -> what the tables were learned from."""
    return base.groupBy("split").agg(
        F.sum("n").alias("trained_rows"),
        F.coalesce(F.date_format(F.max("until"), "yyyy-MM-dd"), F.lit("")).alias("trained_until"),
    ).withColumn("version", F.lit(L.MODEL_VERSION))


def words_of(text: Column) -> Column:
    """Blank-separated words of the lower-cased text that consist of letters only."""
    s = F.lower(text)
    any_letters = F.filter(F.split(s, r"(?U)\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    return F.when(F.octet_length(s) == F.char_length(s), F.regexp_extract_all(s, F.lit(r"(?<!\S)[a-z]+(?!\S)"), F.lit(0))).otherwise(any_letters)


def vocabulary(parsed: DataFrame, splits: Splits) -> DataFrame:
    """(split, word): every word of the training texts, and of the English side of the phrase dictionary.

    Words are made distinct on the map side, so a word that is in every message is sent once per task.
    """
    own = parsed.select("bucket", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).distinct()
    known = own.withColumn("split", F.explode(splits.learners(F.col("bucket")))).select("split", "word")
    english = sorted({w for _, rep in L.HINGLISH for w in rep.split()})
    fixed = known.sparkSession.createDataFrame(
        [(s, w) for s in sorted(splits.learns) for w in english], "split int, word string")
    return known.unionByName(fixed).distinct()


def paraphrase_table(paraphrases: DataFrame, phrases: DataFrame) -> DataFrame:
    """(split, last) -> team and source wording, for paraphrases of known wording.

    A paraphrase never shadows a known or vague wording; if two sources give the same one, the
    source that comes first in the alphabet keeps it.
    """
    cand = P.with_phrases(paraphrases.select("source", F.col("paraphrase").alias("text")))
    cand = cand.where("last <> '' and not vague").select("source", "last").distinct()
    by_source = phrases.select("split", F.col("last").alias("source"), F.col("team").alias("para_team"))
    known = phrases.select("split", "last")
    return (cand.join(by_source, "source").join(known, ["split", "last"], "left_anti")
            .groupBy("split", "last")
            .agg(F.min(F.struct(F.col("source").alias("para_source"), "para_team")).alias("s"))
            .select("split", "last", "s.para_team", "s.para_source"))


def stats_table(base: DataFrame, phrases: DataFrame) -> DataFrame:
    """One row per split: what it was learned from, pooled outcomes, and the evidence quoted in reasons."""
    def prefixed(df, p):
        return df.select("split", *[F.col(c).alias(f"{p}_{c}") for c in ("counts", "n", "team", "k", "alternatives")])

    out = meta_table(base)
    for part in (prefixed(clear_table(base), "clear"), prefixed(vague_table(base), "pooled"),
                 two_request_table(base, phrases), payment_table(base, phrases)):
        out = out.join(F.broadcast(part), "split", "left")  # one row per split on both sides
    return out.fillna(0, ["two_k", "two_n", "pay_bot", "pay_closed", "pay_n"])


@dataclass(frozen=True)
class Evidence:
    """The learned tables. All are published, so scoring never recomputes history."""

    base: DataFrame
    phrases: DataFrame
    products: DataFrame
    stats: DataFrame
    vocab: DataFrame | None
    paraphrases: DataFrame | None
    teams: DataFrame | None
    min_support: int = L.MIN_SUPPORT

    def with_support(self, k: int) -> "Evidence":
        """The same evidence with another minimum number of past requests per wording."""
        return replace(self, phrases=publish(phrase_table(self.base, k), "phrases"), min_support=k)


TABLES = ("base", "phrases", "products", "stats", "vocab", "paraphrases", "teams")


def fit(history: DataFrame, target: str = "final_team_cur", splits: Splits = WHOLE, features=L.DEFAULT_FEATURES,
        paraphrases: DataFrame | None = None, teams: DataFrame | None = None,
        min_support: int = L.MIN_SUPPORT, parsed: bool = False) -> Evidence:
    """Learn all tables from cleaned history (``text``, ``created_at``, the target, optionally product and bot label)."""
    rows = history if parsed else P.with_phrases(history)
    if "bucket" not in rows.columns:
        rows = rows.withColumn("bucket", F.lit(0))
    first = {"base": evidence_base(rows, target, splits)}
    if "B4" in features:
        first["vocab"] = vocabulary(rows, splits)
    first = publish_all(**first)
    base, vocab = first["base"], first.get("vocab")
    phrases = publish(phrase_table(base, min_support), "phrases")
    para = (publish(paraphrase_table(paraphrases, phrases), "paraphrases")
            if paraphrases is not None and "B3" in features else None)
    rest = publish_all(products=shrunk_posterior(base, ["product_family"]), stats=stats_table(base, phrases))
    return Evidence(base=base, phrases=phrases, vocab=vocab, paraphrases=para, teams=teams, min_support=min_support,
                    **rest)


def save(evidence: Evidence, folder: str) -> None:
    """Persist the learned tables as Parquet, one folder per table."""
    for name in TABLES:
        table = getattr(evidence, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
    evidence.stats.select(F.lit(evidence.min_support).alias("min_support")).distinct().write.mode("overwrite").parquet(
        f"{folder}/settings")


def load(spark, folder: str) -> Evidence:
    from pyspark.errors import AnalysisException

    def read(name):
        try:
            return spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            return None

    settings = read("settings").first()
    return Evidence(**{n: read(n) for n in TABLES}, min_support=settings["min_support"])


def product_majority(base_rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """(last, product) cells with enough support whose majority differs from the wording's own majority."""
    cells = team_counts(base_rows, ["last", "product_family"]).where(F.col("n") >= L.MIN_SUPPORT)
    own = phrases.select("last", F.col("team").alias("phrase_team"))
    return with_majority(cells).select("last", "product_family", F.col("team").alias("cell_team"), "n").join(own, "last")


def top_phrase(df: DataFrame, by: str, phrase: str) -> DataFrame:
    """The most frequent phrase in each family (equal counts: alphabetical)."""
    counts = df.groupBy(by, phrase).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(
        F.min(F.struct((-F.col("n")).alias("minus"), F.col(phrase).alias("phrase"))).alias("s"),
        F.sum("n").alias("family_rows")).select(by, F.col("s.phrase").alias(phrase), (-F.col("s.minus")).alias("n"), "family_rows")


def occurrence_rank(df: DataFrame, by: str, order: list[str], pieces: int = 64) -> DataFrame:
    """0-based position of each row within its group in the given order (window over the group).

    A hot group is not sorted by one task: rows are ranked inside time slices of the group first and
    the sizes of the earlier slices are added.
    """
    first = order[0]
    sliced = df.withColumn("_slice", F.date_trunc("day", F.col(first)))
    w = Window.partitionBy(by, "_slice").orderBy(*order)
    sizes = sliced.groupBy(by, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked_rows = sliced.withColumn("_in_slice", F.row_number().over(w) - 1)
    return (ranked_rows.join(offsets, [by, "_slice"])
            .withColumn("rank", (F.col("_in_slice") + F.col("_before")).cast("bigint"))
            .drop("_slice", "_in_slice", "_before"))
