"""How good decisions are: accuracy, per-team figures, confidence, selective routing, errors.

Every function takes ``decided`` (decisions next to the closing team ``final_team_cur`` and the
baseline's ``bot_team``) and reduces it in one aggregation; what follows works on a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import clean as C


def right(pred: str = "team", truth: str = "final_team_cur") -> Column:
    return F.coalesce((F.col(pred) == F.col(truth)).cast("int"), F.lit(0))


def share(condition: Column) -> Column:
    """Share of rows that meet the condition."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def mean_where(value: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, value))


def accuracy(decided: DataFrame, by: list[str] = (), pred: str = "team", vague: Column | None = None) -> DataFrame:
    """Rows, agreement with the closing team and with the baseline's label, overall / clear / vague."""
    is_vague = F.col("route_type") == "vague" if vague is None else vague
    ok = right(pred)
    return decided.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(ok).alias("vs_outcome"),
        F.avg(right(pred, "bot_team")).alias("vs_bot"),
        mean_where(ok, ~is_vague).alias("clear"),
        mean_where(ok, is_vague).alias("vague"),
        share(is_vague).alias("vague_share"))


def by_group(decided: DataFrame, group: str) -> DataFrame:
    """Share, router accuracy and baseline accuracy per route type, confidence level or deciding step."""
    out = decided.groupBy(group).agg(F.count("*").alias("n"), F.avg(right()).alias("router_right"),
                                     F.avg(right("bot_team")).alias("bot_right"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a few rows


def confusion_counts(decided: DataFrame, pred: str = "team") -> DataFrame:
    return decided.groupBy(F.col("final_team_cur").alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(decided: DataFrame, pred: str = "team") -> DataFrame:
    """One row per closing team, one column per decided team, in the fixed order, zeros filled in."""
    teams = decided.sparkSession.createDataFrame([(t,) for t in L.TEAMS], "truth string")
    wide = confusion_counts(decided, pred).groupBy("truth").agg(
        *[F.coalesce(F.sum(F.when(F.col("pred") == t, F.col("n"))), F.lit(0)).alias(t) for t in L.TEAMS])
    return teams.join(F.broadcast(wide), "truth", "left").fillna(0)


def team_report(decided: DataFrame, pred: str = "team", by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per team, from one confusion table; empty denominators give 0."""
    counts = decided.groupBy(*by, F.col("final_team_cur").alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    sides = counts.select(*by, F.explode(F.array(
        F.struct(F.col("truth").alias("team"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("team"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )).alias("s"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    per = sides.groupBy(*by, "s.team").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), (F.sum("hit") / 2).alias("hits"))
    per = per.where(F.col("team").isNotNull())
    return per.withColumns({
        "precision": F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0),
        "recall": F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0),
        "f1": F.when(F.col("predicted") + F.col("support") > 0,
                     2 * F.col("hits") / (F.col("predicted") + F.col("support"))).otherwise(0.0),
    }).select(*by, "team", "precision", "recall", "f1", "support")


def macro_f1(decided: DataFrame, pred: str = "team", by: list[str] = ()) -> DataFrame:
    """Mean F1 over the teams that occur as outcome or decision."""
    return team_report(decided, pred, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def selective_routing(decided: DataFrame) -> DataFrame:
    """Coverage and accuracy when only some requests are routed automatically; one pass, thresholds on rounded confidence."""
    rules = [
        ("always", F.lit(True)),
        ("confidence >= 0.70", F.col("confidence") >= 0.70),
        ("confidence >= 0.90", F.col("confidence") >= 0.90),
        ("not vague", F.col("route_type") != "vague"),
        ("auto_route flag", F.col("auto_route")),
    ]
    one = decided.agg(
        F.count("*").alias("n"),
        *[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(rules)],
        *[F.coalesce(F.sum(F.when(c, right())), F.lit(0)).alias(f"k{i}") for i, (_, c) in enumerate(rules)])
    return one.select("n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("auto_route_when"), F.col(f"n{i}").alias("routed"), F.col(f"k{i}").alias("routed_right"))
        for i, (name, _) in enumerate(rules)])).alias("r")).select(
        "r.auto_route_when", F.try_divide("r.routed", "n").alias("share_routed"),
        F.try_divide("r.routed_right", "r.routed").alias("accuracy_routed"),
        (1 - F.try_divide("r.routed", "n")).alias("share_to_person"))


def top_k(decided: DataFrame, ks=(1, 2, 3)) -> DataFrame:
    """How often the closing team is among the first k alternatives (the decision itself when there are none)."""
    names = F.transform("alternatives", lambda a: a["team"])
    shown = F.when(F.size("alternatives") > 0, names).otherwise(F.array("team"))
    hit = {k: F.array_contains(F.slice(shown, 1, k), F.col("final_team_cur")).cast("int") for k in ks}
    vague = F.col("route_type") == "vague"
    one = decided.agg(*[f.alias(f"{p}{k}") for k in ks for p, f in (
        ("a", F.avg(hit[k])), ("c", mean_where(hit[k], ~vague)), ("v", mean_where(hit[k], vague)))])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(k).alias("k"), F.col(f"a{k}").alias("all_requests"), F.col(f"c{k}").alias("clear_requests"),
        F.col(f"v{k}").alias("vague_requests")) for k in ks])).alias("r")).select("r.*")


def error_breakdown(decided: DataFrame) -> DataFrame:
    """Right / wrong vague / wrong clear, and how many of the clear errors are inconsistent records."""
    ok = right() == 1
    vague = F.col("route_type") == "vague"
    return decided.agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("right"),
        F.count_if(~ok & vague).alias("vague_errors"),
        F.count_if(~ok & ~vague).alias("clear_errors"),
        F.count_if(~ok & ~vague & F.col("inconsistent")).alias("inconsistent_errors"),
        (F.count_if(~ok & ~vague) / F.greatest(F.count_if(~vague), F.lit(1))).alias("clear_error_share"))


def error_rows(decided: DataFrame) -> DataFrame:
    """The wrongly decided requests, with numbers redacted for display."""
    return decided.where(right() == 0).select(
        "request_id", C.redact(F.col("text")).alias("shown"), "bot_team", "final_team_cur", "transfers",
        F.col("team").alias("pred"), "route_type", "confidence")


def sample_rows(df: DataFrame, n: int, row_id: str, seed: int = 0) -> DataFrame:
    """n rows in an order drawn from the seed: the same sample whatever the partitioning (top-n, no full sort)."""
    from .splits import stable_hash
    return df.withColumn("_draw", stable_hash(F.col(row_id), F.lit(seed))).orderBy("_draw", row_id).limit(n).drop("_draw")


def bot_monthly(history: DataFrame) -> DataFrame:
    return history.groupBy(C.month_of(F.col("created_at")).alias("month")).agg(
        F.count("*").alias("n"), F.avg(right("bot_team")).alias("bot_right"))


def bot_by_label(history: DataFrame) -> DataFrame:
    return history.groupBy("bot_team").agg(F.count("*").alias("n"), F.avg(right("bot_team")).alias("bot_right"))


def mix(decided: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values."""
    out = decided.groupBy(column).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a few rows


def weighted_accuracy(mix_table: DataFrame, accuracy_by_type: DataFrame) -> DataFrame:
    """Expected accuracy of a set with the given mix of route types."""
    return mix_table.join(F.broadcast(accuracy_by_type), "route_type").agg(
        F.sum(F.col("share") * F.col("accuracy")).alias("expected_accuracy"))


def clarify_projection(decided: DataFrame) -> DataFrame:
    """Accuracy if every vague request were asked and then routed as well as the clear ones."""
    vague = F.col("route_type") == "vague"
    one = decided.agg(share(vague).alias("vague_share"), mean_where(right(), ~vague).alias("clear_accuracy"))
    return one.withColumn("projected", (1 - F.col("vague_share")) * F.col("clear_accuracy")
                          + F.col("vague_share") * F.col("clear_accuracy"))


def fold_summary(per_fold: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    return per_fold.groupBy(*by).agg(
        F.count("*").alias("folds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("low"), F.max(value).alias("high"))
