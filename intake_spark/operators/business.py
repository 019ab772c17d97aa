"""What misrouting costs and who is busy, in the policy's rupee rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from .stats import exact_median


def trailing_months(history: DataFrame, months: int) -> DataFrame:
    """Rows from the last ``months`` calendar months before the newest row, both ends included.

    The cut is one value; at scale it is the newest date of the partitioned history.
    """
    cut = history.agg((F.max("created_at") - F.make_ym_interval(F.lit(0), F.lit(months))).alias("c")).first()["c"]
    return history.where(F.col("created_at") >= F.lit(cut).cast("timestamp_ntz"))


def misrouted() -> Column:
    return F.col("first_team_cur") != F.col("final_team_cur")


def request_cost() -> Column:
    """Transfers, plus one extra contact when the first team was wrong."""
    return F.col("transfers") * L.TRANSFER_RS + misrouted().cast("int") * L.EXTRA_CONTACT_RS


def misroute_costs(history: DataFrame, months: int = 12) -> DataFrame:
    """One row: volume, misroute rate, transfers, cost, cost per misrouted request, median hours both ways."""
    recent = trailing_months(history, months)
    mis = misrouted()
    sums = recent.agg(
        F.count("*").alias("requests_12m"), (F.count("*") / months).alias("per_month"),
        F.avg(mis.cast("int")).alias("misroute_rate"), F.sum("transfers").alias("transfers_12m"),
        F.sum(request_cost()).cast("double").alias("cost_12m"),
        F.avg(F.when(mis, request_cost())).alias("cost_per_misroute"))
    hours = exact_median(recent.withColumn("mis", mis), "hours_to_resolve", ["mis"]).agg(
        F.max(F.when(F.col("mis"), F.col("median"))).alias("hours_misrouted"),
        F.max(F.when(~F.col("mis"), F.col("median"))).alias("hours_right_first"))
    one = F.lit(1)
    return sums.withColumn("_k", one).join(F.broadcast(hours.withColumn("_k", one)), "_k").drop("_k")  # one row each


def team_volumes(history: DataFrame, months: int = 6) -> DataFrame:
    """Requests a month per team: what the baseline's labels say and what was closed, in one aggregation.

    Volumes are rounded half to even, and the shares are taken of the rounded volumes.
    """
    recent = trailing_months(history, months)
    sides = recent.select(F.explode(F.array(
        F.struct(F.col("bot_team").alias("team"), F.lit(1).alias("bot"), F.lit(0).alias("actual")),
        F.struct(F.col("final_team_cur").alias("team"), F.lit(0).alias("bot"), F.lit(1).alias("actual")))).alias("s"))
    v = sides.groupBy("s.team").agg(
        F.bround(F.sum("s.bot") / months, 0).alias("bot_label_per_month"),
        F.bround(F.sum("s.actual") / months, 0).alias("actual_per_month"))
    total = F.sum("actual_per_month").over(Window.partitionBy())  # one row per team
    return v.withColumns({
        "actual_share": F.bround(F.col("actual_per_month") / total, 3),
        "bot_overstates_by": (F.col("bot_label_per_month") - F.col("actual_per_month")).cast("int"),
    }).orderBy(F.desc("actual_per_month"), "team")


def scenarios(history: DataFrame, rates: DataFrame) -> DataFrame:
    """Today / router / router and one question: misroute rate, cost a year, licence, saving against today.

    ``rates`` is one row with router_right, bot_right and clear_right.
    """
    one = F.lit(1)
    c = misroute_costs(history).select("requests_12m", "cost_per_misroute").withColumn("_k", one)
    r = rates.withColumn("_k", one).join(F.broadcast(c), "_k")  # one row each
    yearly = F.col("requests_12m") * F.col("cost_per_misroute")
    bot_mis = 1 - F.col("bot_right")

    def row(name, miss, licence):
        saved = (bot_mis - miss) * yearly + (L.LICENCE_RS - licence)
        return F.struct(F.lit(name).alias("scenario"), miss.alias("wrong_first_team"), (miss * yearly).alias("misroute_cost"),
                        F.lit(licence).alias("licence"), saved.alias("saving"))

    return r.select(F.explode(F.array(
        row("Today: vendor bot", bot_mis, L.LICENCE_RS),
        row("Router, bot switched off", 1 - F.col("router_right"), 0),
        row("Router + one intake question", 1 - F.col("clear_right"), 0))).alias("s")).select("s.*")


def hours_by_source(history: DataFrame) -> DataFrame:
    """Check of the time-zone fix: medians agree between sources and nothing is negative."""
    negative = history.groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("hours_to_resolve") < 0).cast("int")).alias("negative_share"))
    return negative.join(F.broadcast(exact_median(history, "hours_to_resolve", ["source"])), "source")


def cost_per_miss(history: DataFrame) -> DataFrame:
    """One row: average cost of a misrouted request over all history."""
    return history.agg(F.avg(F.when(misrouted(), request_cost())).alias("cost_per_miss"))
