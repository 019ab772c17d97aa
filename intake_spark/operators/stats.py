"""Statistical tests on counts: exact paired test, step-down correction, bootstrap interval, association."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: the argument is raised by 8, then Stirling's series (error below 1e-12)."""
    z = x + 8
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def paired_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b wins against c losses at even odds.

    Twice the smaller tail: its largest term by log-Gamma, the others relative to it. The relative
    terms fall off like a normal curve, so 10 standard deviations of them are all that is summed.
    """
    b, c = b.cast("double"), c.cast("double")
    n, m = b + c, F.least(b, c)
    top = F.exp(log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1) - n * math.log(2))
    steps = F.least(m, F.ceil(5 * F.sqrt(n) + 60)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, j):
        term = acc["term"] * (m - j + 1) / (n - m + j)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    js = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(js, start, add, lambda acc: acc["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * top * tail))


def paired_counts(ok_new: Column, ok_base: Column) -> list[Column]:
    """wins and losses of the new decision against the base, as aggregates."""
    return [F.count_if(ok_new & ~ok_base).alias("wins"), F.count_if(~ok_new & ok_base).alias("losses")]


def holm(df: DataFrame, p: str = "p", by: list[str] = (), out: str = "p_holm") -> DataFrame:
    """Holm's step-down correction over one small table of p values (a row per model)."""
    whole = Window.partitionBy(*by)
    order = whole.orderBy(p, *[c for c in ("model", "variant") if c in df.columns])
    ranked = df.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count("*").over(whole))
    stepped = F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))
    return ranked.withColumn(out, F.max(stepped).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_m")


def upper_gamma(a: Column, x: Column, terms: int = 400) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a >= 1/2: the tail of a chi-square with 2a degrees at 2x.

    Below a + 1 one less a power series, from there on a continued fraction, taken from its far end; both have converged to
    double precision long before ``terms`` steps for a up to some thousands.
    """
    a, x = a.cast("double"), x.cast("double")
    lead = F.exp(a * F.log(x) - x - log_gamma(a + 1))  # x^a e^-x / Gamma(a + 1)
    steps = F.sequence(F.lit(1), F.lit(terms))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, n):
        term = acc["term"] * x / (a + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = 1 - lead * F.aggregate(steps, start, add, lambda acc: acc["total"])
    tail = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), x + 2 * terms + 1 - a, lambda acc, n: x + 2 * n - 1 - a - n * (n - a) / acc)
    fraction = lead * a / tail
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, series).otherwise(fraction)


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """Probability of a statistic at least this large without association; NULL without degrees of freedom."""
    return F.when(dof > 0, upper_gamma(F.greatest(dof, F.lit(1)) / 2, F.greatest(statistic, F.lit(0.0)) / 2))


def bootstrap_interval(decided: DataFrame, ok: Column, by: list[str] = (), resamples: int = 2000, seed: int = 0) -> DataFrame:
    """95% percentile interval of an accuracy, from replicates that any engine can recompute.

    A resample of n yes/no rows is fully described by how many of them are yes, and that number is binomial. Replicate b of a group
    draws the inverse of that distribution at a number made by hash from (group, b). The inverse is monotone, so
    the percentiles over replicates are those of the hashed numbers, looked up in a table of the distribution around its mean.
    """
    from .splits import stable_hash
    counts = decided.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("k")).where("n > 0")
    replicate = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    group = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in by)) if by else F.lit("all")
    drawn = counts.select(*by, "n", "k", replicate.alias("b")).withColumn("u", stable_hash(group, F.col("b").cast("string"), F.lit(str(seed))) / F.lit(float(1 << 60)))
    spots = {}
    for name, share in (("low", 0.025), ("high", 0.975)):
        at = share * (resamples - 1)
        spots |= {f"{name}0": int(at) + 1, f"{name}1": min(int(at) + 2, resamples)}
    sorted_u = drawn.groupBy(*by, "n", "k").agg(F.array_sort(F.collect_list("u")).alias("us"))  # as many as there are replicates
    p = F.col("k") / F.col("n")
    spread = F.ceil(10 + 9 * F.sqrt(F.col("n") * p * (1 - p))).cast("long")
    mean = F.floor(F.col("n") * p).cast("long")
    table = sorted_u.withColumn("j", F.explode(F.sequence(F.greatest(F.lit(0), mean - spread), F.least(F.col("n"), mean + spread))))
    n, j = F.col("n").cast("double"), F.col("j").cast("double")
    mass = F.when((p == 0) | (p == 1), (F.col("j") == F.col("k")).cast("double")).otherwise(
        F.exp(log_gamma(n + 1) - log_gamma(j + 1) - log_gamma(n - j + 1) + j * F.log(p) + (n - j) * F.log(1 - p)))
    table = table.withColumn("reached", F.sum(mass).over(Window.partitionBy(*by, "n", "k").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)))
    picks = [F.coalesce(F.min(F.when(F.col("reached") >= F.col("us")[i - 1], F.col("j"))), F.max("j")).alias(name) for name, i in spots.items()]
    part = {name: share * (resamples - 1) - int(share * (resamples - 1)) for name, share in (("low", 0.025), ("high", 0.975))}

    def between(name: str) -> Column:
        return ((1 - part[name]) * F.col(f"{name}0") + part[name] * F.col(f"{name}1")) / F.col("n")

    return table.groupBy(*by, "n", "k").agg(*picks).select(*by, "n", (F.col("k") / F.col("n")).alias("accuracy"), between("low").alias("low"), between("high").alias("high"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's statistic, degrees of freedom, p-value and Cramer's V of two categorical columns, from their counts."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("c"))
    joined = cells.join(rows, a).join(cols, b)
    one = joined.agg(
        F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"),
        F.count_distinct(a).alias("ra"), F.count_distinct(b).alias("cb"))
    stat = F.col("n") * (F.col("s") - 1)
    dof = (F.col("ra") - 1) * (F.col("cb") - 1)
    return one.select("n", stat.alias("statistic"), dof.alias("dof"), chi_square_p(stat, dof).alias("p"), F.when(
        F.least("ra", "cb") > 1, F.sqrt(F.greatest(stat, F.lit(0.0)) / (F.col("n") * (F.least("ra", "cb") - 1)))).alias("cramers_v"))


def exact_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact interpolating median per group, without holding a group's values in one place.

    Values are counted, the counts are summed per unit interval, and only the one or two intervals
    that hold the middle positions are looked into.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn(
        "_bin", F.floor(value))
    bins = counts.groupBy(*by, "_bin").agg(F.sum("_n").alias("_in_bin"))
    order = Window.partitionBy(*by).orderBy("_bin")
    bins = bins.withColumns({"_end": F.sum("_in_bin").over(order), "_all": F.sum("_in_bin").over(Window.partitionBy(*by))})
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    bins = bins.withColumns({"_start": F.col("_end") - F.col("_in_bin"), "_low": low, "_high": high}).where(
        ((F.col("_start") <= F.col("_low")) & (F.col("_low") < F.col("_end")))
        | ((F.col("_start") <= F.col("_high")) & (F.col("_high") < F.col("_end"))))
    inside = counts.join(F.broadcast(bins.select(*by, "_bin", "_start", "_low", "_high")), [*by, "_bin"])  # two bins per group
    inside = inside.withColumn("_to", F.col("_start") + F.sum("_n").over(Window.partitionBy(*by, "_bin").orderBy(value)))
    inside = inside.withColumn("_from", F.col("_to") - F.col("_n"))

    def at(pos):
        return F.max(F.when((F.col("_from") <= F.col(pos)) & (F.col(pos) < F.col("_to")), F.col(value)))

    return inside.groupBy(*by).agg(((at("_low") + at("_high")) / 2).alias("median"))
