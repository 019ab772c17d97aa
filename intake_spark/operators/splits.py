"""How history is divided into what a model learns from and what it is scored on.

A row belongs to one *bucket*; a *split* is a model that learns from some buckets and is scored on
another. Learned tables carry the split in their key, so every fold of a cross-validation is fitted
and scored in the same job: counts are taken once per bucket and handed to the splits that use them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..session import publish


@dataclass(frozen=True)
class Splits:
    """``learns[s]`` / ``scores[s]``: the buckets that split ``s`` learns from / is scored on."""

    learns: dict[int, tuple[int, ...]]
    scores: dict[int, tuple[int, ...]]

    def _members(self, bucket: Column, of: dict[int, tuple[int, ...]]) -> Column:
        buckets = sorted({b for bs in of.values() for b in bs})
        out = F
        for b in buckets:
            out = out.when(bucket == b, F.array(*[F.lit(s) for s, bs in sorted(of.items()) if b in bs]))
        return out if buckets else F.array().cast("array<int>")

    def learners(self, bucket: Column) -> Column:
        return self._members(bucket, self.learns)

    def scorers(self, bucket: Column) -> Column:
        return self._members(bucket, self.scores)

    def scored(self, rows: DataFrame) -> DataFrame:
        """The rows to score, one copy per split that scores them."""
        return rows.withColumn("split", F.explode(self.scorers(F.col("bucket"))))


WHOLE = Splits({0: (0,)}, {0: (0,)})
OUT_OF_TIME = Splits({0: (0,)}, {0: (1,)})


def k_fold(k: int) -> Splits:
    return Splits({s: tuple(b for b in range(k) if b != s) for s in range(k)}, {s: (s,) for s in range(k)})


def rolling(n: int = len(L.QUARTERS)) -> Splits:
    """Split i learns from everything before quarter i and is scored on quarter i (buckets 1..n; 0 = before)."""
    return Splits({i: tuple(range(i + 1)) for i in range(n)}, {i: (i + 1,) for i in range(n)})


def time_bucket(ts: Column, cuts: list[str]) -> Column:
    """0 before the first cut, i after cut i-1 (each cut belongs to the later bucket)."""
    out = F.lit(0)
    for c in cuts:
        out = out + (ts >= F.lit(c).cast("timestamp_ntz")).cast("int")
    return out


def out_of_time_bucket(ts: Column) -> Column:
    return time_bucket(ts, [L.OUT_OF_TIME_START])


def quarter_bucket(ts: Column) -> Column:
    """The quarter a row is scored in; what lies after the last quarter is in no quarter."""
    return time_bucket(ts, [q[1] for q in L.QUARTERS] + [L.QUARTERS[-1][2]])


def stable_hash(*columns) -> Column:
    """A 60-bit hash that other engines can recompute: the head of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("bigint")


def stratified_bucket(df: DataFrame, label: str, row_id: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Folds with the label's shares: rows take turns within (label, hash slice).

    The turns are counted inside 4,096 hash slices per label, so no single task ranks a whole label;
    every slice deals from its own starting fold.
    """
    slices = 4096
    sliced = df.withColumn("_h", stable_hash(F.col(row_id), F.lit(seed))).withColumn("_slice", F.col("_h") % slices)
    w = Window.partitionBy(label, "_slice").orderBy("_h", row_id)
    turn = F.row_number().over(w) - 1 + F.col("_slice")
    return sliced.withColumn("bucket", (turn % k).cast("int")).drop("_slice", "_h")


def group_buckets(df: DataFrame, group: str, k: int = 5, slices: int = 64) -> DataFrame:
    """(group, bucket): groups dealt by size, back and forth over the k folds.

    The turns are counted inside hash slices of the groups, each with its own starting fold: one rule at every size.
    """
    sizes = publish(df.groupBy(group).agg(F.count("*").alias("n")), "group_sizes")
    w = Window.partitionBy("_slice").orderBy(F.desc("n"), group)
    dealt = sizes.withColumn("_slice", stable_hash(F.col(group)) % slices).withColumn("_turn", F.row_number().over(w) - 1 + F.col("_slice"))
    seat = F.col("_turn") % k
    bucket = F.when(F.floor(F.col("_turn") / k) % 2 == 0, seat).otherwise(k - 1 - seat).cast("int")
    return publish(dealt.select(group, bucket.alias("bucket")), "group_buckets")
