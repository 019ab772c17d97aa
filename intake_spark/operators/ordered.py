"""Running totals inside ordered groups of any size: a hot group is cut into pieces by range, and totals are carried over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import publish

PIECE = "_piece"


def in_pieces(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` published with a piece number: rows range-partitioned by (``by``, ``order``).

    The pieces of a group follow each other in the order of the group. Ranges come from sampled rows, so a group with
    a third of all rows is a third of the pieces. Published, because a second run of the sampling would cut elsewhere.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return publish(df.repartitionByRange(parts, *by, *order).withColumn(PIECE, F.spark_partition_id()), "pieces")


def carried(pieces: DataFrame, by: list[str], order: list[Column], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running totals from the first row of the group to each row.

    ``totals`` maps a new column to (kind, value) with the kinds ``count``, ``sum`` and ``xor``. Each piece of a group is a
    window of its own. What earlier pieces add is one row for each piece that goes on with a group of the piece before: at most as
    many rows as there are pieces, so they are broadcast.
    """
    aggregate = {"count": F.count, "sum": F.sum, "xor": F.bit_xor}
    outer = {"count": F.sum, "sum": F.sum, "xor": F.bit_xor}
    inner = Window.partitionBy(*by, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    per_piece = pieces.groupBy(*by, PIECE).agg(*(aggregate[kind](value).alias(name) for name, (kind, value) in totals.items()))
    earlier = per_piece.select(*(F.col(k).alias(f"_by_{k}") for k in by), F.col(PIECE).alias("_at"),
                               F.count("*").over(before).alias("_earlier"),
                               *(outer[kind](name).over(before).alias(f"_before_{name}") for name, (kind, _) in totals.items()))
    earlier = earlier.where("_earlier > 0")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by], F.col(PIECE) == F.col("_at"))
    local = pieces.withColumns({name: aggregate[kind](value).over(inner) for name, (kind, value) in totals.items()})
    joined = local.join(F.broadcast(earlier), same, "left")

    def whole(name: str, kind: str) -> Column:
        prior = F.coalesce(F.col(f"_before_{name}"), F.lit(0))
        return F.col(name).bitwiseXOR(prior) if kind == "xor" else F.col(name) + prior

    return joined.withColumns({name: whole(name, kind) for name, (kind, _) in totals.items()}).drop("_at", "_earlier", *earlier.columns)


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 inside each group, NULL keys being a group; ``order`` should tell all rows of a group apart."""
    return carried(in_pieces(df, by, order), by, order, {name: ("count", F.lit(1))}).drop(PIECE)
