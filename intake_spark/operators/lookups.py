"""Joins of a large row set to a learned table, safe at any table size and under any key skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import publish

# A learned row is a phrase or a message (at most 2,000 characters) and a few numbers, so this many
# rows stay below some 40 MB on each executor.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 4 << 20  # of files: a few times as much in memory
HOT_SHARE = 1_000   # a key is hot when it holds at least 1/1000 of the rows: so at most 1,000 keys are
HOT_PIECES = 64     # a hot key is spread over this many pieces


def planned_bytes(table: DataFrame) -> int | None:
    """The planner's size of a table: for a published one the size of its files. No job is run."""
    try:
        return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a client without access to the planner
        return None


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table may be broadcast: by the size of its files, else by reading at most ``rows + 1`` rows."""
    size = planned_bytes(table)
    if size is not None and size <= BROADCAST_BYTES:
        return True
    return table.limit(rows + 1).count() <= rows


def lookup(left: DataFrame, table: DataFrame, keys: list[str], row_id: list[str], how: str = "left",
           rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``left`` to a published ``table``.

    A small table is broadcast, so the big side is never shuffled. A larger one is joined by a
    shuffle in which hot keys and NULL keys of the big side are spread by a hash of ``row_id``; the
    few table rows they need are repeated once per piece. Nothing is dropped on either way.
    """
    if is_small(table, rows):
        return left.join(F.broadcast(table), keys, how)
    return spread_join(left, table, keys, row_id, how)


def lookup_where(left: DataFrame, table: DataFrame, keys: list[str], row_id: list[str], needed: Column) -> DataFrame:
    """``lookup`` for rows with ``needed`` (never NULL); beyond a broadcast, the other rows stay out of the shuffle."""
    if is_small(table):
        return left.join(F.broadcast(table), keys, "left")
    none = {f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name not in keys}
    return spread_join(left.where(needed), table, keys, row_id).unionByName(left.where(~needed).withColumns(none))


def spread_join(left: DataFrame, table: DataFrame, keys: list[str], row_id: list[str], how: str = "left",
                share: int = HOT_SHARE, pieces: int = HOT_PIECES) -> DataFrame:
    """The shuffle side of ``lookup``; the big side is read once for its key counts and once for the join."""
    counts = publish(left.groupBy(*keys).agg(F.count("*").alias("_rows")), "key_counts")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    hot = counts.where((F.col("_rows") * share >= F.lit(total)) & (F.col("_rows") > 1)).select(*keys, F.lit(True).alias("_hot"))
    piece = F.pmod(F.xxhash64(*row_id), F.lit(pieces)).cast("int")
    is_null = F.lit(False)
    for k in keys:
        is_null = is_null | F.col(k).isNull()
    marked = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_piece", F.when(F.col("_hot") | is_null, piece).otherwise(F.lit(0))).drop("_hot")
    repeated = table.join(F.broadcast(hot), keys, "left").withColumn(
        "_piece", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(pieces - 1)))
                            .otherwise(F.array(F.lit(0))))).drop("_hot")
    return marked.join(repeated, keys + ["_piece"], how).drop("_piece")
