"""Approximate nearest neighbours by cosine: the blocks of the exact search, but a query meets only the cells of its nearest pivots.

How many cells that takes depends on the vectors: a few where they cluster, a large part of all where they point everywhere. So the number
is learned: a documented sample (the ``SAMPLE`` points with the smallest hash) searches exactly, and ``cells_needed`` takes the least number of
cells that holds ``GOAL`` of the places found. Every point is indexed.

Rows that move: as in the exact search, packed blocks; vectors are not repeated per cell. A task holds one group of queries. Distances are
exact, only membership is approximate: measure it with ``recall``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import publish
from .neighbors import best_in_blocks, in_blocks, no_neighbours, pivots_of, placed_by_pivot, with_vectors

#: Points that learn the number of cells, and the share of their exact places that it must hold.
SAMPLE, GOAL = 512, 0.95
#: Points that a cell aims at; there are at most ``CELLS`` cells.
LIMIT, CELLS = 256, 1024


def cells_needed(sample: DataFrame, cells: DataFrame, met: DataFrame, pivots: np.ndarray, k: int) -> int:
    """The least number of nearest cells that holds ``GOAL`` of the exact ``k`` places of ``sample`` (id, vec, cell)."""
    exact = best_in_blocks(in_blocks(sample), met, k, True)
    places = exact.join(cells.select(F.col("id").alias("p_id"), F.col("cell").alias("at")), "p_id").join(
        F.broadcast(sample.select(F.col("id").alias("q_id"), "vec")), "q_id").select("vec", "at").collect()  # k rows per point of the sample
    if not places:
        return 1
    like = np.stack([np.array(r["vec"]) for r in places]) @ pivots.T
    own = np.take_along_axis(like, np.array([[r["at"]] for r in places]), axis=1)
    before = np.sort((like > own).sum(axis=1))
    return int(before[int(np.ceil(GOAL * len(before))) - 1]) + 1


def k_near(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(q_id, p_id, distance, rank) of up to ``k`` near points; both inputs hold (id, vec) with unit vectors.

    Rows without a vector take no part; equal distances rank by id, as in the exact search. No points or no queries: no rows.
    """
    pts = publish(with_vectors(points), "ann_points")
    n = pts.count()
    if not n:
        return no_neighbours(queries, points)
    pivots = pivots_of(pts, int(min(CELLS, max(1, n // LIMIT))))
    cells = publish(placed_by_pivot(pts, pivots), "ann_cells")
    met = in_blocks(cells)
    sample = publish(cells.orderBy(F.xxhash64(F.lit(1), "vec"), "id").limit(SAMPLE), "ann_sample")
    probes = cells_needed(sample, cells, met, pivots, k)
    asked = met if queries is points else in_blocks(publish(placed_by_pivot(with_vectors(queries), pivots), "ann_queries"))
    return best_in_blocks(asked, met, k, exclude_self, pivots, probes)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours' places that are filled as well: found at the same rank or nearer than the exact last one."""
    edge = exact.groupBy("q_id").agg(F.max("distance").alias("edge"), F.count("*").alias("wanted"))
    hits = found.join(edge, "q_id").where(F.col("distance") <= F.col("edge") + 1e-9).groupBy("q_id").agg(F.count("*").alias("hits"))
    return edge.join(hits, "q_id", "left").agg(F.count("*").alias("queries"), F.sum("wanted").alias("neighbours"),
                                              F.try_divide(F.sum(F.least("wanted", F.coalesce("hits", F.lit(0)))), F.sum("wanted")).alias("recall"))
