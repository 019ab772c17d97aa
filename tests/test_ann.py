"""Approximate search: exact distances, recall against brute force, copies as one point, narrow buckets where many points meet, nothing to search."""
import numpy as np
import pytest

from intake_spark.operators import ann as A
from intake_spark.session import publish

SCHEMA = "id long, vec array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_copies_and_dense_regions(spark, monkeypatch):
    monkeypatch.setattr(A, "LIMIT", 40)
    rng = np.random.default_rng(3)
    crowd = unit(rng.standard_normal((1, 12)) + 0.02 * rng.standard_normal((150, 12)))  # a third of all, nearly in one direction
    x = np.concatenate([crowd, unit(rng.standard_normal((200, 12))), np.repeat(unit(rng.standard_normal((1, 12))), 100, axis=0)])
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows + [(900, None)], SCHEMA)
    got = A.k_near(points, points, 5, exclude_self=True).toPandas()
    d = np.round(1 - x @ x.T, 12)
    assert np.allclose(got.distance, d[got.q_id, got.p_id], atol=1e-9) and not (got.q_id == got.p_id).any()
    assert set(got.q_id) == set(range(len(x))) and (got.groupby("q_id")["rank"].max() <= 5).all()
    np.fill_diagonal(d, 9)
    edge = np.sort(d, axis=1)[:, 4]
    assert (got.distance <= edge[got.q_id] + 1e-9).sum() >= 0.9 * 5 * len(x)
    copies = got[got.q_id >= 350].groupby("q_id")["p_id"].apply(sorted)
    assert all(p == [i for i in range(350, 357) if i != q][:5] for q, p in copies.items())


def test_nothing_to_search(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    assert A.k_near(one, none, 3).count() == 0 == A.k_near(none, one, 3).count()
    assert A.k_near(one, one, 3, exclude_self=True).count() == 0
    assert [tuple(r) for r in A.k_near(one, one, 3).collect()] == [(1, 1, pytest.approx(0.0), 1)]


def test_recall_on_vectors_without_clusters_and_rows_written(spark, monkeypatch):
    """Vectors that point everywhere have far neighbours; no table holds a vector more than once."""
    written = []
    monkeypatch.setattr(A, "publish", lambda df, name: written.append(publish(df, name)) or written[-1])
    x = unit(np.random.default_rng(4).standard_normal((6000, 32)))
    points = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], SCHEMA)
    asked = points.where("id % 20 = 0")
    got = A.k_near(asked, points, 10, exclude_self=True).toPandas()
    d = np.round(1 - x[::20] @ x.T, 12)
    d[np.arange(300), np.arange(0, 6000, 20)] = 9
    edge = np.sort(d, axis=1)[:, 9]
    assert (got.distance <= edge[got.q_id // 20] + 1e-9).sum() >= 0.9 * 10 * 300
    assert max(df.count() for df in written) <= len(x)
