"""Neighbours between two large sides: equal to a plain search, ties, copies and odd vectors included."""

import numpy as np
import pytest

from facetgraph.operators import pivots, vectors


def plain(rows, asked, k, within=np.inf):
    found = []
    for q, y in asked:
        far = sorted((float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(y, np.float32).astype(float)) ** 2).sum())), i) for i, v in rows)
        found += [(q, i, round(d, 9)) for d, i in far[:k] if d <= within]
    return sorted(found)


def told(df):
    return sorted((r.query_id, r.vec_id, round(r.distance, 9)) for r in df.collect())


def table(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("block_rows", [6, 40, 8192])
def test_both_sides_by_pivots(spark, block_rows):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(7, 5)) * 4
    rows = [(i, middles[i % 7] + rng.normal(size=5)) for i in range(200)]
    rows += [(i, rows[3][1]) for i in range(200, 300)] + [(i, rows[3][1] + 1e-3 * rng.normal(size=5)) for i in range(300, 360)]  # copies and near copies
    asked = [(i, v) for i, v in rows if i % 20 == 0] + [(1000, rng.normal(size=5) * 9), (1001, rows[3][1])]
    odd = [(900, None), (901, [1.0]), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4)]
    left, right = table(spark, rows + odd, "vec_id"), table(spark, asked + odd, "query_id")
    for k, within in ((4, None), (1, 1.5), (500, 2.0)):
        found = pivots.knn_by_pivots(left, right, k, within, block_rows=block_rows)
        assert told(found) == plain(rows, asked, k, np.inf if within is None else within)


def test_empty_sides(spark):
    rows = table(spark, [(1, [0.0, 1.0])], "vec_id")
    asked = table(spark, [(1, [0.0, 1.0])], "query_id")
    for a, b, k in ((rows.limit(0), asked, 3), (rows, asked.limit(0), 3), (rows, asked, 0)):
        assert pivots.knn_by_pivots(a, b, k).count() == 0
    assert told(pivots.knn_by_pivots(rows, asked, 3)) == [(1, 1, 0.0)]


def test_few_cells_are_visited(spark):
    rng = np.random.default_rng(12)
    middles = rng.normal(size=(20, 8)) * 50
    rows = [(i, middles[i % 20] + rng.normal(size=8)) for i in range(2000)]
    far = pivots.distances(np.array([v for _, v in rows]), middles)
    home = far.argmin(axis=1)
    cells = pivots.Cells(middles, np.array([far[home == c, c].max() for c in range(20)]), np.bincount(home, minlength=20))
    assert not pivots._away(5)(cells, far, np.full(len(far), 6.0)).any() and not pivots._away(5)(cells, far, np.full(len(far), np.inf)).any()


def test_large_sides_go_by_pivots(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows, asked = [(i, rng.normal(size=4)) for i in range(80)], [(i, rng.normal(size=4)) for i in range(30)]
    left, right = table(spark, rows, "vec_id"), table(spark, asked, "query_id")
    small = told(vectors.knn_join(left, right, 3))
    nearest = {r.query_id: (r.entity_id, r.distance) for r in vectors.assign_to_centroids(right, left.withColumnRenamed("vec_id", "entity_id"), None, key="query_id").collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 10)
    monkeypatch.setattr(vectors, "SENT", 10)
    assert told(vectors.knn_join(left, right, 3)) == small == plain(rows, asked, 3)
    again = {r.query_id: (r.entity_id, r.distance) for r in vectors.assign_to_centroids(right, left.withColumnRenamed("vec_id", "entity_id"), None, key="query_id").collect()}
    assert again == nearest and len(again) == 30
