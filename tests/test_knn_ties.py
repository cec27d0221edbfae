"""Neighbours among many equal vectors."""

import random

from facetgraph.operators import vectors


def test_knn_join_takes_the_lowest_ids_of_equal_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in random.Random(3).sample(range(300), 300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(0, [0.0, 1.0]), (1, [2.0, 0.5])], "query_id long, embedding array<float>")
    found = sorted((r.query_id, r.distance, r.vec_id) for r in vectors.knn_join(table, queries, 2).collect())
    assert found == [(0, 0.0, 0), (0, 0.0, 3), (1, 0.5, 2), (1, 0.5, 5)]
    assert vectors.knn_join(table, queries, 400).count() == 600
