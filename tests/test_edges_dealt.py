"""Edges and neighbours are dealt by the number of detections, not to a fixed number of parts."""

import pytest
from pyspark.sql import functions as F

from facetgraph import storage
from facetgraph.operators import graph


@pytest.fixture
def found(spark):
    return spark.range(900).select((F.col("id") % 300).alias("file_id"), F.when(F.col("id") % 11 > 0, F.col("id") % 7).alias("entity_id"))


def test_parts_grow_with_detections(spark, monkeypatch, found):
    monkeypatch.setattr(storage.tasks, "__defaults__", (100,))
    files = spark.range(300).select("id", (F.col("id") * 10).alias("mtime_unix"))
    whole = graph.edges(found, files)
    merged = graph.merge_edges(graph.edges(found.filter("file_id % 2 = 0"), files), graph.edges(found.filter("file_id % 2 = 1"), files), graph.parts_of(found))
    names = spark.range(7).select(F.col("id").alias("entity_id"), F.lit("x").alias("display_name"))
    near = graph.neighbours(graph.edges(found), names, parts=graph.parts_of(found))
    assert graph.parts_of(found) == whole.rdd.getNumPartitions() == merged.rdd.getNumPartitions() == graph.edges(found).rdd.getNumPartitions() == 9
    for df, keys in ((whole, "entity_a#"), (near, "entity_id#")):
        assert f"hashpartitioning({keys}" in df._jdf.queryExecution().toString() and ", 9), REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    rows = {}
    for r in found.filter("entity_id IS NOT NULL").collect():
        rows.setdefault(r.file_id, set()).add(r.entity_id)
    expected = {}
    for f, es in rows.items():
        for a in es:
            for b in es:
                if a < b:
                    expected.setdefault((a, b), []).append(f * 10)
    expected = {(a, b, len(t), min(t), max(t)) for (a, b), t in expected.items()}
    assert {tuple(r) for r in whole.collect()} == expected == {tuple(r) for r in merged.collect()}
