"""Tables as a base and a log of changes: what is read and written, merging, layers made one, and the graph that grows with a batch."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from facetgraph import models, tables
from facetgraph.operators import graph
from facetgraph.plans.api import Engine
from facetgraph.tables import Catalogue


def files(spark, ids, status="pending", faces=0):
    return spark.createDataFrame([(i, f"/p/{i}.jpg", "picture", status, faces) for i in ids], "id long, abs_path string, filetype string, status string, face_count int")


def told(catalogue):
    return {r.id: (r.status, r.face_count) for r in catalogue.table("files").collect()}


def written(spark, catalogue, name, since):
    """Files of data that the layers after the first since of them have."""
    return [len(spark.read.parquet(folder).inputFiles()) for _, _, folder in catalogue._layers(name)[since:]]


def read(spark, df):
    """Files that a plan reads."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ran = df.select("*")._jdf.queryExecution()
        ran.toRdd().count()
        leaves = ran.executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        return sum(s.metrics().apply("numFiles").value() for s in scans if s.metrics().contains("numFiles"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    at = Catalogue(spark, f"file://{tmp_path}/c")
    assert at.table("files").count() == 0 and at.lookup("files", files(spark, [1])).count() == 0
    at.save("files", files(spark, range(300)))
    some = at.lookup("files", files(spark, [7, 8, 9999]))
    assert sorted(r.id for r in some.collect()) == [7, 8] and read(spark, some) <= 3 < 100 < read(spark, at.table("files"))
    at.save("files", files(spark, [7, 8, 500], "indexed", 3), files(spark, [9]))
    assert written(spark, at, "files", 1)[0] <= 8 and len(at._layers("files")) == 2
    found = told(at)
    assert found[7] == found[8] == found[500] == ("indexed", 3) and 9 not in found and len(found) == 300 and found[10] == ("pending", 0)
    assert [r.status for r in at.lookup("files", files(spark, [7])).collect()] == ["indexed"] and at.lookup("files", files(spark, [9])).count() == 0
    assert read(spark, at.lookup("files", files(spark, [7]))) <= 3


@pytest.mark.parametrize("rows, kinds", [(80, ["base", "log", "change"]), (3, ["base", "change"])])
def test_many_layers_are_made_one(spark, tmp_path, monkeypatch, rows, kinds):
    monkeypatch.setattr(tables, "LAYERS", 3)
    at = Catalogue(spark, f"file://{tmp_path}/c")
    at.save("files", files(spark, range(rows)))
    for k in range(3):
        at.save("files", files(spark, [k, 1000 + k], "indexed", k), files(spark, [2]) if k == 1 else None)
    at.save("files", files(spark, [0], "failed"))
    assert [kind for kind, _, _ in at._layers("files")] == kinds
    found = told(at)
    assert found[0] == ("failed", 0) and found[1001] == ("indexed", 1) and found[2] == ("indexed", 2) and len(found) == rows + 3


def test_who_comes_late_gets_an_error(spark, tmp_path):
    at = Catalogue(spark, f"file://{tmp_path}/c")
    at.save("files", files(spark, [1, 2]))
    seen = at.version("files")
    at.save("files", files(spark, [1], "indexed"))
    with pytest.raises(RuntimeError):
        at.save("files", files(spark, [1], "failed"), at=seen)
    assert told(at) == {1: ("indexed", 0), 2: ("pending", 0)}


def test_a_batch_adds_to_the_graph(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/c", partial(models.hash_embedder, 8))
    engine.save("files", files(spark, range(1, 60)).withColumn("mtime_unix", F.col("id") * 10))
    axis = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    at = 0
    for batch in ([(1, 0), (1, 1)], [(2, 0), (2, 1), (2, 2), (3, 1)], [(1, 2)]):
        rows = [(at + k + 1, f, 0.9, p) for k, (f, p) in enumerate(batch)]
        at += len(rows)
        new = spark.createDataFrame([(i, f, s) for i, f, s, _ in rows], "id long, file_id long, det_score double")
        engine.save("face_vec", spark.createDataFrame([(i, axis(p)) for i, _, _, p in rows], "detection_id long, embedding array<float>"))
        engine.save("face_detections", new)
        layers = len(engine._layers("files"))
        engine.cluster_faces(now=5, late=False, merge=None, only=engine.lookup("face_detections", new))
        assert sum(written(spark, engine, "files", layers)) <= 3
    found = engine.table("face_detections")
    expected = {(r.entity_a, r.entity_b): r[2:] for r in graph.edges(found, engine.table("files")).collect()}
    assert {(r.entity_a, r.entity_b): r[2:] for r in engine.table("entity_relations").collect()} == expected and len(expected) == 3
    assert engine.table("entity_relation_files").count() == graph.edge_files(found).count() == 6
    counts = {r.id: r.face_count for r in engine.table("files").collect()}
    assert (counts[1], counts[2], counts[3], counts[4]) == (3, 3, 1, 0)
    assert {r.entity_id: r.sample_count for r in engine.table("entities").collect()} == {1: 2, 2: 3, 3: 2}
