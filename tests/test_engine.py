"""The engine from a listing to search results, on a small hand-made catalogue."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from facetgraph import models
from facetgraph.plans import search
from facetgraph.plans.api import Engine
from facetgraph.streaming import indexing

ENTITIES = [(1, "Asha", "mother", 5), (2, "Ravi", "father", 4), (3, "", "", 2)]
FILES = [(10, 1000), (11, 1010), (12, 2000), (13, 3000), (14, 0)]
FACES = {10: [1, 2], 11: [1, 2], 12: [1], 13: [1, 2, 3], 14: [None]}


# workers import the package, not this module
load_embedder = partial(models.hash_embedder, 32)
load_tagger = partial(models.gazetteer, {"asha": "PERSON", "ravi": "PERSON", "me": "SELF"})


@pytest.fixture(scope="module")
def tables(spark):
    from facetgraph.operators import graph

    files = spark.createDataFrame([(i, f"/p/{i}.jpg", f"{i}.jpg", 1, t) for i, t in FILES], "id long, abs_path string, display_name string, size_bytes long, mtime_unix long")
    entities = spark.createDataFrame(ENTITIES, "entity_id long, display_name string, relation string, sample_count int")
    found = spark.createDataFrame([(f, e) for f, es in FACES.items() for e in es], "file_id long, entity_id long")
    members = graph.memberships(found).withColumn("score", F.lit(1.0))
    embed = models.hash_embedder(32)
    vectors = spark.createDataFrame(list(zip([10, 11, 12, 13, 14], embed(["sunset beach", "dog", "red car", "beach", "temple"]))), "file_id long, embedding array<float>")
    return search.Tables(files, entities, members, found, graph.edge_files(found), vectors)


def test_edges(tables):
    from facetgraph.operators import graph

    assert sorted((r.entity_a, r.entity_b, r.co_occurrence_count) for r in graph.edges(tables.detections).collect()) == [(1, 2, 3), (1, 3, 1), (2, 3, 1)]
    assert [(r.neighbor_id, r.co_occurrence_count) for r in graph.neighbours(graph.edges(tables.detections), tables.entities, 1).orderBy(F.desc("co_occurrence_count")).collect()] == [(2, 3), (3, 1)]
    files = lambda *ids: sorted(r.file_id for r in graph.candidates(tables.members, list(ids)).collect())
    assert files(1) == [10, 11, 12, 13] and files(1, 2) == [10, 11, 13] and files(1, 2, 3) == [13] and files(1, 9) == []


def test_queries_of_every_kind_in_one_search(spark, tables):
    rows = [(0, "Asha Ravi", -1), (1, "Asha beach", -1), (2, "me Ravi", 3), (3, "zebra temple", -1), (4, "me Ravi", -1)]
    asked = spark.createDataFrame(rows, "query_id long, text string, owner_entity_id long")
    hits = search.search(asked, tables, load_embedder, load_tagger, search.Options(spelling=False, intent=False)).orderBy("query_id", "rank").collect()
    of = lambda q: ([r.file_id for r in hits if r.query_id == q], {r.metric for r in hits if r.query_id == q})
    assert of(0) == ([10, 13], {"membership"})  # 11 was taken within 30 s of 10
    assert of(1)[0][0] == 13 and of(1)[1] == {"cosine"}
    assert of(2) == ([13], {"membership"})
    assert of(3)[0][0] == 14 and len(of(3)[0]) == 5 and of(3)[1] == {"l2"}
    assert of(4)[1] == {"cosine"}  # nobody owns the library: "me" is a word of the caption


def test_common_files(spark, tables):
    asked = spark.createDataFrame([(0, [1, 2]), (1, [1, 2, 3]), (2, [1]), (3, [2, 9]), (4, [])], "query_id long, ids array<bigint>")
    for pairs in (tables.pair_files, tables.pair_files.limit(0)):
        found = search.common_files(asked, tables.members, pairs).collect()
        assert sorted((r.query_id, r.file_id) for r in found) == [(0, 10), (0, 11), (0, 13), (1, 13), (2, 10), (2, 11), (2, 12), (2, 13)]


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/catalogue", load_embedder, load_tagger)
    assert engine.get_top_entities().count() == 0 and engine.get_stored_files().count() == 0
    listing = spark.createDataFrame(
        [(1, "content://1", "/a/x.JPG", "x", "image/jpeg", 10, 100, 4, 4, None), (2, "content://2", None, "y", "image/png", 20, 200, 4, 4, None), (3, "c", "/a/z.txt", "z", "", 5, 1, 0, 0, None)],
        "mediaId long, contentUri string, absPath string, displayName string, mimeType string, sizeBytes long, mtimeUnix long, widthPx int, heightPx int, durationMs long",
    )
    assert engine.start_storing(listing) == 2
    assert engine.start_storing(listing) == 2 and engine.table("files").count() == 2
    engine.generate_embeddings(now=7)
    assert engine.table("clip_vec").count() == 2
    assert engine.get_index_progress().first().percent == 100
    assert {r.status for r in engine.table("files").collect()} == {"indexed"}
    one, two = [1.0] + [0.0] * 3, [0.0] * 3 + [1.0]
    engine.save("face_detections", spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.9), (3, 2, 0.9)], "id long, file_id long, det_score double"))
    engine.save("face_vec", spark.createDataFrame([(1, one), (2, two), (3, one)], "detection_id long, embedding array<float>"))
    engine.cluster_faces(now=9)
    assert [(r.entity_a, r.entity_b, r.co_occurrence_count) for r in engine.table("entity_relations").collect()] == [(1, 2, 1)]
    assert [r.sample_count for r in engine.get_top_entities().collect()] == [2, 1]
    engine.set_entity_metadata(1, "Mira", "sister", 0, "Pune", now=11)
    told = engine.get_entity_metadata(1).first()
    assert (told.display_name, told.age, told.location) == ("Mira", 0, "Pune")
    assert engine.get_entity_metadata(99).first().display_name == ""
    assert [r.file_id for r in engine.get_entity_files(1).collect()] == [1, 2]
    engine.reset_face_data()
    assert engine.get_top_entities().count() == 0 and engine.table("files").count() == 2


def test_stream_equals_batch_and_failures_stay(spark, tmp_path):
    def load():
        embed = models.hash_embedder(8)

        def run(values):
            if any("bad" in v for v in values):
                raise ValueError("unreadable")
            return embed(values)

        return run

    schema = "id long, abs_path string, filetype string, status string"
    rows = [(i, "/bad" if i == 4 else f"/p {i}", "picture", "pending") for i in range(9)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing left
        indexing.index(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/check", load, files_per_batch=1).awaitTermination(120)
    assert {r.status: r["count"] for r in spark.read.parquet(f"{tmp_path}/out/status").groupBy("status").count().collect()} == {"indexed": 8, "failed": 1}
    assert spark.read.parquet(f"{tmp_path}/out/vectors").count() == 8
    done = indexing.progress(spark, f"{tmp_path}/out", 9).first()
    assert (done.processed, done.failed, done.percent) == (9, 1, 100)
