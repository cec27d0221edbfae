"""People over several runs: names are kept, failures stay, centroids move on, faces are found again."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetgraph import models
from facetgraph.operators import vectors
from facetgraph.plans.api import Engine, Faces

EMBED = partial(models.hash_embedder, 8)


def listing(spark, names):
    rows = [(i, "c", f"/a/{n}.jpg", n, "image/jpeg", 10, 100 * i, 4, 4, None) for i, n in enumerate(names, 1)]
    return spark.createDataFrame(rows, "mediaId long, contentUri string, absPath string, displayName string, mimeType string, sizeBytes long, mtimeUnix long, widthPx int, heightPx int, durationMs long")


# workers import the package, not this module: what they run is made inside of functions, which travels by value
def failing_loader():
    def failing():
        def run(values):
            raise ValueError("unreadable")

        return run

    return failing


def unit(*x):
    v = np.array(x, float)
    return (v / np.linalg.norm(v)).tolist()


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/catalogue", EMBED)


def test_a_failed_file_stays_failed(spark, engine):
    engine.start_storing(listing(spark, ["x", "y"]))
    engine.generate_embeddings(now=1)
    engine.save("files", engine.table("files").withColumn("status", F.lit("pending")))
    engine.embedder = failing_loader()
    engine.generate_embeddings(now=2)
    assert {r.status for r in engine.table("files").collect()} == {"failed"}
    engine.embedder = EMBED
    engine.generate_embeddings(now=3)
    assert {r.status for r in engine.table("files").collect()} == {"failed"}
    assert engine.get_index_progress().first().status == "finished"


def test_a_paused_run_goes_on(spark, engine):
    engine.start_storing(listing(spark, ["x", "y", "z"]))
    taken = []

    class Pausing(Engine):
        def save(self, name, rows):
            super().save(name, rows)
            if name == "files":
                taken.append(1)
                self.pause_embeddings()

    pausing = Pausing(spark, engine.path, EMBED)
    pausing.generate_embeddings(now=1, files_per_batch=2)
    assert len(taken) == 1 and pausing.get_index_progress().first().status == "paused"
    assert sorted(r.status for r in engine.table("files").collect()) == ["indexed", "indexed", "pending"]
    engine.generate_embeddings(now=2, files_per_batch=2)
    assert engine.table("files").filter("status = 'indexed'").count() == 3 and engine.get_index_progress().first().status == "finished"


def test_two_writers_cannot_both_win(spark, engine):
    engine.start_storing(listing(spark, ["x"]))

    class Late(Engine):
        def _pointers(self, name):
            return []  # what it saw before the other wrote

    with pytest.raises(RuntimeError):
        Late(spark, engine.path).save("files", engine.table("files"))
    assert engine.table("files").count() == 1


def test_people_are_kept_by_later_runs(spark, engine):
    engine.start_storing(listing(spark, ["x", "y", "z"]))
    a, b = unit(1, 0, 0, 0), unit(0, 0, 1, 0)
    near_a, blurred = unit(1, 0.4, 0, 0), unit(0, 0.1, 1, 0.6)
    engine.save("face_detections", spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.9)], "id long, file_id long, det_score double"))
    engine.save("face_vec", spark.createDataFrame([(1, a), (2, b)], "detection_id long, embedding array<float>"))
    engine.cluster_faces(now=5)
    engine.set_entity_metadata(1, "Mira", "sister", 30, "Pune", now=6)
    more = engine.table("face_detections").unionByName(spark.createDataFrame([(3, 2, None, 0, 0, 0, 0, 0.9, 7, ""), (4, 3, None, 0, 0, 0, 0, 0.3, 7, "")], engine.table("face_detections").schema))
    engine.save("face_detections", more)
    engine.save("face_vec", engine.table("face_vec").unionByName(spark.createDataFrame([(3, near_a), (4, blurred)], "detection_id long, embedding array<float>")))
    engine.cluster_faces(now=8)
    people = {r.entity_id: r for r in engine.table("entities").collect()}
    assert (people[1].display_name, people[1].relation, people[1].age, people[1].location) == ("Mira", "sister", 30, "Pune")
    assert (people[1].sample_count, people[1].created_at, people[1].updated_at) == (2, 5, 8) and people[2].sample_count == 2
    assert {r.id: r.entity_id for r in engine.table("face_detections").collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
    moved = 0.9 * np.array(a) + 0.1 * np.array(near_a)
    found = {r.entity_id: r.embedding for r in engine.table("person_centroids").collect()}
    assert found[1] == pytest.approx(moved / np.linalg.norm(moved), abs=1e-6)
    moved = 0.9 * np.array(b) + 0.1 * np.array(blurred)
    assert found[2] == pytest.approx(moved / np.linalg.norm(moved), abs=1e-6)
    # a third person close to the first is merged into it, centroid and count included
    engine.save("person_centroids", engine.table("person_centroids").unionByName(spark.createDataFrame([(9, unit(1, 0.9, 0, 0))], "entity_id long, embedding array<float>")))
    engine.save("entities", engine.table("entities").unionByName(engine.table("entities").filter("entity_id = 1").withColumn("entity_id", F.lit(9).cast("long")).withColumn("sample_count", F.lit(1))))
    before = np.array(found[1])
    engine.cluster_faces(now=9)
    people = {r.entity_id: r for r in engine.table("entities").collect()}
    assert set(people) == {1, 2} and people[1].sample_count == 3 and people[1].display_name == "Mira"
    mean = (2 * before + np.array(unit(1, 0.9, 0, 0))) / 3
    assert {r.entity_id: r.embedding for r in engine.table("person_centroids").collect()}[1] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-6)


def face_models():
    def unit(*x):
        return [v / sum(y * y for y in x) ** 0.5 for v in x]

    def decode(content):
        return np.frombuffer(bytes(content), np.uint8).reshape(64, 64, 1).astype(float)

    def encode(picture):
        return picture.astype(np.uint8).tobytes()

    def detector():
        points = [float(x) for p in ((38, 52), (74, 52), (56, 72), (42, 92), (71, 92)) for x in p]

        def run(values):
            out = []
            for v in values:
                if v is None:
                    raise ValueError("unreadable")
                one = {"score": 4.0, "cx": 16.0, "cy": 16.0, "stride": 8.0, "deltas": [1.0, 1.0, 1.0, 1.0], "offsets": [(x / 2 - 16) / 8 for x in points]}
                again, other, weak = {**one, "score": 3.0, "cx": 17.0}, {**one, "score": 2.0, "cx": 100.0}, {**one, "score": -3.0, "cx": 60.0}
                out.append({"scale": 2.0, "anchors": [other, one, again, weak]})
            return out

        return run

    def embed_crops():
        def run(values):
            return [unit(1, 0, 0, 0) if v is not None else None for v in values]

        return run

    return Faces(detector, embed_crops, decode, encode)


def pictures(files):
    return files.select(F.col("id").alias("file_id"), F.encode(F.rpad(F.lit("a"), 64 * 64, "b"), "utf-8").alias("content"))


def test_anchors_become_boxes_and_points(spark):
    faces, rows = face_models(), spark.createDataFrame([(1, bytearray(64 * 64)), (2, None)], "file_id long, content binary")
    found = sorted(models.detect_faces(rows, faces.detector).collect(), key=lambda r: r.place)
    # the second anchor hides behind the first, the last is too weak; an unreadable picture has none
    assert [(r.file_id, r.place, r.x, r.y, r.w, r.h) for r in found] == [(1, 0, 4.0, 4.0, 8.0, 8.0), (1, 1, 46.0, 4.0, 8.0, 8.0)]
    assert found[0].conf == pytest.approx(1 / (1 + np.exp(-4))) and found[0].points[:2] == [9.5, 13.0]
    cut = models.embed_faces(models.detect_faces(rows, faces.detector), faces.decode, faces.encode, faces.embedder).collect()
    assert sorted(r.crop_path for r in cut) == ["1_0.jpg", "1_1.jpg"] and all(len(r.crop) == 112 * 112 and len(r.embedding) == 4 for r in cut)
    broken = models.embed_faces(models.detect_faces(rows.withColumn("content", F.when(F.col("content").isNotNull(), F.lit(bytearray(3)))), faces.detector), faces.decode, faces.encode, faces.embedder).collect()
    assert len(broken) == 2 and all(r.crop_path == "" and r.embedding is None for r in broken)


def test_faces_are_found_with_the_pictures_and_again_after_a_reset(spark, engine):
    engine.start_storing(listing(spark, ["x", "y"]))
    faces = face_models()
    engine.generate_embeddings(now=1, files_per_batch=1, faces=faces, pictures=pictures)
    found = engine.table("face_detections").collect()
    assert len(found) == 4 and {r.entity_id for r in found} == {1} and len({r.id for r in found}) == 4
    assert engine.table("face_vec").count() == 4 and spark.read.parquet(f"{engine.path}/crops").count() == 4
    assert {r.face_count for r in engine.table("files").collect()} == {2}
    engine.set_entity_name(1, "Asha", now=2)
    engine.reset_face_data(3, faces, pictures)
    people = engine.table("entities").collect()
    assert [(r.entity_id, r.display_name, r.sample_count) for r in people] == [(1, "", 4)]
    assert spark.read.parquet(f"{engine.path}/crops").count() == 4 and engine.table("entity_relations").count() == 0
    engine.reset_face_data()
    assert engine.table("entities").count() == engine.table("face_vec").count() == 0


def test_tokenizers_as_columns(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    found = models.tokenized(rows, lambda: lambda text: [len(w) for w in text.split()]).collect()
    assert [(r.id, r.ids) for r in found] == [(1, [1, 1]), (2, None)]


def test_pairs_with_copies_and_other_dimensions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:] = x[0]  # a third of all rows are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = sorted((i, j) for i in range(150) for j in range(i + 1, 150) if np.linalg.norm(x[i] - x[j]) <= 0.3)
    for block_rows in (10, 8192):
        found = vectors.similar_pairs(table, 0.3, block_rows=block_rows).collect()
        assert sorted((r.a, r.b) for r in found) == expected
    assert vectors.similar_pairs(table.limit(0), 0.3).count() == 0


@pytest.mark.parametrize("block, held", [(4096, 16), (3, 2)])
def test_nearest_centroid_over_blocks(spark, monkeypatch, block, held):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "HELD_BLOCKS", held)
    rng = np.random.default_rng(9)
    c, x = rng.normal(size=(11, 5)), rng.normal(size=(40, 5))
    c[7] = c[2]  # equally near: the least id
    centroids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)] + [(50, None)], "entity_id long, embedding array<double>")
    faces = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0])], "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.entity_id, r.distance) for r in vectors.assign_to_centroids(faces, centroids, None).collect()}
    d = np.linalg.norm(x[:, None] - c[None], axis=2)
    assert {k: v[0] for k, v in found.items()} == {i: int(d[i].argmin()) for i in range(40)}
    assert [found[i][1] for i in range(40)] == pytest.approx(d.min(axis=1).tolist())
    plan = vectors.assign_to_centroids(faces, centroids, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_clustering_goes_on_where_it_was():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist(), 0.4 if i % 7 == 0 else 0.9) for i, v in enumerate(x)]
    whole, after = vectors.lead(rows)
    first, middle = vectors.lead(rows[:25])
    second, end = vectors.lead(rows[25:], middle)
    assert first + second == whole and [e for e, _ in end] == [e for e, _ in after]
    odd, _ = vectors.lead([(1, None, 0.9), (2, [1.0, 0.0], 0.9), (3, [1.0], 0.9)])
    assert odd == [(1, None, None), (2, 1, 0.0), (3, None, None)]
    assert vectors.absorb([(1, None, 3), (2, [1.0, 0.0], 2), (3, [1.0, 0.1], 1), (4, [1.0], 1)]) == [(3, 2)]


def test_pairs_meet_once_where_pivots_do_not_prune(spark):
    x = np.random.default_rng(9).normal(size=(600, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    dealt, total = vectors._in_chunks(table, x[:12], 1.1, 32, 50)
    groups = {}
    for r in dealt.select("cell", "i", "j", "chunk").collect():
        groups.setdefault((r.cell, r.i, r.j), []).append(r.chunk)
    assert len(groups) <= total
    compared = sum(c.count(i) * c.count(j) for (_, i, j), c in groups.items())
    assert compared <= 1.2 * 600 * 600 / 2 + 600 * 50  # visitors of a cell aren't compared with each other: not the cube of the cells
