"""A stream of faces: the tables are those of a run over all files, also when it stops in the middle."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetgraph import models
from facetgraph.operators import vectors
from facetgraph.plans.api import Engine
from facetgraph.streaming import people


def faces(seed, n):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(4, 6))
    x = middles[rng.integers(0, 4, n)] + 0.25 * rng.normal(size=(n, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i % 2, i, i // 3, 0.4 if i % 6 == 0 else 0.9, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]


def arrive(spark, rows, folder):
    found = spark.createDataFrame(rows, "owner long, id long, file_id long, det_score double, embedding array<float>")
    whole = found.select(*[F.col(f.split(" ")[0]) if f.split(" ")[0] in found.columns else F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in people.FACE.split(", ")])
    whole.coalesce(1).write.mode("append").parquet(folder)


def test_a_stream_and_a_run_give_the_same_tables(spark, tmp_path):
    rows, folder = faces(1, 48), f"file://{tmp_path}/faces"
    at = lambda owner: Engine(spark, f"file://{tmp_path}/c{owner}", partial(models.hash_embedder, 8))
    for owner in (0, 1):
        at(owner).save("files", spark.createDataFrame([(i, f"/p/{i}", "picture", 10 * i) for i in range(20)], "id long, abs_path string, filetype string, mtime_unix long"))

    class Failing(Engine):
        def _grow_graph(self, joined):
            raise OSError("lost in the middle of a batch")

    def run(engine_of):
        stream = spark.readStream.schema(people.FACE).option("maxFilesPerTrigger", 1).parquet(folder)
        query = people.follow(stream, engine_of, f"file://{tmp_path}/checkpoint", now=7)
        query.awaitTermination()

    arrive(spark, rows[:20], folder)
    run(at)
    arrive(spark, rows[20:], folder)
    with pytest.raises(Exception, match="lost in the middle"):
        run(lambda owner: Failing(spark, at(owner).path) if owner == 1 else at(owner))
    run(at)
    for owner in (0, 1):
        own = sorted((r for r in rows if r[0] == owner), key=lambda r: (r[2], r[1]))
        found, after = vectors.lead([(r[1], r[4], r[3]) for r in own])
        engine = at(owner)
        assert {r.id: r.entity_id for r in engine.table("face_detections").collect()} == {i: e for i, e, _ in found}
        counts = {e: sum(1 for _, x, _ in found if x == e) for e, _ in after}
        assert {r.entity_id: r.sample_count for r in engine.table("entities").collect()} == counts
        got = {r.entity_id: r.embedding for r in engine.table("person_centroids").collect()}
        assert set(got) == set(counts) and all(got[e] == pytest.approx(v, abs=1e-5) for e, v in after)
        whole = Engine(spark, f"file://{tmp_path}/whole{owner}", partial(models.hash_embedder, 8))
        whole.save("files", engine.table("files"))
        whole.save("face_detections", engine.table("face_detections"))
        whole.update_graph()
        for name in ("entity_relations", "entity_relation_files"):
            assert sorted(map(tuple, engine.table(name).collect())) == sorted(map(tuple, whole.table(name).collect())), name
