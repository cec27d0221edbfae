"""The engine's entry points over one catalogue folder of Parquet tables.

A change writes the changed rows and then points to them, so readers always
see a whole table, and a batch costs what is new. Where there is no catalogue yet, reads return empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog, graph, stats, vectors
from ..operators.rounds import ranked
from ..schemas import SCHEMAS, ensure_columns
from ..sources import media
from ..tables import Catalogue
from . import search as search_plan


@dataclass(frozen=True)
class Faces:
    """The face models: a detector of anchors and an embedder of crops, each loaded once in a worker, and a picture codec."""

    detector: Callable[[], Callable[[list], list]]
    embedder: Callable[[], Callable[[list], list]]
    decode: Callable[[bytes], np.ndarray]
    encode: Callable[[np.ndarray], bytes]


class Engine(Catalogue):
    def __init__(self, spark: SparkSession, path: str, embedder=None, tagger=None, options: search_plan.Options = search_plan.Options()):
        super().__init__(spark, path)
        self.embedder, self.tagger, self.options = embedder, tagger, options
        self.owner, self.paused, self.state = -1, False, "idle"

    def _work(self, rows: DataFrame) -> DataFrame:
        """rows, computed once and written beside the tables, so that what a model says is asked once."""
        at = f"{self.path}/_work/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _clear_work(self) -> None:
        jvm, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_work"), True)

    # reading and indexing files

    def start_storing(self, listing: DataFrame) -> int:
        """Scan a listing and add what is new; returns how many rows the scan had."""
        scanned, at = self._work(media.scan_phone(listing)), self.version("files")
        self.save("files", catalog.new_files(self.table("files"), ensure_columns(media.to_files(scanned), "files")), at=at)
        return scanned.count()

    def get_stored_files(self, limit: int = 100) -> DataFrame:
        return stats.stored_files(self.table("files"), limit)

    def generate_embeddings(self, now: int, column: str = "abs_path", files_per_batch: int | None = None, faces: Faces | None = None, pictures: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Embed all pending pictures and mark them, batch by batch until nothing is pending or the run is paused.

        What fails in this run is marked failed and not tried again, whatever vectors an
        older run left. With faces, each batch's pictures, read by pictures (id, abs_path to file_id, content),
        are searched for faces too, which join the people known so far; a run that wasn't paused
        then assigns what was left over and merges people that are close. (streaming.indexing is the form for files that keep coming.)
        """
        self.paused, self.state = False, "processing"
        while not self.paused:
            pending = self.table("files").filter((F.col("filetype") == "picture") & (F.col("status") == "pending"))
            waiting = ranked(pending.select("id", "abs_path", F.col(column).alias("_in")), "id")
            n, at = waiting.count(), 0
            if not n:
                break
            while at < n and not self.paused:
                to = n if files_per_batch is None else min(n, at + files_per_batch)
                self._index(waiting.filter((F.col("nth") >= at) & (F.col("nth") < to)).drop("nth"), now, faces, pictures)
                at = to
        if self.paused:
            self.state = "paused"
        else:
            if faces is not None:
                self.finish_faces(now)
            self.state = "finished"
        self._clear_work()

    def _index(self, batch: DataFrame, now: int, faces: Faces | None = None, pictures: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Embed the files of batch (id, abs_path, _in), mark them and find their people: the batch's rows and their keys' buckets are all that is read and written of the tables."""
        from ..models import apply_model

        done = self._work(apply_model(batch, self.embedder, "_in", "embedding", "array<float>").select("id", "abs_path", "embedding"))
        good = done.filter(F.col("embedding").isNotNull())
        self.save("clip_vec", good.select(F.col("id").alias("file_id"), "embedding"))
        own = self.lookup("files", done)
        tried = catalog.set_status(own, done.filter(F.col("embedding").isNull()).select("id", F.lit("failed").alias("status")))
        self.save("files", catalog.mark_indexed(tried, good.select("id"), now))
        if faces is not None and pictures is not None:
            self.cluster_faces(now, late=False, merge=None, only=self.add_faces(pictures(good.select("id", "abs_path")), faces, now))

    def pause_embeddings(self) -> None:
        """Ask a running generate_embeddings to stop after its batch; a later call goes on with what is pending."""
        self.paused = True

    def get_index_progress(self) -> DataFrame:
        return stats.progress(self.table("files")).withColumn("status", F.lit(self.state))

    def get_database_stats(self) -> DataFrame:
        return stats.by_type(self.table("files"))

    # people

    def add_faces(self, pictures: DataFrame, faces: Faces, now: int) -> DataFrame:
        """Find, cut out and embed the faces of pictures (file_id, content); crops, detections and vectors are appended (K6, K7, K9). Returns the new detections."""
        from ..models import detect_faces, embed_faces

        found = self._work(embed_faces(detect_faces(pictures, faces.detector), faces.decode, faces.encode, faces.embedder))
        folder = f"{self.path}/crops"
        found.filter(F.col("crop").isNotNull()).select("file_id", "place", "crop_path", "crop").write.mode("append").parquet(folder)
        at = self.version("face_detections")
        fresh = self._work(catalog.new_detections(found, self.table("face_detections").agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"], now))
        # detections of a file are numbered by falling confidence, as its faces' places are
        order = Window.partitionBy("file_id")
        ids = fresh.withColumn("place", (F.row_number().over(order.orderBy("id")) - 1)).select("id", "file_id", "place")
        vecs = ids.join(found.select("file_id", F.row_number().over(order.orderBy(F.desc("conf"), "x", "y")).alias("nth"), "embedding").withColumn("place", F.col("nth") - 1).drop("nth"), ["file_id", "place"])
        self.save("face_vec", vecs.filter(F.col("embedding").isNotNull()).select(F.col("id").alias("detection_id"), "embedding"))
        self.save("face_detections", fresh, at=at)
        return fresh

    def cluster_faces(self, now: int, near: float = 0.6, loose: float = 0.75, merge: float | None = 1.0, late: bool = True, graph_too: bool = True, only: DataFrame | None = None) -> None:
        """Cluster the faces that have no person yet, in the order of their files (T1); people known before stay as they are.

        only: the detections of a batch, where others that are left over wait for the end of the run. Clustering goes on from the stored centroids, which faces draw along; new people
        get numbers above all known ones. With late, faces left over go to the nearest centroid,
        which stays (T2); with merge, people whose centroids are as close are merged (T3). The graph takes in what is new (T5).
        """
        found = self.table("face_detections").filter(F.col("entity_id").isNull()) if only is None else only
        faces = self._work(self._with_vectors(found))
        first = 1 + (self.table("entities").agg(F.max("entity_id").alias("m")).first()["m"] or 0)
        at = self.version("person_centroids")
        step = self._work(vectors.cluster_step(faces, self.table("person_centroids"), "id", "file_id", near=near, blurry=loose, first=first))
        given = step.filter(F.col("embedding").isNull() & F.col("entity_id").isNotNull()).select("id", "entity_id")
        # centroids that no face drew along stay as they are
        moved = step.filter(F.col("embedding").isNotNull()).join(given.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "embedding")
        self.save("person_centroids", moved, at=at)
        self._join_people(given, now, graph_too)
        if late or merge is not None:
            self.finish_faces(now, loose if late else None, merge, graph_too)

    def take_in(self, faces: DataFrame, centroids: DataFrame, now: int) -> None:
        """Faces (a detection's columns, embedding) that were clustered elsewhere, and the centroids that they moved (entity_id, embedding), as a stream hands them on."""
        self.save("face_detections", faces.withColumn("entity_id", F.lit(None).cast("long")))
        self.save("face_vec", faces.filter(F.col("embedding").isNotNull()).select(F.col("id").alias("detection_id"), "embedding"))
        self.save("person_centroids", centroids.select("entity_id", "embedding"))
        self._join_people(faces.filter(F.col("entity_id").isNotNull()).select("id", "entity_id"), now, True)

    def _with_vectors(self, found: DataFrame) -> DataFrame:
        """id, file_id, embedding, score of detections that have a vector."""
        own = self.lookup("face_vec", found.select(F.col("id").alias("detection_id")))
        return found.join(own, found["id"] == own["detection_id"]).select("id", "file_id", "embedding", F.col("det_score").alias("score"))

    def _join_people(self, given: DataFrame, now: int, graph_too: bool) -> None:
        """Detections get the people of given (id, entity_id); people, memberships and the graph take them in."""
        if not given.limit(1).count():
            return
        at, people_at = self.version("face_detections"), self.version("entities")
        own = self.lookup("face_detections", given)
        joined = self._work(own.join(given.withColumnRenamed("entity_id", "_new"), "id").select(*[F.col("_new").alias(c) if c == "entity_id" else F.col(c) for c in own.columns]))
        counts = given.groupBy("entity_id").agg(F.count("*").alias("n"))
        people = self.lookup("entities", given)
        grown = people.join(counts, "entity_id", "right").select("entity_id", *[c for c in people.columns if c not in ("entity_id", "sample_count", "created_at", "updated_at", "entity_type", "display_name", "confidence")],
            F.coalesce("entity_type", F.lit("person")).alias("entity_type"), F.coalesce("display_name", F.lit("")).alias("display_name"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
            (F.coalesce("sample_count", F.lit(0)) + F.col("n")).cast("int").alias("sample_count"), F.coalesce("created_at", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"))
        self.save("entities", grown, at=people_at)
        self.save("face_detections", joined, at=at)
        self.save("entity_memberships", graph.memberships(joined).withColumn("score", F.lit(1.0)).withColumn("created_at", F.lit(now)))
        if graph_too:
            self._grow_graph(joined)

    def _grow_graph(self, joined: DataFrame) -> None:
        """The graph after the detections of joined: pairs that are new are added to their edges (K10, K11), and files count their faces (K8)."""
        touched = joined.select("file_id").distinct()
        whole = self._work(self.table("face_detections").join(touched, "file_id", "left_semi"))
        at, edges_at = self.version("entity_relation_files"), self.version("entity_relations")
        pairs = graph.edge_files(whole)
        fresh = self._work(pairs.join(self.lookup("entity_relation_files", pairs), ["entity_a", "entity_b", "file_id"], "left_anti"))
        files_at, files = self.version("files"), self.lookup("files", touched.withColumnRenamed("file_id", "id"))
        added = self._work(graph.edges_of(fresh, files))
        self.save("entity_relations", graph.merge_edges(self.lookup("entity_relations", added), added), at=edges_at)
        self.save("entity_relation_files", fresh, at=at)
        counts = graph.face_counts(files, whole).withColumnRenamed("face_count", "n")
        self.save("files", files.drop("face_count").join(counts, "id").withColumnRenamed("n", "face_count"), at=files_at)

    def finish_faces(self, now: int, loose: float | None = 0.75, merge: float | None = 1.0, graph_too: bool = True) -> None:
        """At the end of a run: faces left over go to the nearest centroid (T2), then people that are close are merged."""
        if loose is not None:
            left = self._with_vectors(self.table("face_detections").filter(F.col("entity_id").isNull()))
            self._join_people(self._work(vectors.assign_to_centroids(left, self.table("person_centroids"), loose, key="id").select("id", "entity_id")), now, graph_too)
        if merge is None:
            return
        at, centroids = {n: self.version(n) for n in ("person_centroids", "entities", "face_detections", "entity_memberships")}, self.table("person_centroids")
        merged = self._work(vectors.merge_step(centroids.join(self.table("entities").select("entity_id", "sample_count"), "entity_id"), merge))
        gone = merged.filter(F.col("keeper_id").isNotNull()).select(F.col("entity_id").alias("merged_id"), "keeper_id")
        if not gone.limit(1).count():
            return
        lost = gone.select(F.col("merged_id").alias("entity_id"))
        kept = merged.join(gone.select(F.col("keeper_id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("entity_id", "embedding", F.col("sample_count").alias("_all"))
        people = self.lookup("entities", kept)
        grown = people.drop("sample_count", "updated_at").join(kept.select("entity_id", "_all"), "entity_id").withColumn("sample_count", F.col("_all").cast("int")).withColumn("updated_at", F.lit(now))
        moved = self._work(self.table("face_detections").join(lost, "entity_id", "left_semi"))
        old = self._work(self.table("entity_memberships").join(lost, "entity_id", "left_semi"))
        remapped = self._work(vectors.remap(moved, gone))
        self.save("person_centroids", kept.select("entity_id", "embedding"), lost, at["person_centroids"])
        self.save("entities", grown, lost, at["entities"])
        self.save("face_detections", remapped, at=at["face_detections"])
        self.save("entity_memberships", graph.memberships(remapped).withColumn("score", F.lit(1.0)).withColumn("created_at", F.lit(now)), old, at["entity_memberships"])
        if graph_too:
            self.update_graph()

    def update_graph(self) -> None:
        """The graph made anew of all detections, as after merging."""
        found, files = self.table("face_detections"), self.table("files")
        self.replace("entity_relations", graph.edges(found, files))
        self.replace("entity_relation_files", graph.edge_files(found))
        counts = graph.face_counts(files, found).withColumnRenamed("face_count", "n")
        changed = files.join(counts, "id").filter(F.col("face_count") != F.col("n")).drop("face_count").withColumnRenamed("n", "face_count")
        self.save("files", changed)

    def reset_face_data(self, now: int = 0, faces: Faces | None = None, pictures: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Forget all people, faces and crops; with faces, look for them again in all indexed pictures and cluster them.

        As in a first run faces are clustered and leftovers assigned; people aren't merged and the graph isn't made.
        """
        for name, rows in catalog.reset_faces({n: self.table(n) for n in SCHEMAS}).items():
            self.replace(name, rows)
        jvm, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/crops"), True)
        if faces is not None and pictures is not None:
            self.add_faces(pictures(stats.indexed_pictures(self.table("files")).select("id", "abs_path")), faces, now)
            self.cluster_faces(now, merge=None, graph_too=False)
        self._clear_work()

    def get_top_entities(self, limit: int = 50) -> DataFrame:
        return graph.top_entities(self.table("entities"), limit)

    def get_best_face_crop(self, entity_id: int) -> DataFrame:
        return graph.best_crops(self.table("face_detections").filter(F.col("entity_id") == entity_id), self.table("files"))

    def get_entity_neighbors(self, entity_id: int, limit: int = 20) -> DataFrame:
        return graph.neighbours(self.table("entity_relations"), self.table("entities"), entity_id, limit)

    def get_entity_files(self, entity_id: int, limit: int = 100) -> DataFrame:
        return graph.entity_files(self.table("entity_memberships"), self.table("files"), entity_id, limit)

    def set_entity_name(self, entity_id: int, name: str, now: int) -> None:
        self._change([(entity_id, name)], "entity_id long, display_name string", now)

    def set_entity_metadata(self, entity_id: int, name: str, relation: str, age: int, location: str, now: int) -> None:
        self._change([(entity_id, name, relation, age, location)], "entity_id long, display_name string, relation string, age int, location string", now)

    def _change(self, rows: list[tuple], schema: str, now: int) -> None:
        asked, at = self.spark.createDataFrame(rows, schema), self.version("entities")
        self.save("entities", catalog.set_metadata(self.lookup("entities", asked), asked, now), at=at)

    def get_entity_metadata(self, entity_id: int) -> DataFrame:
        return catalog.metadata(self.table("entities"), entity_id)

    def set_owner_entity_id(self, entity_id: int) -> None:
        self.owner = entity_id

    def get_owner_entity_id(self) -> int:
        return self.owner

    # search

    def set_search_options(self, graph_on: bool = True, spelling: bool = True, intent: bool = True) -> None:
        self.options = search_plan.Options(graph_on, spelling, intent, self.options.top_k, self.options.burst_seconds)

    def search_images(self, *queries: str) -> DataFrame:
        rows = [(i, q, self.owner) for i, q in enumerate(queries) if q.strip()]
        asked = self.spark.createDataFrame(rows, "query_id long, text string, owner_entity_id long")
        tables = search_plan.Tables(*(self.table(n) for n in ("files", "entities", "entity_memberships", "face_detections", "entity_relation_files")), self.table("clip_vec"))
        return search_plan.search(asked, tables, self.embedder, self.tagger, self.options)
