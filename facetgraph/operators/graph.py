"""The people graph: memberships, co-occurrence, candidates, neighbours and portraits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import tasks


def memberships(detections: DataFrame) -> DataFrame:
    """Distinct entity_id, file_id of detections that have an entity."""
    return detections.filter(F.col("entity_id").isNotNull()).select("entity_id", "file_id").distinct()


def _together(detections: DataFrame, parts: int) -> DataFrame:
    """file_id, es: the sorted entities of each file that has two or more."""
    named = detections.filter(F.col("entity_id").isNotNull()).select("file_id", "entity_id").repartition(parts, "file_id")
    return named.groupBy("file_id").agg(F.array_sort(F.collect_set("entity_id")).alias("es")).filter(F.size("es") > 1)


def _paired(sets: DataFrame, *keep: str) -> DataFrame:
    firsts = sets.select("file_id", *keep, "es", F.posexplode("es").alias("i", "entity_a"))
    return firsts.select("entity_a", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("entity_b"), "file_id", *keep)


def parts_of(detections: DataFrame) -> int:
    """Parts that detections, and what is made of them, are dealt to: a task has about as many rows however large the table is."""
    return tasks(detections.sparkSession, detections.count())


def edge_files(detections: DataFrame) -> DataFrame:
    """entity_a < entity_b, file_id: all pairs of entities within a file.

    The pairs come out of each file's own array of entities, so files aren't joined
    with themselves: one shuffle by file.
    """
    return _paired(_together(detections, parts_of(detections)))


def edges(detections: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """entity_a, entity_b, co_occurrence_count, and first and last time seen where files (id, mtime_unix) are given.

    A file's time is joined to its entities, before they are paired.
    """
    parts = parts_of(detections)
    sets = _together(detections, parts)
    if files is None:
        return _counted(_paired(sets), parts)
    times = files.select(F.col("id").alias("file_id"), "mtime_unix").repartition(parts, "file_id")
    return _counted(_paired(sets.join(times, "file_id"), "mtime_unix"), parts, *_times())


def _times() -> tuple[Column, Column]:
    return F.min("mtime_unix").alias("first_seen_at"), F.max("mtime_unix").alias("last_seen_at")


def _counted(pairs: DataFrame, parts: int, *more: Column) -> DataFrame:
    return pairs.drop("file_id").repartition(parts, "entity_a", "entity_b").groupBy("entity_a", "entity_b").agg(F.count("*").alias("co_occurrence_count"), *more)


def edges_of(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """edges of pairs of edge_files, with times."""
    timed = pairs.join(files.select(F.col("id").alias("file_id"), "mtime_unix"), "file_id")
    return timed.groupBy("entity_a", "entity_b").agg(F.count("*").alias("co_occurrence_count"), *_times())


def merge_edges(old: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """Edge tables added up: counts, the first and the last time seen (the upsert of K10); dealt to parts, if they are given."""
    both = old.unionByName(new)
    both = both if parts is None else both.repartition(parts, "entity_a", "entity_b")
    return both.groupBy("entity_a", "entity_b").agg(F.sum("co_occurrence_count").alias("co_occurrence_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def neighbours(edges: DataFrame, entities: DataFrame, entity_id: int | None = None, limit: int = 20, parts: int | None = None) -> DataFrame:
    """entity_id, neighbor_id, display_name, co_occurrence_count: each entity's most frequent companions.

    Both directions of an edge are equi-joined; the best limit of an entity are kept
    before the names are fetched. Entities are dealt to parts, if they are given.
    """
    there = edges.select(F.col("entity_a").alias("entity_id"), F.col("entity_b").alias("neighbor_id"), "co_occurrence_count")
    back = edges.select(F.col("entity_b").alias("entity_id"), F.col("entity_a").alias("neighbor_id"), "co_occurrence_count")
    both = there.unionByName(back)
    if entity_id is not None:
        both = both.filter(F.col("entity_id") == entity_id)
    both = both if parts is None else both.repartition(parts, "entity_id")
    order = Window.partitionBy("entity_id").orderBy(F.desc("co_occurrence_count"), "neighbor_id")
    best = both.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).drop("nth")
    names = entities.select(F.col("entity_id").alias("neighbor_id"), F.coalesce("display_name", F.lit("")).alias("display_name"))
    return best.join(names, "neighbor_id").select("entity_id", "neighbor_id", "display_name", "co_occurrence_count")


def candidates(members: DataFrame, ids: list[int], pairs: DataFrame | None = None) -> DataFrame:
    """file_id of the files that hold all of ids: one, two (by the pair table, if it has any), or more.

    Relational division in one pass: count the distinct wanted entities of each file.
    No file is a final answer, never a union.
    """
    wanted = sorted({i for i in ids if i is not None and i >= 0})
    if len(wanted) == 1:
        return members.filter(F.col("entity_id") == wanted[0]).select("file_id").distinct()
    found = members.filter(F.col("entity_id").isin(wanted)).groupBy("file_id").agg(F.count_distinct("entity_id").alias("n")).filter(F.col("n") == len(wanted)).select("file_id")
    if pairs is not None and len(wanted) == 2:
        known = pairs.filter((F.col("entity_a") == wanted[0]) & (F.col("entity_b") == wanted[1])).select("file_id").distinct()
        none = known.agg((F.count("*") == 0).alias("_none"))  # one row
        return known.unionByName(found.crossJoin(F.broadcast(none)).filter("_none").select("file_id"))
    return found


def ranked_by_membership(members: DataFrame, ids: list[int], top_k: int = 30) -> DataFrame:
    """file_id, score: the least score of ids in each file that has them all, the best top_k."""
    wanted = sorted(set(ids))
    each = members.filter(F.col("entity_id").isin(wanted)).groupBy("file_id").agg(F.min("score").alias("score"), F.count_distinct("entity_id").alias("n"))
    return each.filter(F.col("n") == len(wanted)).select("file_id", "score").orderBy(F.desc("score"), "file_id").limit(top_k)


def verified(hits: DataFrame, detections: DataFrame, ids: list[int]) -> DataFrame:
    """Hits whose files' detections have all of ids."""
    wanted = sorted(set(ids))
    if not wanted:
        return hits
    return hits.join(candidates(detections.filter(F.col("entity_id").isNotNull()), wanted), "file_id", "left_semi")


def best_crops(detections: DataFrame, files: DataFrame, min_score: float = 0.65, min_side: int = 60) -> DataFrame:
    """entity_id, file_id, id, bbox_w, bbox_h, det_score: each entity's best face.

    Faces of quality come first, then larger ones, then lower ids.
    """
    passes = (F.col("det_score") > min_score) & (F.col("bbox_w") > min_side) & (F.col("bbox_h") > min_side)
    faces = detections.filter(F.col("entity_id").isNotNull()).join(files.select(F.col("id").alias("file_id"), "abs_path"), "file_id")
    order = Window.partitionBy("entity_id").orderBy(F.when(passes, 0).otherwise(1), F.desc(F.col("bbox_w") * F.col("bbox_h")), "id", "det_score", "file_id")
    return faces.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("entity_id", "file_id", "abs_path", "id", "bbox_w", "bbox_h", "det_score")


def top_entities(entities: DataFrame, limit: int = 50) -> DataFrame:
    return entities.select("entity_id", "display_name", "sample_count").orderBy(F.desc("sample_count"), "entity_id").limit(limit)


def entity_files(members: DataFrame, files: DataFrame, entity_id: int, limit: int = 100) -> DataFrame:
    """file_id, abs_path, score of an entity's best files."""
    own = members.filter(F.col("entity_id") == entity_id)
    return own.join(files.select(F.col("id").alias("file_id"), "abs_path"), "file_id").select("file_id", "abs_path", "score").orderBy(F.desc("score"), "file_id").limit(limit)


def people_cards(entities: DataFrame, detections: DataFrame, files: DataFrame, limit: int = 50) -> DataFrame:
    """The top entities with their best face, in one job."""
    top = top_entities(entities, limit)
    own = detections.join(F.broadcast(top.select("entity_id")), "entity_id", "left_semi")  # limit rows
    return top.join(best_crops(own, files), "entity_id", "left").select("entity_id", "display_name", "sample_count", F.col("abs_path").alias("crop_path"), F.col("id").alias("detection_id"))


def face_counts(files: DataFrame, detections: DataFrame) -> DataFrame:
    """id, face_count of every file, 0 without faces."""
    counts = detections.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))
    return files.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("face_count"))
