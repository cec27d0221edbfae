"""Changes of the catalogue as new snapshots: each takes the old rows and returns the new ones.

Times are given by the caller, so a snapshot can be made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import FILETYPES, STATUSES


def new_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """The valid rows of new whose abs_path old doesn't have, the least id of equal paths."""
    allowed = F.col("filetype").isin(*FILETYPES) & F.col("status").isin(*STATUSES) & F.col("abs_path").isNotNull()
    first = Window.partitionBy("abs_path").orderBy("id")
    fresh = new.filter(allowed).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return fresh.join(old.select("abs_path"), "abs_path", "left_anti").select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and the rows of new_files."""
    return old.unionByName(new_files(old, new))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key (K4)."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def mark_indexed(files: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """files with those of ids (id) indexed at now (K4, K5)."""
    done = files.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.col("_hit").isNotNull()
    return done.select(*[F.when(hit, F.lit("indexed")).otherwise(F.col(c)).alias(c) if c == "status" else F.when(hit, F.lit(now)).otherwise(F.col(c)).cast("long").alias(c) if c == "last_indexed_at" else F.col(c) for c in files.columns])


def set_status(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files with the status of changes (id, status), unknown ids change nothing."""
    new = changes.select("id", F.col("status").alias("_status"))
    return files.join(new, "id", "left").select(*[F.coalesce("_status", "status").alias("status") if c == "status" else F.col(c) for c in files.columns])


def set_metadata(entities: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """entities with changes (entity_id and any of display_name, relation, age, location); an age up to 0 is none."""
    given = [c for c in changes.columns if c != "entity_id"]
    new = changes.select(F.col("entity_id"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in given])
    hit = F.col("_hit").isNotNull()

    def value(c: str) -> Column:
        if c == "updated_at":
            return F.when(hit, F.lit(now)).otherwise(F.col(c)).cast("long").alias(c)
        if c not in given:
            return F.col(c)
        own = F.when(F.col("_age") > 0, F.col("_age")) if c == "age" else F.col(f"_{c}")
        return F.when(hit, own).otherwise(F.col(c)).alias(c)

    return entities.join(new, "entity_id", "left").select(*[value(c) for c in entities.columns])


def metadata(entities: DataFrame, entity_id: int) -> DataFrame:
    """One row for an entity; an unknown one is empty, not an error."""
    spark = entities.sparkSession
    asked = spark.createDataFrame([(entity_id,)], "entity_id long")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("display_name", "relation", "location")]
    return asked.join(entities, "entity_id", "left").select("entity_id", *text, F.coalesce("age", F.lit(0)).alias("age"), F.coalesce("sample_count", F.lit(0)).alias("sample_count"))


def delete_entities(gone: DataFrame, detections: DataFrame, members: DataFrame, edges: DataFrame, edge_files: DataFrame) -> dict[str, DataFrame]:
    """What is left once entities (entity_id) are deleted: their detections lose the entity, the rest goes."""
    ids = gone.select("entity_id").distinct()
    marked = detections.join(ids.withColumn("_gone", F.lit(True)), "entity_id", "left")
    freed = marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "entity_id" else F.col(c) for c in detections.columns])
    without = lambda df: df.join(ids.select(F.col("entity_id").alias("entity_a")), "entity_a", "left_anti").join(ids.select(F.col("entity_id").alias("entity_b")), "entity_b", "left_anti").select(*df.columns)
    return {"face_detections": freed, "entity_memberships": members.join(ids, "entity_id", "left_anti").select(*members.columns), "entity_relations": without(edges), "entity_relation_files": without(edge_files)}


def reset_faces(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All that was learned of faces is emptied, and face counts are 0 again."""
    gone = ("entity_memberships", "face_vec", "face_detections", "person_centroids", "entities", "entity_relations", "entity_relation_files")
    out = {k: (df.limit(0) if k in gone else df) for k, df in tables.items()}
    if "files" in out:
        out["files"] = out["files"].withColumn("face_count", F.lit(0))
    return out


#: Groups of files whose ids are counted together.
ID_GROUPS = 1024


def new_detections(found: DataFrame, last: int, now: int) -> DataFrame:
    """found (file_id, x, y, w, h, conf, crop_path) as detections without entity, with ids above last (K6).

    Ids are gapless and the same each time: files are hashed to ID_GROUPS groups, the
    groups' sizes alone reach the driver, and rows are numbered within their group.
    """
    spark = found.sparkSession
    grouped = found.withColumn("_g", F.pmod(F.xxhash64("file_id"), F.lit(ID_GROUPS)))
    starts, at = [], last
    for g in grouped.groupBy("_g").count().orderBy("_g").collect():
        starts.append((g["_g"], at))
        at += g["count"]
    first = F.broadcast(spark.createDataFrame(starts, "_g long, _first long"))
    order = Window.partitionBy("_g").orderBy("file_id", F.desc("conf"), "x", "y")
    return grouped.withColumn("_k", F.row_number().over(order)).join(first, "_g").select(
        (F.col("_first") + F.col("_k")).cast("long").alias("id"),
        "file_id",
        F.lit(None).cast("long").alias("entity_id"),
        *[F.col(c).cast("int").alias(f"bbox_{c}") for c in ("x", "y", "w", "h")],
        F.col("conf").cast("double").alias("det_score"),
        F.lit(now).cast("long").alias("created_at"),
        F.coalesce("crop_path", F.lit("")).alias("aligned_crop_path"),
    )


def append_detections(old: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """old and new_detections of found, with ids above the largest of old."""
    return old.unionByName(new_detections(found, old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"], now))


def as_json(rows: DataFrame, order: list[str], decimals: int = 6) -> DataFrame:
    """One row json: all rows as a JSON array, in order, floats with fixed decimals (K16). For results of a bounded number of rows."""
    fields = [F.format_string(f"%.{decimals}f", F.col(f.name)).cast("decimal(38,6)").alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema]
    ordered = rows.select(F.struct(*order).alias("_o"), F.struct(*fields).alias("_r"))
    return ordered.agg(F.array_sort(F.collect_list(F.struct("_o", "_r"))).alias("all")).select(F.to_json(F.transform("all", lambda x: x["_r"])).alias("json"))
