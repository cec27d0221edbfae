"""Tables of the catalogue, and the checks that Spark doesn't make by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "files": "id bigint, abs_path string, display_name string, filetype string, mime_type string, size_bytes bigint, mtime_unix bigint, last_indexed_at bigint, width_px int, height_px int, duration_ms bigint, face_count int, status string, retry_count int",
    "entities": "entity_id bigint, entity_type string, display_name string, confidence double, sample_count int, created_at bigint, updated_at bigint, relation string, age int, location string",
    "face_detections": "id bigint, file_id bigint, entity_id bigint, bbox_x int, bbox_y int, bbox_w int, bbox_h int, det_score double, created_at bigint, aligned_crop_path string",
    "entity_memberships": "entity_id bigint, file_id bigint, score double, created_at bigint",
    "entity_relations": "entity_a bigint, entity_b bigint, co_occurrence_count bigint, first_seen_at bigint, last_seen_at bigint",
    "entity_relation_files": "entity_a bigint, entity_b bigint, file_id bigint",
    "clip_vec": "file_id bigint, embedding array<float>",
    "person_centroids": "entity_id bigint, embedding array<float>",
    "face_vec": "detection_id bigint, embedding array<float>",
    "document_chunks": "id bigint, file_id bigint, chunk_index int, chunk_text string, created_at bigint",
    "document_vec": "chunk_id bigint, embedding array<float>",
}
#: The columns that tell a table's rows apart.
KEYS = {
    "files": ["id"],
    "entities": ["entity_id"],
    "face_detections": ["id"],
    "entity_memberships": ["entity_id", "file_id"],
    "entity_relations": ["entity_a", "entity_b"],
    "entity_relation_files": ["entity_a", "entity_b", "file_id"],
    "clip_vec": ["file_id"],
    "person_centroids": ["entity_id"],
    "face_vec": ["detection_id"],
    "document_chunks": ["id"],
    "document_vec": ["chunk_id"],
}
#: What a missing column is filled with.
DEFAULTS = {"display_name": "", "face_count": 0, "status": "pending", "retry_count": 0, "confidence": 1.0, "sample_count": 0, "score": 1.0, "entity_type": "person"}
#: Allowed values (fixed values).
FILETYPES = ("picture", "document", "audio", "video")
STATUSES = ("pending", "indexed", "failed", "skipped")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def ensure_columns(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of a table: missing ones are added with their default, additive migration."""
    out = []
    for column in SCHEMAS[name].split(", "):
        field, kind = column.split(" ")
        value = F.col(field) if field in df.columns else F.lit(DEFAULTS.get(field))
        out.append(value.cast(kind).alias(field))
    return df.select(*out)


def violations(files: DataFrame) -> DataFrame:
    """Rows of files that the checks and keys of the table forbid."""
    bad = F.col("abs_path").isNull() | ~F.coalesce(F.col("filetype").isin(*FILETYPES), F.lit(False)) | ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    repeated = files.groupBy("abs_path").count().filter("count > 1").select("abs_path")
    return files.filter(bad).unionByName(files.filter(~bad).join(repeated, "abs_path", "left_semi").select(*files.columns))
