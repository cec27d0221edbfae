"""Catalogue tables made of the star-schema test tables, so that every operator has input at any scale.

Each is given twice: as a DataFrame for the queries, as SQL for their oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import tasks

FILES_SQL = """
  SELECT o_orderkey AS id, '/o/' || o_orderkey || '.jpg' AS abs_path, 'o' || o_orderkey || '.jpg' AS display_name,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'picture' WHEN '2' THEN 'picture' WHEN '3' THEN 'video' WHEN '4' THEN 'audio' ELSE 'document' END AS filetype,
         'type/' || substr(o_orderpriority, 1, 1) AS mime_type,
         CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CAST(epoch(o_orderdate) AS BIGINT) AS mtime_unix,
         CAST(0 AS BIGINT) AS last_indexed_at, 0 AS face_count,
         CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status
  FROM orders"""
DETECTIONS_SQL = """
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS file_id, CASE WHEN l_quantity >= 5 THEN l_suppkey END AS entity_id,
         CAST(l_partkey % 200 AS INTEGER) AS bbox_w, CAST(l_linenumber * 30 AS INTEGER) AS bbox_h, l_quantity / 50 AS det_score
  FROM lineitem"""
ENTITIES_SQL = """
  SELECT s_suppkey AS entity_id, s_name AS display_name, n_name AS relation, CAST(coalesce(c, 0) AS BIGINT) AS sample_count
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey"""
MEMBERS_SQL = """
  SELECT l_suppkey AS entity_id, l_orderkey AS file_id, 1 - max(l_discount) AS score FROM lineitem GROUP BY 1, 2"""
WITH = f"WITH files AS ({FILES_SQL}), detections AS ({DETECTIONS_SQL}), entities AS ({ENTITIES_SQL}), members AS ({MEMBERS_SQL})"
PAIRS_SQL = """
  pair_files AS (SELECT DISTINCT x.entity_id AS entity_a, y.entity_id AS entity_b, x.file_id FROM detections x JOIN detections y
    ON x.file_id = y.file_id AND x.entity_id < y.entity_id)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    kind = F.substring("o_orderpriority", 1, 1)
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("/o/"), "o_orderkey", F.lit(".jpg")).alias("abs_path"),
        F.concat(F.lit("o"), "o_orderkey", F.lit(".jpg")).alias("display_name"),
        F.when(kind.isin("1", "2"), "picture").when(kind == "3", "video").when(kind == "4", "audio").otherwise("document").alias("filetype"),
        F.concat(F.lit("type/"), kind).alias("mime_type"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime_unix"),
        F.lit(0).cast("long").alias("last_indexed_at"),
        F.lit(0).alias("face_count"),
        F.when(status == "F", "indexed").when(status == "O", "pending").otherwise("failed").alias("status"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("file_id"),
        F.when(F.col("l_quantity") >= 5, F.col("l_suppkey")).alias("entity_id"),
        (F.col("l_partkey") % 200).cast("int").alias("bbox_w"),
        (F.col("l_linenumber") * 30).cast("int").alias("bbox_h"),
        (F.col("l_quantity") / 50).alias("det_score"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    counts = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("c"))
    named = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(counts, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return named.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("display_name"), F.col("n_name").alias("relation"), F.coalesce("c", F.lit(0)).cast("long").alias("sample_count"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each entity and file; dealt out by the number of rows, so that no task holds more of them where the table is larger."""
    li = read(spark, sf_dir, "lineitem")
    dealt = li.select("l_suppkey", "l_orderkey", "l_discount").repartition(tasks(spark, li.count()), "l_suppkey", "l_orderkey")
    return dealt.groupBy(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("file_id")).agg((1 - F.max("l_discount")).alias("score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")
