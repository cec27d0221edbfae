"""Counts of the catalogue, each in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_type(files: DataFrame) -> DataFrame:
    """filetype, n, bytes and each type's share of all bytes in percent."""
    each = files.groupBy("filetype").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    whole = F.sum("bytes").over(Window.partitionBy())  # a row for each type
    return each.withColumn("share", F.when(whole > 0, F.round(F.col("bytes") * 100.0 / whole, 4)).otherwise(0.0))


def counts(files: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """n_files, n_pictures, n_pending_pictures, n_targets (not skipped) and n_vectors (A1)."""
    found = files.agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("filetype") == "picture").alias("n_pictures"),
        F.count_if((F.col("filetype") == "picture") & (F.col("status") == "pending")).alias("n_pending_pictures"),
        F.count_if((F.col("filetype") == "picture") & (F.col("status") != "skipped")).alias("n_targets"),
    )
    if vectors is None:
        return found
    return found.join(F.broadcast(vectors.agg(F.count("*").alias("n_vectors"))), F.lit(True))  # one row each


def progress(files: DataFrame) -> DataFrame:
    """processed, total, percent of the pictures."""
    pictures = F.col("filetype") == "picture"
    n = files.agg(F.count_if(pictures).alias("total"), F.count_if(pictures & (F.col("status") == "pending")).alias("pending"))
    processed = F.col("total") - F.col("pending")
    return n.select(processed.alias("processed"), "total", F.when(F.col("total") > 0, F.least(F.lit(100), F.ceil(100 * processed / F.col("total")))).otherwise(0).cast("long").alias("percent"))


def pending_pictures(files: DataFrame, limit: int = 10) -> DataFrame:
    return files.filter((F.col("filetype") == "picture") & (F.col("status") == "pending")).orderBy("id").limit(limit)


def indexed_pictures(files: DataFrame) -> DataFrame:
    return files.filter((F.col("filetype") == "picture") & (F.col("status") == "indexed"))


def stored_files(files: DataFrame, limit: int = 100) -> DataFrame:
    """uri, type, mime, size of files in order of their ids."""
    return files.orderBy("id").limit(limit).select(F.col("abs_path").alias("uri"), F.col("filetype").alias("type"), F.col("mime_type").alias("mime"), F.col("size_bytes").alias("size"))


def scan_summary(scanned: DataFrame) -> DataFrame:
    """fileDtype, n, bytes of a scan (A10)."""
    return scanned.groupBy("fileDtype").agg(F.count("*").alias("n"), F.sum("sizeBytes").alias("bytes"))
