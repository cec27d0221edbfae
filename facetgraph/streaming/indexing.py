"""Incremental indexing: new files are embedded as they come, by micro-batches.

A file source with a checkpoint replaces polling for pending rows: what a batch has
taken is known, a stopped query goes on where it was, and a batch that runs again
writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..models import apply_model


def index(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    embedder: Callable[[], Callable[[list], list]],
    column: str = "abs_path",
    files_per_batch: int = 10,
    now: int = 0,
) -> StreamingQuery:
    """Embed the pending pictures that arrive in source, until nothing is left.

    target/vectors gets file_id and embedding, target/status the outcome of each file
    (indexed, or failed and never tried again), target/progress the counts of each batch.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    pending = rows.filter((F.col("filetype") == "picture") & (F.col("status") == "pending"))

    def write(batch: DataFrame, number: int) -> None:
        done = apply_model(batch.select("id", F.col(column).alias("_in")), embedder, "_in", "embedding", "array<float>")
        path = f"{target}/work/batch={number}"
        done.select("id", "embedding").write.mode("overwrite").parquet(path)
        done = spark.read.schema("id long, embedding array<float>").parquet(path)
        ok = F.col("embedding").isNotNull()
        done.filter(ok).select(F.col("id").alias("file_id"), "embedding").write.mode("overwrite").parquet(f"{target}/vectors/batch={number}")
        done.select("id", F.when(ok, "indexed").otherwise("failed").alias("status"), F.lit(now).cast("long").alias("last_indexed_at")).write.mode("overwrite").parquet(f"{target}/status/batch={number}")
        counts = done.agg(F.count("*").alias("processed"), F.count_if(~ok).alias("failed"))
        counts.write.mode("overwrite").parquet(f"{target}/progress/batch={number}")

    return pending.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, target: str, total: int) -> DataFrame:
    """processed, failed, total, percent so far."""
    done = spark.read.parquet(f"{target}/progress").agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))
    percent = F.least(F.lit(100), F.ceil(100 * F.col("processed") / max(total, 1)))
    return done.select("processed", "failed", F.lit(total).alias("total"), percent.cast("long").alias("percent"))


def running_members(stream: DataFrame) -> DataFrame:
    """entity_id, sample_count of a stream of detections: the counts are the stream's state."""
    return stream.filter(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.count("*").alias("sample_count"))
