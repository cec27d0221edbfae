"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_dir, shared_path, stored  # noqa: F401 (the operators take them from here)

#: Rows and bytes that one Arrow batch may hold on its way to Python. Texts may be long, so
#: a batch is kept far below Spark's defaults of 10,000 rows and 64 MB; a longer text is a batch alone.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark alone (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts, in rows and in bytes.

    Spark reads both settings when a plan starts, not when it is made, so they stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def runs_of_texts(texts: list[str], rows: int = 64, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts, each of at most rows texts and, but for a text alone, chars characters."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and (i - first == rows or held + len(text) > chars):
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def blob_of_text() -> Column:
    """SHA-256 of the text, null as the empty text."""
    return F.sha2(whole_text(), 256)


def row_key() -> Column:
    """What tells rows of documents apart, in the order in which one stands for many: doc_id, nulls last, then text."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), blob_of_text().alias("blob"))
