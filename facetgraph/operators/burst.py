"""Suppression of bursts: hits taken within seconds of one that ranks higher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_S = 30


def spread(ranked: Column, seconds: int = WINDOW_S) -> Column:
    """Of an array of (rank, mtime, ...) in order, those not within seconds of one kept before. Times up to 0 are exempt."""
    none = F.filter(ranked, lambda x: F.lit(False))
    near = lambda kept, x: F.exists(kept, lambda k: (k["mtime"] > 0) & (F.abs(k["mtime"] - x["mtime"]) < seconds))
    return F.aggregate(ranked, none, lambda kept, x: F.when((x["mtime"] > 0) & near(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def deburst(hits: DataFrame, query: str = "query_id", rank: str = "rank", mtime: str = "mtime_unix", seconds: int = WINDOW_S) -> DataFrame:
    """The hits of each query that survive (W4). A query has at most its top k hits, so its array is short."""
    rest = [c for c in hits.columns if c not in (query, rank)]
    packed = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(mtime).cast("long").alias("mtime"), *rest))).alias("hits"))
    kept = packed.select(query, F.explode(spread(F.col("hits"), seconds)).alias("hit"))
    return kept.select(query, F.col("hit.rank").alias(rank), *[F.col(f"hit.{c}").alias(c) for c in rest])
