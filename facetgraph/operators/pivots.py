"""Joins of two large sides of vectors by pivots: both are partitioned, neither passes through the driver.

Vectors belong to the nearest of a bounded number of pivots, themselves vectors. What lies in another cell is
at least as far away as the triangle inequality and the plane between both pivots say, so a query goes to few cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

#: Pivots at most, rows of either side that one task compares, about, and cells for each so many rows.
PIVOTS, BLOCK_ROWS, CELLS_A_BLOCK = 4096, 8192, 4
#: Bound of the rounding errors of rough squared distances, as a share of both vectors' squares.
ROUNDING = 1e-10
#: What pruning leaves to rounding, as a share of the distances compared.
SLACK = 1e-6


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of a column as doubles; all are of this size, without nulls."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), size)


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ p.T + (p**2).sum(axis=1)[None, :], 0))


def is_finite(size: int) -> Column:
    """Whether the embedding has this size and finite components only."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size("embedding") == size) & fine, F.lit(False))


def finite(rows: DataFrame, size: int) -> DataFrame:
    return rows.filter(is_finite(size))


def most_common_size(rows: DataFrame) -> tuple[int, int]:
    """The dimension that most vectors have, of equally frequent ones the least, and how many have it; (0, 0) without vectors."""
    found = rows.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return (found[0]["d"], found[0]["n"]) if found else (0, 0)


def choose(rows: DataFrame, key: str, count: int) -> np.ndarray:
    """At most PIVOTS different vectors of rows, those of the least hash of their key."""
    chosen = rows.orderBy(F.xxhash64(key), key).limit(min(PIVOTS, count)).select("embedding").collect()
    return np.unique(np.array([r["embedding"] for r in chosen], np.float64), axis=0)


@dataclass(frozen=True)
class Cells:
    """Pivots, and of each cell its radius and how many rows it has."""

    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray


def best_rows(q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in q, place in x and distance of the k rows of x nearest to each query, ties by their ids own."""
    squares, length = (q**2).sum(axis=1), (x**2).sum(axis=1)
    rough = squares[:, None] - 2 * q @ x.T + length[None, :]
    # all rows up to the k-th rough distance, and what rounding may have put beyond it
    kth = np.partition(rough, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1]
    margin = ROUNDING * (squares + np.nanmax(length, initial=0.0))
    of, near = np.nonzero(~(rough > (kth + margin)[:, None]))
    step = max(1, (1 << 22) // q.shape[1])
    exact = np.concatenate([np.sqrt(((x[near[i : i + step]] - q[of[i : i + step]]) ** 2).sum(axis=1)) for i in range(0, len(of), step)])
    order = np.lexsort((own[near], exact, of))
    first = np.searchsorted(of, np.arange(len(q)))
    order = order[np.arange(len(of)) - first[of] < k]
    return of[order], near[order], exact[order]


def _placed(rows: DataFrame, shared: Broadcast, size: int, visits: Callable[[Cells, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """id, embedding, cell, far (from its pivot) for all cells that visits (cells, distances, bound) names for a row of (id, embedding, bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            x, bound = matrix(batch.column(1), size), batch.column(2).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 512):
                far = distances(x[at : at + 512], cells.pivots)
                who, cell = np.nonzero(visits(cells, far, bound[at : at + 512]))
                place = pa.array(at + who)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(cell.astype(np.int32)), pa.array(far[who, cell])], ["id", "embedding", "cell", "far"])

    return rows.mapInArrow(run, f"id long, embedding {dict(rows.dtypes)['embedding']}, cell int, far double")


def at_home(cells: Cells, far: np.ndarray, bound: np.ndarray) -> np.ndarray:
    return np.arange(far.shape[1])[None, :] == far.argmin(axis=1)[:, None]


def _away(k: int) -> Callable[[Cells, np.ndarray, np.ndarray], np.ndarray]:
    """The cells beside its own that may hold one of a query's k nearest: bound is the k-th distance known, or the farthest wanted."""

    def visits(cells: Cells, far: np.ndarray, bound: np.ndarray) -> np.ndarray:
        own = far.argmin(axis=1)
        # so many rows lie within a cell's distance and radius, so the k-th nearest does
        ends = far + cells.radius[None, :]
        order = ends.argsort(axis=1)
        enough = cells.rows[order].cumsum(axis=1) >= k
        kth = np.where(enough.any(axis=1), np.take_along_axis(ends, order, 1)[np.arange(len(far)), enough.argmax(axis=1)], np.inf)
        reach = np.minimum(bound, kth)[:, None] + SLACK * (1 + far.max(axis=1))[:, None]
        between = distances(cells.pivots, cells.pivots)[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (far**2 - far[np.arange(len(own)), own][:, None] ** 2) / (2 * between), 0)
        return (far - cells.radius[None, :] <= reach) & (plane <= reach) & (cells.rows > 0)[None, :] & ~at_home(cells, far, bound)

    return visits


def _dealt(rows: DataFrame, own: dict[int, int], other: dict[int, int], first: bool) -> DataFrame:
    """rows dealt to the chunks of their cell, once for each chunk of the other side: group is (cell, chunk of vectors, chunk of queries)."""
    counts = rows.sparkSession.createDataFrame([(c, n, other.get(c, 0)) for c, n in own.items()], "cell int, _own int, _other int")  # at most PIVOTS rows
    met = rows.join(F.broadcast(counts), "cell").filter("_other > 0").withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_own")).cast("int"))
    met = met.withColumn("_theirs", F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
    a, b = ("_mine", "_theirs") if first else ("_theirs", "_mine")
    return met.select("id", "embedding", "cell", F.col(a).alias("part"), F.col(b).alias("share"))


def _chunks(rows: DataFrame, block_rows: int) -> dict[int, int]:
    return {r["cell"]: -(-r["n"] // block_rows) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most PIVOTS rows


def _met(vectors: DataFrame, parts: dict[int, int], queries: DataFrame, k: int, size: int, within: float, block_rows: int) -> DataFrame:
    """q, v, distance: the k nearest within each chunk of a cell that a query came to; parts are the chunks of vectors by cell."""
    queries = stored(queries, "queries")
    shares = _chunks(queries, block_rows)

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, asking = np.array(own.column("id"), np.int64), np.array(asked.column("id"), np.int64)
        found = []
        if len(ids) and len(asking):
            x, q = matrix(own.column("embedding"), size), matrix(asked.column("embedding"), size)
            for at in range(0, len(q), 256):
                of, near, exact = best_rows(q[at : at + 256], ids, x, k)
                keep = exact <= within
                found.append((asking[at + of[keep]], ids[near[keep]], exact[keep]))
        whole = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"q": whole[0], "v": whole[1], "distance": whole[2]})

    left, right = _dealt(vectors, parts, shares, True), _dealt(queries, shares, parts, False)
    keys = ("cell", "part", "share")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "q long, v long, distance double")


def _k_best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("distance", "v"))).filter(F.col("nth") <= k).drop("nth")


def knn_by_pivots(vectors: DataFrame, queries: DataFrame, k: int, within: float | None = None, key: str = "vec_id", query_key: str = "query_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_key, key, distance: the k nearest vectors of each query, at most within away, ties by key; both sides may be large.

    First each query is answered by its own cell; the k-th distance then says which other cells it has to
    visit. A cell's rows and the queries that come to it are dealt out in chunks of about block_rows, so no task holds more than one of each.
    Of equal vectors only the k lowest keys take part, as no query has more, so a mass of copies costs nothing.
    Null vectors, those of another dimension than most queries' and those with a component that isn't finite have no
    neighbours. k below 1, no vectors or no queries give an empty table. Query keys should differ.
    """
    spark, most = vectors.sparkSession, np.inf if within is None else float(within)
    size = most_common_size(queries)[0]
    rows = finite(vectors.select(F.col(key).cast("long").alias("id"), "embedding"), size)
    asked = finite(queries.select(F.col(query_key).cast("long").alias("id"), "embedding"), size).withColumn("bound", F.lit(most))
    n = rows.count() if size and k > 0 else 0
    if not n:
        return spark.createDataFrame([], f"{query_key} long, {key} long, distance double")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).filter(F.col("nth") <= k).select("id", "embedding", F.lit(0.0).alias("bound"))
    pivots = choose(rows, "id", 1 + CELLS_A_BLOCK * n // block_rows)
    nothing = np.zeros(len(pivots))
    placed = stored(_placed(rows, spark.sparkContext.broadcast(Cells(pivots, nothing, nothing)), size, at_home), "cells")
    stats = placed.groupBy("cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect()  # at most PIVOTS rows
    radius, counts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in stats:
        radius[r["cell"]], counts[r["cell"]] = r["r"] * (1 + SLACK) + SLACK, r["n"]
    parts = {r["cell"]: -(-r["n"] // block_rows) for r in stats}
    shared = spark.sparkContext.broadcast(Cells(pivots, radius, counts))
    home = stored(_k_best(_met(placed, parts, _placed(asked, shared, size, at_home), k, size, most, block_rows), k), "home")
    known = home.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
    bounds = asked.join(known, asked["id"] == known["q"], "left").select("id", "embedding", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(most)).alias("bound"))
    away = _met(placed, parts, _placed(bounds, shared, size, _away(k)), k, size, most, block_rows)
    return _k_best(home.unionByName(away), k).select(F.col("q").alias(query_key), F.col("v").alias(key), "distance")
