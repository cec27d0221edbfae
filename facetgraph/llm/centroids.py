"""Clustering of whole-number vectors around centroids, exact by float32 screening.

A matrix product in single precision gives every distance with a rigorous bound of its rounding error. The centroids
whose intervals reach the least upper end are the shortlist; where it has more than one, its
distances are computed anew in whole numbers, and of equal ones the lowest number wins. Sums of a round are made
task by task, then added by Spark; the driver sees one row of sums for each centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Unit roundoff of single precision.
UNIT = 2.0**-24
#: Whole numbers below this have squared distances of SIZE components within 64 bits; larger ones are Python's.
PLAIN = 1 << 27
#: Components of this size or more aren't clustered: their sums would leave Spark's decimals.
MOST = 10**26
LONGEST = 2**63 - 1


def kept(embedding: Column, size: int = SIZE) -> Column:
    """Whether a vector takes part: size components, none null or non-finite, none of MOST or more once scaled."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < MOST / SCALE)
    return F.coalesce((F.size(embedding) == size) & F.forall(embedding, fine), F.lit(False))


def scaled(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles as whole numbers: int64 where all are below PLAIN, else Python's."""
    whole = np.floor(SCALE * rows)
    if not len(whole) or np.abs(whole).max() < PLAIN:
        return whole.astype(np.int64)
    return np.array([int(x) for x in whole.ravel()], object).reshape(whole.shape)


def squared(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, one by one, in whole numbers."""
    if object in (rows.dtype, others.dtype):
        rows, others = rows.astype(object), others.astype(object)
    apart = rows - others
    return (apart * apart).sum(axis=1)


def intervals(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2 x.c for all rows and centroids, from one product in single precision.

    Turning n components into singles and adding n products, in any order, with or without fused steps, errs by at
    most k / (1 - k) |x| |c|, k = (n + 2) UNIT. What doubles add to that is far below the slack of a hundredth more.
    """
    c = centroids.astype(np.float64)
    x = rows.astype(np.float64)
    k = (x.shape[1] + 2) * UNIT
    lengths, others = np.sqrt((x * x).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    with np.errstate(over="ignore", invalid="ignore"):
        product = (rows.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    error = 1.01 * (2 * k / (1 - k) * lengths[:, None] * others[None, :] + 2.0**-40 * (others**2)[None, :])
    middle = (others**2)[None, :] - 2 * product
    lost = ~np.isfinite(product)  # too large for single precision: nothing is known of it
    return np.where(lost, -np.inf, middle - error), np.where(lost, np.inf, middle + error)


def assign(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, of equally near ones the lowest."""
    low, high = intervals(rows, centroids)
    open_ = low <= high.min(axis=1)[:, None]
    found = open_.argmax(axis=1)
    unsure = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(unsure):
        of, number = np.nonzero(open_[unsure])
        exact = squared(rows[unsure][of], centroids[number])
        least: dict[int, tuple] = {}
        if exact.dtype == object:
            for i, d, c in zip(of.tolist(), exact.tolist(), number.tolist(), strict=True):
                least[i] = min(least.get(i, (d, c)), (d, c))
            found[unsure] = [least[i][1] for i in range(len(unsure))]
        else:
            order = np.lexsort((number, exact, of))
            found[unsure] = number[order[np.searchsorted(of[order], np.arange(len(unsure)))]]
    return found


def whole_rows(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a column, all of this size without nulls, as whole numbers."""
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size))


def centroids_of(rows: list[list[int]]) -> np.ndarray:
    plain = all(abs(x) < PLAIN for row in rows for x in row)
    return np.array(rows, np.int64 if plain else object)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, sums) of a round; the driver gets one row for each centroid."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centroids), [np.zeros(size, object) for _ in centroids]
        for batch in batches:
            rows = whole_rows(batch.column(0), size)
            found = assign(rows, centroids)
            for c in np.unique(found).tolist():
                own = rows[found == c]
                counts[c] += len(own)
                sums[c] += own.sum(axis=0).astype(object)
        used = [c for c, n in enumerate(counts) if n]
        flat = pa.array([str(x) for c in used for x in sums[c]], pa.string())
        number, place = np.repeat(np.array(used, np.int32), size), np.tile(np.arange(size, dtype=np.int32), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(place), pa.array(np.repeat(np.array([counts[c] for c in used], np.int64), size)), flat], ["c", "place", "n", "s"])

    cells = vectors.select("embedding").mapInArrow(run, "c int, place int, n long, s string")
    whole = cells.groupBy("c", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return whole.groupBy("c").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "s"))).alias("sums")).collect()


def start(vectors: DataFrame, count: int, key: str) -> list[list[int]]:
    """The count vectors with the least SHA-256 of 3:<key>, null keys last, of equal keys the least vector."""
    first = vectors.select(F.sha2(F.concat(F.lit("3:"), F.col(key).cast("string")), 256).alias("h"), "embedding").orderBy(F.col("h").asc_nulls_last(), "embedding").limit(count).collect()
    return [[int(x) for x in row] for row in scaled(np.array([r["embedding"] for r in first], np.float64))]


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, key: str = "vec_id") -> tuple[DataFrame, list[list[int]]]:
    """key, cluster and distance (squared, in whole numbers) of each vector that takes part (kept), and the centroids.

    Vectors become whole numbers, floor(1024 x). The first centroids are those of start; each round gives every
    vector to its nearest centroid and moves that to the floor of its vectors' mean; an empty one stays. With
    fewer vectors than count there are as many centroids as vectors, with none an empty table. A null key is kept, repeated
    rows count each, other columns are ignored. Distances beyond 64 bits are given as the greatest long, assignments are exact all the same.
    Each round reads the vectors once and shuffles size * count rows of sums for each task; centroids are sent with the task.
    """
    taken = vectors.select(F.col(key), F.col("embedding")).filter(kept(F.col("embedding"), size))
    centroids = start(taken, count, key)
    if not centroids:
        return taken.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        for r in _sums(taken, centroids_of(centroids)):
            centroids[r["c"]] = [int(x["s"]) // r["n"] for x in r["sums"]]
    last = centroids_of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = whole_rows(batch.column(1), size)
            found = assign(rows, last)
            far = squared(rows, last[found])
            far = far if far.dtype != object else [min(int(d), LONGEST) for d in far]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int32)), pa.array(far, pa.int64())], [key, "cluster", "distance"])

    return taken.mapInArrow(run, f"{key} {taken.schema[key].dataType.simpleString()}, cluster int, distance long"), centroids


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, key: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """key, cluster, distance, inertia (of all) for each vector of cluster(), and for each centroid cluster, cluster_inertia, centroid (decimals).

    The assignment is written to the shared folder and read for both the sums and the rows; sums beyond 64 bits end at the greatest long.
    """
    found, centroids = cluster(vectors, count, rounds, size, key)
    found = stored(found, "clusters")
    most = lambda x: min(x, LONGEST)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(c, most(sums.get(c, 0)), [str(x) for x in row]) for c, row in enumerate(centroids)]
    centers = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, centroid array<string>")
    return found.withColumn("inertia", F.lit(most(sum(sums.values()))).cast("long")), centers.withColumn("centroid", F.col("centroid").cast("array<decimal(38,0)>"))
