"""Nearest neighbours, centroids, leader clustering and merging over vectors.

Exact searches compare blocks of rows with a query set of checked size as matrix
products in Arrow batches; only each query's best rows of a block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector
from ..storage import stored, tasks
from .pivots import BLOCK_ROWS, PIVOTS, ROUNDING, best_rows, distances, finite, is_finite, knn_by_pivots, matrix, most_common_size
from .rounds import ENTITIES, MOST, Rule, in_rounds, named, ranked, replay

#: Query vectors that one broadcast block holds; more are searched block by block.
QUERY_BLOCK = 4096
#: Centroids that are broadcast at most, 64 MB at 512 components; more are joined by pivots.
SENT = 16_384
#: Blocks of centroids that a task holds at once; more are searched in a further pass over the rows.
HELD_BLOCKS = 16


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", metric: str = "l2", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, distance and the columns of keep of the k rows nearest to one query, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    far = vector.l2(F.col("embedding"), q) if metric == "l2" else 1 - vector.dot(F.col("embedding"), q)
    rows = vectors.filter(F.size("embedding") == len(query))
    return rows.select(key, *keep, far.alias("distance")).orderBy("distance", key).limit(k)


def _blocks(queries: DataFrame, key: str, most: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Keys and vectors of queries in blocks of QUERY_BLOCK, or None where there are more than most of them."""
    rows = queries.select(key, "embedding").limit(most + 1).collect()
    if len(rows) > most:
        return None
    return [(np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.float64)) for some in (rows[at : at + QUERY_BLOCK] for at in range(0, len(rows), QUERY_BLOCK))]


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, within: float | None = None, key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """query_id, key, distance: for each query its k nearest vectors by L2, at most within away.

    Up to QUERY_BLOCK queries are sent to the vectors, of which each task hands on its best; more are joined by
    pivots. Rows of another dimension than the queries' are skipped, as are null ones.
    """
    spark = vectors.sparkSession
    sent = _blocks(queries, query_key, QUERY_BLOCK)
    if sent is None:
        return knn_by_pivots(vectors, queries, k, within, key, query_key)
    if not sent:
        return spark.createDataFrame([], f"{query_key} long, {key} long, distance double")
    shared = spark.sparkContext.broadcast(sent[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = shared.value
        for batch in batches:
            places, x = _rows_of(batch.column(1), rows.shape[1])
            if not len(places):
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)[places]
            for at in range(0, len(rows), 256):
                of, near, exact = best_rows(rows[at : at + 256], own, x, k)
                keep = np.ones(len(exact), bool) if within is None else exact <= within
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + of][keep]), pa.array(own[near][keep]), pa.array(exact[keep])], ["q", "v", "distance"])

    found = vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(run, "q long, v long, distance double")
    order = Window.partitionBy("q").orderBy("distance", "v")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select(F.col("q").alias(query_key), F.col("v").alias(key), "distance")


def _rows_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a column's vectors of a dimension, and these as a matrix."""
    lists = column.to_pylist()
    keep = [i for i, e in enumerate(lists) if e is not None and len(e) == size]
    return np.array(keep, np.int64), np.array([lists[i] for i in keep], np.float64).reshape(len(keep), size)


def _in_chunks(rows: DataFrame, chosen: np.ndarray, within: float, size: int, block_rows: int) -> tuple[DataFrame, int]:
    """id, embedding, cell, chunk, i, j of finite rows: what chunks i and j of a cell hold is to be compared; and how many such pairs there are."""
    pivots = rows.sparkSession.sparkContext.broadcast(chosen)
    kind = dict(rows.dtypes)["embedding"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            x = matrix(batch.column(1), size)
            for at in range(0, len(x), 512):
                far = distances(x[at : at + 512], p)
                own = far.argmin(axis=1)
                slack = 2 * within + 1e-6 * (1 + far.max(axis=1))
                who, cell = np.nonzero((far <= (far[np.arange(len(own)), own] + slack)[:, None]) & (np.arange(len(p))[None, :] <= own[:, None]))
                place = pa.array(at + who)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(cell.astype(np.int32)), pa.array(cell == own[who])], ["id", "embedding", "cell", "home"])

    met = rows.mapInArrow(visit, f"id long, embedding {kind}, cell int, home boolean")
    # chunks of a cell's own rows and of its visitors, at most PIVOTS rows
    counts = met.groupBy("cell").agg(F.ceil(F.count_if("home") / block_rows).cast("int").alias("h"), F.ceil(F.count_if(~F.col("home")) / block_rows).cast("int").alias("v"))
    cells = stored(counts.filter("h > 0"), "cells")
    total = cells.agg(F.sum((F.col("h") * (F.col("h") + 1) / 2).cast("long") + F.col("h") * F.col("v"))).first()[0] or 0
    # own chunks meet those from their own on, then all of visitors; a visitors' chunk meets every own one
    ranged = lambda lo, hi: F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    h, v, zero = F.col("h"), F.col("v"), F.lit(0)
    own = F.pmod(F.xxhash64("id"), h).cast("int")
    guest = h + F.pmod(F.xxhash64("id"), F.greatest(v, F.lit(1))).cast("int")
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    inside = F.transform(ranged(zero, h + v), lambda j: pair(F.least(F.col("chunk"), j), F.greatest(F.col("chunk"), j)))
    outside = F.transform(ranged(zero, h), lambda j: pair(j, F.col("chunk")))
    dealt = met.join(F.broadcast(cells), "cell").withColumn("chunk", F.when(F.col("home"), own).otherwise(guest))
    dealt = dealt.withColumn("pair", F.explode(F.when(F.col("home"), inside).otherwise(outside))).select("id", "embedding", "cell", "chunk", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
    return dealt, total


def similar_pairs(vectors: DataFrame, within: float, key: str = "vec_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a < b and distance of all pairs at most within apart.

    Rows belong to the nearest of a bounded number of pivots. By the triangle inequality
    a row with a partner at another pivot is at most 2 * within farther from that pivot
    than from its own; so it visits, of the pivots before its own, only those, and every
    pair meets once. A pivot's own rows are dealt to chunks of about block_rows, its visitors to others; each pair
    of chunks is a task, but for two of visitors: none holds more, however many rows are alike, and what meets nobody new isn't compared.
    Where distances say little, as in many dimensions, all pairs are compared once, in as many tasks. Null vectors have no partners;
    vectors of another dimension than most aren't compared, one with a component that isn't finite has no partners.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), "embedding").filter(F.col("embedding").isNotNull())
    size, n = most_common_size(rows)
    if not size:
        return spark.createDataFrame([], "a long, b long, distance double")
    rows = finite(rows, size)
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, 1 + n // block_rows)).select("embedding").collect()  # at most PIVOTS
    if not chosen:
        return spark.createDataFrame([], "a long, b long, distance double")
    dealt, total = _in_chunks(rows, np.unique(np.array([r["embedding"] for r in chosen], np.float64), axis=0), within, size, block_rows)

    def run(table: pa.Table) -> pa.Table:
        ids, x, chunk = np.array(table.column("id")), matrix(table.column("embedding"), size), np.array(table.column("chunk"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        lo, hi = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        y, a, b, d = x[hi], [], [], []
        length = (y**2).sum(axis=1)
        for at in range(0, len(lo), 256):
            some = lo[at : at + 256]
            rough = x[some] @ y.T
            rough *= -2
            rough += length
            bound = within * within + 1e-6 - (x[some] ** 2).sum(axis=1)
            r, c = np.nonzero(rough <= bound[:, None])
            left, right = some[r], hi[c]
            exact = np.sqrt(((x[left] - x[right]) ** 2).sum(axis=1))
            keep = (exact <= within) & ((ids[left] < ids[right]) if i == j else (ids[left] != ids[right]))
            a.append(np.minimum(ids[left], ids[right])[keep])
            b.append(np.maximum(ids[left], ids[right])[keep])
            d.append(exact[keep])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"a": join(a, np.int64), "b": join(b, np.int64), "distance": join(d, np.float64)})

    return dealt.repartition(tasks(spark, total, 4), "cell", "i", "j").groupBy("cell", "i", "j").applyInArrow(run, "a long, b long, distance double")


def mean_vectors(vectors: DataFrame, group: str, weight: Column | None = None) -> DataFrame:
    """group, embedding: the weighted mean of each group's vectors at length 1."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    cells = vectors.select(group, w.alias("w"), F.posexplode("embedding").alias("place", "x"))
    means = cells.groupBy(group, "place").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    whole = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda s: s["m"]).alias("embedding"))
    return whole.select(group, vector.unit(F.col("embedding")).alias("embedding"))


def assign_to_centroids(faces: DataFrame, centroids: DataFrame, within: float | None = 0.75, key: str = "vec_id") -> DataFrame:
    """key, entity_id, distance of the faces whose nearest centroid, left as it is, lies within reach.

    Up to SENT centroids are broadcast in blocks and each face keeps its best in its own task:
    faces are neither shuffled nor collected. HELD_BLOCKS blocks are searched in one
    pass over the faces; a larger set takes further passes, which hand the best on. More centroids are
    joined by pivots. Of equally near centroids the least id is taken. Null vectors, and those of another dimension, have none.
    """
    spark = faces.sparkSession
    sent = _blocks(centroids.filter(F.col("embedding").isNotNull()), "entity_id", SENT)
    if sent is None:
        return knn_by_pivots(centroids, faces, 1, within, "entity_id", key).select(key, "entity_id", "distance")
    best = faces.select(F.col(key).cast("long").alias(key), "embedding", F.lit(None).cast("long").alias("entity_id"), F.lit(None).cast("double").alias("distance"))
    kind = dict(best.dtypes)["embedding"]
    held: list = []

    def searched(rows: DataFrame, blocks: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                entity = batch.column(2).to_pylist()
                distance = np.array([np.inf if d is None else d for d in batch.column(3).to_pylist()])
                for block in blocks:
                    ids, c = block.value
                    places, x = _rows_of(batch.column(1), c.shape[1])
                    squares = (c**2).sum(axis=1)
                    for at in range(0, len(x), 256):
                        some = x[at : at + 256]
                        length = (some**2).sum(axis=1)
                        rough = length[:, None] - 2 * some @ c.T + squares[None, :]
                        # all centroids up to the least rough distance, and what rounding may have put beyond it
                        margin = ROUNDING * (length + squares.max())
                        of, near = np.nonzero(~(rough > (rough.min(axis=1) + margin)[:, None]))
                        step = max(1, (1 << 22) // c.shape[1])
                        exact = np.concatenate([np.sqrt(((some[of[i : i + step]] - c[near[i : i + step]]) ** 2).sum(axis=1)) for i in range(0, len(of), step)])
                        order = np.lexsort((ids[near], exact, of))
                        first = order[np.searchsorted(of[order], np.arange(len(some)))]
                        for i, e, d in zip(places[at : at + 256].tolist(), ids[near[first]].tolist(), exact[first].tolist(), strict=True):
                            if entity[i] is None or (d, e) < (distance[i], entity[i]):
                                entity[i], distance[i] = e, d
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entity, pa.int64()), pa.array(distance, mask=np.isinf(distance))], [key, "embedding", "entity_id", "distance"])

        return rows.mapInArrow(run, f"{key} long, embedding {kind}, entity_id long, distance double")

    for block in sent:
        held.append(spark.sparkContext.broadcast(block))
        if len(held) == HELD_BLOCKS:
            best, held = searched(best, held), []
    if held:
        best = searched(best, held)
    found = best.filter(F.col("entity_id").isNotNull()).select(key, "entity_id", "distance")
    return found if within is None else found.filter(F.col("distance") <= within)


class Centroids:
    """Vectors by entity, in the order in which they came."""

    def __init__(self, start: list[tuple[int, list[float]]]):
        self.ids = [i for i, _ in start]
        self.rows = np.array([v for _, v in start], np.float64) if start else np.empty((0, 0))
        self.next = max(self.ids, default=0) + 1

    def nearest(self, v: np.ndarray) -> tuple[int, float]:
        """Place and distance of the nearest centroid, -1 where there is none."""
        if not self.ids:
            return -1, np.inf
        d = np.sqrt(((self.rows[: len(self.ids)] - v) ** 2).sum(axis=1))
        return int(d.argmin()), float(d.min())

    def move(self, place: int, v: np.ndarray, alpha: float) -> None:
        moved = (1 - alpha) * self.rows[place] + alpha * v
        length = np.sqrt((moved**2).sum())
        self.rows[place] = moved / length if length > 0 else moved

    def open(self, v: np.ndarray) -> int:
        n = len(self.ids)
        if n == len(self.rows):
            grown = np.empty((max(16, 2 * n), len(v)))
            grown[:n] = self.rows.reshape(n, len(v))
            self.rows = grown
        self.rows[n] = v
        self.ids.append(self.next)
        self.next += 1
        return self.ids[-1]


#: The score from which a face isn't blurry, and a face's part in its centroid.
SHARP, ALPHA = 0.5, 0.1


def lead(rows: list[tuple], start: list[tuple] = (), near: float = 0.6, blurry: float = 0.75, sharp: float = SHARP, alpha: float = ALPHA, first: int = 1) -> tuple[list[tuple], list[tuple]]:
    """Online leader clustering of (id, vector, score) in order: [(id, entity or None, distance or None)] and the centroids after it.

    A face joins its nearest centroid if that is near enough (blurry faces, of a score
    below sharp, may be farther away), and draws the centroid along; else it opens an
    entity, unless it is blurry. start: (entity, vector) known before; new entities get
    the numbers after them, from first on. Null vectors, those of another dimension and those with a component that isn't finite stay without entity.
    """
    size = len(start[0][1]) if start else next((len(v) for _, v, _ in rows if v is not None), 0)
    known = Centroids([s for s in start if s[1] is not None and len(s[1]) == size and np.isfinite(np.asarray(s[1], np.float64)).all()])
    known.next = max(known.next, first)
    out = []
    for i, v, score in rows:
        if v is None or len(v) != size or not np.isfinite(np.asarray(v, np.float64)).all():
            out.append((i, None, None))
            continue
        v = np.asarray(v, np.float64)
        place, distance = known.nearest(v)
        if distance <= (blurry if score < sharp else near):
            known.move(place, v, alpha)
            out.append((i, known.ids[place], distance))
        elif score < sharp:
            out.append((i, None, None))
        else:
            out.append((i, known.open(v), 0.0))
    return out, [(e, known.rows[k].tolist()) for k, e in enumerate(known.ids)]


def _lead_apart(rows: DataFrame, known: DataFrame, key: str, near: float, blurry: float, first: int, most: int) -> DataFrame:
    """cluster_step of one scope, in rounds of many tasks; rows as cluster_step has them."""
    spark = rows.sparkSession
    own = known.filter(F.col("embedding").isNotNull())
    like = own.orderBy("entity_id").select(F.size("embedding")).first() or rows.filter(F.col("embedding").isNotNull()).orderBy("_order", "_key").select(F.size("embedding")).first()
    size = like[0] if like else 0
    start, fine = finite(own, size), finite(rows, size)
    base = 1 + (start.agg(F.max("entity_id")).first()[0] or 0)
    scope = rows.select("_scope").first()[0]
    sharp = F.coalesce("score", F.lit(1.0)) >= SHARP
    numbered = ranked(fine.select("_key", "_order", F.col("embedding").cast("array<double>").alias("embedding"), F.when(sharp, near).otherwise(blurry).cast("double").alias("reach"), sharp.alias("opens")), "_order", "_key")
    faces = numbered.select((F.col("nth") + base).alias("id"), F.col("_key").alias("key"), "embedding", "reach", "opens", F.lit(1.0).alias("w"))
    found, after = in_rounds(faces, start.select(F.col("entity_id").alias("id"), "embedding", F.lit(1.0).alias("w")), size, Rule(True, ALPHA), most)
    opened = ranked(after.filter(F.col("id") >= base).select("id"), "id").select(F.col("id").alias("entity"), (F.col("nth") + max(base, first)).alias("name"))
    led = named(found, opened).select(F.col("key").alias(key), F.coalesce("name", "entity").alias("entity_id"), "distance", F.lit(None).cast("array<float>").alias("embedding"))
    centroids = after.join(opened, after["id"] == opened["entity"], "left").select(F.lit(None).cast("long").alias(key), F.coalesce("name", "id").alias("entity_id"), F.lit(None).cast("double").alias("distance"), F.col("embedding").cast("array<float>").alias("embedding"))
    odd = rows.filter(~is_finite(size)).select(F.col("_key").alias(key), F.lit(None).cast("long").alias("entity_id"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("array<float>").alias("embedding"))
    return led.unionByName(centroids).unionByName(odd).select(F.lit(scope).cast("long").alias("scope"), "*")


def cluster_step(faces: DataFrame, centroids: DataFrame | None = None, key: str = "vec_id", order: str | None = None, scope: str | None = None, near: float = 0.6, blurry: float = 0.75, first: int = 1, most: int = MOST) -> DataFrame:
    """scope, key, entity_id, distance of faces by leader clustering in the order of a column, and rows of a null key with the embedding of each centroid after it.

    centroids (entity_id, embedding and scope): those of earlier steps; without them
    clustering starts anew. Each value of scope (an owner, a library) is a sequence of
    its own with its own numbers; without scope the whole table is one. Sequences of at most most faces (and four times
    as many centroids) are gone through by a task each, beside each other; a longer one is led in rounds over
    many tasks, with the same result. Null vectors, and those of another dimension or with a component that isn't finite, have no entity.
    """
    spark = faces.sparkSession
    of = F.lit(0).cast("long") if scope is None else F.col(scope).cast("long")
    score = F.col("score").cast("double") if "score" in faces.columns else F.lit(1.0)
    rows = faces.select(of.alias("_scope"), F.col(key).cast("long").alias("_key"), F.col(order or key).cast("long").alias("_order"), score.alias("score"), "embedding")
    if centroids is None:
        known = spark.createDataFrame([], "_scope long, entity_id long, embedding array<float>")
    else:
        known = centroids.select(of.alias("_scope"), F.col("entity_id").cast("long").alias("entity_id"), "embedding")

    def run(table: pa.Table, before: pa.Table) -> pa.Table:
        start = sorted((r["entity_id"], r["embedding"]) for r in before.to_pylist() if r["embedding"] is not None)
        ordered = sorted(table.to_pylist(), key=lambda r: (r["_order"] is not None, r["_order"] or 0, r["_key"] is not None, r["_key"] or 0))
        own = (table if table.num_rows else before).column("_scope")[0].as_py()
        found, after = lead([(r["_key"], r["embedding"], 1.0 if r["score"] is None else r["score"]) for r in ordered], start, near, blurry, first=first)
        # floats of 32 bits are what tables of vectors hold
        return pa.table({
            "scope": pa.array([own] * (len(found) + len(after)), pa.int64()),
            key: pa.array([f[0] for f in found] + [None] * len(after), pa.int64()),
            "entity_id": pa.array([f[1] for f in found] + [a[0] for a in after], pa.int64()),
            "distance": pa.array([f[2] for f in found] + [None] * len(after), pa.float64()),
            "embedding": pa.array([None] * len(found) + [a[1] for a in after], pa.list_(pa.float32())),
        })

    counts = rows.groupBy("_scope").agg(F.count("*").alias("n")).join(known.groupBy("_scope").agg(F.count("*").alias("c")), "_scope", "left")
    # as many at most as faces make sequences of more than most
    long = [r["_scope"] for r in counts.filter((F.col("n") > most) | (F.col("c") > ENTITIES * most)).select("_scope").collect()]
    of_long = lambda s: F.col("_scope").eqNullSafe(F.lit(s).cast("long"))
    apart = [_lead_apart(rows.filter(of_long(s)), known.filter(of_long(s)), key, near, blurry, first, most) for s in long]
    for s in long:
        rows, known = rows.filter(~of_long(s)), known.filter(~of_long(s))
    whole = rows.groupBy("_scope").cogroup(known.groupBy("_scope")).applyInArrow(run, f"scope long, {key} long, entity_id long, distance double, embedding array<float>")
    for more in apart:
        whole = whole.unionByName(more)
    return whole


def cluster_online(faces: DataFrame, key: str = "vec_id", order: str | None = None, scope: str | None = None, near: float = 0.6, blurry: float = 0.75, centroids: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """scope, key, entity_id, distance of the faces of cluster_step."""
    return cluster_step(faces, centroids, key, order, scope, near, blurry, most=most).filter(F.col("embedding").isNull()).drop("embedding")


def absorb(rows: list[tuple], within: float = 1.0) -> list[tuple]:
    """(merged id, keeper id) of absorbed()."""
    return absorbed(rows, within)[0]


def absorbed(rows: list[tuple], within: float = 1.0) -> tuple[list[tuple], list[tuple]]:
    """Greedy merging of (id, vector, weight): [(merged id, keeper id)] and what is left, (id, vector, weight), heavier entities first.

    A keeper takes the weighted mean of both at once, so what it absorbs next may differ.
    Null vectors, and those of another dimension, aren't merged.
    """
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    out, left = [], []
    for size in sorted({len(r[1]) for r in rows if r[1] is not None}):
        own = [r for r in rows if r[1] is not None and len(r[1]) == size]
        n, nothing = len(own), (np.empty(0, np.int64), np.empty((0, size)), np.empty(0))
        # going down, each is absorbed by the first keeper within reach, or becomes one
        keeper, _, after = replay(np.arange(n), np.array([r[1] for r in own], np.float64), np.full(n, within), np.ones(n, bool), np.array([max(r[2], 1) for r in own], np.float64), nothing, Rule(False))
        out += [(own[j][0], own[i][0]) for i, j in sorted((i, j) for j, i in enumerate(keeper) if i != j)]
        left += [(own[i][0], v, int(w)) for i, v, w, _ in after]
    return out, left


def _merge_apart(rows: DataFrame, within: float, most: int) -> DataFrame:
    """merge_step of one scope, in rounds of many tasks: going down by weight, an entity is absorbed by the first keeper within reach, or becomes one."""
    parts = []
    for size in [r[0] for r in rows.select(F.size("embedding")).distinct().collect()]:  # dimensions of models, a few
        fine = finite(rows, size)
        ordered = fine.select("entity_id", F.col("embedding").cast("array<double>").alias("embedding"), (-F.coalesce("sample_count", F.lit(0))).alias("_light"))
        numbered = ranked(ordered, "_light", "entity_id").select(F.col("nth").alias("id"), F.col("entity_id").alias("key"), "embedding", F.lit(float(within)).alias("reach"), F.lit(True).alias("opens"), F.greatest(-F.col("_light"), F.lit(1)).cast("double").alias("w"))
        found, after = in_rounds(numbered, None, size, Rule(False), most)
        keepers = stored(after.join(numbered.select("id", F.col("key").alias("name")), "id"), "keepers")
        gone = named(found.filter("entity != id"), keepers.select(F.col("id").alias("entity"), "name"))
        parts.append(gone.select(F.col("key").alias("entity_id"), F.col("name").alias("keeper_id"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("long").alias("sample_count")))
        parts.append(keepers.select(F.col("name").alias("entity_id"), F.lit(None).cast("long").alias("keeper_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("w").cast("long").alias("sample_count")))
        odd = rows.filter((F.size("embedding") == size) & ~is_finite(size))
        parts.append(odd.select("entity_id", F.lit(None).cast("long").alias("keeper_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.greatest(F.coalesce("sample_count", F.lit(0)), F.lit(1)).cast("long").alias("sample_count")))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def merge_step(centroids: DataFrame, within: float = 1.0, scope: str | None = None, most: int = MOST) -> DataFrame:
    """entity_id, keeper_id, embedding, sample_count over centroids (entity_id, embedding, sample_count), greedily by sample_count.

    A merged entity has its keeper; one that is left has none, and its centroid and weight with all that it absorbed.
    Scopes of at most four times most entities are merged by a task each, larger ones in rounds over many tasks, with the same
    result. Null vectors have no row, those of another dimension meet their like, and one with a component that isn't finite is left as it is.
    """
    rows = centroids.select((F.lit(0).cast("long") if scope is None else F.col(scope).cast("long")).alias("_scope"), F.col("entity_id").cast("long"), "embedding", F.col("sample_count").cast("long")).filter(F.col("embedding").isNotNull())

    def run(table: pa.Table) -> pa.Table:
        found, left = absorbed([(r["entity_id"], r["embedding"], r["sample_count"] or 0) for r in table.to_pylist()], within)
        return pa.table({
            "entity_id": pa.array([a for a, _ in found] + [x[0] for x in left], pa.int64()),
            "keeper_id": pa.array([b for _, b in found] + [None] * len(left), pa.int64()),
            "embedding": pa.array([None] * len(found) + [x[1] for x in left], pa.list_(pa.float32())),
            "sample_count": pa.array([None] * len(found) + [x[2] for x in left], pa.int64()),
        })

    # as many at most as entities make scopes of more than most
    long = [r["_scope"] for r in rows.groupBy("_scope").agg(F.count("*").alias("n")).filter(F.col("n") > ENTITIES * most).select("_scope").collect()]
    of_long = lambda s: F.col("_scope").eqNullSafe(F.lit(s).cast("long"))
    apart = [_merge_apart(rows.filter(of_long(s)), within, most) for s in long]
    for s in long:
        rows = rows.filter(~of_long(s))
    whole = rows.groupBy("_scope").applyInArrow(run, "entity_id long, keeper_id long, embedding array<float>, sample_count long")
    for more in apart:
        whole = whole.unionByName(more)
    return whole


def merge_entities(centroids: DataFrame, within: float = 1.0, scope: str | None = None, most: int = MOST) -> DataFrame:
    """merged_id, keeper_id of merge_step."""
    return merge_step(centroids, within, scope, most).filter(F.col("keeper_id").isNotNull()).select(F.col("entity_id").alias("merged_id"), "keeper_id")


def remap(rows: DataFrame, merges: DataFrame, column: str = "entity_id") -> DataFrame:
    """rows with merged entities replaced by their keepers."""
    joined = rows.join(merges, rows[column] == merges["merged_id"], "left")
    return joined.select(*[F.coalesce("keeper_id", column).alias(column) if c == column else c for c in rows.columns])
