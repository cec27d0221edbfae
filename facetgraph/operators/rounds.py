"""Step-by-step clustering of ordered rows in many tasks, by speculative rounds.

Row by row, a row joins an entity within its reach and draws it along, or opens one. Each step depends on all before
it, yet only on those nearby: an entity that stays within a margin of where it was can only meet rows within
reach and margin of that place. So rows and entities that may meet are linked, each linked group is gone through in
order by one task, groups beside each other, and then it is checked how far each entity really went.
Where one left its margin, its margin grows and the round is repeated; else the round is what the sequence gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored
from .components import components
from .pivots import SLACK, choose, distances, matrix

#: Rows that one task goes through, and times as many entities that it holds.
MOST, ENTITIES = 4096, 4
#: Times that a row may travel to meet others in a round, on average, and tasks' worth of rows in a round at most.
TRAVEL, WIDTH = 64, 32
#: Rows in a round at most where tasks are small; own rows of a cell in which rows meet.
ROUND_ROWS, MEET = 1 << 16, 8192
#: Links that one task joins to groups; more are joined by shuffles.
LINKS = 1 << 20
#: Parts into which a lookup of entities is salted, as one may have a third of all rows.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """How a row picks among the entities within its reach, and how it draws the one along."""

    #: The nearest one, or the first in order.
    nearest: bool
    #: The row's part of the moving average; without it the mean by weight.
    alpha: float | None = None

    def moved(self, c: np.ndarray, w: float, v: np.ndarray, own: float) -> np.ndarray:
        new = (c * w + v * own) / (w + own) if self.alpha is None else (1 - self.alpha) * c + self.alpha * v
        length = np.sqrt((new**2).sum())
        return new / length if length > 0 else new


def replay(ids: np.ndarray, x: np.ndarray, reach: np.ndarray, opens: np.ndarray, w: np.ndarray, start: tuple[np.ndarray, np.ndarray, np.ndarray], rule: Rule) -> tuple[list, list, list[tuple]]:
    """Entity and distance of each row in the order of ids, and (entity, vector, weight, drift) of entities that moved or opened.

    start: numbers, vectors and weights of entities before, by number. A row that opens one gives it its own id.
    """
    n, size = len(start[0]), x.shape[1]
    known, weights, names = np.concatenate([start[1].reshape(n, size), np.empty((len(ids), size))]), [*start[2].tolist()], [*start[0].tolist()]
    origin, drift, touched = known.copy(), [0.0] * n, set()
    entity, distance = [None] * len(ids), [None] * len(ids)
    for i in np.argsort(ids, kind="stable").tolist():
        v, at = x[i], -1
        if n:
            d = np.sqrt(((known[:n] - v) ** 2).sum(axis=1))
            at = int(d.argmin() if rule.nearest else (d <= reach[i]).argmax())
            at = at if d[at] <= reach[i] else -1
        if at >= 0:
            entity[i], distance[i] = names[at], float(d[at])
            known[at] = rule.moved(known[at], weights[at], v, float(w[i]))
            weights[at] += float(w[i])
            drift[at] = max(drift[at], float(np.sqrt(((known[at] - origin[at]) ** 2).sum())))
            touched.add(at)
        elif opens[i]:
            known[n] = origin[n] = v
            names.append(int(ids[i]))
            weights.append(float(w[i]))
            drift.append(0.0)
            touched.add(n)
            entity[i], distance[i] = names[n], 0.0
            n += 1
    return entity, distance, [(names[k], known[k].tolist(), weights[k], drift[k]) for k in sorted(touched)]


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with nth, their number from 0 in this order; written, so that ranges of nth are read alone."""
    own = stored(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "sorted")
    counts, before, told = own.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("i")).orderBy("_p").collect(), 0, []  # a row for each part
    for r in counts:
        told.append((r["_p"], before - r["i"]))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(told, "_p int, _offset long")
    found = stored(own.join(F.broadcast(offsets), "_p").withColumn("nth", F.col("_i") + F.col("_offset")).drop("_p", "_i", "_offset").sortWithinPartitions("nth"), "ranked")
    discard(own)
    return found


def _least(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least of n nodes that each reaches over links between left and right."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, left, label[right])
        np.minimum.at(least, right, label[left])
        np.minimum.at(least, label, least)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _links(table: pa.Table, size: int) -> pa.Table:
    """Links between the own nodes and the visitors of a part of a cell that may meet, each to one node of its group there."""
    node, face, home = (np.array(table.column(c)) for c in ("id", "face", "home"))
    r, m, x = np.array(table.column("reach")), np.array(table.column("margin")), matrix(table.column("embedding"), size)
    ids, place = np.unique(node, return_inverse=True)  # an own row may be among the visitors, too
    label, own, guests = np.arange(len(ids)), np.flatnonzero(home), np.flatnonzero(~home)
    for at in range(0, len(guests) if len(own) else 0, 256):
        some = guests[at : at + 256]
        reach = np.maximum(r[some, None] + m[None, own], m[some, None] + r[None, own]) + SLACK
        near = (distances(x[some], x[own]) <= reach) & (face[some, None] | face[None, own])
        guest, host = np.nonzero(near)
        a, b = label[place[some[guest]]], label[place[own[host]]]
        if (a != b).any():
            met, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            merged = np.arange(len(ids))
            merged[met] = met[_least(ends[: len(a)], ends[len(a) :], len(met))]
            label = merged[label]
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table({"a": ids[linked], "b": ids[label[linked]]})


def _joined(table: pa.Table) -> pa.Table:
    """node, root of a bounded number of links, root being the least node."""
    a, b = np.array(table.column("a")), np.array(table.column("b"))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    return pa.table({"node": nodes, "root": nodes[_least(place[: len(a)], place[len(a) :], len(nodes))]})


def _met(nodes: DataFrame, size: int, n: int, most: int) -> DataFrame | None:
    """nodes with cell, part, share and home: all that may meet do so in one (cell, part, share); None where they would have to travel too often.

    What meets is compared, not gone through, so cells and parts have MEET rows even where a task goes through fewer. A cell's own nodes are dealt to parts, its visitors, own rows among them, to shares. Rows visit all cells in which the triangle inequality
    allows a partner, entities stay at home, as they don't meet each other.
    """
    spark, most = nodes.sparkSession, max(most, MEET)
    far = nodes.agg(F.max(F.when(F.col("face"), F.col("reach"))).alias("r"), F.max("margin").alias("m")).first()
    within, shared = float(far["r"] + far["m"]), spark.sparkContext.broadcast(choose(nodes, "id", 1 + n // most))

    def visit(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value
            homes, visits = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for batch in batches:
                x, face = matrix(batch.column(1), size), np.array(batch.column(4))
                for at in range(0, len(x), 512):
                    d = distances(x[at : at + 512], p)
                    home = np.arange(len(p))[None, :] == d.argmin(axis=1)[:, None]
                    slack = 2 * within + SLACK * (1 + d.max(axis=1))
                    goes = home | ((d <= (d.min(axis=1) + slack)[:, None]) & face[at : at + 512, None])
                    homes, visits = homes + home.sum(axis=0), visits + (goes & face[at : at + 512, None]).sum(axis=0)
                    if whole:
                        who, cell = np.nonzero(goes)
                        place = pa.array(at + who)
                        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(place) for i in range(5)), pa.array(cell.astype(np.int32)), pa.array(home[who, cell])], ["id", "embedding", "reach", "margin", "face", "cell", "home"])
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p), dtype=np.int32)), pa.array(homes), pa.array(visits)], ["cell", "h", "v"])

        return run

    slim = nodes.select("id", "embedding", "reach", "margin", "face")
    counts = slim.mapInArrow(visit(False), "cell int, h long, v long").groupBy("cell").agg(F.sum("h").alias("h"), F.sum("v").alias("v")).collect()  # a row for each pivot
    dealt = [(r["cell"], -(-r["h"] // most), -(-r["v"] // (ENTITIES * most))) for r in counts if r["h"] and r["v"]]
    parts, shares = {c: k for c, k, _ in dealt}, {c: k for c, _, k in dealt}
    if sum(r["v"] * parts.get(r["cell"], 0) + r["h"] * shares.get(r["cell"], 0) for r in counts) > TRAVEL * n:
        return None
    met = slim.mapInArrow(visit(True), "id long, embedding array<double>, reach double, margin double, face boolean, cell int, home boolean")
    met = met.join(F.broadcast(spark.createDataFrame(dealt, "cell int, parts int, shares int")), "cell")
    each, mine = lambda k: F.sequence(F.lit(0), F.col(k) - 1), lambda k: F.array(F.pmod(F.xxhash64("id"), F.col(k)).cast("int"))
    own = met.filter("home").withColumn("part", F.explode(mine("parts"))).withColumn("share", F.explode(each("shares")))
    guests = met.filter("face").withColumn("share", F.explode(mine("shares"))).withColumn("part", F.explode(each("parts"))).withColumn("home", F.lit(False))
    return own.unionByName(guests).drop("parts", "shares")


def _groups(nodes: DataFrame, size: int, n: int, most: int) -> tuple[DataFrame, int] | None:
    """nodes with root, the same for all that may meet, directly or by others, and the rows of the largest group; None where too many do for one task.

    nodes: id, embedding, reach (of a row), margin (of an entity, or of one that a row may open), face (whether it is a row). Entities that no row
    may meet are left out.
    """
    met = _met(nodes, size, n, most)
    if met is None:
        return None
    links = stored(met.groupBy("cell", "part", "share").applyInArrow(lambda t: _links(t, size), "a long, b long"), "links")
    if links.count() <= LINKS:
        roots = links.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(_joined, "node long, root long")
    else:
        roots = components(links)
        roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    rooted = nodes.join(roots, nodes["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", F.when(F.col("face"), F.col("id")))).drop("node")
    rooted = stored(rooted.filter(F.col("root").isNotNull()), "rooted")
    sizes = rooted.groupBy("root").agg(F.count_if("face").alias("f"), F.count_if(~F.col("face")).alias("e")).agg(F.max("f").alias("f"), F.max("e").alias("e")).first()
    if sizes["f"] > most or sizes["e"] > ENTITIES * most:
        discard(rooted)
        return None
    return rooted, sizes["f"]


def _gone_through(nodes: DataFrame, size: int, parts: int, rule: Rule) -> DataFrame:
    """Rows (id, key, entity, distance) and entities (null id, entity, embedding, w, drift, margin) after a round over nodes with root."""

    def run(table: pa.Table) -> pa.Table:
        root, ids, face, x = np.array(table.column("root")), np.array(table.column("id")), np.array(table.column("face")), matrix(table.column("embedding"), size)
        reach, opens, w, margin = (np.array(table.column(c)) for c in ("reach", "opens", "w", "margin"))
        by_root = np.lexsort((ids, root))
        bounds = np.flatnonzero(np.append(True, root[by_root][1:] != root[by_root][:-1])).tolist()
        keys, rows, order, entity, distance, after, margins = table.column("key"), [], [], [], [], [], []
        for lo, hi in zip(bounds, [*bounds[1:], len(ids)], strict=True):
            own = by_root[lo:hi]
            f, e = own[face[own]], own[~face[own]]
            to, far, new = replay(ids[f], x[f], reach[f], opens[f], w[f], (ids[e], x[e], w[e]), rule)
            allowed = dict(zip(ids[own].tolist(), margin[own].tolist(), strict=True))
            rows += ids[f].tolist()
            order += f.tolist()
            entity += to
            distance += far
            after += new
            margins += [allowed[a[0]] for a in new]
        none = [None] * len(after)
        return pa.table({
            "id": pa.array(rows + none, pa.int64()),
            "key": pa.array([*keys.take(pa.array(order, pa.int64())).to_pylist(), *none], pa.int64()),
            "entity": pa.array(entity + [a[0] for a in after], pa.int64()),
            "distance": pa.array(distance + none, pa.float64()),
            "embedding": pa.array([None] * len(rows) + [a[1] for a in after], pa.list_(pa.float64())),
            "w": pa.array([None] * len(rows) + [a[2] for a in after], pa.float64()),
            "drift": pa.array([None] * len(rows) + [a[3] for a in after], pa.float64()),
            "margin": pa.array([None] * len(rows) + margins, pa.float64()),
        })

    dealt = nodes.withColumn("_part", F.pmod(F.xxhash64("root"), F.lit(parts)))
    return dealt.groupBy("_part").applyInArrow(run, "id long, key long, entity long, distance double, embedding array<double>, w double, drift double, margin double")


def in_rounds(rows: DataFrame, entities: DataFrame | None, size: int, rule: Rule, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(id, key, entity, distance) of rows and (id, embedding, w) of entities after them, as if row followed row by id.

    rows: id (numbers without gaps, as ranked gives them, from any number on), key, embedding (size finite doubles), reach,
    opens (whether it may open an entity), w. entities: id (all below those of rows), embedding, w. A row that opens an entity gives it its id.

    Up to WIDTH * most rows, or ROUND_ROWS, go into a round, as many as leave no linked group above most rows; a mass of rows in one place,
    whose order is all there is, takes several rounds. A task goes through about most rows, at most twice as many for
    parts that hash alike. Entities are written again by each round. Where entities left their margin, the next rounds
    begin with the one that most would have kept, unless that links too many rows.
    """
    spark = rows.sparkSession
    ends = rows.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("reach").alias("r")).first()
    schema = "id long, embedding array<double>, w double"
    entities = spark.createDataFrame([], schema) if entities is None else stored(entities.select("id", F.col("embedding").cast("array<double>"), F.col("w").cast("double")), "entities")
    found: list[DataFrame] = []
    if ends["a"] is None:
        return spark.createDataFrame([], "id long, key long, entity long, distance double"), entities
    at, end, known, first = ends["a"], ends["b"] + 1, entities.count(), ends["r"] / 8
    width, calm, largest, least, learns = 2 * most, 8, most, first, True
    while at < end:
        to, margins = min(end, at + width), None
        while True:
            faces = rows.filter((F.col("id") >= at) & (F.col("id") < to)).select("id", "key", "embedding", "reach", "opens", "w", F.lit(True).alias("face"))
            before = entities.select("id", F.lit(None).cast("long").alias("key"), "embedding", F.lit(float("-inf")).alias("reach"), F.lit(False).alias("opens"), "w", F.lit(False).alias("face"))
            # what can't open an entity needs no margin
            nodes = faces.unionByName(before).withColumn("margin", F.when(F.col("face") & ~F.col("opens"), F.lit(float("-inf"))).otherwise(F.lit(float(first))))
            if margins is not None:
                grown = margins.withColumnRenamed("margin", "_grown")
                nodes = nodes.join(grown, "id", "left").withColumn("margin", F.greatest("_grown", "margin")).drop("_grown")
            if to - at <= most and known <= ENTITIES * most:
                grouped, largest = nodes.withColumn("margin", F.lit(float("inf"))).withColumn("root", F.lit(0).cast("long")), 0
            else:
                grouped, largest = _groups(nodes, size, to - at + known, most) or (None, most)
            if grouped is None and to - at > 1:
                break
            if grouped is None:  # one row and all entities around it, however many
                grouped = nodes.withColumn("margin", F.lit(float("inf"))).withColumn("root", F.lit(0).cast("long"))
            out = stored(_gone_through(grouped, size, 1 + (to - at) // most, rule), "round")
            astray = out.filter("id IS NULL AND drift > margin").select(F.col("entity").alias("id"), (2 * F.col("drift")).alias("margin"))
            if not astray.limit(1).count():
                break
            kept = astray if margins is None else margins.join(astray, "id", "left_anti").unionByName(astray)
            margins = stored(kept, "margins")
            if learns:
                usual = out.filter("id IS NULL").agg(F.percentile_approx("drift", 0.99)).first()[0]
                first = max(first, min(1.25 * usual, 4 * least))
            discard(out)
        if grouped is None and first > least:
            first, learns = least, False
            continue
        if grouped is None:
            width, calm = max(most if to - at > most else 1, (to - at) // 8), 0
            continue
        found.append(out.filter("id IS NOT NULL").select("id", "key", "entity", "distance"))
        moved = out.filter("id IS NULL").select(F.col("entity").alias("id"), "embedding", "w")
        old, entities = entities, stored(entities.join(moved, "id", "left_anti").unionByName(moved), "entities")
        if old.inputFiles():
            discard(old)
        at, known, calm = to, entities.count(), calm + 1
        if calm > 8 and largest <= most // 4:  # room for more; where more was too crowded, 8 rounds go by before
            width = min(4 * width, max(WIDTH * most, ROUND_ROWS))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return whole, entities


def named(found: DataFrame, names: DataFrame) -> DataFrame:
    """found with name for its entity, by names (entity, name); salted, as one entity may have most rows."""
    salts = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salts, ["entity", "_salt"], "left").drop("_salt")
