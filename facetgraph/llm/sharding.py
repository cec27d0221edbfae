"""Sharding by vector bin packing.

Groups of equal texts are placed on shards so that bytes, tokens and rows are balanced
together: what is placed goes where the dot product of its size vector with the shard's
residual capacity is highest, largest first.

One rule holds at every size. Groups are classed by their size vector, each component to
within a factor of the square root of two, so the groups of a class are as good as equal to
the placement. A class is dealt into cells by the groups' hash, as many cells as it holds
1 / CELLS parts of any dimension; a cell, whole groups of nearly one size, is placed by its exact size
vector. So small tables have about a group in each cell, large ones many, and what is placed
one after another has a bound: 3 * CELLS cells and one for each class, of which there are at
most a few thousand (half octaves of bytes, of tokens, of rows).

A group that holds more than a shard of a dimension can't be placed whole without
spoiling the balance: it is cut by row into units of at most an eighth of a shard.

Only sizes by class and by cell reach the driver; slots are counted out in pieces of about PIECE rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, shared_dir, stored, whole_text

CELLS = 4096
#: Rows of a cell that get their slots in one task, about; fewer where the tasks outnumber such pieces.
PIECE = 100_000
DIMS = ("size", "tokens", "one")


def rough_tokens(text: Column) -> Column:
    """Blank-separated pieces of a text; a caller may give another count."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def place(items: list[tuple[tuple, tuple[float, ...]]], n_shards: int) -> dict[tuple, int]:
    """Shard by item. items: (name, size vector); vectors are shares of the whole.

    Ties go to the lower shard; items of equal size go in the order of their names.
    """
    residual = [[1.0 / n_shards] * len(DIMS) for _ in range(n_shards)]
    chosen = {}
    for name, vector in sorted(items, key=lambda x: (-max(x[1]), x[0])):
        scores = [sum(a * b for a, b in zip(vector, room, strict=True)) for room in residual]
        best = scores.index(max(scores))
        chosen[name] = best
        residual[best] = [b - a for a, b in zip(vector, residual[best], strict=True)]
    return chosen


def size_class(*sums: Column) -> Column:
    """One number for a size vector's half octaves."""
    halves = [F.floor(2 * F.log2(F.greatest(s, F.lit(1)).cast("double"))) for s in sums]
    return ((halves[0] * 256 + halves[1]) * 256 + halves[2]).cast("long")


def pack(docs: DataFrame, n_shards: int = 8, tokens: Column | None = None, cells: int = CELLS, piece: int = PIECE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text).

    Nulls: a null text is the empty text (size 1); a null doc_id is a row like any
    other. Repeated rows are rows of one group and get slots of their own. The rows of a
    group share a shard, but for a group of more than a shard, which is cut; which
    of its rows go where depends on their order in the files. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    text = whole_text()
    light = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            (rough_tokens(text) if tokens is None else tokens).cast("long").alias("tokens"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("one", F.lit(1).cast("long")),
        "shard-rows",
    )
    sums = [F.sum(c).alias(c) for c in DIMS]
    groups = stored(light.groupBy("h").agg(*sums).withColumn("class", size_class(*map(F.col, DIMS))), "shard-groups")
    classes = groups.groupBy("class").agg(*sums).collect()  # a few thousand at most
    total = [max(1, sum(c[d] or 0 for c in classes)) for d in DIMS]
    share = lambda x: max((x[d] or 0) / t for d, t in zip(DIMS, total, strict=True))
    over = F.greatest(*[F.col(d) / F.lit(t) for d, t in zip(DIMS, total, strict=True)]) > F.lit(1 / n_shards)
    cut = {g["h"]: (g, math.ceil(share(g) * 8 * n_shards)) for g in groups.filter(over).collect()}  # fewer than 3 * n_shards
    cells_df = spark.createDataFrame([(c["class"], max(1, math.ceil(share(c) * cells))) for c in classes], "class long, cells int")
    cut_df = spark.createDataFrame([(h, units) for h, (_, units) in cut.items()], "h long, units int")
    celled = groups.join(F.broadcast(cells_df), "class").join(F.broadcast(cut_df), "h", "left")
    celled = celled.withColumn("cell", F.when(F.col("units").isNull(), F.pmod(F.xxhash64("h"), F.col("cells"))).cast("long"))
    whole = celled.filter("units IS NULL").groupBy("class", "cell").agg(*sums).collect()  # at most 3 * cells and one for each class
    items = {("cell", c["class"], c["cell"]): tuple((c[d] or 0) / t for d, t in zip(DIMS, total, strict=True)) for c in whole}
    rows_of = {("cell", c["class"], c["cell"]): c["one"] for c in whole}
    for h, (g, units) in cut.items():
        for unit in range(units):
            items["cut", h, unit] = tuple((g[d] or 0) / t / units for d, t in zip(DIMS, total, strict=True))
            rows_of["cut", h, unit] = g["one"] // units
    shard_of = place(list(items.items()), n_shards)
    piece = min(piece, max(1, total[2] // (4 * partitions(spark))))
    plan = [(number, name[1], name[2], name[0] == "cut", shard_of[name], 1 + rows_of[name] // piece) for number, name in enumerate(sorted(items))]
    plan_df = F.broadcast(spark.createDataFrame(plan, "item int, of long, nth long, is_cut boolean, shard int, pieces int"))

    named = celled.select("h", F.coalesce("units", F.lit(0)).alias("units"), F.when(F.col("units").isNull(), F.col("class")).otherwise(F.col("h")).alias("of"), "cell")
    rows = light.join(named, "h").withColumn("nth", F.coalesce("cell", F.pmod(F.xxhash64("row"), F.col("units"))).cast("long")).withColumn("is_cut", F.col("cell").isNull())
    rows = rows.join(plan_df, ["of", "nth", "is_cut"]).withColumn("piece", F.pmod(F.xxhash64(F.lit(1), "row"), F.col("pieces")).cast("int"))
    rows = stored(rows.select("doc_id", "size", "text_crc32", "item", "piece", "shard", "row"), "sharded-rows")
    counted = rows.groupBy("shard", "item", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("item", "piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("item", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("item", "piece").orderBy("doc_id", "text_crc32", "size", "row")
    slots = rows.join(bases, ["item", "piece"]).withColumn("slot", (F.col("base") + F.row_number().over(order) - 1).cast("long"))
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")
