"""Connected components of an edge table, by alternating large and small stars.

Every round is two star operations, each a shuffle by node with map-side minima,
and is written to the shared folder: no edge or component reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them. Edges run from the larger node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b): root is the least node that it reaches.

    Roots themselves have no row. Loops and repeated edges do no harm; an edge with a
    null end is dropped; no edges give no rows. Ends may be of any ordered type.
    """
    edges = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, old = state, edges
        edges = stored(_small(_large(edges)), "edges")
        discard(old)
