"""Posting lists of entities: the files that hold each, by ranges of file ids.

Of a range, a list has the places of its files, two bytes each, or a bitmap where that is shorter; so it is never
larger than a few bytes a file. Lists lie in buckets of their entity, and an intersection reads those that are asked for
alone and goes through each range that all lists have, the shortest list first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored, tasks

#: Files of a range, as many as two bytes or a bitmap of 4,096 tell apart, and buckets of stored lists.
RANGE, BUCKETS = 32768, 256
#: Bytes of lists that one task intersects, about.
TASK_BYTES = 64 << 20


def packed(places: np.ndarray) -> bytes:
    """Sorted places within a range: two bytes each, or a bitmap where that is shorter."""
    if 2 * len(places) < RANGE // 8:
        return places.astype("<u2").tobytes()
    bits = np.zeros(RANGE, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def places(bits: bytes) -> np.ndarray:
    """The sorted places of a packed list."""
    if len(bits) < RANGE // 8:
        return np.frombuffer(bits, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def common(lists: list[bytes]) -> np.ndarray:
    """The places that all lists have, beginning with the shortest."""
    found: np.ndarray | None = None
    for bits in sorted(lists, key=len):
        own = places(bits)
        found = own if found is None else np.intersect1d(found, own, assume_unique=True)
        if not len(found):
            break
    return found


def postings(members: DataFrame, rows: int | None = None) -> DataFrame:
    """entity_id, range, bits, n for the files of each entity of members (entity_id, file_id); null ones have none, repeated rows count once.

    Members are dealt out by how many they are, so a task has about as many however large the table is: rows, or a bound of them, if that is known; else they are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, values = batch.column(2), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            own = [packed(x) for x in np.split(values, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary()), pa.array(np.diff(ends, prepend=0))], ["entity_id", "range", "bits", "n"])

    known = members.filter(F.col("entity_id").isNotNull() & F.col("file_id").isNotNull())
    place = known.select("entity_id", F.floor(F.col("file_id") / RANGE).alias("range"), F.pmod("file_id", F.lit(RANGE)).cast("int").alias("place"))
    dealt = place.repartition(tasks(members.sparkSession, members.count() if rows is None else rows), "entity_id", "range")
    lists = dealt.groupBy("entity_id", "range").agg(F.array_sort(F.collect_set("place")).alias("places"))
    return lists.mapInArrow(run, f"entity_id {dict(members.dtypes)['entity_id']}, range long, bits binary, n long")


def _bucket():
    return F.pmod(F.xxhash64("entity_id"), F.lit(BUCKETS)).cast("int")


def write_postings(members: DataFrame, path: str) -> None:
    """The lists of members, in buckets of their entity."""
    postings(members).withColumn("bucket", _bucket()).repartition("bucket").sortWithinPartitions("entity_id", "range").write.partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The stored lists of the entities of asked (query_id, ids); only their buckets are read."""
    own = asked.select(F.explode("ids").alias("entity_id")).filter(F.col("entity_id") >= 0).distinct()
    buckets = [r[0] for r in own.select(_bucket()).distinct().collect()]  # at most BUCKETS
    stored = spark.read.schema("entity_id long, range long, bits binary, n long, bucket int").parquet(path)
    return stored.filter(F.col("bucket").isin(buckets)).drop("bucket").join(own, "entity_id", "left_semi")


def intersect(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """query_id, file_id: the files that hold all entities of each query (query_id, ids), as relational division finds them.

    Repeated, null and negative ids of a query don't count; a query without others, or with an entity that has no file, finds nothing.
    lists is read twice, so it should be a stored table. Queries and ranges are dealt out by the bytes of the lists that they meet.
    """
    ids = F.array_distinct(F.filter("ids", lambda x: x.isNotNull() & (x >= 0)))
    wanted = asked.select("query_id", F.explode(ids).alias("entity_id"), F.size(ids).alias("of"))
    sizes = lists.groupBy("entity_id").agg(F.sum(F.length("bits")).alias("bytes"))
    sized = stored(wanted.join(sizes, "entity_id"), "asked-lists")
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    parts = tasks(asked.sparkSession, total, TASK_BYTES)
    met = lists.select("entity_id", "range", "bits").repartition(parts, "entity_id").join(sized.drop("bytes").repartition(parts, "entity_id"), "entity_id")
    met = met.select("query_id", "of", "range", "bits").repartition(parts, "query_id", "range")
    whole = met.groupBy("query_id", "of", "range").agg(F.collect_list("bits").alias("lists")).filter(F.size("lists") == F.col("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [common(x) + at * RANGE for at, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n, step = np.array([len(x) for x in found], np.int64), 64
            for i in range(0, len(found), step):  # a range has up to RANGE files
                of = pa.array(i + np.repeat(np.arange(len(n[i : i + step])), n[i : i + step]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.concatenate(found[i : i + step]))], ["query_id", "file_id"])

    return whole.select("query_id", "range", "lists").mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, file_id long")
