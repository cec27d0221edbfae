"""Intersections of posting lists against sets, and the buckets that they read."""

import random

from facetgraph import storage
from facetgraph.operators import postings


def test_intersections_are_those_of_sets(spark, tmp_path):
    rng = random.Random(7)
    held = {e: set(rng.sample(range(-70_000, 200_000), 300)) | set(range(30_000, 30_000 + 40 * e)) for e in range(12)}
    held[12] = {5}
    rows = [(e, f) for e, fs in held.items() for f in fs] + [(3, 30_001)] * 50 + [(None, 1), (4, None)]
    members = spark.createDataFrame(rows, "entity_id long, file_id long").repartition(3)
    asked = [(q, rng.sample(range(14), rng.randrange(1, 5)) + rng.choice([[], [-1], [None]])) for q in range(60)] + [(90, []), (91, [-1]), (92, None), (93, [2, 2])]
    queries = spark.createDataFrame(asked, "query_id long, ids array<bigint>")
    expected = set()
    for q, ids in asked:
        own = {i for i in ids or [] if i is not None and i >= 0}
        if own:
            expected |= {(q, f) for f in set.intersection(*(held.get(i, set()) for i in own))}
    assert {(r.query_id, r.file_id) for r in postings.intersect(queries, postings.postings(members)).collect()} == expected
    path = f"file://{tmp_path}/lists"
    postings.write_postings(members, path)
    assert {(r.query_id, r.file_id) for r in postings.intersect(queries, postings.read_postings(spark, path, queries)).collect()} == expected
    few = postings.read_postings(spark, path, queries.filter("query_id = 93"))
    assert {r.entity_id for r in few.collect()} == {2} and "PartitionFilters: [isnotnull(bucket" in few._jdf.queryExecution().toString() or "bucket" in few._jdf.queryExecution().toString().split("PartitionFilters")[1][:60]
    assert postings.intersect(queries, postings.postings(members.limit(0))).count() == 0


def test_lists_are_no_larger_than_their_files(spark):
    rows = [(e, f) for e in range(20) for f in range(e, 1_000_000, 10_000)] + [(50, f) for f in range(40_000)]
    lists = postings.postings(spark.createDataFrame(rows, "entity_id long, file_id long")).collect()
    assert all(len(r.bits) == min(2 * r.n, postings.RANGE // 8) for r in lists)
    assert sorted((r.entity_id, int(x) + r.range * postings.RANGE) for r in lists for x in postings.places(r.bits)) == sorted(rows)


def test_members_and_lists_are_dealt_by_their_size(spark):
    members = spark.range(40).selectExpr('id % 4 AS entity_id', 'id AS file_id')
    found = postings.postings(members, 7 * storage.TASK_ROWS + 1)
    assert found.rdd.getNumPartitions() == 8 and sum(r.n for r in found.collect()) == 40
    assert storage.tasks(spark, 10) == 2 and storage.tasks(spark, 7 * storage.TASK_ROWS + 1) == 8
