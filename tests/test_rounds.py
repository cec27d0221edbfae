"""Clustering and merging in rounds over many tasks: equal, row by row, to the plain sequence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetgraph.operators import rounds, vectors


def people(seed, n, size=8, spread=0.25, persons=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(persons, size))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    x = middles[rng.integers(0, persons, n)] + spread * rng.normal(size=(n, size)) / size**0.5
    x[n // 3 : n // 2] = x[0]  # a mass of copies
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, [float(np.float32(a)) for a in v], 0.4 if i % 5 == 0 else 0.9) for i, v in enumerate(x)]


def same(found, expected):
    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=str), sorted(expected, key=str), strict=True):
        assert a[:-1] == b[:-1] and (a[-1] == b[-1] or a[-1] == pytest.approx(b[-1], abs=1e-12)), (a, b)


@pytest.mark.parametrize("most, spread", [(40, 0.25), (70, 0.9)])
def test_leading_in_rounds(spark, most, spread):
    rows = people(1, 240, spread=spread)
    odd = [(900, None, 0.9), (901, [1.0], 0.9), (902, [float("nan")] * 8, 0.9)]
    start = [(3, rows[5][1]), (7, rows[11][1]), (8, [1.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score double").repartition(3)
    known = spark.createDataFrame(start, "entity_id long, embedding array<float>")
    for before, given in ((None, []), (known, start)):
        expected, after = vectors.lead(rows + odd, given, 0.6, 0.75, first=4)
        found = vectors.cluster_step(table, before, near=0.6, blurry=0.75, first=4, most=most).collect()
        same([(r.vec_id, r.entity_id, r.distance) for r in found if r.embedding is None], expected)
        got = {r.entity_id: r.embedding for r in found if r.embedding is not None}
        assert set(got) == {e for e, _ in after} and all(got[e] == pytest.approx(v, abs=1e-6) for e, v in after)


def test_leading_by_scope(spark):
    rows = [(i, v, s, 1 if i % 4 else None) for i, v, s in people(2, 160)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, owner long")
    found = vectors.cluster_online(table, scope="owner", most=50).collect()
    for owner in (1, None):
        same([(r.vec_id, r.entity_id, r.distance) for r in found if r.scope == owner], vectors.lead([r[:3] for r in rows if r[3] == owner])[0])


def test_margins_grow_until_they_hold(spark, monkeypatch):
    grown, plain = [], rounds._groups
    monkeypatch.setattr(rounds, "_groups", lambda nodes, *rest: (grown.append(nodes.filter("face").agg(F.max("margin")).first()[0]), plain(nodes, *rest))[1])
    rng = np.random.default_rng(3)
    chain = [(k, [k * 0.3 + 0.01 * rng.random(), 0.0], 1.0) for k in range(60)]  # drawn along, an entity goes far from where it opened
    far = [(100 + k, [0.0, 100.0 + 3 * k], 1.0) for k in range(60)]
    table, rule = spark.createDataFrame(chain + far, "vec_id long, embedding array<double>, score double"), rounds.Rule(True, 0.5)
    nothing = (np.empty(0, np.int64), np.empty((0, 2)), np.empty(0))
    entity, distance, after = rounds.replay(np.arange(120), np.array([r[1] for r in chain + far]), np.full(120, 0.6), np.ones(120, bool), np.ones(120), nothing, rule)
    rows = rounds.ranked(table, "vec_id").select(F.col("nth").alias("id"), F.col("vec_id").alias("key"), "embedding", F.lit(0.6).alias("reach"), F.lit(True).alias("opens"), F.lit(1.0).alias("w"))
    found, entities = rounds.in_rounds(rows, None, 2, rule, most=70)
    got = {r.id: (r.entity, r.distance) for r in found.collect()}
    assert [got[i] for i in range(120)] == list(zip(entity, distance, strict=True))
    assert entities.count() == len(after) and len(grown) > 1 and grown[-1] > grown[0]


@pytest.mark.parametrize("most, spread", [(40, 0.25)])
def test_merging_in_rounds(spark, most, spread):
    rng = np.random.default_rng(4)
    rows = [(i, v, int(rng.integers(0, 6))) for i, v, _ in people(5, 150, spread=spread)]
    rows += [(500 + i, [1.0, float(i)], 1) for i in range(3)] + [(600, None, 5), (601, [float("nan")] * 8, 2)]
    table = spark.createDataFrame(rows, "entity_id long, embedding array<float>, sample_count long").repartition(3)
    merged, left = vectors.absorbed([(a, b, c) for a, b, c in rows if a != 601], 0.7)
    found = vectors.merge_step(table, 0.7, most=most - 10).collect()
    assert sorted((r.entity_id, r.keeper_id) for r in found if r.keeper_id is not None) == sorted(merged)
    got = {r.entity_id: r for r in found if r.keeper_id is None}
    assert set(got) == {e for e, _, _ in left} | {601}
    for e, v, w in left:
        assert got[e].embedding == pytest.approx(v, abs=1e-6) and got[e].sample_count == w
    assert vectors.merge_step(table.limit(0), 0.7).count() == 0


def test_links_beyond_one_task(spark, monkeypatch):
    rows = people(6, 120)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    monkeypatch.setattr(rounds, "LINKS", 5)
    found = vectors.cluster_online(table, most=60).collect()
    same([(r.vec_id, r.entity_id, r.distance) for r in found], vectors.lead(rows)[0])


def test_cells_hold_more_than_a_task_goes_through(spark, monkeypatch):
    rows = people(7, 200, size=32, persons=60)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    widths, plain = [], rounds._groups
    monkeypatch.setattr(rounds, "_groups", lambda nodes, size, n, most: (widths.append(nodes.filter("face").count()), plain(nodes, size, n, most))[1])
    monkeypatch.setattr(rounds, "WIDTH", 2)
    monkeypatch.setattr(rounds, "MEET", 50)  # several cells, parts and shares
    found = vectors.cluster_online(table.filter("vec_id < 66 OR vec_id >= 100"), most=40).collect()
    same([(r.vec_id, r.entity_id, r.distance) for r in found], vectors.lead([r for r in rows if r[0] < 66 or r[0] >= 100])[0])
    assert max(widths) > 80  # rounds grow beyond WIDTH tasks' worth of rows
