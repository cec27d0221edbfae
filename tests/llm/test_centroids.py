"""Centroid clustering against plain whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from facetgraph.llm import centroids, queries


def plain_clusters(rows, count=8, rounds=10):
    """(centroids, assignment) of [(vec_id, vector)] by the rules, with Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:count]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min(range(len(c)), key=lambda k: (far(v, c[k]), k))
    for _ in range(rounds):
        found = [near(v) for _, v in kept]
        for k in range(len(c)):
            own = [v for (_, v), f in zip(kept, found, strict=True) if f == k]
            if own:
                c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return c, [(i, near(v), far(v, c[near(v)])) for i, v in kept]


def vectors(seed, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 1]) * scale * rng.random() for _ in range(64)]) for i in range(150)]
    rows += [(i, rows[i % 3][1]) for i in range(150, 220)]  # a third are copies
    rows += [(300, None), (301, [0.5] * 63), (302, [0.5] * 63 + [None]), (303, [0.5] * 63 + [float("nan")]), (304, [float("-inf")] + [0.5] * 63), (305, []), (None, rows[5][1]), (7, rows[8][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e9])
def test_op13(spark, tmp_path, scale):
    rows = vectors(3, scale)
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    table.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    found = queries.queries()["op13_centroid_clustering"](spark, f"file://{tmp_path}").collect()
    c, told = plain_clusters(rows)
    most = lambda x: min(x, 2**63 - 1)
    sums = {k: sum(most(d) for _, f, d in told if f == k) for k in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    expected = [(i, k, most(d), most(sums[k]), most(sum(sums.values())), sha[k]) for i, k, d in told]
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found))) == sorted(map(str, expected))


def test_few_vectors_and_none(spark, tmp_path):
    for k, n in enumerate((0, 1, 5)):
        rows = [(i, [float(i % 2)] * 64) for i in range(n)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        found, centers = centroids.clustered(table)
        assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == plain_clusters(rows)[1] and centers.count() == n, k


@pytest.mark.parametrize("scale", [3, 1 << 10, 1 << 20, 1 << 26, 1 << 40, 10**20])
def test_intervals_hold_and_ties_go_to_the_lowest(scale):
    rng = np.random.default_rng(6)
    whole = lambda n: np.array([[int(x) for x in row] for row in (rng.uniform(-1, 1, (n, 64)) * scale).astype(object)], object)
    c, rows = whole(9), whole(120)
    c[4], c[7] = c[1], c[1]
    for k in range(60):  # near the middle between two centroids, so single precision can't tell
        rows[k] = (c[k % 4] + c[5]) // 2 + rng.integers(-1, 2, 64)
    rows[60:70] = c[1]
    if scale < centroids.PLAIN:
        rows, c = rows.astype(np.int64), c.astype(np.int64)
    low, high = centroids.intervals(rows, c)
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, w, strict=True)) for w in c] for r in rows]
    for i, r in enumerate(rows):
        length = sum(int(x) ** 2 for x in r)
        assert all(lo <= float(d - length) * (1 + np.sign(d - length) * 1e-12) and float(d - length) * (1 - np.sign(d - length) * 1e-12) <= hi for lo, hi, d in zip(low[i], high[i], far[i], strict=True))
    assert centroids.assign(rows, c).tolist() == [min(range(9), key=lambda k: (d[k], k)) for d in far]
    if scale < 10**18:  # beyond, products leave single precision and nothing is known of them
        assert (low <= high.min(axis=1)[:, None]).sum(axis=1)[70:].mean() < 4  # elsewhere the shortlist is short
