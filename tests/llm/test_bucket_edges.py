"""Small buckets whose pairs fill whole runs exactly."""

import numpy as np
import pytest

from facetgraph.llm import simhash


@pytest.mark.parametrize("buckets", [99, 100, 101, 200])
def test_no_pair_of_the_last_row_is_skipped(buckets):
    rows = 10_001
    slot = np.stack([np.repeat(np.arange(buckets), rows), np.zeros(buckets * rows, np.int64)], axis=1)
    role, fp = np.ones(buckets * rows, np.int64), np.full(buckets * rows, 2**64 - 1, np.uint64)
    role[::rows] = 0
    fp[::rows] = np.arange(buckets)
    fp[rows - 1 :: rows] = np.arange(buckets)
    found = [int(x) for a, b in simhash.bucket_edges(slot, role, fp, 4) for x in a]
    assert sorted(found) == list(range(buckets))
