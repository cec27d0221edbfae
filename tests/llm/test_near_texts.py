"""Near-duplicates of the pipeline against brute force over shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from facetgraph.llm import near_texts

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], KINDS)


def five(t):
    w = (t or "").lower().split()
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    """Row places by the first of their group, all pairs compared."""
    sets, parent = [five(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a and b and len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    out = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([4, 60, 200]))]
        for _ in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    hub = [word() for _ in range(100)]
    out += [" ".join([*hub[:99], word()]) for _ in range(40)]
    return [*enumerate(out), (900, None), (901, ""), (902, out[0].upper())]


@pytest.mark.parametrize("held", [near_texts.HELD, 500])
def test_firsts_are_those_of_brute_force(spark, rows, held):
    found = {r.doc_id for r in near_texts.firsts(table(spark, rows), held=held).collect()}
    assert found == {rows[k][0] for k in groups(rows)}
    assert near_texts.firsts(table(spark, rows).limit(0)).count() == 0


def test_stage_drops_what_is_near_by_shingles_and_far_by_bits(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = list(words), list(words)
    near[10] = near[50] = "other"
    far[10] = far[50] = far[80] = "other"
    docs = table(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far[:20] + words[:2] + far[30:]))])
    assert len(five(" ".join(words)) & five(" ".join(near))) / len(five(" ".join(words)) | five(" ".join(near))) >= 0.8
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_forest_is_exact_at_the_threshold():
    sets = [np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(3, 12, dtype=np.uint64)]
    assert near_texts.forest(sets, 0.8) == [(0, 1)] and near_texts.forest(sets, 0.81) == []


def test_fingerprints_alone_bring_near_texts_together(spark, monkeypatch):
    words = [f"w{i}" for i in range(1500)]
    near = [*words[:-1], "other"]
    far = [f"v{i}" for i in range(1500)]
    sets = [near_texts.shingle_set(" ".join(x)) for x in (words, near)]
    assert 0 < bin(near_texts.fingerprint(sets[0]) ^ near_texts.fingerprint(sets[1])).count("1") <= 4
    monkeypatch.setattr(near_texts, "bands", lambda own: np.empty(0, np.int64))  # no MinHash
    docs = table(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, ""), (5, None)])
    assert {r.doc_id for r in near_texts.firsts(docs).collect()} == {1, 3, 4}
