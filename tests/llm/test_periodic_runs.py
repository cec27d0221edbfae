"""Periodic runs against plain search, with true hashes and with useless ones."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from facetgraph.llm import periodic_runs, queries


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randrange(0, 110), rng.choice([1, 2, 3, 25])
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 30 and rng.random() < 0.6:
            s, p = rng.randrange(n - 20), rng.randrange(1, 10)
            for i in range(s + p, rng.randrange(s + 19, n)):
                words[i] = words[i - p]
        yield words


@pytest.mark.parametrize("hashes", ["true", "useless"])
def test_runs_are_those_of_a_plain_search(monkeypatch, hashes):
    if hashes == "useless":
        monkeypatch.setattr(periodic_runs, "mixed", lambda x: np.zeros(len(x), np.uint64))
    for k, words in enumerate(sequences(5, 250)):
        for least in (12, 2):
            assert periodic_runs.runs(np.array(words, np.int64), least, block=(1, 40, 1 << 18)[k % 3]) == plain_runs(words, least), words


def text_of(words):
    return " \t".join(f"w{w}é" for w in words)


def test_op11(spark, tmp_path):
    texts = [text_of(w) for w in sequences(6, 120)] + [None, "", " \n\t", "a", "x " * 4000, "é\x1cé \x85 é\xa0é"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "b " * 20)]
    spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, runs string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {}
    for r in queries.queries()["op11_periodic_runs"](spark, f"file://{tmp_path}").collect():
        found.setdefault(r.doc_id, []).append(r)
    assert len(found[7]) == 2 and found[7][0] == found[7][1] and sum(map(len, found.values())) == len(docs)
    planted = 0
    for i, t in docs:
        words = (t or "").encode().split()
        n = len(words)
        if i is not None and n:
            h = zlib.crc32(str(i).encode())
            if h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
                planted += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        drop = {k for s, length, p in runs for k in range(s + p, s + length)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
        r = found[i][0]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert planted > 5


def test_empty_table_and_long_text(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    words = [f"w{i * i % 9973}" for i in range(120_000)]
    words[50_000:90_000] = words[50_000:60_000] * 4
    found = periodic_runs.find_runs(spark.createDataFrame([("a", " ".join(words))], "doc_id string, text string")).first()
    assert (50_000, 10_000) in {(r.start, r.period) for r in found.runs} and len(found.collapsed.split(" ")) < 100_000
