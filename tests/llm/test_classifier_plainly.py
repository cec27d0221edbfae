"""The quality classifier against plain loops: features, steps of descent, and scores as the softmax of an average."""

import math
import random
import zlib

import numpy as np
import pytest

from facetgraph.llm import quality_classifier as qc

SIZE = 257


def plain_features(text):
    found, rows = text.split(" "), []
    found = [w for w in found if w]
    for w in found:
        marked = f"<{w}>".encode()
        rows.append(zlib.crc32(marked) % SIZE)
        rows += [zlib.crc32(marked[i : i + k], k) % SIZE for k in (3, 4, 5) for i in range(len(marked) - k + 1)]
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    rows += [0] * (32 * (len(windows) - len(set(windows))) if len(found) > 3 else 0)
    return rows


def average(table, rows):
    return [sum(table[r][d] for r in rows) / max(len(rows), 1) for d in range(qc.DIM)]


def softmax(out, bias, mean):
    z = [sum(o * m for o, m in zip(out[c], mean, strict=True)) + bias[c] for c in (0, 1)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_train(data, epochs, rate):
    """One text a step: the gradient of -log p[y] by the output, the bias (a tenth as fast) and each occurrence of a feature."""
    rng = np.random.default_rng(qc.SEED)
    table = rng.uniform(-1 / qc.DIM, 1 / qc.DIM, (SIZE, qc.DIM)).astype(np.float32).astype(float).tolist()
    out, bias, step = [[0.0] * qc.DIM, [0.0] * qc.DIM], [0.0, 0.0], 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)).tolist():
            rows, y = data[k]
            now = rate * (1 - step / (epochs * len(data)))
            step += 1
            mean = average(table, rows)
            p = softmax(out, bias, mean)
            p[y] -= 1
            back = [p[0] * out[0][d] + p[1] * out[1][d] for d in range(qc.DIM)]
            for c in (0, 1):
                out[c] = [o - now * p[c] * m for o, m in zip(out[c], mean, strict=True)]
                bias[c] -= now * 0.1 * p[c]
            scale = now / max(len(rows), 1) * min(64.0, len(set(rows)) ** 0.5)
            for r in rows:
                table[r] = [t - scale * b for t, b in zip(table[r], back, strict=True)]
    return table, out, bias


@pytest.fixture
def data(monkeypatch):
    monkeypatch.setattr(qc, "BUCKETS", SIZE)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "é", "x"], k=rng.randrange(0, 14))) for _ in range(12)] + ["", "a b c " * 6]
    return texts, [k % 2 for k in range(len(texts))]


def test_features_are_counted_as_plainly(data):
    for text in data[0]:
        rows, times = qc.text_features(text)
        plain = plain_features(text)
        assert dict(zip(rows.tolist(), times.tolist(), strict=True)) == {r: plain.count(r) for r in set(plain)}


@pytest.mark.parametrize("epochs", [1, 3])
def test_training_and_scores_are_those_of_plain_loops(data, epochs):
    texts, labels = data
    table, out, bias = plain_train([(plain_features(t), y) for t, y in zip(texts, labels, strict=True)], epochs, 0.6)
    model = qc.train([(*qc.text_features(t), y) for t, y in zip(texts, labels, strict=True)], epochs, 0.6)
    evidence = [sum(t * (b - a) for t, a, b in zip(row, out[0], out[1], strict=True)) for row in table]
    assert model.evidence.tolist() == pytest.approx(evidence, abs=2e-5) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)
    scorer = qc.Scorer(model)
    for text in [*texts, "new words, alpha", "beta " * 40]:
        assert scorer.score(text) == pytest.approx(softmax(out, bias, average(table, plain_features(text)))[1], abs=2e-5)
    assert qc.train([], 3).evidence.any() == False and qc.Scorer(qc.train([])).score("x") == 0.5  # noqa: E712
