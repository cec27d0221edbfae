"""Quality classifier: supervised subword embeddings.

A text's features are its words, the character n-grams of its words, and one feature
for windows of three words that it had before, hashed to rows of one embedding table. Their vectors are averaged, and a softmax layer over the
average gives the classes. Both are trained by stochastic gradient descent in numpy.

The output is linear in the average, so for scoring each feature needs one number
only: its vector times the difference of the output weights. That table is what
executors get, and its size is fixed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

BUCKETS = 1 << 17
DIM = 16
NGRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 0.6
SEED = 17
#: Labelled rows that training takes at most: those with the least hash of their id.
SAMPLE = 3000
#: Words whose features a worker keeps. More are hashed anew: speed alone depends on it.
KEPT = 500_000
#: Row of the feature for repeated windows, and how often each of them counts: about as a word's n-grams do together.
REPEATED, REPEAT_TIMES = 0, 32


def features(word: bytes) -> list[int]:
    """Rows of the embedding table for a word: itself and its n-grams, with marks at its ends."""
    marked = b"<" + word + b">"
    crc, n = zlib.crc32, len(marked)
    return [crc(marked) % BUCKETS] + [crc(marked[i : i + k], k) % BUCKETS for k in NGRAMS for i in range(n - k + 1)]


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def repeats(found: list[bytes]) -> int:
    """Windows of three words that the text had before."""
    if len(found) < 4:
        return 0
    h = np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)
    with np.errstate(over="ignore"):
        windows = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    return len(windows) - len(np.unique(windows))


@dataclass
class Model:
    """Of each feature, and by itself, the evidence for class 1."""

    evidence: np.ndarray
    bias: float

    def score(self, logit: float) -> float:
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a whole text and how often each occurs."""
    seen: dict[bytes, int] = {}
    found = words(text)
    for w in found:
        seen[w] = seen.get(w, 0) + 1
    rows, times = [], []
    for w, n in seen.items():
        own = features(w)
        rows += own
        times += [n] * len(own)
    if again := repeats(found):
        rows.append(REPEATED)
        times.append(again * REPEAT_TIMES)
    unique, place = np.unique(np.array(rows, np.int32), return_inverse=True)
    return unique, np.bincount(place, np.array(times, np.float64), len(unique)).astype(np.float32) if rows else np.empty(0, np.float32)


Example = tuple[np.ndarray, np.ndarray, int]


def train(examples: Iterable[Example], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Softmax over averaged embeddings of examples (features, times, class), one text a step, the rate falling to zero.

    Without examples the model says 0.5 of everything; with one class alone it leans
    to that class.
    """
    data = list(examples)
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(data))
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            rows, times, y = data[k]
            now = rate * (1 - step / steps)
            step += 1
            total = max(times.sum(), 1)
            mean = (times @ table[rows]) / total if len(rows) else np.zeros(DIM, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            if len(rows):
                table[rows] -= (now * times / total)[:, None] * back[None, :] * min(64.0, len(rows) ** 0.5)
    return Model((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts, keeping the summed evidence of words up to a bound."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.sums, self.sizes = np.zeros(KEPT, np.float64), np.zeros(KEPT, np.int64)

    def score(self, text: str) -> float:
        ids, evidence = self.ids, self.model.evidence
        found = words(text)
        total = repeats(found) * REPEAT_TIMES
        logit = total * float(evidence[REPEATED])
        at = list(map(ids.get, found))
        if None in at:
            for k, i in enumerate(at):
                if i is None and (i := ids.get(found[k])) is None:
                    rows = features(found[k])
                    if len(ids) == KEPT:
                        logit += float(evidence[rows].sum())
                        total += len(rows)
                        continue
                    i = ids[found[k]] = len(ids)
                    self.sums[i], self.sizes[i] = evidence[rows].sum(), len(rows)
                at[k] = i
            at = [i for i in at if i is not None]
        places = np.array(at, np.int64)
        total += int(self.sizes[places].sum())
        logit += float(self.sums[places].sum())
        return float(self.model.score(logit / max(total, 1) + self.model.bias))


def held_out(doc_id: Column) -> Column:
    """Whether a row teaches nothing: by its doc_id, and where that is null, as no label can be its own."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Train on the texts of at most sample labelled rows that aren't held out.

    Rows with a null id or label teach nothing. Of rows of documents that repeat an id the
    one of the least text hash is taken, so at most sample texts reach the driver, one at a time: their
    features are kept there, their texts aren't.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample rows of ids
    first = texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"))
    once = texts.join(F.broadcast(first), "doc_id").filter(F.xxhash64("text") == F.col("least")).dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], *text_features(r["text"]), r["y"]) for r in once.toLocalIterator()]
    return train([r[1:] for r in sorted(rows, key=lambda r: r[0])])


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (of class 1), predicted for each row of docs (doc_id, text).

    A null or empty text has no features: its score is the model's bias alone. Null
    and repeated doc_ids keep their rows; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
