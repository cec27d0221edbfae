"""Benchmark decontamination by winnowing.

Every text is cut into words; a fingerprint is the hash of K adjacent words, and of
each window of WINDOW adjacent hashes the least is kept (the rightmost of equal
ones). Two texts that share K + WINDOW - 1 = 13 words in a row share such a
fingerprint, wherever the words stand. Fingerprints of the benchmark and of the
documents are joined, and each hit is extended to both sides over equal words: a
shared run of 13 words or more is covered whole.

An item of fewer than 13 words is one window by itself: the hash of all its words
is joined with the hashes of that many words in the documents.

A benchmark of up to BLOCK_BYTES is broadcast, and documents aren't shuffled. A larger one
never meets the driver: fingerprints of both sides are joined by shuffle, and the texts
of the pairs that meet are fetched for the extension. Both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

SPAN = 13
K = 7
WINDOW = SPAN - K + 1
#: Bytes of benchmark text that are broadcast at most.
BLOCK_BYTES = 16_000_000
#: Word characters: ASCII digits and letters (lowered) and all beyond ASCII.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once, and nothing is kept."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    places = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in known), np.uint64, len(known))[places]


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k adjacent words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ (out >> np.uint64(29))) * _BASE + hashes[j : j + n]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of each window, the rightmost of equal ones."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(window - 1, window - 1 + n)
    low = grams[window - 1 :].copy()
    for j in range(window - 2, -1, -1):
        less = grams[j : j + n] < low
        low[less] = grams[j : j + n][less]
        best[less] = np.flatnonzero(less) + j
    return np.unique(best)


class Block:
    """Some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items: list[object] = []
        self.hashes: list[np.ndarray] = []
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            h = word_hashes(words(text))
            if not len(h):
                continue
            i = len(self.items)
            self.items.append(item_id)
            self.hashes.append(h)
            if len(h) < SPAN:
                short[len(h)][int(gram_hashes(h, len(h))[0])].append(i)
                continue
            grams = gram_hashes(h, K)
            for at in winnow(grams):
                postings[int(grams[at])].append((i, int(at)))
        self.postings = dict(postings)
        self.keys = np.sort(np.fromiter(self.postings, np.uint64, len(self.postings)))
        self.short = [(n, dict(found), np.sort(np.fromiter(found, np.uint64, len(found)))) for n, found in sorted(short.items())]

    @staticmethod
    def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of the values that are keys."""
        if not len(keys) or not len(values):
            return np.empty(0, np.int64)
        at = np.searchsorted(keys, values)
        at[at == len(keys)] = 0
        return np.flatnonzero(keys[at] == values)

    def spans(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, start, end) over documents laid end to end; bounds are their ends, places are in the whole."""
        starts = np.append(0, bounds[:-1])
        grams = gram_hashes(hashes, K)
        chosen = winnow(grams)
        chosen = chosen[self.among(grams[chosen], self.keys)]
        done: dict[tuple[int, int], int] = {}
        for p in chosen.tolist():
            d = int(np.searchsorted(bounds, p, "right"))
            lo, hi = int(starts[d]), int(bounds[d])
            for i, q in self.postings[int(grams[p])]:
                if done.get((i, p - q), -1) > p:
                    continue
                own = self.hashes[i]
                ahead = min(hi - p, len(own) - q)
                differ = np.flatnonzero(hashes[p : p + ahead] != own[q : q + ahead])
                right = int(differ[0]) if len(differ) else ahead
                back = min(p - lo, q)
                differ = np.flatnonzero(hashes[p - back : p] != own[q - back : q])
                left = back - 1 - int(differ[-1]) if len(differ) else back
                done[i, p - q] = p + right
                if left + right >= SPAN:
                    yield d, i, p - left, p + right
        for n, found, keys in self.short:
            grams = gram_hashes(hashes, n)
            for p in self.among(grams, keys).tolist():
                d = int(np.searchsorted(bounds, p, "right"))
                if p + n <= bounds[d]:
                    for i in found[int(grams[p])]:
                        if (hashes[p : p + n] == self.hashes[i]).all():
                            yield d, i, p, p + n


def named_items(benchmark: DataFrame) -> DataFrame:
    """item (the item_id as a string, of a null one the empty string) and text of the benchmark, equal rows once."""
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), whole_text().alias("text")).distinct()


def probe(docs: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
    """doc_id and the hash of the text with n_words, n_hit and items, for one block.

    Hits are counted here and not in a step of its own: Spark keeps a Python worker for each such step of
    a task, and every worker comes to hold what any later step loads.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Block(block))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            split = [words(t) for t in batch.column(1).to_pylist()]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            bounds = np.cumsum(counts)
            hashes = word_hashes([w for s in split for w in s])
            spans: list[list[int]] = [[] for _ in split]
            items: list[set[str]] = [set() for _ in split]
            for d, i, start, end in block.spans(hashes, bounds):
                first = bounds[d] - counts[d]
                spans[d] += [int(start - first), int(end - first)]
                items[d].add(block.items[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts), pa.array([covered(s) for s in spans], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                ["doc_id", "text_hash", "n_words", "n_hit", "items"],
            )

    return docs.select("doc_id", whole_text().alias("text"), F.xxhash64(whole_text()).alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, n_words long, n_hit long, items array<string>")


def covered(spans: list[int]) -> int:
    """Words inside any of the spans, given as start, end, start, end, ..."""
    total, reach = 0, 0
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def fingerprints(rows: DataFrame, lengths: list[int], short: bool) -> DataFrame:
    """n, fp and the columns of rows but its text: a text's winnowed fingerprints (n is 0) and hashes of n words.

    Texts of a benchmark (short) of fewer than SPAN words have one hash, of all their
    words, and no other; documents have those of all runs of each of lengths.
    """
    names = [c for c in rows.columns if c != "text"]
    ordered = rows.select(*names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(len(names)).to_pylist()):
                hashes = word_hashes(words(text))
                if short and len(hashes) < SPAN:
                    found = [(len(hashes), gram_hashes(hashes, len(hashes)))] if len(hashes) else []
                else:
                    grams = gram_hashes(hashes, K)
                    found = [(0, grams[winnow(grams)]), *((n, gram_hashes(hashes, n)) for n in lengths)]
                for n, fps in found:
                    fps = np.unique(fps)
                    own = [c.take(pa.array(np.full(len(fps), row))) for c in batch.columns[: len(names)]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), n, np.int32)), pa.array(fps.view(np.int64)), *own], ["n", "fp", *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name != "text")
    return ordered.mapInArrow(run, f"n int, fp long, {kinds}")


def joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit and items for each row of docs, by a join of fingerprints; no side is broadcast."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = items.withColumn("item_hash", F.xxhash64("text"))
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    theirs = fingerprints(items, [], True)
    lengths = [r["n"] for r in theirs.select("n").filter("n > 0").distinct().collect()]  # fewer than SPAN
    ours = fingerprints(texts, sorted(lengths), False)
    # a fingerprint that many items or documents share is one row of each of them: what meets are pairs of texts
    pairs = ours.join(theirs.hint("merge"), ["n", "fp"]).select("doc_id", "text_hash", "item", "item_hash").distinct()
    whole = texts.dropDuplicates(["doc_id", "text_hash"]).withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
    met = pairs.join(whole.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))).select("doc_id", "text_hash", "item", "item_hash", "text")
    met = met.join(items.withColumnRenamed("text", "item_text").hint("merge"), ["item", "item_hash"]).select("doc_id", "text_hash", "text", "item", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            doc_ids, hashes, texts, names, item_texts = batch.columns
            for row in range(batch.num_rows):
                item = names[row].as_py(), item_texts[row].as_py()
                if item != last:
                    last, block = item, Block([item])
                found = word_hashes(words(texts[row].as_py()))
                spans = [x for _, _, start, end in block.spans(found, np.array([len(found)])) for x in (int(start), int(end))]
                if spans:
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(row, 1), hashes.slice(row, 1), pa.array([spans], pa.list_(pa.int64())), names.slice(row, 1)], ["doc_id", "text_hash", "spans", "item"])

    spans = met.mapInArrow(run, f"doc_id {kind}, text_hash long, spans array<bigint>, item string")
    each = spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [covered(s) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), batch.column(3)], ["of", "of_hash", "n_hit", "items"])

    each = each.mapInArrow(digest, f"of {kind}, of_hash long, n_hit long, items array<string>")
    rows = probe(docs, []).drop("n_hit", "items")
    known = rows.join(each.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    return known.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def fits(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> bool:
    """Whether items (item, text) are few and short enough to be broadcast."""
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item")).alias("n"), F.count("*").alias("rows")).first()
    return (size["n"] or 0) + 64 * size["rows"] <= block_bytes


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings) for each row of docs (doc_id, text).

    n_hit counts the words inside an occurrence of any window of an item (item_id,
    text). Null texts have no words, on either side; a null item_id is the item named by the
    empty string; an empty benchmark hits nothing; an empty docs gives an empty result.
    Repeated item_ids count once, by all of their texts. Repeated rows of docs give
    repeated results. Other columns are ignored. doc_id may be of any type that can be compared.
    """
    small_batches(docs.sparkSession)
    items = named_items(benchmark)
    if fits(items, block_bytes):
        found = probe(docs, [(r["item"], r["text"]) for r in items.collect()])  # at most block_bytes
    else:
        found = joined(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "items")


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """The rows of docs (text and any other columns) that aren't contaminated, whole, where the benchmark is broadcast, else None.

    The row goes through the search as its own id, so no text is shuffled.
    """
    if not fits(named_items(benchmark)):
        return None
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    found = contamination(docs.select(whole.alias("doc_id"), "text"), benchmark)
    return found.filter(~contaminated()).select(*[F.col(f"doc_id.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def contaminated() -> Column:
    """A row of contamination() with a hit that covers a twentieth of its words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
