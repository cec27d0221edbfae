"""Language-model scoring by cross-entropy difference.

Two bigram models, one of a target (documents labelled as good) and one of the whole
corpus, share one vocabulary, all words of the corpus, and one smoothing; the
background's counts are brought to the target's number of tokens, so that the models
differ in what they have seen alone. A document's score is the mean, over its tokens, of
the loss under the target less the loss under the background: the lower, the more like
the target. A document is never scored by its own counts: they are taken from both
models first, so what a model knows of a text it knows from other rows.

    P(word | before) = (pairs(before, word) + SMOOTH * P(word)) / (words(before) + SMOOTH)
    P(word) = (words(word) + 1) / (tokens + vocabulary)

The models are as large as the corpus makes them and are never gathered anywhere. Pairs
are dealt out by their word, so a share holds all pairs of its words and, with them, the
words' own counts; the loss's denominator, which is about the word before, is booked
where that word is the predicted one. So one shuffle brings pairs together for counting
and for scoring, and a second one brings the sums back to the batch of documents that they
came from. Pairs and sums travel in packed arrays, a row for each batch and share; a
cluster with more memory takes larger shares (share_bytes), so that rows stay long.

Words and pairs so frequent that they would crowd a share are known before: of each batch
those with a quarter of a share's part are gathered, so whatever has half a share's part
of the corpus is among them. There are at most four for each share. Their counts are broadcast, a
frequent word's pairs are dealt out by pair and a frequent pair's documents by batch.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_of_texts, small_batches, stored, whole_text

#: Weight of a word's overall share against its share after one word, in tokens.
SMOOTH = 50.0
#: Bytes of text whose pairs make one share, about four million tokens.
SHARE_BYTES = 24_000_000
#: Good documents' ids are broadcast up to so many; beyond, texts meet them in a shuffle.
FEW = 1_000_000
#: Registers of the estimate of the vocabulary's size.
REGISTERS = 1 << 14
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A word before is known by the upper 40 bits of its hash: among the four million entries of a share, of which
#: those of one word alone are told apart by it, a handful may be taken for others.
BEFORE = np.uint64(24)
#: Texts and characters that are cut into pairs at once; a longer text is cut alone.
TEXTS, CHARS = 1000, 4_000_000
#: Mark of a document of the target in its place.
GOOD = np.uint16(1 << 15)
#: Entries of a share whose losses are computed at once, about.
ENTRIES = 500_000


def pair_hash(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of a pair by the hash of its word and the upper bits of that of the word before."""
    with np.errstate(over="ignore"):
        x = (word ^ (before << np.uint64(31) | before >> np.uint64(33))) * _MIX
        return x ^ x >> np.uint64(29)


class Pairs:
    """The pairs of adjacent words of some whole texts, an end symbol before and after each text.

    hashes: of the distinct words. word, before: places in hashes; doc: place of the text; one entry a pair.
    """

    def __init__(self, texts: list[str]):
        known: dict[bytes, int] = defaultdict(count().__next__)
        flat, sizes = [], []
        for text in texts:
            own = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
            flat.append(b"")  # the end symbol
            flat += own
            sizes.append(len(own) + 1)
        flat.append(b"")
        ids = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in known), np.uint64, len(known))
        self.contexts = self.hashes >> BEFORE
        self.sizes = np.array(sizes, np.int64)
        self.word, self.before = ids[1:], ids[:-1]
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)

    def __len__(self) -> int:
        return len(self.word)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)


def among(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is one of the sorted keys, and its place there."""
    if not len(keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values, at


@dataclass
class Frequent:
    """Counts of the frequent words and pairs, by sorted hash: (target, background); and the totals of both."""

    shares: int
    words: np.ndarray
    pairs: np.ndarray
    word_counts: np.ndarray
    pair_counts: np.ndarray
    tokens: tuple[int, int]
    vocabulary: int


def marked(docs: DataFrame, labels: DataFrame, label: str, few: int = FEW) -> DataFrame:
    """text, good and doc_id for each row of docs."""
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label")).filter(F.col("_label") == 1).select(F.col("doc_id").alias("_good"))
    good = stored(good, "good-documents")
    side = F.broadcast(good) if good.limit(few + 1).count() <= few else good
    rows = docs.select("doc_id", whole_text().alias("text"))
    joined = rows.join(side, F.col("doc_id") == F.col("_good"), "left")
    return joined.select("text", F.col("_good").isNotNull().alias("good"), "doc_id")


def gathered(rows: DataFrame, shares: int) -> DataFrame:
    """kind, hash, n: what each batch has often (0 words, 1 pairs), its tokens (2), and the registers of its words (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in cut(batches):
            least = len(own) / (4 * shares)
            words = np.bincount(own.word, minlength=len(own.hashes))
            often = words >= least
            ordered = np.sort(own.word * len(own.hashes) + own.before)
            starts = runs(ordered)
            times = np.diff(np.append(starts, len(ordered)))
            some = ordered[starts[times >= least]]
            pairs = pair_hash(own.hashes[some // len(own.hashes)], own.contexts[some % len(own.hashes)])
            register = (own.hashes % np.uint64(REGISTERS)).astype(np.int64)
            rest = own.hashes // np.uint64(REGISTERS) | np.uint64(1 << 50)
            rank = 1 + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            most = np.zeros(REGISTERS, np.int64)
            np.maximum.at(most, register, rank)
            used = np.flatnonzero(most)
            parts = [(0, own.hashes[often].view(np.int64), words[often]), (1, pairs.view(np.int64), times[times >= least]), (2, np.zeros(1, np.int64), np.array([len(own)])), (3, used, most[used])]
            for kind, hashes, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), pa.array(hashes), pa.array(n.astype(np.int64))], ["kind", "hash", "n"])

    found = rows.select("text").mapInArrow(run, "kind byte, hash long, n long")
    return found.groupBy("kind", "hash").agg(F.when(F.col("kind") == 3, F.max("n")).otherwise(F.sum("n")).alias("n"))


def vocabulary_size(registers: np.ndarray) -> int:
    """How many distinct words filled the registers (HyperLogLog); nearly exact where many are empty."""
    m, empty = REGISTERS, REGISTERS - len(registers)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (empty + np.sum(2.0 ** -registers.astype(np.float64)))
    return round(m * math.log(m / empty)) if raw <= 2.5 * m and empty else round(raw)


def frequent(rows: DataFrame, share_bytes: int = SHARE_BYTES) -> Frequent:
    """The frequent words and pairs of rows (text, good), with their whole counts."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shares = max(1, math.ceil(size / share_bytes))
    seen = stored(gathered(rows, shares), "frequent")
    tokens = seen.filter("kind = 2").agg(F.sum("n").alias("n")).first()["n"] or 0
    ranks = np.array([r["n"] for r in seen.filter("kind = 3").select("n").collect()], np.int64)  # at most REGISTERS
    keep = seen.filter((F.col("kind") < 2) & (F.col("n") * 4 * shares >= tokens)).select("kind", "hash").collect()  # at most 4 * shares of each kind
    words, pairs = (np.sort(np.array([r["hash"] for r in keep if r["kind"] == k], np.int64).view(np.uint64)) for k in (0, 1))
    shared = spark.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        for batch, own in cut(batches):
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[own.doc]
            is_word, place = among(own.hashes, words)
            some = np.flatnonzero(is_word[own.word])
            at = place[own.word[some]]
            is_pair, pair_at = among(pair_hash(own.hashes[own.word[some]], own.contexts[own.before[some]]), pairs)
            parts = [(0, at, good[some], len(words)), (1, pair_at[is_pair], good[some][is_pair], len(pairs)), (2, np.zeros(len(own), np.int64), good, 1)]
            for kind, at, mine, n in parts:
                background, target = np.bincount(at, minlength=n), np.bincount(at[mine], minlength=n)
                used = np.flatnonzero(background)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind, np.int8)), pa.array(used), pa.array(target[used]), pa.array(background[used])], ["kind", "at", "target", "background"])

    counted = rows.select("text", "good").mapInArrow(run, "kind byte, at long, target long, background long").groupBy("kind", "at").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    counts = [np.zeros((n, 2), np.int64) for n in (len(words), len(pairs), 1)]
    for r in counted.collect():  # at most 4 * shares of each kind, and one
        counts[r["kind"]][r["at"]] = r["target"], r["background"]
    return Frequent(shares, words, pairs, counts[0], counts[1], tuple(int(x) for x in counts[2][0]), vocabulary_size(ranks))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Pairs]]:
    """Runs of rows (text, ...) with their pairs, TEXTS rows and CHARS characters at most, or one row."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for at, end in runs_of_texts(texts, TEXTS, CHARS):
            yield batch.slice(at, end - at), Pairs(texts[at:end])


#: Columns of a message: to a share with entries, or to any share with the batch's documents.
ENTRY = ["words", "lengths", "high", "low", "docs", "times", "own"]


def packed(rows: DataFrame, known: Frequent) -> DataFrame:
    """share, block, ids, sizes and ENTRY: a row for each batch of rows (text, good, doc_id) and share, and one for the batch alone.

    words, lengths: the share's words and how many entries each has; high, low, docs,
    times, own: of each entry, a distinct pair in a text, the word before (32 and 8 bits),
    the text's place in the batch (and GOOD where it is in the target), how often the text
    has the pair, and how often the word. The batch's own row has its doc_ids and tokens.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((known.shares, known.words, known.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shares, words, pairs = shared.value
        task = TaskContext.get().partitionId()
        for number, (batch, texts) in enumerate(cut(batches)):
            # words in the order of their shares and hashes, so that sorted entries are sorted by share
            share = ((texts.hashes >> np.uint64(32)) % np.uint64(shares)).astype(np.int64)
            order = np.lexsort((texts.hashes, share))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            hashes, contexts, share = texts.hashes[order], texts.contexts[order], share[order]
            n, n_docs = len(hashes), len(texts.sizes)
            word, before = place[texts.word], place[texts.before]
            ordered = np.sort((word * n + before) * n_docs + texts.doc) if n * n * n_docs < 1 << 62 else None
            if ordered is None:
                by = np.lexsort((texts.doc, before, word))
                word, before, doc = word[by], before[by], texts.doc[by]
                starts = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (before[1:] != before[:-1]) | (doc[1:] != doc[:-1])))
                word, before, doc = word[starts], before[starts], doc[starts]
                total = len(by)
            else:
                starts, total = runs(ordered), len(ordered)
                doc, word, before = ordered[starts] % n_docs, ordered[starts] // n_docs // n, ordered[starts] // n_docs % n
            times = np.diff(np.append(starts, total))
            mine = word * n_docs + doc
            by = np.argsort(mine)
            first = runs(mine[by])
            own = np.empty(len(mine), np.int64)
            own[by] = np.repeat(np.add.reduceat(times[by], first), np.diff(np.append(first, len(by))))
            # a frequent word's entries go by pair, a frequent pair's by batch
            goes = share[word]
            often, _ = among(hashes, words)
            some = np.flatnonzero(often[word])
            pair = pair_hash(hashes[word[some]], contexts[before[some]])
            goes[some] = ((pair >> np.uint64(7)) % np.uint64(shares)).astype(np.int64)
            crowded, _ = among(pair, pairs)
            goes[some[crowded]] = (goes[some[crowded]] + int(texts.hashes[-1] >> np.uint64(40)) + number) % shares
            by = np.argsort(goes.astype(np.uint16) if shares <= 1 << 16 else goes, kind="stable")
            goes, word, before, doc, times, own = (x[by] for x in (goes, word, before, doc, times, own))
            contexts = contexts[before]
            high, low = (contexts >> np.uint64(8)).astype(np.uint32), contexts.astype(np.uint8)
            times, own = times.astype(np.int32), own.astype(np.int32)
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            docs = doc.astype(np.uint16) | np.where(good[doc], GOOD, np.uint16(0))
            block, ids = task << 32 | number, batch.column(2)
            cuts = runs(goes)
            for at, end in zip(cuts, np.append(cuts[1:], len(goes)), strict=True):
                first = runs(word[at:end])
                lengths = np.diff(np.append(first, end - at)).astype(np.int32)
                yield message(goes[at], block, ids[:0], None, hashes[word[at:end][first]], lengths, high[at:end], low[at:end], docs[at:end], times[at:end], own[at:end])
            yield message((task + number) % shares, block, ids, texts.sizes.astype(np.int32), *[None] * len(ENTRY))

    ordered = rows.select("text", "good", "doc_id").sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text")
    return ordered.mapInArrow(run, f"share int, block long, ids array<{kind}>, sizes binary, {', '.join(f'{x} binary' for x in ENTRY)}")


def message(share: int, block: int, ids: pa.Array, *arrays: np.ndarray | None) -> pa.RecordBatch:
    """One row, arrays as bytes."""
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([block], pa.int64()), listed, *columns], ["share", "block", "ids", "sizes", *ENTRY])


def entry_losses(known: Frequent, word: np.ndarray, before: np.ndarray, times: np.ndarray, own: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry, the bits that it adds to its text's loss under the target and under the background.

    word, before: hashes (of 64 and 40 bits); times, own: how often the entry's text has the pair and the
    word; good: whether the text is in the target. All entries of a word and of a pair are
    given, but for those whose counts are known as frequent.
    """
    distinct, word = np.unique(word, return_inverse=True)
    key = word.astype(np.uint64) << np.uint64(40) | before
    by = np.argsort(key)
    starts = runs(key[by])
    of_pair = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(by))))
    first = by[starts]
    word_at, is_word = among(distinct, known.words)[::-1]
    pair_is, pair_at = among(pair_hash(distinct[word[first]], before[first]), known.pairs)
    out = []
    total_t, total_b = known.tokens
    for k, weight in ((0, good.astype(np.int64)), (1, None)):
        mine = times if weight is None else times * weight
        pairs = np.add.reduceat(mine[by], starts)
        words = np.bincount(word, mine, len(distinct))
        words[is_word] = known.word_counts[word_at[is_word], k]
        pairs[pair_is] = known.pair_counts[pair_at[pair_is], k]
        scale = 1.0 if k == 0 else max(total_t, 1) / max(total_b, 1)
        left = 1 if weight is None else weight
        n_pair = np.empty(len(by))
        n_pair[by] = pairs[of_pair]
        n_pair = (n_pair - times * left) * scale
        n_word = (words[word] - own * left) * scale
        share = (n_word + 1.0) / ((total_t if k == 0 else total_b) * scale + known.vocabulary)
        out.append(times * (np.log2(n_word + SMOOTH) - np.log2(n_pair + SMOOTH * share)))
    return out[0], out[1]


def summed(rows: DataFrame, known: Frequent) -> DataFrame:
    """block, ids, sizes, docs, target, background: of the texts of a block, the bits that the pairs of one share add."""
    kind = rows.schema["ids"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def done(blocks: list[int], held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        counts = [len(x) // 2 for x in held["docs"]]
        numbers = lambda name, kind: np.frombuffer(b"".join(held.pop(name)), kind)
        marks, words, lengths = numbers("docs", np.uint16), numbers("words", np.uint64), numbers("lengths", np.int32)
        high, low, times, own = numbers("high", np.uint32), numbers("low", np.uint8), numbers("times", np.int32), numbers("own", np.int32)
        # a slot for each text of each block
        slot = np.repeat(np.arange(len(blocks), dtype=np.int32) * TEXTS, counts) + (marks & ~GOOD)
        # the entries in groups of words, those of frequent words by pair, so that what is computed at once has a bound
        groups = min(256, 1 + len(slot) // ENTRIES)
        group = np.repeat(((words >> np.uint64(8)) % np.uint64(groups)).astype(np.uint8), lengths)
        often = np.repeat(among(words, shared.value.words)[0], lengths)
        group[often] = (high[often] % np.uint32(groups)).astype(np.uint8)
        by = np.argsort(group, kind="stable")
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        ends = np.cumsum(np.bincount(group, minlength=groups))
        sums, used = np.zeros((2, len(blocks) * TEXTS)), np.zeros(len(blocks) * TEXTS, bool)
        used[slot] = True
        for at, end in zip([0, *ends[:-1]], ends, strict=True):
            some = by[at:end]
            if len(some):
                before = high[some].astype(np.uint64) << np.uint64(8) | low[some]
                losses = entry_losses(shared.value, words[word[some]], before, times[some].astype(np.int64), own[some].astype(np.int64), marks[some] >= GOOD)
                for k in (0, 1):
                    np.add.at(sums[k], slot[some], losses[k])
        for i, block in enumerate(blocks):
            docs = np.flatnonzero(used[i * TEXTS : (i + 1) * TEXTS])
            values = sums[:, i * TEXTS + docs].astype(np.float32)
            yield reply(block, pa.nulls(0), None, docs.astype(np.uint16), values[0], values[1])

    def reply(block: int, ids: pa.Array, sizes: bytes | None, *arrays: np.ndarray | None) -> pa.RecordBatch:
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        columns = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in arrays]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), listed, pa.array([sizes], pa.binary()), *columns], ["block", "ids", "sizes", "docs", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, blocks, held = None, [], {}
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[row].as_py()  # noqa: B023, E731
                if get("docs") is None:
                    yield reply(get("block"), batch.column(batch.schema.get_field_index("ids"))[row].values, get("sizes"), None, None, None)
                    continue
                if blocks and share != get("share"):
                    yield from typed(done(blocks, held), id_type)
                    blocks, held = [], {}
                share = get("share")
                blocks.append(get("block"))
                for name in ENTRY:
                    held.setdefault(name, []).append(get(name))
        if blocks:
            yield from typed(done(blocks, held), id_type)

    def typed(found: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield batch.set_column(1, "ids", batch.column(1).cast(pa.list_(id_type)))

    dealt = rows.repartitionById(known.shares, "share").sortWithinPartitions("share")
    return dealt.mapInArrow(run, f"block long, ids {kind}, sizes binary, docs binary, target binary, background binary")


def collected(replies: DataFrame, kind: str, parts: int) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss of the texts of all blocks, by what their shares replied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums, ids, sizes = None, np.zeros((2, TEXTS)), None, None

        def done() -> pa.RecordBatch:
            mean = sums[:, : len(sizes)] / sizes
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(mean[0]), pa.array(mean[1])], ["doc_id", "n_tokens", "target_loss", "background_loss"])

        for batch in batches:
            for row in range(batch.num_rows):
                at, listed, own, docs, target, background = (batch.column(k)[row] for k in range(6))
                if block is not None and block != at.as_py():
                    yield done()
                    sums = np.zeros((2, TEXTS))
                block = at.as_py()
                if docs.as_py() is None:
                    ids, sizes = listed.values, np.frombuffer(own.as_py(), np.int32)
                    continue
                places = np.frombuffer(docs.as_py(), np.uint16)
                sums[0, places] += np.frombuffer(target.as_py(), np.float32)
                sums[1, places] += np.frombuffer(background.as_py(), np.float32)
        if block is not None:
            yield done()

    return replies.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double")


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", few: int = FEW, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for each row of docs (doc_id, text).

    n_tokens counts the words and the end symbol after them. A null or empty text is
    the end symbol alone. Labels that are null or missing leave a document out of the
    target; documents with a null doc_id are never in it. Without any target both
    models say what overall shares say. Repeated rows are repeated, and each knows the
    others' counts; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = marked(docs, labels, label, few)
    known = frequent(rows, share_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = collected(summed(packed(rows, known), known), kind, known.shares)
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))
