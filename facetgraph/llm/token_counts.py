"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a doubly linked list; a heap holds its adjacent
pairs by merge rank and place. The lowest is popped and merged again and again;
an entry whose pair has changed meanwhile is skipped. The count is the number of
symbols at first less the number of merges: no token identifiers are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import PATTERN, pieces, spelled
from .common import small_batches, whole_text

#: Pieces of fewer than 64 characters whose count a worker keeps. More are counted anew: speed alone depends on it.
KEPT = 1_000_000
LIMIT = 512


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


class MergeCounter:
    """Counts tokens as a byte-level BPE file's merges give them."""

    def __init__(self, path: str, kept: int = KEPT):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number: dict[str, int] = {}
        of = lambda s: number.setdefault(s, len(number))
        self.first = [of(s) for s in byte_symbols()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[of(a) << 24 | of(b)] = (rank, of(a + b))
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(PATTERN)
        self.kept, self.most = {}, kept

    def merged(self, token: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(token)
        if n < 2:
            return n
        get, first = self.merges.get, self.first
        symbol = [first[b] for b in token]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := get(symbol[i] << 24 | symbol[i + 1]):
                heap.append(found[0] << 32 | i)
        heapq.heapify(heap)
        merges = 0
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = get(symbol[i] << 24 | symbol[j])
            if not found or found[0] != entry >> 32:
                continue
            merges += 1
            symbol[i], symbol[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if right := get(symbol[i] << 24 | symbol[k]):
                    heapq.heappush(heap, right[0] << 32 | i)
            h = before[i]
            if h >= 0 and (left := get(symbol[h] << 24 | symbol[i])):
                heapq.heappush(heap, left[0] << 32 | h)
        return n - merges

    def _piece(self, piece: str) -> int:
        parts, special = ([piece], 0) if self.special is None else (self.special.split(piece), len(self.special.findall(piece)))
        return special + sum(self.merged(t.encode("utf-8")) for part in parts for t in self.cut.findall(part))

    def count(self, text: str) -> int:
        """Tokens of a whole text; the strings of added tokens count one each."""
        first, *rest = pieces(text)
        total, kept = self._piece(first), self.kept
        for piece in rest:
            n = kept.get(piece)
            if n is None:
                n = self._piece(spelled(piece))
                if len(kept) < self.most and len(piece) < 64:
                    kept[piece] = n
            total += n
        return total


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The worker's counter for a file: workers outlive tasks, so its table does too."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. A null doc_id is kept. Repeated
    rows give repeated results; an empty table gives an empty one. Other columns are
    ignored. path names the tokenizer file on every executor.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            counts = [count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
