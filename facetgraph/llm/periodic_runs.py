"""Runs of periodic words, found on a harmonic grid with prefix hashes.

For each period p the grid points are 0, p, 2p and so on. A stretch of 2p words holds two neighbouring grid points,
so a run of period p shows there: how far the words agree behind both points and before them gives the whole
stretch. There are about n ln n pairs of a period and a grid point; they are searched as arrays, in blocks
of a bounded number of pairs. What hashes claim is compared word by word before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

#: Words of the shortest run.
LEAST = 12
#: Pairs of a period and a grid point that are searched at a time.
BLOCK = 1 << 18
#: Multiplier and seed of the prefix hashes. Any odd multiplier and any seed give the same runs.
BASE, SEED = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits for each number (wrapping)."""
    x = x.astype(np.uint64) + np.uint64(SEED)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Hashes of all prefixes of a sequence: equal stretches have equal hashes, unequal ones hardly ever."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.power = np.ones(self.n + 1, np.uint64)
        self.power[1:] = BASE
        self.power = np.cumprod(self.power)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed(ids) * self.power[:-1], out=self.sums[1:])

    def alike(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of these lengths at i and at j have equal hashes, i <= j."""
        left, right = self.sums[i + length] - self.sums[i], self.sums[j + length] - self.sums[j]
        return left * self.power[j - i] == right

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Words that agree from i and j on (or before them, with back), at most most, for all pairs at once: binary search."""
        low, high = np.zeros_like(i), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.alike(i - mid, j - mid, mid) if back else self.alike(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _pairs(n: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points and periods, periods ascending, about block of them at a time and one period's at least."""
    p = np.arange(1, n // 2 + 1)
    counts = (n - 1) // p  # grid points with another behind them
    ends = np.cumsum(counts)
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        some = np.repeat(p[at:to], counts[at:to])
        nth = np.arange(len(some)) - np.repeat(ends[at:to] - counts[at:to] - (ends[at - 1] if at else 0), counts[at:to])
        yield nth * some, some
        at = to


def _exact(ids: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """Start and end of the longest stretch around i and i + p whose words p apart are equal, word by word."""
    ahead = np.flatnonzero(ids[i : len(ids) - p] != ids[i + p :])
    behind = np.flatnonzero(ids[:i] != ids[p : i + p])
    return (int(behind[-1]) + 1 if len(behind) else 0), (i + p + int(ahead[0]) if len(ahead) else len(ids))


def runs(ids: np.ndarray, least: int = LEAST, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period.

    A run has length >= max(least, 2 * period), period is its smallest, and neither neighbour extends it.
    """
    n, found = len(ids), {}
    if n < max(least, 2):
        return []
    prefixes = Prefixes(ids)
    for i, p in _pairs(n, block):
        # a run needs so many agreeing words around the pair, so half of them lie on one side
        need = np.maximum(p, least - p)
        half = (need + 1) >> 1
        j = i + p
        ahead, behind = j + half <= n, i >= half
        ahead[ahead] = prefixes.alike(i[ahead], j[ahead], half[ahead])
        behind[behind] = prefixes.alike(i[behind] - half[behind], j[behind] - half[behind], half[behind])
        hit = np.flatnonzero(ahead | behind)
        if not len(hit):
            continue
        i, p, j = i[hit], p[hit], j[hit]
        before = prefixes.common(i, j, i, True)
        after = prefixes.common(i, j, n - j, False)
        long = np.flatnonzero(before + after >= need[hit])
        if not len(long):
            continue
        start, end, p, i = (i - before)[long], (j + after)[long], p[long], i[long]
        order = np.lexsort((p, end, start))
        start, end, p, i = start[order], end[order], p[order], i[order]
        # many pairs claim one stretch: its other grid points, and multiples of its period
        first = np.ones(len(p), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (p[1:] != p[:-1])
        heads = np.flatnonzero(first)
        for s, e, q, a, b in zip(start[heads].tolist(), end[heads].tolist(), p[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(p)], strict=True):
            if q % found.get((s, e), q + 1) == 0:
                continue  # a multiple of the run's period
            if np.array_equal(ids[s : e - q], ids[s + q : e]):
                found[s, e] = min(q, found.get((s, e), q))
                continue
            for at in i[a:b].tolist():  # unequal words of equal hash: word by word for each of the pairs
                s, e = _exact(ids, at, q)
                if e - s >= max(least, 2 * q):
                    found[s, e] = min(q, found.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def numbered(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as UTF-8, and a number for each, equal for equal words."""
    words = text.encode().split()  # of bytes, split() knows exactly these white spaces
    number: dict[bytes, int] = {}
    return words, np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words with one space between, without those that a run holds after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()] if found else words).decode()


def longest(found: Column) -> Column:
    """The run of the greatest length, then least start, then least period; null where there is none."""
    return F.get(F.array_sort(found, lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"]).cast("int")).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))), F.lit(0))


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed for each row of docs (doc_id, text).

    Places are numbers of words from 0. collapsed is the text's words, one space between, without those that repeat
    a period. A null text and one without words have no runs and an empty collapsed text; a null doc_id is kept;
    repeated rows give repeated results; an empty table gives an empty one. Other columns are ignored.
    Each text is whole in one task, as its runs may span it all.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, short = [], [], []
            for text in batch.column(1):
                words, ids = numbered(text.as_py())
                found = runs(ids, least)
                counts.append(len(words))
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                short.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(short, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
