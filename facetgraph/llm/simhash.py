"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints are linked where at most TAU bits differ. The 64 bits are dealt into
m partitions, bits that vary together into the same one. If the partitions'
thresholds t_1..t_m sum to TAU - m + 1, two linked fingerprints differ in at most
t_i bits of some partition i: so each fingerprint is entered under its value of each
partition, and probes the values within t_i of it. m and the thresholds are those of
the least estimated cost, found by dynamic programming over bit counts of all
fingerprints. Every candidate is verified on all 64 bits.

Within a bucket a search over the fingerprints not reached yet emits the edges of a
spanning forest, never all pairs; buckets of more than BUCKET rows are dealt out by
pairs of chunks. Components of the edges are found without collecting them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, whole_text
from .components import components

BITS = 64
TAU = 4
SHINGLE = 4
SEED = 42
#: Rows of a bucket that one task compares; larger buckets are dealt out by pairs of chunks.
BUCKET = 16_384
#: Tasks that a component's members are dealt to when they learn its name.
SALTS = 64
#: Cost of verifying a candidate against that of shuffling a probe.
VERIFY_COST = 0.02
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str, width: int = SHINGLE) -> list[bytes]:
    """Word shingles of a text, repeats included: ASCII letters lowered, words between ASCII white space.

    Fewer words than width give one shingle of them all, no words give none.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """The bits that over half of n hashes have, given as bytes, eight for each; none for no hashes."""
    ones = np.zeros(BITS, np.int64)
    for raw in parts:
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64-bit majority of the shingles' XXH64 (seed 42); no words give zero."""
    import xxhash

    found, digest = shingles(text, width), xxhash.xxh64_digest
    parts = (np.frombuffer(b"".join([digest(s, SEED) for s in found[at : at + (1 << 16)]]), np.uint8) for at in range(0, len(found), 1 << 16))
    return majority(parts, len(found))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both (64 x 64, by matrix products a batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            n += len(fp)
            for at in range(0, len(fp), 4096):
                bits = ((fp[at : at + 4096, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
                total += (bits.T @ bits).astype(np.int64)
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").filter("n > 0").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most 4097
    out = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m partitions of nearly equal width: the bit most correlated with a partition joins it next."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    free, out = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        first = max(free, key=lambda b: (max((like[b, c] for c in free), default=0), -b))
        own = [first]
        free.remove(first)
        while len(own) < width:
            best = max(free, key=lambda b: (like[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def within(p: np.ndarray, most: int) -> np.ndarray:
    """Share of pairs whose bits, set with chances p, differ in at most 0..most places."""
    exact = np.zeros(most + 2)
    exact[0] = 1
    for x in 2 * p * (1 - p):
        exact = exact * (1 - x) + np.append([0], exact[:-1]) * x
    return np.cumsum(exact[: most + 1])


def ball(width: int, radius: int) -> int:
    from math import comb

    return sum(comb(width, r) for r in range(radius + 1))


def allocate(n: int, both: np.ndarray, tau: int = TAU) -> tuple[list[list[int]], list[int]]:
    """Partitions and their thresholds of the least estimated cost, -1 for one that needs no search.

    The cost of threshold t is n * ball(width, t) probes and n * n / 2 * P(distance
    <= t) candidates; dynamic programming over the partitions spends TAU - m + 1 plus
    one for each partition (a threshold of -1 spends none).
    """
    p, best = np.diag(both) / max(n, 1), None
    for m in range(2, tau + 2):
        groups = group_bits(n, both, m)
        budget = tau - m + 1 + m
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            share, new = within(p[g], budget), {}
            for spent, (cost, chosen) in state.items():
                for t in range(-1, min(3, budget - spent - 1) + 1):
                    add = 0.0 if t < 0 else n * ball(len(g), t) + VERIFY_COST * n * n / 2 * share[t]
                    now = (cost + add, [*chosen, t])
                    if spent + t + 1 not in new or now < new[spent + t + 1]:
                        new[spent + t + 1] = now
            state = new
        if budget in state and (best is None or state[budget][0] < best[0]):
            best = (state[budget][0], groups, state[budget][1])
    return best[1], best[2]


def entries(fps: DataFrame, groups: list[list[int]], radii: list[int]) -> DataFrame:
    """slot, role, fp: each fingerprint under its own values (role 0) and those it probes (role 1)."""
    plan = []
    for i, (bits, radius) in enumerate(zip(groups, radii, strict=True)):
        flips = [sum(1 << j for j in c) for r in range(1, radius + 1) for c in combinations(range(len(bits)), r)]
        if radius >= 0:
            plan.append((i, np.array(bits, np.uint64), np.array(flips, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            for i, places, flips in plan:
                own = np.zeros(len(fp), np.uint64)
                for j, b in enumerate(places):
                    own |= ((bits >> b) & np.uint64(1)) << np.uint64(j)
                for role, flip in [(0, np.zeros(1, np.uint64)), *((1, flips[k : k + 64]) for k in range(0, len(flips), 64))]:
                    slots = ((own[:, None] ^ flip[None, :]) | (np.uint64(i) << np.uint64(59))).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(slots.view(np.int64)), pa.array(np.full(len(slots), role, np.int8)), pa.array(np.repeat(fp, len(flip)))], ["slot", "role", "fp"])

    return fps.select("fp").mapInArrow(run, "slot long, role byte, fp long")


def forest(fp: np.ndarray, role: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of one bucket's links: those with a role 0 row at one end at least."""
    open_ = {0: fp[role == 0], 1: fp[role == 1]}
    front: list[tuple[int, np.uint64]] = []
    while front or len(open_[0]):
        if front:
            kind, at = front.pop()
        else:
            kind, at, open_[0] = 0, open_[0][0], open_[0][1:]
        for other in (0, 1) if kind == 0 else (0,):
            near = np.bitwise_count(open_[other] ^ at) <= tau
            if near.any():
                hits = open_[other][near]
                open_[other] = open_[other][~near]
                front += [(other, x) for x in hits]
                yield np.full(len(hits), at), hits


def bucket_edges(slot: np.ndarray, role: np.ndarray, fp: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of whole buckets, given sorted by slot and role."""
    starts = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]).any(axis=1)))
    ends = np.append(starts[1:], len(slot))
    owns = np.add.reduceat((role == 0).astype(np.int64), starts)
    large = (owns > 16) & (ends - starts > 1)
    for s, e in zip(starts[large], ends[large], strict=True):
        yield from forest(fp[s:e], role[s:e], tau)
    small = ~large & (owns > 0) & (ends - starts > 1)
    firsts = np.concatenate([np.empty(0, np.int64), *(starts[small] + k for k in range(16))])
    last = np.tile(starts[small] + owns[small], 16)
    end = np.tile(ends[small], 16)
    keep = (firsts < last) & (firsts + 1 < end)
    firsts, end = firsts[keep], end[keep]
    width = end - firsts - 1
    cut = np.searchsorted(np.cumsum(width), np.arange(0, width.sum() + 1_000_000, 1_000_000))
    cut[-1] = len(width)  # also where the sum is a multiple of a run's size
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        w = width[lo:hi]
        a = np.repeat(firsts[lo : lo + len(w)], w)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= tau
        yield fp[a[near]], fp[b[near]]


def links(fps: DataFrame, tau: int = TAU, bucket: int = BUCKET) -> DataFrame:
    """a, b: edges that connect what is within tau bits among distinct fingerprints fps (fp).

    Null fingerprints have no links, a repeated one does no harm, an empty table gives no edges.
    """
    n, both = bit_counts(fps)
    groups, radii = allocate(n, both, tau)
    rows = entries(fps, groups, radii).withColumn("chunk", F.lit(0).cast("long"))
    crowded = rows.groupBy("slot").count().filter(F.col("count") > bucket)
    crowded = stored(crowded, "crowded")
    if crowded.limit(1).count():
        k = F.ceil(F.col("count") / (bucket // 2)).cast("long")
        own = F.pmod(F.xxhash64("fp"), F.col("k"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.least(own, j) * F.col("k") + F.greatest(own, j) + 1)
        rows = rows.drop("chunk").join(crowded.withColumn("k", k).drop("count"), "slot", "left").withColumn("chunk", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).select("slot", "role", "fp", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in bucket_edges(table[:, :2], table[:, 2], table[:, 3].copy().view(np.uint64), tau):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        n_held = 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1))
            n_held += len(held[-1])
            if n_held < 200_000:
                continue
            table = np.concatenate(held)
            last = np.flatnonzero((table[:, :2] != table[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            yield from found(table[:cut])
            held = [table[cut:]]
            n_held = len(held[0])
        if n_held:
            yield from found(np.concatenate(held))

    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "slot", "chunk").sortWithinPartitions("slot", "chunk", "role").select("slot", "chunk", "role", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, tau: int = TAU, width: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text).

    component_id is the least doc_id reachable over links of at most tau bits, the
    row's own included. A text without words, or null, has fingerprint zero and is
    linked like any other. Rows of one doc_id count as one document for the least id,
    and each keeps its row. A null doc_id takes part in links and is never a
    component's name unless no other id is there. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = stored(fingerprints(docs, width), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(fps, tau, bucket))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # a fingerprint without links is its own component; a large component's members meet its name in SALTS tasks
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    salted = least.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = named.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"], "left")
    component = F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("first"))
    named = stored(met.select("fp", component.alias("component_id")), "fingerprint-components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
