"""Near-duplicates by Jaccard similarity of word shingles.

Two texts are linked where their whole sets of WIDTH-word shingles have a Jaccard
similarity of LEAST or more. Candidates meet by SimHash: the sets' 64-bit fingerprints are
linked by op6's pigeonhole index at TAU bits, and what a component of them holds is one
bucket. That misses pairs near LEAST: on sf0.1 9 bits differ in the median linked pair and
14 in the farthest, and no index by partitions of 64 bits is selective at that distance. So
candidates meet by MinHash, too: BANDS values of ROWS minima each, of which a pair at LEAST
shares one with a chance of 1 - (1 - LEAST ** ROWS) ** BANDS (all but 7 in a million; more
alike, fewer missed). Each candidate is verified on whole sets, whichever way it came.

Texts of one set are one node. Bands of one member are dropped before any text moves,
and bands of the same members are one bucket. Within a bucket a search over the sets
not reached yet emits the edges of a spanning forest, never all pairs; buckets of more
than HELD shingles are dealt out by pairs of chunks. Shingles and sets are known by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob_of_text, partitions, row_key, small_batches, stored, whole_text
from .components import components
from .simhash import SEED, majority, shingles
from .simhash import links as bit_links

WIDTH = 5
LEAST = 0.8
ROWS, BANDS = 5, 30
#: Shingles of a bucket that one task compares, about; larger buckets are dealt out by pairs of chunks.
HELD = 2_000_000
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    raw = b"".join([xxhash.xxh64_digest(s, SEED) for s in set(shingles(text, width))])
    return np.unique(np.frombuffer(raw, np.uint64))


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set: the bits that over half of its hashes have."""
    return majority((own[at : at + (1 << 16)].view(np.uint8) for at in range(0, len(own), 1 << 16)), len(own))


def bands(own: np.ndarray) -> np.ndarray:
    """One hash for each band of a set; none for an empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024, None] * _TIMES + _PLUS).min(axis=0), out=least)
    raw = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(raw, np.uint64).view(np.int64)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, same (the set's hash), size, fp (its fingerprint) and bands for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            same = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            fps = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), pa.array(sizes), pa.array(fps), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["key", "same", "size", "fp", "bands"])

    rows = docs.select(row_key().alias("key"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, same long, size long, fp long, bands array<bigint>")


def alike(nodes: DataFrame) -> DataFrame:
    """band, same: the component of each node's fingerprint over links of few bits, found by op6's index; sets without shingles have none."""
    own = nodes.filter("size > 0").select("fp", "same")
    fps = stored(own.select("fp").distinct(), "set-fingerprints")
    roots = components(bit_links(fps))
    return own.join(roots, own["fp"] == roots["node"], "left").select(F.xxhash64(F.coalesce("root", "fp"), F.lit("fingerprint")).alias("band"), "same")


def meetings(nodes: DataFrame) -> DataFrame:
    """bucket, same: the members of each band or component of fingerprints of two or more, those of the same members once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty((0, 2), np.int64)]

        def found(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.append(True, table[1:, 0] != table[:-1, 0]))
            ends = np.append(starts[1:], len(table))
            some = ends - starts > 1
            names = [xxhash.xxh64_intdigest(table[s:e, 1].tobytes(), SEED) for s, e in zip(starts[some], ends[some], strict=True)]
            if names:
                lengths = (ends - starts)[some]
                buckets = np.repeat(np.array(names, np.uint64).view(np.int64), lengths)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(table[np.repeat(some, ends - starts), 1].copy())], ["bucket", "same"])

        n_held = 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1))
            n_held += len(held[-1])
            if n_held < 200_000:
                continue
            table = np.concatenate(held)
            last = np.flatnonzero(table[:, 0] != table[-1, 0])
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from found(table[:cut])
            held, n_held = [table[cut:]], 0
        table = np.concatenate(held)
        if len(table):
            yield from found(table)

    entered = alike(nodes).unionByName(nodes.select(F.explode("bands").alias("band"), "same"))
    dealt = entered.repartition(partitions(nodes.sparkSession), "band").sortWithinPartitions("band", "same")
    return dealt.mapInArrow(run, "bucket long, same long").distinct()


def forest(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among non-empty sets, by place."""
    sizes = np.array([len(s) for s in sets])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    open_, front, out = np.arange(len(sets)), [], []
    while front or len(open_) > 1:
        if not len(open_):
            break
        if front:
            at = front.pop()
        else:
            at, open_ = open_[0], open_[1:]
            rest = flat[np.repeat(np.isin(np.arange(len(sets)), open_), sizes)]
        mask = np.zeros(len(known), bool)
        mask[own[at]] = True
        shared = np.add.reduceat(mask[rest].astype(np.int64), np.cumsum(sizes[open_]) - sizes[open_])
        near = shared / (sizes[open_] + sizes[at] - shared) >= least
        if near.any():
            out += [(int(at), int(x)) for x in open_[near]]
            front += list(open_[near])
            rest = rest[np.repeat(~near, sizes[open_])]
            open_ = open_[~near]
    return out


def links(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, least: float = LEAST, held: int = HELD) -> DataFrame:
    """a, b: edges that connect the nodes (same, size, fp, bands, first: the key of one row) of which the whole sets are near."""
    met = stored(meetings(nodes), "meetings")
    wanted = met.select("same").distinct().join(nodes.select("same", "first"), "same").select("same", F.col("first.doc_id").alias("id"), F.col("first.blob").alias("blob"))
    texts = docs.select("doc_id", whole_text().alias("text"), blob_of_text().alias("here"))
    fetched = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("here") == F.col("blob"))).groupBy("same").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["same", "own"])

    sets = fetched.mapInArrow(cut, "same long, own binary")
    crowded = met.join(nodes.select("same", "size"), "same").groupBy("bucket").agg(F.sum("size").alias("size")).filter(F.col("size") > held)
    crowded = stored(crowded.select("bucket", (F.ceil(F.col("size") / (held // 2))).cast("long").alias("k")), "crowded")
    rows = met.withColumn("chunk", F.lit(0).cast("long"))
    if crowded.limit(1).count():
        own = F.pmod(F.xxhash64("same"), F.col("k"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.least(own, j) * F.col("k") + F.greatest(own, j) + 1)
        rows = met.join(crowded, "bucket", "left").withColumn("chunk", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).select("bucket", "same", "chunk")

    def run(table: pa.Table) -> pa.Table:
        same = np.array(table.column("same"), np.int64)
        found = forest([np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()], least)
        ends = same[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": ends[:, 0].copy(), "b": ends[:, 1].copy()})

    return rows.join(sets, "same").groupBy("bucket", "chunk").applyInArrow(run, "a long, b long")


def firsts(docs: DataFrame, width: int = WIDTH, least: float = LEAST, held: int = HELD) -> DataFrame:
    """doc_id, blob (hash of the text) of the first row of each group of docs (doc_id, text).

    A group is what links of at least least reach. First is the least doc_id, null
    ones last, then the least blob; rows of one doc_id and text are one. Texts without
    words, or null, are copies of each other and near to no other text. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = stored(signatures(docs, width), "signatures")
    nodes = stored(rows.groupBy("same").agg(F.min("key").alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    roots = components(links(docs, nodes, width, least, held))
    named = nodes.join(roots, nodes["same"] == roots["node"], "left").select("first", F.coalesce("root", "same").alias("root"))
    return named.groupBy("root").agg(F.min("first").alias("key")).select("key.doc_id", "key.blob")
