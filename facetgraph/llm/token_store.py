"""Token-id output as directly addressable codes.

Each id is split in chunks of WIDTH bits, low chunk first. Level k holds the k-th
chunks of all ids that have one, beside a bitmap that says of each whether the id
goes on; a directory of popcounts, one for each BLOCK bits, gives the rank of any
bit. So the place of an id's next chunk is the rank of its continuation bit, and
any token is read by itself, without decoding a block.

File format: a folder of Parquet rows, each a segment of whole documents in
ascending doc_id order: ``part, seq, before, doc_ids, lengths, n_tokens, payload``,
before being the tokens of the part's earlier segments, the payload the codes below, and a second small folder with the first position
of each part. Rows are written by Spark's commit protocol, so a lost executor
costs the tasks it ran and nothing else.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytelevel import SPACE, pieces, spelled
from .common import partitions, runs_of_texts, shared_path, small_batches, whole_text

MAGIC = b"DACS"
WIDTH = 8
BLOCK = 512
#: Tokens after which a segment is closed (it always holds whole documents).
SEGMENT = 1 << 20
#: Pieces of fewer than LONG characters whose ids a worker keeps, in two tables: when the newer one has KEPT,
#: it becomes the older one, whose pieces move up where they are met again. Speed alone depends on it.
KEPT, LONG = 800_000, 64
#: New pieces that go to the library as one text.
JOINED = 512
#: White space inside a piece, and how tokens that start with a blank or a line feed are written in a byte-level vocabulary.
INNER = re.compile(f".[{SPACE}]", re.DOTALL)
OPENINGS = ("\u0120", "\u010a")


def pack_codes(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids, chunks of WIDTH = 8 bits."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while len(rest) or not levels:
        chunks = (rest & 0xFF).astype(np.uint8)
        rest = rest >> WIDTH
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(bits)] = bits
        per_block = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.zeros(len(per_block) + 1, np.uint32)
        np.cumsum(per_block, out=ranks[1:])
        levels.append((len(chunks), chunks.tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more]
    out = [MAGIC, struct.pack("<BI", len(levels), len(ids))]
    for n, chunks, bits, ranks in levels:
        out += [struct.pack("<III", n, len(bits), len(ranks)), chunks, bits, ranks]
    return b"".join(out)


class Codes:
    """Reads what pack_codes wrote."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_levels, self.n = struct.unpack_from("<BI", payload, 4)
        self.levels, at = [], 9
        for _ in range(n_levels):
            n, n_bits, n_ranks = struct.unpack_from("<III", payload, at)
            at += 12
            chunks = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(payload, "<u4", n_ranks // 4, at + n + n_bits)
            at += n + n_bits + n_ranks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The i-th id, by a chunk, a bit and a rank at each of its levels."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (WIDTH * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            first = block * (BLOCK // 8)
            rank = int(ranks[block]) + int(np.bitwise_count(bits[first : i >> 3]).sum())
            i = rank + int(np.bitwise_count(np.uint8(bits[i >> 3] & ((1 << (i & 7)) - 1))))
        return value

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at many places, as __getitem__ finds them, none of the others being decoded."""
        places = np.asarray(places, np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.n):
            raise IndexError(places)
        values = np.zeros(len(places), np.uint32)
        for first in range(0, len(places), 1 << 15):
            some = np.arange(first, min(first + (1 << 15), len(places)))
            at = places[some]
            for k, (chunks, bits, ranks) in enumerate(self.levels):
                values[some] |= chunks[at].astype(np.uint32) << np.uint32(WIDTH * k)
                more = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                some, at = some[more], at[more]
                if not len(at):
                    break
                block = at // BLOCK
                own = (block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)
                whole = np.where(own < (at >> 3)[:, None], bits[np.minimum(own, len(bits) - 1)], 0)
                before = np.bitwise_count(whole).sum(axis=1, dtype=np.int64)
                part = bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
                at = ranks[block].astype(np.int64) + before + np.bitwise_count(part)
        return values

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        ids = np.zeros(self.n, np.uint32)
        here = np.arange(self.n)
        for k, (chunks, bits, _) in enumerate(self.levels):
            ids[here] |= chunks.astype(np.uint32) << np.uint32(WIDTH * k)
            here = here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return ids


class PieceEncoder:
    """The ids of whole texts, by the tokenizers library; ids of pieces are kept.

    Pieces not seen before go to the library many at a time, as one text: a piece without
    white space inside has exactly one token that starts with a blank or a line feed, its
    first, so their ids are told apart again. A tokenizer of another kind than byte-level
    BPE, of which texts can't be cut, is given whole texts.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = kept
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_piece = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] in OPENINGS]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't first."""
        alone = [p for p in new if not p or INNER.search(p)]
        found = dict(zip(alone, (x.tobytes() for x in self._ids(list(map(spelled, alone)))), strict=True))
        joined = [p for p in new if p not in found]
        for at in range(0, len(joined), JOINED):
            some = joined[at : at + JOINED]
            ids = self._ids([(" " + " ".join(some)).replace(" \n", "\n")])[0]
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                found.update((p, raw[i:j]) for p, i, j in zip(some, cuts, cuts[1:], strict=False))
            else:
                found.update(zip(some, (x.tobytes() for x in self._ids(list(map(spelled, some)))), strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return [x.tobytes() for x in self._ids(texts)]
        split = [pieces(t) for t in texts]
        # a first piece is looked up after a line feed, which is a token of its own
        firsts = [s[0] for s in split]
        after = [bool(p) and not p[0].isspace() for p in firsts]
        for s, known in zip(split, after, strict=True):
            s[0] = "\n" + s[0] if known else ""
        if len(self.kept) >= self.most:
            self.kept, self.older = {}, self.kept
        wanted = set().union(*split).difference(self.kept)
        again = [p for p in wanted if p in self.older]
        self.kept.update((p, self.older[p]) for p in again)
        new = self._learn(list(wanted.difference(again)))
        short = {p: x for p, x in new.items() if len(p) < LONG}
        self.kept.update(short)
        table = self.kept if len(short) == len(new) else ChainMap(new, self.kept)
        get, out = table.__getitem__, []
        for s, first, known in zip(split, firsts, after, strict=True):
            if known:
                out.append(b"".join(map(get, s))[4:])
            else:
                out.append((self._ids([first])[0].tobytes() if first else b"") + b"".join(map(get, s[1:])))
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 0, n_parts: int | None = None, segment: int = SEGMENT) -> str:
    """Encode docs (doc_id, text) and write the store to path; returns path.

    Parts are ranges of doc_id, so parts in order and rows in order are the corpus in
    ascending doc_id order. A null text is empty: its end id alone. Null doc_ids come
    first; rows of one doc_id are ordered by text. doc_id may be of any ordered type.
    Other columns are ignored; an empty table gives a store of no segments. A text of
    any length is encoded whole, and a segment holds one such document at least.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seq = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        before, n = 0, 0
        doc_ids, lengths, held = [], [], []

        def closed(id_type: pa.DataType) -> pa.RecordBatch:
            schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(id_type)), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary())])
            payload = pack_codes(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "doc_ids": doc_ids, "lengths": lengths, "n_tokens": n, "payload": payload}], schema)

        for batch in batches:
            ids, texts, id_type = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(0).type
            for at, end in runs_of_texts(texts):
                for doc_id, codes in zip(ids[at:end], encode(texts[at:end]), strict=True):
                    held += [codes, tail]
                    doc_ids.append(doc_id)
                    lengths.append((len(codes) + len(tail)) // 4)
                    n += lengths[-1]
                    if n >= segment:
                        yield closed(id_type)
                        before += n
                        doc_ids, lengths, held, n, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield closed(id_type)

    rows = docs.select("doc_id", whole_text().alias("text")).repartitionByRange(n_parts or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, f"part int, seq int, before long, doc_ids array<{kind}>, lengths array<bigint>, n_tokens long, payload binary").write.option("compression", "zstd").parquet(f"{path}/segments")
    parts = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a part
    starts, at = [], 0
    for p in parts:
        starts.append((p["part"], at))
        at += p["n"]
    spark.createDataFrame(starts, "part int, part_start long").coalesce(1).write.parquet(f"{path}/parts")
    return path


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a store with the position of their first token.

    The parts' starts are a row for each part of the store, so they can be broadcast,
    and no payload is shuffled.
    """
    starts = spark.read.parquet(f"{path}/parts")
    return spark.read.parquet(f"{path}/segments").join(F.broadcast(starts), "part").withColumn("first_token", F.col("part_start") + F.col("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, middle_id of each document, from the store's files.

    The checksum is that of all ids, decoded level by level; middle_id, the id at half of
    the document (null where it has none), is read by itself through the rank directory.
    """
    small_batches(spark)
    stored = segments(spark, path)
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, lengths = batch.column(0)[k].values, batch.column(1)[k].values.to_numpy()
                codes = Codes(batch.column(2)[k].as_py())
                data, ends = codes.all().astype("<u4", copy=False), np.cumsum(lengths)
                crcs = [zlib.crc32(data[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                some = lengths > 0
                middle = np.zeros(len(lengths), np.int64)
                middle[some] = codes.take((ends - lengths + lengths // 2)[some])
                starts = batch.column(3)[k].as_py() + ends - lengths
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array(middle, mask=~some)], ["doc_id", "start", "n_tokens", "ids_crc32", "middle_id"])

    rows = stored.select("doc_ids", "lengths", "payload", "first_token")
    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, middle_id long")


def lookup(positions: DataFrame, path: str, segment: int = SEGMENT, asked_at_once: int = 1 << 16) -> DataFrame:
    """position, token for each row of positions (position long), by random access.

    Segments are matched by equal buckets of positions, so neither side is crossed
    with the other. Each position is read once; those of one range of asked_at_once
    positions of a segment travel together, so a list has that length at most however
    many rows ask for it. Positions outside the store, and nulls, get no row.
    """
    spark = positions.sparkSession
    small_batches(spark)
    index = segments(spark, path).select("part", "seq", "n_tokens", "first_token").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first_token") / segment), F.floor((F.col("first_token") + F.greatest("n_tokens", F.lit(1)) - 1) / segment))))
    asked = positions.select("position").distinct().withColumn("bucket", F.floor(F.col("position") / segment))
    found = asked.join(index, "bucket").filter((F.col("position") >= F.col("first_token")) & (F.col("position") < F.col("first_token") + F.col("n_tokens")))
    asks = found.groupBy("part", "seq", "first_token", F.floor(F.col("position") / asked_at_once).alias("range")).agg(F.collect_list("position").alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                places = batch.column(0)[k].values.to_numpy()
                ids = Codes(batch.column(2)[k].as_py()).take(places - batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(ids.astype(np.int64))], ["position", "token"])

    read = asks.join(spark.read.parquet(f"{path}/segments").select("part", "seq", "payload"), ["part", "seq"]).select("asks", "first_token", "payload").mapInArrow(run, "position long, token long")
    return positions.select("position").join(read, "position")


def fresh_store(spark: SparkSession) -> str:
    return shared_path(spark, "tokens")
