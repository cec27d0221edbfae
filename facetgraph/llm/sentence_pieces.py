"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The best segmentation of a text is the one whose pieces have the highest sum of log
scores. Pieces are looked up in a double-array trie over UTF-8 bytes; a character
that no piece covers becomes its bytes' pieces. White space is written as a marker
that stands before words, one more before the text.

Where no piece has a marker after another character (checked when a model is
loaded), the best path of a text is the best paths of its words joined, so each
distinct word is segmented once and its pieces are kept, up to a bound.

A unigram model's scores are log probabilities and used as they are. A BPE model's
scores only rank its pieces; log scores are then those of Zipf's law over that rank,
ln p = -ln(rank + 2.7) - ln Z, so that longer pieces win where they are common.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, whole_text

MARK = "▁"
#: Kinds of pieces and models in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
#: What an unknown character costs beyond the least piece (a fixed value of the library).
UNKNOWN_COST = 10.0
#: Words whose pieces a worker keeps. More are segmented anew: speed alone depends on it.
KEPT = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class DoubleArray:
    """A trie over bytes in two arrays: child = base[node] + byte + 1, valid where check[child] is the node."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        size = 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], offset, todo = 0, 0, [(0, tree)]
        while todo:
            place, node = todo.pop()
            value[place] = node.get(-1, -1)
            children = sorted(b for b in node if b >= 0)
            if not children:
                continue
            # places before the last one found are dense, so the search goes on from there
            while True:
                if offset + 258 > len(check):
                    more = offset + 258
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if all(check[offset + b + 1] < 0 for b in children):
                    break
                offset += 1
            base[place] = offset
            for b in children:
                check[offset + b + 1] = place
            todo += [(offset + b + 1, node[b]) for b in children]
        spare = [-1] * 257
        self.base, self.check, self.value = base, check + spare, value


@dataclass
class Model:
    """Pieces, their kinds and log scores, and how texts are written."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, model_type, prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode("utf-8"))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normal = dict(_fields(value))
                prefix = bool(normal.get(3, 1))
                if normal.get(2) or normal.get(4, 1):
                    raise ValueError("only models that leave texts as they are (no character map, white space kept) are supported")
        if model_type != UNIGRAM:
            scores = zipf(scores, kinds)
        for p, k in zip(pieces, kinds, strict=True):
            if k in (NORMAL, USER) and MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} crosses words")
        return cls(pieces, scores, kinds, prefix)


def zipf(ranks: list[float], kinds: list[int]) -> list[float]:
    """Log scores by Zipf's law from a model's negative ranks, as 32-bit floats."""
    total = math.log(sum(1 / (2.7 - s) for s, k in zip(ranks, kinds, strict=True) if k in (NORMAL, USER)))
    return [float(np.float32(-math.log(2.7 - s) - total)) if k in (NORMAL, USER) else 0.0 for s, k in zip(ranks, kinds, strict=True)]


class Codec:
    def __init__(self, model: Model, kept: int = KEPT):
        self.model = model
        known = {p.encode("utf-8"): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER) and p}
        self.trie = DoubleArray(known)
        self.unknown = min((model.scores[i] for i in known.values()), default=0.0) - UNKNOWN_COST
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        self.unk_id = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.texts = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.kept, self.most = {}, kept

    def segment(self, data: bytes) -> list[int]:
        """The best path through data, of equal ones that with the earliest start of each piece from the end."""
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.model.scores
        best, start, piece = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, k, single = best[at], 0, at, False
            while k < n:
                child = base[node] + data[k] + 1
                if check[child] != node:
                    break
                node, k = child, k + 1
                found = value[node]
                if found >= 0:
                    total = here + scores[found]
                    if best[k] is None or total > best[k]:
                        best[k], start[k], piece[k] = total, at, found
                    single = single or k - at == width
            if not single:
                k, total = at + width, here + self.unknown
                if best[k] is None or total > best[k]:
                    best[k], start[k], piece[k] = total, at, -1
            at += width
        out, at = [], n
        while at > 0:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(data[start[at] : at])]
            else:
                out.append(self.unk_id)
            at = start[at]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, np.int32)
        kept, most, parts = self.kept, self.most, []
        if self.model.dummy_prefix:
            text = " " + text
        for word in self.words.findall(text.replace(" ", MARK)):
            ids = kept.get(word)
            if ids is None:
                ids = np.array(self.segment(word.encode("utf-8")), np.int32).tobytes()
                if len(kept) < most and len(word) < 64:
                    kept[word] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: markers are blanks again, but for the one before the text; byte pieces are joined to characters."""
        texts = self.texts
        whole = b"".join([texts[i] for i in ids.tolist()])
        if self.model.dummy_prefix and whole.startswith(b" "):
            whole = whole[1:]
        return whole.decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(Model.load(path))
    return _CODECS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """All columns of docs but those named like the new ones, and ids, n_pieces, n_byte_pieces, ids_crc32, round_trip.

    ids are the pieces of the whole text, round_trip whether they decode to it again
    (a text that holds the marker itself doesn't). A null or empty text has no pieces
    and decodes to the empty text. Null and repeated doc_ids keep their rows; an empty
    table gives an empty result. path names the model file on every executor.
    """
    small_batches(docs.sparkSession)
    new = {"ids": "array<int>", "n_pieces": "long", "n_byte_pieces": "long", "ids_crc32": "long", "round_trip": "boolean"}
    rest = docs.drop(*[c for c in new if c in docs.columns])
    whole = rest.select(whole_text().alias("_whole"), "*")
    # columns of any name, also of names with dots, go through as c0, c1, ...
    shown = [*rest.columns, *new]
    names = [f"c{k}" for k in range(len(rest.columns))]
    whole = whole.toDF("_whole", *names).select(*names, "_whole")
    n_rest = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        is_byte = np.array([k == BYTE for k in own.model.kinds])
        for batch in batches:
            texts = [t or "" for t in batch.column(n_rest).to_pylist()]
            for at in range(0, len(texts), 200):
                ids = [own.encode(t) for t in texts[at : at + 200]]
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                sizes = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))
                columns = [c.slice(at, len(ids)) for c in batch.columns[:n_rest]]
                columns += [
                    lists,
                    pa.array(sizes),
                    pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    pa.array([own.decode(i) == t for i, t in zip(ids, texts[at : at + 200], strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*names, *new])

    schema = ", ".join([*(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, rest.schema, strict=True)), *(f"{k} {v}" for k, v in new.items())])
    return whole.mapInArrow(run, schema).toDF(*shown)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of encoded and decoded, the text of the ids (null where ids is null)."""
    small_batches(encoded.sparkSession)
    rest = encoded.drop("decoded")
    names = rest.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if i is None else own.decode(np.array(i, np.int32)) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return rest.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "decoded string"]))

