"""Models as functions of Arrow batches, with stand-ins that need no weights.

A model is any callable of a list of values to a list of results; it is loaded once
by each worker. The stand-ins are deterministic and make no claim of quality.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import boxes, vector

DIM = 512


def apply_model(df: DataFrame, load: Callable[[], Callable[[list], list]], column: str, out: str, kind: str) -> DataFrame:
    """df with a column of the model's results; a batch that fails is tried row by row, and rows that fail get null."""
    names = df.columns
    at = names.index(column)
    out_type = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            values = batch.column(at).to_pylist()
            try:
                results = model(values)
            except Exception:
                results = []
                for v in values:
                    try:
                        results += model([v])
                    except Exception:
                        results.append(None)
            yield pa.RecordBatch.from_pydict({**{n: batch.column(i) for i, n in enumerate(names)}, out: results}, schema=pa.schema([*batch.schema, (out, out_type)]))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` {kind}"])
    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(f"x {kind}")[0].dataType)


def hash_embedder(dim: int = DIM) -> Callable[[list], list]:
    """Unit vectors of texts or bytes by signed hashing of their words."""

    def embed(values: list) -> list:
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            x = np.zeros(dim)
            for w in (v.encode() if isinstance(v, str) else bytes(v)).lower().split():
                h = zlib.crc32(w)
                x[h % dim] += 1 if h >> 31 else -1
            n = np.linalg.norm(x)
            out.append((x / n if n else x).astype(np.float32).tolist())
        return out

    return embed


def gazetteer(people: dict[str, str]) -> Callable[[list], list]:
    """BIO labels of queries' words: SELF, PERSON or RELATION by a word list."""

    def tag(values: list) -> list:
        return [None if v is None else [f"B-{people[w.lower()]}" if w.lower() in people else "O" for w in v.split()] for v in values]

    return tag


#: What a detector says of a picture: the scale of its input against the picture, and its anchors, with scores, centres
#: and strides in the input's pixels, distances to the sides and offsets to key points in strides.
ANCHORS = "struct<scale:double,anchors:array<struct<score:double,cx:double,cy:double,stride:double,deltas:array<double>,offsets:array<double>>>>"


def detect_faces(pictures: DataFrame, load: Callable[[], Callable[[list], list]], overlap: float = 0.4, least: float = 0.5) -> DataFrame:
    """file_id, content, place, conf, x, y, w, h, points of the faces in pictures (file_id, content).

    The model gives anchors (ANCHORS); scores that aren't between 0 and 1 are logits, as all of the picture's then are. Boxes and
    key points are decoded to the picture's own pixels and overlapping boxes suppressed.
    place numbers a picture's faces by falling confidence. A picture that can't be read has none.
    """
    found = apply_model(pictures.select("file_id", "content"), load, "content", "_raw", ANCHORS)
    scores = vector.logits_to_scores(F.transform("_raw.anchors", lambda a: a["score"]))
    scored = found.select("file_id", "content", "_raw", scores.alias("_scores"))

    def face(a: Column, i: Column) -> Column:
        box = boxes.anchor_box(a["cx"], a["cy"], a["deltas"], a["stride"], F.col("_raw.scale"))
        return F.struct(F.col("_scores")[i].alias("conf"), i.alias("i"), *[box[c].alias(c) for c in "xywh"])

    good = F.filter(F.transform("_raw.anchors", face), lambda b: b["conf"] > least)
    kept = scored.select("file_id", "content", "_raw", F.posexplode(boxes.suppressed(good, overlap)).alias("place", "_box"))
    anchor = F.col("_raw.anchors")[F.col("_box.i")]
    points = boxes.anchor_points(anchor["cx"], anchor["cy"], anchor["offsets"], anchor["stride"], F.col("_raw.scale"))
    flat = F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))
    return kept.select("file_id", "content", "place", *[F.col(f"_box.{c}").alias(c) for c in ("conf", "x", "y", "w", "h")], flat.alias("points"))


def embed_faces(faces: DataFrame, decode: Callable, encode: Callable, load: Callable[[], Callable[[list], list]], size: int = 112) -> DataFrame:
    """file_id, place, conf, x, y, w, h, crop_path, crop, embedding of faces (detect_faces).

    Faces are turned upright, cut out, encoded, and embedded from the crop. One that can't be cut
    out has an empty crop_path and no embedding.
    """
    from .functions.pixels import crops

    cut = crops(faces, decode, encode, size)
    known = apply_model(cut, load, "crop", "embedding", "array<float>")
    plain = faces.select("file_id", "place", "conf", "x", "y", "w", "h")
    return plain.join(known, ["file_id", "place"]).select("file_id", "place", "conf", "x", "y", "w", "h", F.col("name").alias("crop_path"), "crop", F.when(F.col("crop").isNotNull(), F.col("embedding")).alias("embedding"))


def tokenized(texts: DataFrame, load: Callable[[], Callable[[str], list[int]]], column: str = "text", out: str = "ids") -> DataFrame:
    """texts with the ids that a tokenizer gives, null for null (F22, F23): load() makes it once in each worker."""

    def make() -> Callable[[list], list]:
        one = load()
        return lambda values: [None if v is None else one(v) for v in values]

    return apply_model(texts, make, column, out, "array<int>")
