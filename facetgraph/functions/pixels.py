"""Pixels for models: pictures as arrays, aligned faces, and crops as rows.

A decoder is given by the caller, as no picture library is a part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Mean and deviation of the image model's input by channel (fixed values).
MEAN = (0.48145466, 0.4578275, 0.40821073)
DEVIATION = (0.26862954, 0.26130258, 0.27577711)
#: Eyes, nose and corners of the mouth in an aligned face of 112 pixels (fixed values).
FACE_POINTS = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def sample(picture: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values of a picture (height, width, channels) at places; outside is black."""
    h, w = picture.shape[:2]
    out = np.zeros((*x.shape, picture.shape[2]))
    left, top = np.floor(x).astype(int), np.floor(y).astype(int)
    for dy in (0, 1):
        for dx in (0, 1):
            cx, cy = left + dx, top + dy
            weight = (1 - np.abs(x - cx)) * (1 - np.abs(y - cy))
            inside = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            out[inside] += weight[inside][:, None] * picture[cy[inside], cx[inside]]
    return out


def model_input(picture: np.ndarray, size: int = 224) -> np.ndarray:
    """A picture resized to a square, scaled and normalised, channels first."""
    h, w = picture.shape[:2]
    y, x = np.meshgrid((np.arange(size) + 0.5) * h / size - 0.5, (np.arange(size) + 0.5) * w / size - 0.5, indexing="ij")
    values = sample(picture, x.clip(0, w - 1), y.clip(0, h - 1)) / 255
    return ((values - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32)


def alignment(points: np.ndarray, size: int = 112) -> np.ndarray:
    """The 2 x 3 matrix of turn, scale and shift that brings five points closest to their places in an aligned face (U4)."""
    target = np.array(FACE_POINTS) * size / 112
    rows, values = [], []
    for (x, y), (u, v) in zip(points, target, strict=True):
        rows += [[x, -y, 1, 0], [y, x, 0, 1]]
        values += [u, v]
    a, b, tx, ty = np.linalg.lstsq(np.array(rows, float), np.array(values, float), rcond=None)[0]
    return np.array([[a, -b, tx], [b, a, ty]])


def aligned(picture: np.ndarray, points: np.ndarray, size: int = 112) -> np.ndarray:
    """The aligned face of five points in a picture."""
    m = alignment(points, size)
    back = np.linalg.inv(m[:, :2])
    y, x = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    places = np.stack([x - m[0, 2], y - m[1, 2]], axis=-1) @ back.T
    return sample(picture, places[..., 0], places[..., 1])


def crops(faces: DataFrame, decode: Callable[[bytes], np.ndarray], encode: Callable[[np.ndarray], bytes], size: int = 320) -> DataFrame:
    """file_id, place, name, crop for faces (file_id, place, content, points: x, y five times).

    A face whose picture can't be read, or that can't be cut out, keeps its row with an
    empty name (K9, S11). Rows are written as any table is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, cut = [], []
            for row in batch.to_pylist():
                try:
                    cut.append(encode(aligned(decode(row["content"]), np.array(row["points"], float).reshape(5, 2), size)))
                    names.append(f"{row['file_id']}_{row['place']}.jpg")
                except Exception:
                    cut.append(None)
                    names.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(cut, pa.binary())], ["file_id", "place", "name", "crop"])

    return faces.select("file_id", "place", "content", "points").mapInArrow(run, "file_id long, place int, name string, crop binary")
