"""Depth images: 16-bit PNG files as rows of pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value of the format: how its files begin.
_MAGIC = b"\x89PNG\r\n\x1a\n"
_ROWS = 64


def _nearest_of(left: int, above: int, corner: int) -> int:
    """The one of three neighbours that is nearest to left + above - corner, the first of ties."""
    guess = left + above - corner
    return min((left, above, corner), key=lambda x: abs(guess - x))


def _undone(kind: int, line: np.ndarray, above: np.ndarray, width: int) -> np.ndarray:
    """A line of bytes as it was before the filter ``kind``; ``width`` bytes a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, width), 0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"no filter {kind}")
    out, up = [0] * width + line.tolist(), [0] * width + above.tolist()
    for i in range(width, len(out)):
        guess = (out[i - width] + up[i]) // 2 if kind == 3 else _nearest_of(out[i - width], up[i], up[i - width])
        out[i] = (out[i] + guess) & 255
    return np.array(out[width:], np.uint8)


def decoded(content: bytes) -> np.ndarray:
    """The (height, width) numbers of a PNG file of one 16-bit channel without interlacing; others, and broken ones, are errors."""
    if not content.startswith(_MAGIC):
        raise ValueError("no PNG file")
    at, data, head = len(_MAGIC), b"", None
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(content[at + 8 + size : at + 12 + size]):
            raise ValueError("a part of the PNG file is broken")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
    if head is None or head[2:4] != (16, 0) or head[6]:
        raise ValueError("no PNG file of one 16-bit channel without interlacing")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 2 * width)
    out = np.zeros((height + 1, 2 * width), np.uint8)
    for v in range(height):
        out[v + 1] = _undone(int(lines[v, 0]), lines[v, 1:], out[v], 2)
    return out[1:].view(">u2").astype(np.uint16)


def depth_images(spark: SparkSession, path: str, unit: float = 1000.0) -> DataFrame:
    """frame (the file's name without ending), v, u, depth of every pixel of the PNG files of a folder; ``unit`` is the number that stands for 1, and 0 (nothing measured) is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, content in zip(batch["frame"].to_pylist(), batch["content"], strict=True):
                image = decoded(content.as_py())
                for top in range(0, len(image), _ROWS):
                    part = image[top : top + _ROWS]
                    v, u = np.indices(part.shape, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([frame] * part.size), pa.array(v.ravel() + np.int32(top)), pa.array(u.ravel()), pa.array(part.ravel() / unit, mask=part.ravel() == 0)], names=["frame", "v", "u", "depth"])

    files = spark.read.format("binaryFile").load(path, pathGlobFilter="*.png")
    named = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("frame"), "content")
    return named.mapInArrow(run, "frame string, v int, u int, depth double")
