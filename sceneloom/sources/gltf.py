"""Binary glTF files (GLB) as a data source: vertices and triangles of all meshes, one file in several tasks.

The JSON part of a file says where arrays lie in its binary part; the driver reads that alone. Tasks read ranges of the arrays.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sceneloom.sources.model_files import store_of

NAME, PART_BYTES, BATCH = "gltf_file", 32 << 20, 50_000

# Fixed values of the format: the marks of a file and of its parts, component types as numpy names them, modes that make triangles.
_MAGIC, _JSON, _BIN = 0x46546C67, 0x4E4F534A, 0x004E4942
_COMPONENTS = {5120: "i1", 5121: "u1", 5122: "i2", 5123: "u2", 5125: "u4", 5126: "f4"}
_WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
_TRIANGLES, _STRIP, _FAN = 4, 5, 6

_SCHEMAS = {"vertex": "mesh int, primitive int, index bigint, x double, y double, z double", "triangle": "mesh int, primitive int, index bigint, a bigint, b bigint, c bigint"}
_ARROW = {"vertex": pa.float64(), "triangle": pa.int64()}


def parts_of(path: str) -> tuple[dict, int]:
    """The JSON part of a file, and where its binary part begins (-1: there is none)."""
    store, at = store_of(path)
    with store.open_input_file(at) as file:
        head = file.read(12)
        if len(head) < 12 or struct.unpack("<III", head)[:2] != (_MAGIC, 2):
            raise ValueError(f"no binary glTF file of version 2: {path}")
        found, begin, size = None, -1, struct.unpack("<III", head)[2]
        while file.tell() + 8 <= size:
            length, kind = struct.unpack("<II", file.read(8))
            if kind == _JSON and found is None:
                found = json.loads(file.read(length))
            else:
                begin = file.tell() if kind == _BIN and begin < 0 else begin
                file.seek(file.tell() + length)
    if found is None:
        raise ValueError(f"no JSON part in {path}")
    return found, begin


class Array:
    """Where the rows of an accessor lie in the file."""

    def __init__(self, doc: dict, begin: int, number: int) -> None:
        accessor = doc["accessors"][number]
        view = doc["bufferViews"][accessor["bufferView"]] if "bufferView" in accessor else None
        if view is None or "sparse" in accessor or begin < 0 or view.get("buffer", 0) != 0 or "uri" in doc["buffers"][0]:
            raise ValueError(f"accessor {number} is sparse, compressed or in another file")
        self.dtype, self.width, self.rows = np.dtype("<" + _COMPONENTS[accessor["componentType"]]), _WIDTHS[accessor["type"]], accessor["count"]
        self.at = begin + view.get("byteOffset", 0) + accessor.get("byteOffset", 0)
        self.stride = view.get("byteStride") or self.dtype.itemsize * self.width

    def read(self, file, first: int, rows: int) -> np.ndarray:
        size = self.dtype.itemsize * self.width
        file.seek(self.at + first * self.stride)
        held = file.read((rows - 1) * self.stride + size) if rows else b""
        if rows and len(held) < (rows - 1) * self.stride + size:
            raise EOFError(f"the file ends inside an array, at {self.at}")
        return np.ndarray((rows, self.width), self.dtype, held, strides=(self.stride, self.dtype.itemsize)) if rows else np.empty((0, self.width), self.dtype)


class _Part(InputPartition):
    def __init__(self, mesh: int, primitive: int, mode: int, array: Array | None, first: int, rows: int) -> None:
        self.mesh, self.primitive, self.mode, self.array, self.first, self.rows = mesh, primitive, mode, array, first, rows


def _corners(file, part: _Part, first: int, n: int) -> np.ndarray:
    """Vertex numbers of the triangles from ``first`` on."""

    def numbers(start: int, count: int) -> np.ndarray:
        return np.arange(start, start + count) if part.array is None else part.array.read(file, start, count)[:, 0].astype(np.int64)

    if part.mode == _TRIANGLES:
        return numbers(3 * first, 3 * n).reshape(-1, 3)
    if part.mode == _FAN:
        rim = numbers(first + 1, n + 1)
        return np.column_stack([rim[:-1], rim[1:], np.repeat(numbers(0, 1), n)])
    strip = numbers(first, n + 2)
    odd = (np.arange(first, first + n) % 2).astype(bool)
    return np.column_stack([strip[:-2], np.where(odd, strip[2:], strip[1:-1]), np.where(odd, strip[1:-1], strip[2:])])


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.element, self.part_bytes = options["path"], options.get("element", "vertex"), int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[_Part]:
        doc, begin = parts_of(self.path)
        parts = []
        for m, mesh in enumerate(doc.get("meshes", [])):
            for p, primitive in enumerate(mesh["primitives"]):
                mode = primitive.get("mode", _TRIANGLES)
                if mode not in (_TRIANGLES, _STRIP, _FAN):
                    continue
                places = Array(doc, begin, primitive["attributes"]["POSITION"])
                if self.element == "vertex":
                    array, rows, width = places, places.rows, places.stride
                else:
                    array = Array(doc, begin, primitive["indices"]) if "indices" in primitive else None
                    rows, width = (array or places).rows, 3 * (array.stride if array else 4)
                    rows = rows // 3 if mode == _TRIANGLES else max(0, rows - 2)
                each = max(1, self.part_bytes // width)
                parts += [_Part(m, p, mode, array, i, min(each, rows - i)) for i in range(0, rows, each)]
        return parts or [_Part(0, 0, _TRIANGLES, None, 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, at = store_of(self.path)
        names = [f.split()[0] for f in _SCHEMAS[self.element].split(", ")]
        with store.open_input_file(at) as file:
            for i in range(partition.first, partition.first + partition.rows, BATCH):
                n = min(BATCH, partition.first + partition.rows - i)
                values = partition.array.read(file, i, n) if self.element == "vertex" else _corners(file, partition, i, n)
                place = [pa.array(np.full(n, partition.mesh, np.int32)), pa.array(np.full(n, partition.primitive, np.int32)), pa.array(np.arange(i, i + n))]
                yield pa.RecordBatch.from_arrays([*place, *[pa.array(np.ascontiguousarray(c)).cast(_ARROW[self.element]) for c in values.T]], names=names)


class GltfFiles(DataSource):
    """Options: path (a file), element (vertex or triangle), part_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("element", "vertex")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_glb(spark: SparkSession, path: str, element: str = "vertex", part_bytes: int = PART_BYTES) -> DataFrame:
    """mesh, primitive, index (from 0) and x, y, z of the vertices of one file, or a, b, c, the vertices of its triangles (strips and fans too).

    Places are those of the meshes themselves: nodes, which may move or repeat a mesh, are not followed. Points and lines have no
    rows; sparse or compressed arrays and arrays in other files are an error.
    """
    spark.dataSource.register(GltfFiles)
    return spark.read.format(NAME).option("path", path).option("element", element).option("part_bytes", part_bytes).load()
