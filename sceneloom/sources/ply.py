"""Polygon files (PLY) as a data source: the elements of ascii and binary files, in several tasks, and point files written.

The header says what a record holds.  Binary records without lists have one width, so that offsets follow from their numbers; where
records vary (lists, lines of text), planning walks over them, buffer by buffer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sceneloom.sources.model_files import CHUNK, JoinedWriter, store_of

NAME, PART_BYTES, BATCH = "polygon_file", 32 << 20, 50_000

# Fixed values of the format: its scalar types, as numpy and Spark name them.
_TYPES = {
    "char": ("i1", "smallint"), "uchar": ("u1", "smallint"), "short": ("i2", "smallint"), "ushort": ("u2", "int"), "int": ("i4", "int"), "uint": ("u4", "bigint"), "float": ("f4", "float"), "double": ("f8", "double"),
    "int8": ("i1", "smallint"), "uint8": ("u1", "smallint"), "int16": ("i2", "smallint"), "uint16": ("u2", "int"), "int32": ("i4", "int"), "uint32": ("u4", "bigint"), "float32": ("f4", "float"), "float64": ("f8", "double"),
}
_ARROW = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
_WRITTEN = {"tinyint": "char", "smallint": "uchar", "int": "int", "bigint": "int", "float": "float", "double": "double"}


@dataclass(frozen=True)
class Property:
    name: str
    kind: str
    length: str | None = None  # the type of a list's length


@dataclass(frozen=True)
class Element:
    name: str
    count: int
    properties: tuple[Property, ...]

    def dtype(self, order: str) -> np.dtype | None:
        """The record of an element without lists."""
        return None if any(p.length for p in self.properties) else np.dtype([(p.name, order + _TYPES[p.kind][0]) for p in self.properties])

    def ddl(self) -> str:
        return ", ".join(["index bigint", *[f"`{p.name}` {f'array<{_TYPES[p.kind][1]}>' if p.length else _TYPES[p.kind][1]}" for p in self.properties]])


@dataclass(frozen=True)
class Header:
    format: str
    elements: tuple[Element, ...]
    size: int

    @property
    def order(self) -> str:
        return ">" if "big" in self.format else "<"


def header_of(path: str) -> Header:
    store, at = store_of(path)
    with store.open_input_file(at) as file:
        held = b""
        while (end := re.search(rb"\nend_header\r?\n", held)) is None:
            chunk = file.read(4096)
            if not chunk or not (held + chunk).startswith(b"ply"):
                raise ValueError(f"no polygon file: {path}")
            held += chunk
    form, elements = "", []
    for line in held[: end.start()].decode("ascii", "replace").splitlines()[1:]:
        match line.split():
            case ["format", form, *_]:
                pass
            case ["element", name, count]:
                elements.append(Element(name, int(count), ()))
            case ["property", "list", length, kind, name]:
                elements[-1] = Element(elements[-1].name, elements[-1].count, (*elements[-1].properties, Property(name, kind, length)))
            case ["property", kind, name]:
                elements[-1] = Element(elements[-1].name, elements[-1].count, (*elements[-1].properties, Property(name, kind)))
    return Header(form, tuple(elements), end.end())


class _Walk:
    """Bytes of a file from an offset on, through a buffer."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.held, self.pos = file, at, b"", 0
        file.seek(at)

    def take(self, n: int) -> bytes:
        if len(self.held) - self.pos < n:
            self.held, self.pos = self.held[self.pos :] + self.file.read(max(n, CHUNK)), 0
            if len(self.held) < n:
                raise EOFError(f"the file ends inside a record, at {self.at}")
        out = self.held[self.pos : self.pos + n]
        self.pos, self.at = self.pos + n, self.at + n
        return out

    def line(self) -> bytes:
        while (end := self.held.find(b"\n", self.pos)) < 0:
            more = self.file.read(CHUNK)
            if not more:
                if self.pos == len(self.held):
                    raise EOFError(f"the file ends before its last record, at {self.at}")
                end = len(self.held)
                break
            self.held, self.pos = self.held[self.pos :] + more, 0
        out, after = self.held[self.pos : end], min(end + 1, len(self.held))
        self.at, self.pos = self.at + after - self.pos, after
        return out


def _record(walk: _Walk, element: Element, header: Header) -> list:
    """The values of one record."""
    if header.format == "ascii":
        fields, out = iter(walk.line().split()), []
        number = lambda kind: float(next(fields)) if kind[0] in "fd" else int(next(fields))
        for p in element.properties:
            out.append([number(p.kind) for _ in range(int(next(fields)))] if p.length else number(p.kind))
        return out
    read = lambda kind, n: np.frombuffer(walk.take(n * np.dtype(_TYPES[kind][0]).itemsize), header.order + _TYPES[kind][0])
    return [read(p.kind, int(read(p.length, 1)[0])).tolist() if p.length else read(p.kind, 1)[0].item() for p in element.properties]


def _start(walk: _Walk, header: Header, name: str) -> Element:
    """Moves to the first record of an element."""
    for element in header.elements:
        if element.name == name:
            return element
        dtype = None if header.format == "ascii" else element.dtype(header.order)
        if dtype is not None:
            walk.__init__(walk.file, walk.at + element.count * dtype.itemsize)
        else:
            for _ in range(element.count):
                _record(walk, element, header)
    raise ValueError(f"no element {name}")


class _Part(InputPartition):
    def __init__(self, at: int, first: int, records: int) -> None:
        self.at, self.first, self.records = at, first, records


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.element, self.part_bytes = options["path"], options.get("element", "vertex"), int(options.get("part_bytes", PART_BYTES))
        self.header = header_of(self.path)

    def _dtype(self, element: Element) -> np.dtype | None:
        return None if self.header.format == "ascii" else element.dtype(self.header.order)

    def partitions(self) -> list[_Part]:
        store, at = store_of(self.path)
        with store.open_input_file(at) as file:
            walk = _Walk(file, self.header.size)
            element = _start(walk, self.header, self.element)
            dtype, parts = self._dtype(element), []
            if dtype is not None:
                each = max(1, self.part_bytes // dtype.itemsize)
                return [_Part(walk.at + i * dtype.itemsize, i, min(each, element.count - i)) for i in range(0, max(1, element.count), each)]
            begun, first = walk.at, 0
            for i in range(element.count):
                _record(walk, element, self.header)
                if walk.at - begun >= self.part_bytes:
                    parts.append(_Part(begun, first, i + 1 - first))
                    begun, first = walk.at, i + 1
        return [*parts, _Part(begun, first, element.count - first)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, at = store_of(self.path)
        element = next(e for e in self.header.elements if e.name == self.element)
        dtype, names = self._dtype(element), ["index", *[p.name for p in element.properties]]
        kinds = [pa.list_(_ARROW[_TYPES[p.kind][1]]) if p.length else _ARROW[_TYPES[p.kind][1]] for p in element.properties]
        with store.open_input_file(at) as file:
            walk = _Walk(file, partition.at)
            for i in range(0, partition.records, BATCH):
                n = min(BATCH, partition.records - i)
                if dtype is not None:
                    rows = np.frombuffer(walk.take(n * dtype.itemsize), dtype)
                    columns = [rows[p.name].astype(rows.dtype[p.name].newbyteorder("=")) for p in element.properties]
                else:
                    columns = list(zip(*[_record(walk, element, self.header) for _ in range(n)], strict=True))
                index = np.arange(partition.first + i, partition.first + i + n)
                yield pa.RecordBatch.from_arrays([pa.array(index), *[pa.array(c).cast(k) if dtype is not None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


class _Writer(JoinedWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        super().__init__(options["path"])
        self.ascii = options.get("format", "binary") == "ascii"
        self.properties = [(f.name, _WRITTEN[f.dataType.simpleString()]) for f in schema.fields]
        self.dtype = np.dtype([(n, "<" + _TYPES[k][0]) for n, k in self.properties])

    def header(self, records: int) -> bytes:
        lines = ["ply", f"format {'ascii' if self.ascii else 'binary_little_endian'} 1.0", f"element vertex {records}", *[f"property {k} {n}" for n, k in self.properties], "end_header"]
        return "".join(f"{line}\n" for line in lines).encode()

    def packed(self, row: Row) -> bytes:
        if self.ascii:
            return (" ".join(repr(float(v)) if k in ("float", "double") else str(int(v)) for v, (_, k) in zip(row, self.properties, strict=True)) + "\n").encode()
        return np.array(tuple(row), self.dtype).tobytes()


class PolygonFiles(DataSource):
    """Options: path (a file), element, part_bytes; for writing format (binary or ascii)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        wanted = self.options.get("element", "vertex")
        found = [e for e in header_of(self.options["path"]).elements if e.name == wanted]
        if not found:
            raise ValueError(f"no element {wanted} in {self.options['path']}")
        return found[0].ddl()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> JoinedWriter:
        return _Writer(dict(self.options), schema)


def read_ply(spark: SparkSession, path: str, element: str = "vertex", part_bytes: int = PART_BYTES) -> DataFrame:
    """index (from 0) and the properties of an element of one file, lists as arrays; whole numbers without sign get the next wider type.  A file that ends early is an error."""
    spark.dataSource.register(PolygonFiles)
    return spark.read.format(NAME).option("path", path).option("element", element).option("part_bytes", part_bytes).load()


def write_ply(points: DataFrame, path: str, format: str = "binary") -> None:  # noqa: A002
    """Writes the columns of ``points`` as the vertices of one file, in the order of their partitions: float and double as they are, smallint as uchar (colours), int and bigint as int.  Null is an error."""
    points.sparkSession.dataSource.register(PolygonFiles)
    points.write.format(NAME).option("path", path).option("format", format).mode("append").save()
