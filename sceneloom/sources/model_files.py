"""Binary structure-from-motion models as a data source: one file in several tasks, and written back as one file.

Records have no marks to split at, but say how long they are.  Planning walks from record to record,
buffer by buffer, and notes an offset about every ``part_bytes``; tasks read the records between two offsets.  Writing tasks leave
parts beside the file, and the commit joins them behind the count of their records, chunk by chunk.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sceneloom.schema import CAMERA, CAMERA_MODELS, IMAGE, POINT

NAME = "sfm_model"
#: Bytes of a file that a task reads, about; bytes that are read or copied at a time.
PART_BYTES, CHUNK = 32 << 20, 1 << 20
_MODEL_NUMBERS = {name: (number, n) for number, (name, n) in enumerate(CAMERA_MODELS)}


class _Stream:
    """Little-endian values of a file from an offset on, through a buffer."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.held, self.pos = file, at, b"", 0
        file.seek(at)

    def _need(self, n: int) -> None:
        if len(self.held) - self.pos < n:
            self.held, self.pos = self.held[self.pos :] + self.file.read(max(n, CHUNK)), 0
            if len(self.held) < n:
                raise EOFError(f"the file ends inside a record, at {self.at}")

    def take(self, form: str) -> tuple:
        size = struct.calcsize("<" + form)
        self._need(size)
        out = struct.unpack_from("<" + form, self.held, self.pos)
        self.pos, self.at = self.pos + size, self.at + size
        return out

    def skip(self, n: int) -> None:
        self.at += n
        if self.pos + n <= len(self.held):
            self.pos += n
        else:
            self.file.seek(self.at)
            self.held, self.pos = b"", 0

    def name(self) -> str:
        length = 1
        while (end := self.held.find(b"\0", self.pos)) < 0:
            length = len(self.held) - self.pos + 1
            self._need(length)
        out = self.held[self.pos : end].decode()
        self.at, self.pos = self.at + end + 1 - self.pos, end + 1
        return out


def _camera(s: _Stream) -> tuple:
    camera, model, width, height = s.take("iiQQ")
    name, n = CAMERA_MODELS[model]
    return camera, name, width, height, list(s.take(f"{n}d"))


def _image(s: _Stream) -> tuple:
    image, *pose, camera = s.take("i7di")
    name, n = s.name(), s.take("Q")[0]
    seen = s.take("ddq" * n)
    return image, pose[:4], pose[4:], camera, name, [Row(x=seen[i], y=seen[i + 1], point3d_id=seen[i + 2]) for i in range(0, 3 * n, 3)]


def _point(s: _Stream) -> tuple:
    point, x, y, z, r, g, b, error, n = s.take("Q3d3BdQ")
    track = s.take("ii" * n)
    return point, [x, y, z], [r, g, b], error, [Row(image_id=track[i], point2d_idx=track[i + 1]) for i in range(0, 2 * n, 2)]


def _past_camera(s: _Stream) -> None:
    _, model = s.take("ii")
    s.skip(16 + 8 * CAMERA_MODELS[model][1])


def _past_image(s: _Stream) -> None:
    s.skip(64)
    s.name()
    s.skip(24 * s.take("Q")[0])


def _past_point(s: _Stream) -> None:
    s.skip(43)
    s.skip(8 * s.take("Q")[0])


def _camera_bytes(r: Row) -> bytes:
    number, n = _MODEL_NUMBERS[r["model"]]
    return struct.pack(f"<iiQQ{n}d", r["camera_id"], number, r["width"], r["height"], *r["params"])


def _image_bytes(r: Row) -> bytes:
    seen = [v for o in r["observations"] or [] for v in (o["x"], o["y"], o["point3d_id"])]
    return struct.pack("<i7di", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q" + "ddq" * (len(seen) // 3), len(seen) // 3, *seen)


def _point_bytes(r: Row) -> bytes:
    track = [v for t in r["track"] or [] for v in (t["image_id"], t["point2d_idx"])]
    return struct.pack(f"<Q3d3BdQ{len(track)}i", r["point3d_id"], *r["xyz"], *r["rgb"], r["error"], len(track) // 2, *track)


@dataclass(frozen=True)
class _Kind:
    ddl: str
    read: object
    past: object
    packed: object


KINDS = {"cameras": _Kind(CAMERA, _camera, _past_camera, _camera_bytes), "images": _Kind(IMAGE, _image, _past_image, _image_bytes), "points3D": _Kind(POINT, _point, _past_point, _point_bytes)}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Part(InputPartition):
    def __init__(self, at: int, records: int) -> None:
        self.at, self.records = at, records


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind, self.part_bytes = options["path"], options["kind"], int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[_Part]:
        store, path = store_of(self.path)
        with store.open_input_file(path) as file:
            stream = _Stream(file, 0)
            total, parts, begun, held = stream.take("Q")[0], [], 8, 0
            for _ in range(total):
                KINDS[self.kind].past(stream)
                held += 1
                if stream.at - begun >= self.part_bytes:
                    parts.append(_Part(begun, held))
                    begun, held = stream.at, 0
        return [*parts, _Part(begun, held)] if held or not parts else parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        store, path = store_of(self.path)
        with store.open_input_file(path) as file:
            stream = _Stream(file, partition.at)
            for _ in range(partition.records):
                yield KINDS[self.kind].read(stream)


@dataclass
class _Written(WriterCommitMessage):
    part: int
    path: str
    records: int


class JoinedWriter(DataSourceWriter):
    """Writes one file: tasks leave their records beside it, and the commit puts them together behind a header.  What was there is replaced at the end, or stays if anything fails."""

    def __init__(self, path: str) -> None:
        self.path, self.run = path, uuid.uuid4().hex

    def header(self, records: int) -> bytes:
        raise NotImplementedError

    def packed(self, row: Row) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, path = store_of(self.path)
        context, folder = TaskContext.get(), f"{path}.parts-{self.run}"
        store.create_dir(folder)
        own, records = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}", 0
        with store.open_output_stream(own, buffer_size=CHUNK) as out:
            for row in iterator:
                out.write(self.packed(row))
                records += 1
        return _Written(context.partitionId(), own, records)

    def commit(self, messages: list[_Written | None]) -> None:
        store, path = store_of(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        joined = f"{path}.joined-{self.run}"
        with store.open_output_stream(joined, buffer_size=CHUNK) as out:
            out.write(self.header(sum(m.records for m in parts)))
            for m in parts:
                with store.open_input_stream(m.path) as part:
                    while chunk := part.read(CHUNK):
                        out.write(chunk)
        store.move(joined, path)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, path = store_of(self.path)
        folder = f"{path}.parts-{self.run}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class _Writer(JoinedWriter):
    def __init__(self, options: dict) -> None:
        super().__init__(options["path"])
        self.kind = options["kind"]

    def header(self, records: int) -> bytes:
        return struct.pack("<Q", records)

    def packed(self, row: Row) -> bytes:
        return KINDS[self.kind].packed(row)


class ModelFiles(DataSource):
    """Options: path (a file), kind (cameras, images, points3D), part_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return KINDS[self.options["kind"]].ddl

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def read_file(spark: SparkSession, path: str, kind: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The records of one binary file, about ``part_bytes`` of it a task.  The file must be in a store that Arrow opens (local, HDFS, S3, GCS); ``colmap.read_binary`` reads whole files from any that Spark has."""
    spark.dataSource.register(ModelFiles)
    return spark.read.format(NAME).option("path", path).option("kind", kind).option("part_bytes", part_bytes).load()


def write_file(rows: DataFrame, path: str, kind: str) -> None:
    """Writes ``rows`` (the columns of ``kind``) as one binary file, in the order of their partitions; a file that is there is replaced when all is written."""
    rows.sparkSession.dataSource.register(ModelFiles)
    names = rows.sparkSession.createDataFrame([], KINDS[kind].ddl).columns
    rows.select(*names).write.format(NAME).option("path", path).option("kind", kind).mode("append").save()


def write_model(cameras: DataFrame, images: DataFrame, points: DataFrame, folder: str) -> None:
    """The three binary files of a model, each in the order of its ids."""
    for kind, rows in (("cameras", cameras), ("images", images), ("points3D", points)):
        write_file(rows.orderBy(rows.columns[0]), f"{folder}/{kind}.bin", kind)
