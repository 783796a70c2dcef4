"""Structure-from-motion models as tables: text files by DataFrame functions, binary files record by record."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sceneloom.schema import CAMERA, CAMERA_MODELS, IMAGE, POINT


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, f: the fields of each line that is no comment, in the order of the file (a line's place is counted within its own file)."""
    each = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("nth", "line"))
    return each.where(~F.ltrim("line").startswith("#")).select("file", "nth", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "").alias("f"))


def _doubles(column, start: int, length=None):
    part = F.slice(column, start, F.size(column) if length is None else length)
    return F.transform(part, lambda x: x.cast("double"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    rows = _lines(spark, path).where(F.size("f") > 0)
    return rows.select(f[0].cast("int").alias("camera_id"), f[1].alias("model"), f[2].cast("long").alias("width"), f[3].cast("long").alias("height"), _doubles(f, 5).alias("params"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Two lines a record: the pose, and the observations, which may be an empty line.  Of a folder, each file is paired by itself."""
    paired = _lines(spark, path).withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("nth")) - 1)
    heads = paired.where("n % 2 = 0 AND size(f) > 0").select("file", F.expr("n div 2").alias("k"), F.col("f").alias("h"))
    tails = paired.where("n % 2 = 1").select("file", F.expr("n div 2").alias("k"), F.col("f").alias("o"))
    h, o = F.col("h"), F.coalesce("o", F.array().cast("array<string>"))
    seen = F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(o) / 3).cast("int")), lambda i: i * 3 + 2 < F.size(o)), lambda i: F.struct(o[i * 3].cast("double").alias("x"), o[i * 3 + 1].cast("double").alias("y"), o[i * 3 + 2].cast("long").alias("point3d_id")))
    return heads.join(tails, ["file", "k"], "left").select(h[0].cast("int").alias("image_id"), _doubles(h, 2, 4).alias("qvec"), _doubles(h, 6, 3).alias("tvec"), h[8].cast("int").alias("camera_id"), h[9].alias("name"), seen.alias("observations"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    track = F.transform(F.filter(F.sequence(F.lit(8), F.greatest(F.size(f) - 1, F.lit(8))), lambda i: (i % 2 == 0) & (i + 1 < F.size(f))), lambda i: F.struct(f[i].cast("int").alias("image_id"), f[i + 1].cast("int").alias("point2d_idx")))
    rows = _lines(spark, path).where(F.size("f") > 0)
    return rows.select(f[0].cast("long").alias("point3d_id"), _doubles(f, 2, 3).alias("xyz"), F.transform(F.slice(f, 5, 3), lambda x: x.cast("short")).alias("rgb"), f[7].cast("double").alias("error"), track.alias("track"))


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def name(self) -> str:
        end = self.data.index(b"\0", self.at)
        out, self.at = self.data[self.at : end].decode(), end + 1
        return out


def _cameras(b: _Bytes) -> Iterator[tuple]:
    for _ in range(b.take("Q")[0]):
        camera, model, width, height = b.take("iiQQ")
        name, n = CAMERA_MODELS[model]
        yield camera, name, width, height, list(b.take(f"{n}d"))


def _images(b: _Bytes) -> Iterator[tuple]:
    for _ in range(b.take("Q")[0]):
        image, *pose, camera = b.take("i7di")
        name, n = b.name(), b.take("Q")[0]
        yield image, pose[:4], pose[4:], camera, name, [dict(zip(("x", "y", "point3d_id"), b.take("ddq"), strict=True)) for _ in range(n)]


def _points(b: _Bytes) -> Iterator[tuple]:
    for _ in range(b.take("Q")[0]):
        point, x, y, z, r, g, blue, error, n = b.take("Q3d3BdQ")
        yield point, [x, y, z], [r, g, blue], error, [dict(zip(("image_id", "point2d_idx"), b.take("ii"), strict=True)) for _ in range(n)]


_KINDS = {"cameras": (CAMERA, _cameras), "images": (IMAGE, _images), "points3D": (POINT, _points)}


def read_binary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``cameras``, ``images`` or ``points3D`` of binary files; a file is a task, as records have no marks to split at."""
    ddl, parse = _KINDS[kind]
    names = [c.name for c in spark.createDataFrame([], ddl).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows: list[tuple] = []
                for row in parse(_Bytes(bytes(content))):
                    rows.append(row)
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ddl)


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """cameras, images and points3D of a model's folder, from its binary files if it has all three, else from its text files; an error if it has neither."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    has = lambda end: all(files.exists(jvm.org.apache.hadoop.fs.Path(path, f"{kind}.{end}")) for kind in _KINDS)
    if has("bin"):
        return {kind: read_binary(spark, f"{folder}/{kind}.bin", kind) for kind in _KINDS}
    if has("txt"):
        return {kind: read(spark, f"{folder}/{kind}.txt") for kind, read in (("cameras", read_cameras), ("images", read_images), ("points3D", read_points))}
    raise FileNotFoundError(f"no model in {folder}")


def text_of_cameras(cameras: DataFrame) -> DataFrame:
    numbers = F.array_join(F.transform("params", lambda p: p.cast("string")), " ")
    return cameras.select(F.concat_ws(" ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), numbers).alias("value"))


def text_of_points(points: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    track = F.array_join(F.transform("track", lambda t: F.concat_ws(" ", t["image_id"].cast("string"), t["point2d_idx"].cast("string"))), " ")
    return points.select(F.rtrim(F.concat_ws(" ", F.col("point3d_id").cast("string"), join("xyz"), join("rgb"), F.col("error").cast("string"), track)).alias("value"))


def text_of_images(images: DataFrame) -> DataFrame:
    """Two lines a record in one value, so that they stay together."""
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    seen = F.array_join(F.transform("observations", lambda o: F.concat_ws(" ", o["x"].cast("string"), o["y"].cast("string"), o["point3d_id"].cast("string"))), " ")
    return images.select(F.concat(F.concat_ws(" ", F.col("image_id").cast("string"), join("qvec"), join("tvec"), F.col("camera_id").cast("string"), "name"), F.lit("\n"), seen).alias("value"))


def write_text(values: DataFrame, path: str) -> None:
    values.write.mode("overwrite").text(path)
