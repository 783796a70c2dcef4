"""Frames of a folder, and scanner poses as camera views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions.geometry import quaternion
from sceneloom.operators.windows import renumbered

_MATRIX = "ARRAY<ARRAY<DOUBLE>>"


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, stem of the images (jpg, jpeg, png, webp, in any case) in a folder; without their content, which is not read."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select("path", name.alias("name")).where(F.lower("name").rlike(r"\.(jpg|jpeg|png|webp)$"))
    return named.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))


def _checked(matrix: Column, size: int, what: Column) -> Column:
    """``matrix`` if it has ``size`` rows of ``size`` numbers, else an error."""
    rows = F.transform(matrix, lambda row: (F.size(row) == size) & F.forall(row, lambda x: x.isNotNull()))
    good = F.coalesce((F.size(matrix) == size) & F.forall(rows, lambda x: x), F.lit(False))
    return F.when(good, matrix).otherwise(F.raise_error(F.concat(F.lit(f"not a {size} x {size} matrix: "), what)).cast(_MATRIX))


def _view(pose: Column) -> tuple[Column, Column]:
    """qvec and tvec (world to camera) of a camera-to-world matrix: the rotation turned round, and minus that of the shift."""
    turned = [[pose[j][i] for j in range(3)] for i in range(3)]
    shift = [-reduce(lambda s, x: s + x, (turned[i][j] * pose[j][3] for j in range(3))) for i in range(3)]
    return quaternion(turned), F.array(*shift)


def phone_poses(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """name, intrinsic (3 x 3), pose (4 x 4, camera to world) of ``images`` (name, stem) by name.

    The file holds either one ``intrinsic`` and a list ``aligned_poses``, dealt to the images in the order of
    their names, or an object for each stem with both; the intrinsic is then that of the first image.
    An image without a pose and a matrix of another shape are errors.
    """
    whole = spark.read.text(path, wholetext=True)
    listed = whole.select(F.from_json("value", f"STRUCT<intrinsic: {_MATRIX}, aligned_poses: ARRAY<{_MATRIX}>>").alias("j")).where("j.intrinsic IS NOT NULL AND j.aligned_poses IS NOT NULL")
    if listed.limit(1).count():
        numbered = renumbered(images.select("name", "stem"), "name")
        shared = F.broadcast(listed.select("j.intrinsic"))  # one small matrix
        each = numbered.join(listed.select(F.posexplode("j.aligned_poses").alias("new_id", "pose")), "new_id", "left").crossJoin(shared)
    else:
        entries = whole.select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<intrinsic: {_MATRIX}, aligned_pose: {_MATRIX}>>")).alias("stem", "e"))
        each = images.select("name", "stem").join(entries.select("stem", F.col("e.aligned_pose").alias("pose"), F.col("e.intrinsic").alias("own")), "stem", "left")
        first = each.agg(F.min_by("own", "name").alias("intrinsic"))
        each = each.crossJoin(F.broadcast(first))  # one row
    return each.select("name", _checked(F.col("intrinsic"), 3, F.col("name")).alias("intrinsic"), _checked(F.col("pose"), 4, F.col("name")).alias("pose"))


def _matrices(spark: SparkSession, path: str) -> DataFrame:
    """stem, m: a matrix of numbers between blanks for each file."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
    m = F.transform(lines, lambda line: F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.try_cast("double")))
    return whole.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("stem"), m.alias("m"))


def matrix_camera(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """camera_id 1, model PINHOLE, width, height, params (fx, fy, cx, cy) of a 4 x 4 matrix of intrinsics."""
    m = _checked(F.col("m"), 4, F.col("stem"))
    return _matrices(spark, path).select(m.alias("m")).select(
        F.lit(1).alias("camera_id"), F.lit("PINHOLE").alias("model"), F.lit(width).cast("long").alias("width"), F.lit(height).cast("long").alias("height"),
        F.array(F.col("m")[0][0], F.col("m")[1][1], F.col("m")[0][2], F.col("m")[1][2]).alias("params"),
    )


def matrix_views(spark: SparkSession, folder: str, images: DataFrame, most: int | None = None) -> DataFrame:
    """image_id (from 1), qvec, tvec, camera_id 1, name of the 4 x 4 camera-to-world matrices in <number>.txt files.

    Poses and ``images`` (name, stem) meet by the number that both are called after and are ordered by it.  ``most`` takes so many of
    them, evenly spread with the first and the last, as the sampling that it is.
    """
    number = F.col("stem").cast("long")
    named = images.select("name", number.alias("number"))
    met = _matrices(spark, folder).select(number.alias("number"), _checked(F.col("m"), 4, F.col("stem")).alias("pose")).join(named, "number")
    numbered = renumbered(met, "number")
    if most is not None and most < (total := met.count()):
        spread = [(i, i * (total - 1) // max(1, most - 1)) for i in range(most)]
        chosen = spark.createDataFrame(spread, "place int, new_id long")
        numbered = numbered.join(F.broadcast(chosen), "new_id").drop("new_id").withColumnRenamed("place", "new_id")
    qvec, tvec = _view(F.col("pose"))
    return numbered.select((F.col("new_id") + 1).cast("int").alias("image_id"), qvec.alias("qvec"), tvec.alias("tvec"), F.lit(1).alias("camera_id"), "name")
