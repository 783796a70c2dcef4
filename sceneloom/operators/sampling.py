"""Seeded draws of points from surfaces, by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sceneloom.session import materialised
from sceneloom.sources.gltf import read_glb

#: All areas together are so many units; draws that a face lists at a time.
UNITS, LISTED = 2.0**52, 65_536
#: Units that rounding may move a draw, at most.
SLACK = 16


def uniform(seed: int, *parts: Column | int) -> Column:
    """From 0 to below 1, from the seed and the parts alone."""
    text = F.concat_ws(":", F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / UNITS


def _cross(a: Column, b: Column) -> list[Column]:
    return [a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))]


def area(a: Column, b: Column, c: Column) -> Column:
    """The area of a triangle; null or NaN where a corner has no place."""
    u, v = (F.array(*[p[i] - a[i] for i in range(3)]) for p in (b, c))
    return F.sqrt(sum((x * x for x in _cross(u, v)), F.lit(0.0))) / 2


def faces_of(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh, primitive, index, a, b, c: triangles with the places of their corners; a triangle that names no vertex has null there."""
    corners = triangles.select("mesh", "primitive", "index", F.posexplode(F.array("a", "b", "c")).alias("corner", "vertex"))
    places = vertices.select("mesh", "primitive", F.col("index").alias("vertex"), F.array("x", "y", "z").alias("p"))
    placed = corners.join(places, ["mesh", "primitive", "vertex"], "left")
    return placed.groupBy("mesh", "primitive", "index").agg(*[F.max(F.when(F.col("corner") == i, F.col("p"))).alias(n) for i, n in enumerate("abc")])


def surface_samples(faces: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """sample (0 to n - 1), the key of its face and p: ``n`` points of the faces (``key``, a, b, c), drawn by area.

    Laid end to end in the order of their keys the areas make one line, cut into ``n`` equal stretches; each has one draw at a place of its own, so that a face
    gets the share of its area, give or take two. A face finds its draws by where it begins and ends, without a join. Areas are whole units of
    2 ** -52 of their sum, so that no draw is lost between faces or tasks; the same seed and keys give the same rows, however many tasks there are. Faces
    without area, or with a null or non-finite corner, get none; if no face is left there are no rows. Keys must be unique and without null.
    """
    size = area(F.col("a"), F.col("b"), F.col("c"))
    known = faces.select(*key, "a", "b", "c", size.alias("area")).where((F.col("area") > 0) & (F.col("area") < float("inf")))
    dealt = materialised(known.repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    top = dealt.agg(F.max("area")).first()[0]
    columns = [F.col("sample"), *key, F.col("p")]
    if top is None or n < 1:
        return dealt.limit(0).withColumn("sample", F.lit(0).cast("long")).withColumn("p", F.col("a")).select(columns)
    whole = float(dealt.agg(F.sum((F.col("area") / top).cast("decimal(28,20)"))).first()[0])  # exact, so that the order of the tasks does not matter
    counted = dealt.withColumn("units", F.round(F.col("area") / top / whole * UNITS).cast("long"))
    parts = counted.groupBy("part").agg(F.sum("units").alias("units"))
    ahead = parts.select("part", F.coalesce(F.sum("units").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a task
    total = parts.agg(F.sum("units")).first()[0]
    line = counted.join(F.broadcast(ahead), "part").withColumn("hi", F.col("ahead") + F.sum("units").over(Window.partitionBy("part").orderBy(*key))).withColumn("lo", F.col("hi") - F.col("units"))
    stretch = lambda at: F.floor(at / float(total) * n)
    spans = line.where("units > 0").withColumns({"first": F.greatest(F.lit(0), stretch(F.col("lo") - SLACK)), "last": F.least(F.lit(n - 1), stretch(F.col("hi") + SLACK))})
    lists = spans.withColumn("list", F.explode(F.sequence(F.floor(F.col("first") / LISTED), F.floor(F.col("last") / LISTED))))
    listed = lists.withColumn("sample", F.explode(F.sequence(F.greatest("first", F.col("list") * LISTED), F.least("last", F.col("list") * LISTED + LISTED - 1))))
    at = F.least(F.lit(total - 1), F.floor((F.col("sample") + uniform(seed, F.col("sample"), 0)) / n * float(total)))
    drawn = listed.where((at >= F.col("lo")) & (at < F.col("hi")))
    placed = drawn.withColumns({"r": F.sqrt(uniform(seed, F.col("sample"), 1)), "s": uniform(seed, F.col("sample"), 2)})
    r, s = F.col("r"), F.col("s")
    return placed.withColumn("p", F.array(*[(1 - r) * F.col("a")[i] + r * (1 - s) * F.col("b")[i] + r * s * F.col("c")[i] for i in range(3)])).select(columns)


def mesh_samples(spark: SparkSession, path: str, n: int = 50_000, seed: int = 0) -> DataFrame:
    """sample, mesh, primitive, index, x, y, z: points of all meshes of a binary glTF file, drawn by area, turned from y up to z up. They keep no least distance from each other."""
    found = surface_samples(faces_of(read_glb(spark, path), read_glb(spark, path, "triangle")), ["mesh", "primitive", "index"], n, seed)
    return found.select("sample", "mesh", "primitive", "index", F.col("p")[0].alias("x"), (-F.col("p")[2]).alias("y"), F.col("p")[1].alias("z"))
