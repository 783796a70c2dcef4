"""Mesh vertices: which component they belong to, which images see them, how large they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.geometry import depth_agrees, depth_pixel, projected
from sceneloom.operators.spatial import nearest

#: Views of one scan at most; they are broadcast.
VIEWS = 10_000


def segment_owners(groups: DataFrame) -> DataFrame:
    """segment, object_id of groups (object_id, segment); a segment in two groups is an error when it is read."""
    owners = groups.groupBy("segment").agg(F.min("object_id").alias("object_id"), F.count_distinct("object_id").alias("n"))
    problem = F.raise_error(F.format_string("segment %d is in %d groups", "segment", "n")).cast("long")
    return owners.select("segment", F.when(F.col("n") > 1, problem).otherwise(F.col("object_id").cast("long")).alias("object_id"))


def vertex_components(vertices: DataFrame, groups: DataFrame) -> DataFrame:
    """vertex, segment, object_id (-1 where the segment is in no group)."""
    return vertices.join(segment_owners(groups), "segment", "left").select("vertex", "segment", F.coalesce("object_id", F.lit(-1)).alias("object_id"))


def component_points(members: DataFrame, vertices: DataFrame, points: DataFrame, cell: float = 0.1) -> DataFrame:
    """component_id, point3d_id: the points of a model nearest to the vertices (id, p) of each component (vertex, object_id), each once."""
    found = nearest(vertices, points, 1, cell)
    return members.where("object_id >= 0").join(found.withColumnRenamed("query_id", "vertex"), "vertex").select(F.col("object_id").alias("component_id"), F.col("point_id").alias("point3d_id")).distinct()


def visible_vertices(vertices: DataFrame, views: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """vertex, image_id, u, v: pixels of vertices (vertex, x, y, z) in the images that see them.

    ``views`` (image_id, qvec, tvec, model, params, width, height, and depth_width and
    depth_height if there are depths) are the poses of one scan: more than ``VIEWS`` are an error, as every vertex is held against each.  With ``depths`` (image_id, u, v,
    depth) a vertex is seen only if the depth at its pixel agrees.
    """
    if views.limit(VIEWS + 1).count() > VIEWS:
        raise ValueError(f"more than {VIEWS} views: project scan by scan")
    each = vertices.crossJoin(F.broadcast(views)).withColumn("at", projected(F.col("qvec"), F.col("tvec"), F.col("model"), F.col("params"), F.array("x", "y", "z"), 1e-6)).where("at.in_front")
    pixel = each.withColumns({"u": F.rint("at.u").cast("int"), "v": F.rint("at.v").cast("int")}).where("u >= 0 AND v >= 0 AND u < width AND v < height")
    if depths is None:
        return pixel.select("vertex", "image_id", "u", "v")
    at = pixel.withColumns({"du": depth_pixel(F.col("u"), F.col("width"), F.col("depth_width")), "dv": depth_pixel(F.col("v"), F.col("height"), F.col("depth_height"))})
    seen = at.join(depths.select("image_id", F.col("u").alias("du"), F.col("v").alias("dv"), "depth"), ["image_id", "du", "dv"])
    return seen.where(depth_agrees(F.col("at.depth"), F.col("depth"))).select("vertex", "image_id", "u", "v")


def component_crops(seen: DataFrame, members: DataFrame, least_fraction: float = 0.0) -> DataFrame:
    """component_id, image_id, bounds in pixels, visible and total vertices, fraction_visible and area of each component in each image."""
    total = members.groupBy("object_id").agg(F.count(F.lit(1)).alias("total"))
    bounds = seen.join(members, "vertex").groupBy("object_id", "image_id").agg(*[f(c).alias(f"{n}_{c}") for c in "uv" for f, n in ((F.min, "min"), (F.max, "max"))], F.count_distinct("vertex").alias("visible"))
    out = bounds.join(total, "object_id").withColumns({"fraction_visible": F.col("visible") / F.col("total"), "area": (F.col("max_u") - F.col("min_u") + 1) * (F.col("max_v") - F.col("min_v") + 1)})
    return out.where(F.col("fraction_visible") >= least_fraction).withColumnRenamed("object_id", "component_id")


def coloured(points: DataFrame, members: DataFrame) -> DataFrame:
    """Points with r, g, b: red for members, white for others."""
    marked = points.join(members.select("point3d_id").distinct().withColumn("member", F.lit(True)), "point3d_id", "left")
    return marked.withColumns({"r": F.lit(255), "g": F.when(F.col("member"), 0).otherwise(255), "b": F.when(F.col("member"), 0).otherwise(255)}).drop("member")
