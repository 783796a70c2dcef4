"""Boxes from points, their views in images, crops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.geometry import box_corners, extent, middle, projected
from sceneloom.session import materialised


def percentile_boxes(members: DataFrame, points: DataFrame, percentile: float = 95.0) -> DataFrame:
    """component_id, lo, hi, center, size, corners, num_point3d_ids, num_points_used, num_filtered.

    ``members`` (component_id, point3d_id) are joined with ``points`` (point3d_id, x, y,
    z); unknown points drop out.  Points beyond the middle ``percentile`` per cent on any
    axis are left out, the percentiles being interpolated; a component of which nothing
    is left has no row.
    """
    low = (100.0 - percentile) / 200.0
    known = members.distinct().join(points.select("point3d_id", "x", "y", "z"), "point3d_id")
    bounds = known.groupBy("component_id").agg(*[F.percentile(a, F.array(F.lit(low), F.lit(1 - low))).alias(f"p{a}") for a in "xyz"], F.count(F.lit(1)).alias("num_point3d_ids"))
    inside = F.lit(True)
    for a in "xyz":
        inside = inside & F.col(a).between(F.col(f"p{a}")[0], F.col(f"p{a}")[1])
    kept = known.join(bounds, "component_id").where(inside)
    ends = kept.groupBy("component_id").agg(F.array(*[F.min(a) for a in "xyz"]).alias("lo"), F.array(*[F.max(a) for a in "xyz"]).alias("hi"), F.count(F.lit(1)).alias("num_points_used"), F.first("num_point3d_ids").alias("num_point3d_ids"))
    lo, hi = F.col("lo"), F.col("hi")
    return ends.withColumns({"center": middle(lo, hi), "size": extent(lo, hi), "corners": box_corners(lo, hi), "num_filtered": F.col("num_point3d_ids") - F.col("num_points_used")})


def box_statistics(boxes: DataFrame) -> DataFrame:
    """One row: least, greatest, mean and median volume; least, greatest and mean size on each axis."""
    volume = F.col("size")[0] * F.col("size")[1] * F.col("size")[2]
    sizes = [f(F.col("size")[i]).alias(f"{n}_{a}") for i, a in enumerate("xyz") for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    return boxes.agg(F.min(volume).alias("min_volume"), F.max(volume).alias("max_volume"), F.avg(volume).alias("mean_volume"), F.median(volume).alias("median_volume"), *sizes)


#: Rows on average that a task of ``visibility`` sorts or counts at a time.
TASK_ROWS = 500_000


def visibility(members: DataFrame, track: DataFrame) -> DataFrame:
    """component_id, image_id, visible_points, total_points: how often a component's points are seen by an image (a point counts as often as its track names the image).

    Tasks become more as rows do, so that none holds more than about ``TASK_ROWS`` of them, but for what one key has.
    """
    members = materialised(members)
    seen = materialised(track.groupBy("point3d_id", "image_id").agg(F.count(F.lit(1)).alias("times")))
    least = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows, n, *keys: rows.repartition(max(least, math.ceil(n / TASK_ROWS)), *keys)
    m, s = members.count(), seen.count()
    total = dealt(members, m, "component_id").groupBy("component_id").agg(F.count(F.lit(1)).alias("total_points"))
    met = materialised(dealt(members, m + s, "point3d_id").join(dealt(seen, m + s, "point3d_id"), "point3d_id").select("component_id", "image_id", "times"))
    n = met.count()
    visible = dealt(met, n, "component_id", "image_id").groupBy("component_id", "image_id").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("visible_points"))
    return visible.join(total, "component_id")


def visible_enough(counts: DataFrame, fraction: float = 0.3) -> DataFrame:
    """Images that see the rounded-down ``fraction`` of the points, or one at least."""
    return counts.where(F.col("visible_points") >= F.greatest(F.lit(1), F.floor(F.col("total_points") * fraction))).withColumn("fraction_visible", F.col("visible_points") / F.col("total_points"))


def box_views(boxes: DataFrame, views: DataFrame) -> DataFrame:
    """The 2-D bounds of boxes (component_id, corners) in images.

    ``views`` has component_id, image_id, qvec, tvec, model, params, width, height.
    Corners behind the camera are left out; a view with none in front has no row.  Bounds are cut at 0 below and
    at the image's size above, so a box beside the image comes out inverted: ``inside`` tells.
    """
    each = boxes.join(views, "component_id").withColumn("corner", F.explode("corners"))
    seen = each.withColumn("at", projected(F.col("qvec"), F.col("tvec"), F.col("model"), F.col("params"), F.col("corner"))).where("at.in_front")
    bounds = seen.groupBy("component_id", "image_id", "width", "height").agg(*[f(F.col(f"at.{a}")).alias(f"{n}_{a}") for a in "uv" for f, n in ((F.min, "min"), (F.max, "max"))])
    cut = bounds.select("component_id", "image_id", F.greatest(F.lit(0.0), "min_u").alias("x0"), F.greatest(F.lit(0.0), "min_v").alias("y0"), F.least(F.col("width").cast("double"), "max_u").alias("x1"), F.least(F.col("height").cast("double"), "max_v").alias("y1"))
    return cut.withColumn("inside", (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def outside_percentiles(points: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Points (x, y, z) between two percentiles on each axis; the bounds are one row, broadcast."""
    bounds = points.agg(*[F.percentile(a, F.array(F.lit(low), F.lit(high))).alias(f"p{a}") for a in "xyz"])
    kept = points.crossJoin(F.broadcast(bounds))
    for a in "xyz":
        kept = kept.where(F.col(a).between(F.col(f"p{a}")[0], F.col(f"p{a}")[1]))
    return kept.select(points.columns)


def below_ceiling(points: DataFrame, up: str = "z", percentile: float = 0.8) -> DataFrame:
    top = points.agg(F.percentile(up, F.lit(percentile)).alias("top"))
    return points.crossJoin(F.broadcast(top)).where(F.col(up) <= F.col("top")).select(points.columns)


def near_floor(points: DataFrame, up: str = "z", percentile: float = 0.01, reach: float = 0.3) -> DataFrame:
    """Points at most ``reach`` above the height that ``percentile`` of them lie under."""
    floor = points.agg(F.percentile(up, F.lit(percentile)).alias("floor"))
    return points.crossJoin(F.broadcast(floor)).where(F.col(up) <= F.col("floor") + reach).select(points.columns)


def long_tracks(points: DataFrame, least: int = 3) -> DataFrame:
    return points.where(F.size("track") >= least)


def pixel_count(width: Column, height: Column, inclusive: bool = False) -> Column:
    return ((width + 1) * (height + 1) if inclusive else width * height).cast("long")
