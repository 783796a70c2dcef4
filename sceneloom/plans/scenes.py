"""Mesh components, voxel graphs, per-image lists and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.catalog import query
from sceneloom.functions.geometry import voxel
from sceneloom.operators import graph, meshes, tools
from sceneloom.plans.tables import POINTS, points, rounded, table


def _mesh(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    vertices = rows.select(F.col("l_orderkey").alias("vertex"), (F.col("l_partkey") % 400).alias("segment")).groupBy("vertex").agg(F.min("segment").alias("segment"))
    groups = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("object_id"), F.explode(F.array(F.col("s_suppkey") * 3, F.col("s_suppkey") * 3 + 1)).alias("segment")).where("segment < 120")
    return vertices, groups.where("object_id < 40").dropDuplicates(["segment"])


_MESH = """v AS (SELECT l_orderkey AS vertex, min(l_partkey % 400) AS segment FROM lineitem GROUP BY 1),
g AS (SELECT DISTINCT s_suppkey % 40 AS object_id, unnest([s_suppkey * 3, s_suppkey * 3 + 1]) AS segment FROM supplier), gg AS (SELECT * FROM g WHERE segment < 120)"""


@query("vertex_components", f"WITH {_MESH} SELECT vertex, v.segment, coalesce(object_id, -1) AS object_id FROM v LEFT JOIN gg ON v.segment = gg.segment")
def vertex_components(spark, sf_dir):
    return meshes.vertex_components(*_mesh(spark, sf_dir))


@query("member_colours", f"WITH {_MESH}, m AS (SELECT DISTINCT vertex FROM v JOIN gg USING (segment)) SELECT vec_id AS point3d_id, 255 AS r, CASE WHEN vertex IS NULL THEN 255 ELSE 0 END AS g, CASE WHEN vertex IS NULL THEN 255 ELSE 0 END AS b FROM embeddings LEFT JOIN m ON vec_id = vertex")
def member_colours(spark, sf_dir):
    members = meshes.vertex_components(*_mesh(spark, sf_dir)).where("object_id >= 0").select(F.col("vertex").alias("point3d_id"))
    return meshes.coloured(points(spark, sf_dir).select("point3d_id"), members)


@query("component_crops", f"""WITH {POINTS}, n AS (SELECT point3d_id AS vertex, label, image_id, CAST(round_even(100 * -y / (z + d) + 160, 0) AS INTEGER) AS u, CAST(round_even(110 * x / (z + d) + 120, 0) AS INTEGER) AS v FROM p, (VALUES (0, 6.0), (1, 3.0)) i(image_id, d) WHERE z + d > 0.000001),
s AS (SELECT * FROM n WHERE u >= 0 AND v >= 0 AND u < 320 AND v < 240), t AS (SELECT label, count(*) AS total FROM p GROUP BY label)
SELECT label AS component_id, image_id, min(u) AS min_u, max(u) AS max_u, min(v) AS min_v, max(v) AS max_v, count(DISTINCT vertex) AS visible, any_value(total) AS total, round(count(DISTINCT vertex) / any_value(total), 6) AS fraction_visible FROM s JOIN t USING (label) GROUP BY label, image_id""")
def component_crops(spark, sf_dir):
    """Bounds of components in two images, from their vertices."""
    half = 0.5**0.5
    views = spark.createDataFrame([(i, [half, 0.0, 0.0, half], [0.0, 0.0, d], "PINHOLE", [100.0, 110.0, 160.0, 120.0], 320, 240) for i, d in ((0, 6.0), (1, 3.0))], "image_id int, qvec array<double>, tvec array<double>, model string, params array<double>, width int, height int")
    p = points(spark, sf_dir)
    seen = meshes.visible_vertices(p.withColumnRenamed("point3d_id", "vertex").select("vertex", "x", "y", "z"), views)
    members = p.select(F.col("point3d_id").alias("vertex"), F.col("label").alias("object_id"))
    return meshes.component_crops(seen, members).select("component_id", "image_id", "min_u", "max_u", "min_v", "max_v", "visible", "total", F.round("fraction_visible", 6).alias("fraction_visible"))


@query("voxel_edges", f"""WITH {POINTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM p), g AS (SELECT *, greatest(ceil((x1 - x0) / 1.5), 1) AS gx, greatest(ceil((y1 - y0) / 1.5), 1) AS gy, greatest(ceil((z1 - z0) / 1.5), 1) AS gz FROM b),
d AS (SELECT DISTINCT label * 10 + point3d_id % 4 AS node, CAST((least(trunc((x - x0) / (x1 - x0) * gx), gx - 1) * gy + least(trunc((y - y0) / (y1 - y0) * gy), gy - 1)) * gz + least(trunc((z - z0) / (z1 - z0) * gz), gz - 1) AS BIGINT) AS vox FROM p, g),
z AS (SELECT node, count(*) AS size FROM d GROUP BY node), s AS (SELECT a.node AS a, b.node AS b, count(*) AS overlap FROM d a JOIN d b ON a.vox = b.vox AND a.node < b.node GROUP BY ALL)
SELECT a, b, overlap, round(overlap / (za.size + zb.size - overlap), 9) AS jaccard FROM s JOIN z za ON a = za.node JOIN z zb ON b = zb.node WHERE overlap / (za.size + zb.size - overlap) >= 0.3 AND NOT (a % 10 = b % 10 AND a // 20 = b // 20)""")
def voxel_edges(spark, sf_dir):
    """Edges by shared voxels, none between two instances of one sequence and object."""
    p = points(spark, sf_dir)
    ends = p.agg(F.array(*[F.min(a) for a in "xyz"]).alias("lo"), F.array(*[F.max(a) for a in "xyz"]).alias("hi"))
    inside = p.crossJoin(F.broadcast(ends)).select((F.col("label") * 10 + F.col("point3d_id") % 4).alias("node"), voxel(F.array("x", "y", "z"), F.col("lo"), F.col("hi"), 1.5).alias("point"))
    nodes = inside.select("node").distinct().withColumns({"seq": F.col("node") % 10, "slug": F.floor(F.col("node") / 20)})
    return graph.distinct_instances(graph.jaccard_edges(inside, nodes, None, 0.3, cross=None), nodes).withColumn("jaccard", F.round("jaccard", 9))


@query("image_components", "WITH c AS (SELECT l_suppkey AS image, l_partkey AS component_id, min(l_orderkey) AS first FROM lineitem WHERE CAST(trunc(l_quantity * l_quantity) AS BIGINT) > 100 GROUP BY ALL) SELECT image, count(*) AS n, string_agg(CAST(component_id AS VARCHAR), ',' ORDER BY first, component_id) AS components FROM c GROUP BY image")
def image_components(spark, sf_dir):
    """For each image the components with large crops, first seen first."""
    big = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") * F.col("l_quantity")).cast("long") > 100)
    once = big.groupBy(F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("component_id")).agg(F.min("l_orderkey").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "component_id"))), lambda x: x["component_id"].cast("string"))
    return once.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.array_join(ordered, ",").alias("components"))


@query("run_totals", "WITH s AS (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL) SELECT user_id AS dataset_name, round(sum(CASE WHEN event_type = 'error' THEN 0 ELSE value END), 6) AS total_duration_seconds, count(*) AS steps FROM s GROUP BY user_id")
def run_totals(spark, sf_dir):
    """Step times by data set after one step was put in anew."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("dataset_name"), F.col("event_type").alias("step")).agg(F.max_by("value", "event_id").alias("duration_seconds")).withColumn("status", F.lit("completed"))
    anew = e.where("step = 'error'").withColumn("duration_seconds", F.lit(0.0))
    return tools.step_totals(tools.step_recorded(e, anew)).withColumn("total_duration_seconds", rounded(F.col("total_duration_seconds")))


@query("stub_captions", "SELECT l_suppkey AS component_id, 'A crop of component ' || l_suppkey AS caption FROM lineitem GROUP BY l_suppkey")
def stub_captions(spark, sf_dir):
    crops = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("component_id"), F.format_string("%d_%d.png", "l_orderkey", "l_linenumber").alias("crop_filename"))
    return tools.stubbed_captions(crops).select("component_id", "caption")
