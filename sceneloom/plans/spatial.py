"""Neighbourhoods, distances, occupancy and routes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sceneloom.catalog import query
from sceneloom.functions.geometry import cell_centre, cell_of, moved, voxel
from sceneloom.operators import boxes, cluster, occupancy, oriented, registration, sampling
from sceneloom.operators.spatial import around, centre_distance, nearest, within_radius
from sceneloom.plans.tables import COMPONENTS, POINTS, components, points, rounded
from sceneloom.session import shared_dir
from sceneloom.sources.component_store import read_store, write_store

_MIDDLE = "[(lo[1] + hi[1]) / 2, (lo[2] + hi[2]) / 2, (lo[3] + hi[3]) / 2]"


@query("radius_points", f"""WITH {POINTS} SELECT a.point3d_id AS left_id, b.point3d_id AS right_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS distance
FROM p a JOIN p b ON a.point3d_id <> b.point3d_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.4""")
def radius_points(spark, sf_dir):
    """The radius join of boxes that are points."""
    p = points(spark, sf_dir).select(F.col("point3d_id").alias("component_id"), F.array("x", "y", "z").alias("lo"), F.array("x", "y", "z").alias("hi"))
    return within_radius(p, p, 0.4).select("left_id", "right_id", F.round("distance", 6).alias("distance"))


# The distance of two segments is the least of: end to segment (four cases), and the inner optimum if it lies inside both.
_NEAR = "AND ".join(f"a.lo[{i}] - 0.5 <= b.hi[{i}] AND b.lo[{i}] - 0.5 <= a.hi[{i}] " for i in (1, 2, 3))  # no segment leaves its box
_SEGMENTS = """
k AS (SELECT a.component_id AS left_id, b.component_id AS right_id, a.lo AS a, b.lo AS c, [a.hi[i] - a.lo[i] for i in [1, 2, 3]] AS u, [b.hi[i] - b.lo[i] for i in [1, 2, 3]] AS v, [a.lo[i] - b.lo[i] for i in [1, 2, 3]] AS w
      FROM c a JOIN c b ON a.component_id <> b.component_id WHERE a.lo IS NOT NULL AND b.lo IS NOT NULL AND {which}),
d AS (SELECT *, list_inner_product(u, u) AS uu, list_inner_product(v, v) AS vv, list_inner_product(u, v) AS uv, list_inner_product(u, w) AS uw, list_inner_product(v, w) AS vw FROM k),
e AS (SELECT left_id, right_id, u, v, w, unnest([
        {'s': 0.0, 't': greatest(0, least(1, vw / vv))}, {'s': 1.0, 't': greatest(0, least(1, (vw + uv) / vv))},
        {'s': greatest(0, least(1, -uw / uu)), 't': 0.0}, {'s': greatest(0, least(1, (uv - uw) / uu)), 't': 1.0},
        {'s': greatest(0, least(1, (uv * vw - vv * uw) / (uu * vv - uv * uv))), 't': greatest(0, least(1, (uu * vw - uv * uw) / (uu * vv - uv * uv)))}]) AS st FROM d),
dist AS (SELECT left_id, right_id, min(sqrt(pow(w[1] + st.s * u[1] - st.t * v[1], 2) + pow(w[2] + st.s * u[2] - st.t * v[2], 2) + pow(w[3] + st.s * u[3] - st.t * v[3], 2))) AS distance FROM e GROUP BY left_id, right_id)
"""


@query("radius_components", f"WITH {COMPONENTS}, {_SEGMENTS.replace('{which}', _NEAR)} SELECT left_id, right_id, round(distance, 6) + 0.0 AS distance FROM dist WHERE distance <= 0.5")
def radius_components(spark, sf_dir):
    """Components whose space diagonals come within half a unit of others'."""
    c = components(spark, sf_dir)
    return within_radius(c, c, 0.5).select("left_id", "right_id", rounded(F.col("distance")).alias("distance"))


@query("store_radius", f"WITH {COMPONENTS}, {_SEGMENTS.replace('{which}', _NEAR + 'AND a.component_id % 10 = 0 ')} SELECT left_id, right_id, round(distance, 6) + 0.0 AS distance FROM dist WHERE distance <= 0.5")
def store_radius(spark, sf_dir):
    """What lies within half a unit of each tenth component, by the stored tree of all."""
    path = f"{shared_dir(spark)}/sceneloom/{spark.sparkContext.applicationId}/store_{uuid.uuid4().hex}"
    c = components(spark, sf_dir)
    write_store(c, path)
    near = read_store(spark, path).near(c.where("component_id % 10 = 0"), 0.5)
    return near.select("left_id", "right_id", rounded(F.col("distance")).alias("distance"))


_AROUND = f"""WITH {COMPONENTS}, {_SEGMENTS.replace('{which}', 'a.component_id = 3')}, n AS (SELECT right_id AS component_id, distance FROM dist WHERE left_id = 3 AND distance <= 2.0),
t AS (SELECT {_MIDDLE}[3] AS tz, lo AS tlo, hi AS thi FROM c WHERE component_id = 3)"""


@query("around_component", f"{_AROUND} SELECT component_id, caption, round(distance, 6) + 0.0 AS distance FROM n JOIN c USING (component_id)")
def around_component(spark, sf_dir):
    return around(components(spark, sf_dir), 3, 2.0).select("component_id", "caption", rounded(F.col("distance")).alias("distance"))


@query("around_component_above", f"{_AROUND} SELECT component_id, caption FROM n JOIN c USING (component_id), t WHERE {_MIDDLE}[3] > tz AND tlo[1] <= hi[1] AND thi[1] >= lo[1] AND tlo[2] <= hi[2] AND thi[2] >= lo[2]")
def around_component_above(spark, sf_dir):
    return around(components(spark, sf_dir), 3, 2.0, "above").select("component_id", "caption")


@query("around_component_below", f"{_AROUND} SELECT component_id, caption FROM n JOIN c USING (component_id), t WHERE {_MIDDLE}[3] < tz AND tlo[1] <= hi[1] AND thi[1] >= lo[1] AND tlo[2] <= hi[2] AND thi[2] >= lo[2]")
def around_component_below(spark, sf_dir):
    return around(components(spark, sf_dir), 3, 2.0, "below").select("component_id", "caption")


@query("component_distance", f"WITH {COMPONENTS} SELECT 3 AS first_id, 17 AS second_id, round(sqrt(pow(a[1] - b[1], 2) + pow(a[2] - b[2], 2) + pow(a[3] - b[3], 2)), 6) AS distance FROM (SELECT {_MIDDLE} AS a FROM c WHERE component_id = 3), (SELECT {_MIDDLE} AS b FROM c WHERE component_id = 17)")
def component_distance(spark, sf_dir):
    return centre_distance(components(spark, sf_dir), 3, 17).withColumn("distance", F.round("distance", 6))


_KNN = f"""WITH {POINTS}, k AS (SELECT a.point3d_id AS query_id, b.point3d_id AS point_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS distance FROM p a, p b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS rank FROM k)"""


def _placed(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("point3d_id").alias("id"), F.array("x", "y", "z").alias("p"))


@query("nearest_points", f"{_KNN} SELECT query_id, point_id, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 15")
def nearest_points(spark, sf_dir):
    """Each point's fifteen nearest, itself first."""
    p = _placed(spark, sf_dir)
    return nearest(p, p, 15, 0.5).select("query_id", "point_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


_TURNED = ([[0.8, -0.6, 0.0], [0.48, 0.64, -0.6], [0.36, 0.48, 0.8]], [3.0, -1.0, 2.0])


@query("aligned_points", f"WITH {POINTS} SELECT point3d_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM p WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def aligned_points(spark, sf_dir):
    """All points, turned and shifted, and brought back by what the alignment finds without their ids."""
    p = registration.finite(_placed(spark, sf_dir))
    turned = p.select("id", moved(F.col("p"), *_TURNED).alias("p"))
    motion = registration.aligned(turned.withColumn("id", -F.col("id")), p, scales=(1,), trials=5_000)
    back = motion.apply(F.col("p"))
    return turned.select(F.col("id").alias("point3d_id"), *[rounded(back[i], 3).alias(c) for i, c in enumerate("xyz")])


@query("nearest_vertex", f"""WITH {POINTS}, {COMPONENTS}, k AS (SELECT component_id, point3d_id, sqrt(pow(a[1] - x, 2) + pow(a[2] - y, 2) + pow(a[3] - z, 2)) AS distance FROM (SELECT component_id, {_MIDDLE} AS a FROM c WHERE lo IS NOT NULL), p),
r AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY distance, point3d_id) AS n FROM k) SELECT component_id, point3d_id AS point_id, round(distance, 6) AS distance FROM r WHERE n = 1""")
def nearest_vertex(spark, sf_dir):
    """The point nearest to each component's middle."""
    c = components(spark, sf_dir).where("lo IS NOT NULL").select(F.col("component_id").alias("id"), F.col("center").alias("p"))
    return nearest(c, _placed(spark, sf_dir), 1, 0.5).select(F.col("query_id").alias("component_id"), "point_id", F.round("distance", 6).alias("distance"))


@query("statistical_inliers", f"{_KNN}, m AS (SELECT query_id, avg(distance) AS mean FROM r WHERE rank <= 20 GROUP BY query_id) SELECT query_id AS id FROM m, (SELECT avg(mean) + 2 * stddev_samp(mean) AS top FROM m) WHERE mean <= top")
def statistical_inliers(spark, sf_dir):
    return cluster.inliers(_placed(spark, sf_dir), 20, 2.0, 0.5).select("id")


@query("level_points")
def level_points(spark, sf_dir):
    """Points on level ground: normals from covariances (no SQL form for eigenvectors)."""
    return cluster.level_points(_placed(spark, sf_dir), 15, 20.0, 0.5).select("id")


_GRID = f"""WITH {POINTS}, g AS (SELECT min(x) - 0.6 AS min_x, min(y) - 0.6 AS min_y, max(x) + 0.6 AS max_x, max(y) + 0.6 AS max_y FROM p),
s AS (SELECT *, CAST(ceil((max_y - min_y) / 0.3) AS INTEGER) AS n_rows, CAST(ceil((max_x - min_x) / 0.3) AS INTEGER) AS n_cols FROM g),
cells AS (SELECT row, unnest(range(0, n_cols)) AS col FROM (SELECT unnest(range(0, n_rows)) AS row, n_cols FROM s)),
t AS (SELECT CAST(floor((y - min_y) / 0.3) AS BIGINT) AS row, CAST(floor((x - min_x) / 0.3) AS BIGINT) AS col, count(*) AS total, count(*) FILTER (z <= 0) AS floor FROM p, s GROUP BY ALL),
o AS (SELECT cells.row, cells.col, coalesce(total, 0) AS total, coalesce(floor, 0) AS floor, CASE WHEN coalesce(total, 0) = 0 OR coalesce(floor, 0) / total >= 0.7 THEN 0 ELSE 1 END AS occupied FROM cells LEFT JOIN t ON cells.row = t.row AND cells.col = t.col)"""


def _grid(spark, sf_dir):
    p = points(spark, sf_dir)
    return occupancy.occupancy(p, p.where("z <= 0"), 0.3, 0.7)


@query("occupancy_grid", f"{_GRID} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, total, floor, occupied FROM o")
def occupancy_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("row", "col", "total", "floor", "occupied")


@query("occupancy_statistics", f"{_GRID} SELECT count(*) AS total_cells, count(*) - CAST(sum(occupied) AS BIGINT) AS floor_cells, CAST(sum(occupied) AS BIGINT) AS occupied_cells, round(100 * (count(*) - sum(occupied)) / count(*), 6) AS floor_percentage FROM o")
def occupancy_statistics(spark, sf_dir):
    return occupancy.statistics(_grid(spark, sf_dir)).withColumn("floor_percentage", F.round("floor_percentage", 6))


@query("occupancy_lines", f"{_GRID} SELECT CAST(row AS INTEGER) AS row, string_agg(CASE WHEN occupied = 1 THEN '#' ELSE '.' END, '' ORDER BY col) AS line FROM o GROUP BY row")
def occupancy_lines(spark, sf_dir):
    return occupancy.ascii_rows(_grid(spark, sf_dir))


@query("occupancy_boxes", f"{_GRID}, l AS (SELECT quantile_cont(z, 0.1) AS level FROM p) SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(min_x + col * 0.3, 6) + 0.0 AS x0, round(min_y + row * 0.3, 6) + 0.0 AS y0, round(level, 6) + 0.0 AS z0, round(min_x + col * 0.3 + 0.3, 6) + 0.0 AS x1, round(min_y + row * 0.3 + 0.3, 6) + 0.0 AS y1, round(level + 0.1, 6) + 0.0 AS z1 FROM o, s, l WHERE occupied = 0")
def occupancy_boxes(spark, sf_dir):
    found = occupancy.free_boxes(_grid(spark, sf_dir), points(spark, sf_dir), 0.3)
    return found.select("row", "col", *[rounded(F.col("corners")[c][i]).alias(f"{a}{n}") for n, c in ((0, 0), (1, 6)) for i, a in enumerate("xyz")])


@query("route")
def route(spark, sf_dir):
    """Ways over the occupancy grid (search is order dependent and has no SQL form)."""
    p = points(spark, sf_dir)
    cells = _grid(spark, sf_dir).withColumn("scene", F.lit("all"))
    grids = occupancy.frame(p, 0.3).withColumns({"scene": F.lit("all"), "size": F.lit(0.3)})
    ends = p.select(F.col("point3d_id").cast("int").alias("route_id"), "x", "y")
    asked = ends.join(ends.select((F.col("route_id") - 1).alias("route_id"), F.col("x").alias("x1"), F.col("y").alias("y1")), "route_id").withColumnsRenamed({"x": "x0", "y": "y0"}).withColumn("scene", F.lit("all"))
    return occupancy.routes(asked, cells, grids)


@query("grid_cells", f"WITH {POINTS} SELECT point3d_id, CAST(trunc((x + 1) / 0.25) AS INTEGER) AS col, CAST(trunc((y + 1) / 0.25) AS INTEGER) AS row, round(-1 + (trunc((x + 1) / 0.25) + 0.5) * 0.25, 6) + 0.0 AS centre FROM p")
def grid_cells(spark, sf_dir):
    """Cells truncated toward zero, and back to their centres."""
    col = cell_of(F.col("x"), F.lit(-1.0), F.lit(0.25))
    return points(spark, sf_dir).select("point3d_id", col.alias("col"), cell_of(F.col("y"), F.lit(-1.0), F.lit(0.25)).alias("row"), rounded(cell_centre(col, F.lit(-1.0), F.lit(0.25))).alias("centre"))


@query("voxels", f"""WITH {POINTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM p), g AS (SELECT *, greatest(ceil((x1 - x0) / 0.5), 1) AS gx, greatest(ceil((y1 - y0) / 0.5), 1) AS gy, greatest(ceil((z1 - z0) / 0.5), 1) AS gz FROM b)
SELECT point3d_id, CAST((least(trunc((x - x0) / (x1 - x0) * gx), gx - 1) * gy + least(trunc((y - y0) / (y1 - y0) * gy), gy - 1)) * gz + least(trunc((z - z0) / (z1 - z0) * gz), gz - 1) AS BIGINT) AS voxel FROM p, g""")
def voxels(spark, sf_dir):
    p = points(spark, sf_dir)
    ends = p.agg(F.array(*[F.min(a) for a in "xyz"]).alias("lo"), F.array(*[F.max(a) for a in "xyz"]).alias("hi"))
    return p.crossJoin(F.broadcast(ends)).select("point3d_id", voxel(F.array("x", "y", "z"), F.col("lo"), F.col("hi"), 0.5).alias("voxel"))


@query("scene_inliers", f"WITH {POINTS}, q AS (SELECT quantile_cont(x, 0.05) AS x0, quantile_cont(x, 0.95) AS x1, quantile_cont(y, 0.05) AS y0, quantile_cont(y, 0.95) AS y1, quantile_cont(z, 0.05) AS z0, quantile_cont(z, 0.95) AS z1 FROM p) SELECT point3d_id FROM p, q WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1")
def scene_inliers(spark, sf_dir):
    return boxes.outside_percentiles(points(spark, sf_dir)).select("point3d_id")


@query("below_ceiling", f"WITH {POINTS} SELECT point3d_id FROM p, (SELECT quantile_cont(z, 0.8) AS top FROM p) WHERE z <= top")
def below_ceiling(spark, sf_dir):
    return boxes.below_ceiling(points(spark, sf_dir)).select("point3d_id")


@query("near_floor", f"WITH {POINTS} SELECT point3d_id FROM p, (SELECT quantile_cont(z, 0.01) AS floor FROM p) WHERE z <= floor + 0.3")
def near_floor(spark, sf_dir):
    return boxes.near_floor(points(spark, sf_dir)).select("point3d_id")


# Faces: triples with all points on one side (within 1e-9).  A least rectangle on a face lies along some pair of points, so that all pairs may be tried.
@query("oriented_boxes", f"""WITH {POINTS}, g AS (SELECT coalesce(label, -1) AS component_id, row_number() OVER (PARTITION BY label ORDER BY point3d_id) AS i, x, y, z FROM p),
w AS (SELECT component_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS points FROM g GROUP BY component_id), q AS (SELECT component_id, i, x - mx AS x, y - my AS y, z - mz AS z FROM g JOIN w USING (component_id)),
t AS (SELECT a.component_id, a.i AS i, b.i AS j, c.i AS k, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz, a.x AS ax, a.y AS ay, a.z AS az
      FROM q a JOIN q b ON a.component_id = b.component_id AND a.i < b.i JOIN q c ON b.component_id = c.component_id AND b.i < c.i),
u AS (SELECT component_id, i, j, k, ax, ay, az, nx / m AS nx, ny / m AS ny, nz / m AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS m FROM t) WHERE m > 1e-9),
f AS (SELECT component_id, i, j, k, any_value(u.nx) AS nx, any_value(u.ny) AS ny, any_value(u.nz) AS nz, max(d) - min(d) AS height FROM (SELECT u.*, (q.x - ax) * nx + (q.y - ay) * ny + (q.z - az) * nz AS d FROM u JOIN q USING (component_id)) u GROUP BY component_id, i, j, k HAVING min(d) > -1e-9 OR max(d) < 1e-9),
e AS (SELECT f.*, a.i AS pa, b.i AS pb, b.x - a.x - s * nx AS ex, b.y - a.y - s * ny AS ey, b.z - a.z - s * nz AS ez FROM f JOIN q a ON f.component_id = a.component_id JOIN q b ON a.component_id = b.component_id AND a.i < b.i, LATERAL (SELECT (b.x - a.x) * nx + (b.y - a.y) * ny + (b.z - a.z) * nz AS s)),
v AS (SELECT component_id, i, j, k, pa, pb, nx, ny, nz, height, ex / m AS ex, ey / m AS ey, ez / m AS ez FROM (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS m FROM e) WHERE m > 1e-9),
r AS (SELECT v.component_id, i, j, k, pa, pb, any_value(height) AS height, max(q.x * ex + q.y * ey + q.z * ez) - min(q.x * ex + q.y * ey + q.z * ez) AS along,
      max(q.x * (ny * ez - nz * ey) + q.y * (nz * ex - nx * ez) + q.z * (nx * ey - ny * ex)) - min(q.x * (ny * ez - nz * ey) + q.y * (nz * ex - nx * ez) + q.z * (nx * ey - ny * ex)) AS across
      FROM v JOIN (SELECT component_id, i AS at, x, y, z FROM q) q USING (component_id) GROUP BY v.component_id, i, j, k, pa, pb)
SELECT w.component_id, w.points, round(coalesce(min(height * along * across), 0), 6) + 0.0 AS volume FROM w LEFT JOIN r USING (component_id) GROUP BY w.component_id, w.points""")
def oriented_boxes(spark, sf_dir):
    """The least box on a face of the hull of each label's points."""
    p = points(spark, sf_dir).withColumn("component_id", F.coalesce("label", F.lit(-1)))
    found = oriented.oriented_boxes(p).select("component_id", "volume")
    return p.groupBy("component_id").agg(F.count(F.lit(1)).alias("points")).join(found, "component_id").select("component_id", "points", rounded(F.col("volume")).alias("volume"))


# The twelve triangles of a box, as numbers of its corners: two to a side.
_SIDES = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
_DRAW = "CAST('0x' || substr(md5('5:' || sample || ':{k}'), 1, 13) AS BIGINT) / 4503599627370496"


@query("surface_samples", f"""WITH {COMPONENTS}, k AS (SELECT component_id, [[lo[1], lo[2], lo[3]], [hi[1], lo[2], lo[3]], [hi[1], hi[2], lo[3]], [lo[1], hi[2], lo[3]], [lo[1], lo[2], hi[3]], [hi[1], lo[2], hi[3]], [hi[1], hi[2], hi[3]], [lo[1], hi[2], hi[3]]] AS corners FROM c WHERE lo IS NOT NULL),
s AS (SELECT component_id, t.side AS side, corners[t.a + 1] AS a, corners[t.b + 1] AS b, corners[t.c + 1] AS c FROM k, (VALUES {", ".join(str((i, *t)) for i, t in enumerate(_SIDES))}) t(side, a, b, c)),
m AS (SELECT *, sqrt(pow((b[2] - a[2]) * (c[3] - a[3]) - (b[3] - a[3]) * (c[2] - a[2]), 2) + pow((b[3] - a[3]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[3] - a[3]), 2) + pow((b[1] - a[1]) * (c[2] - a[2]) - (b[2] - a[2]) * (c[1] - a[1]), 2)) / 2 AS area FROM s),
u AS (SELECT *, CAST(round(area / (SELECT sum(area) FROM m) * 4503599627370496) AS BIGINT) AS units FROM m WHERE area > 0), l AS (SELECT *, sum(units) OVER (ORDER BY component_id, side) AS hi, (SELECT count(*) FROM u) AS n, (SELECT sum(units) FROM u) AS total FROM u),
d AS (SELECT sample, least(total - 1, floor((sample + {_DRAW.format(k=0)}) / n * total)) AS place, sqrt({_DRAW.format(k=1)}) AS r, {_DRAW.format(k=2)} AS s FROM (SELECT unnest(range(n)) AS sample, n, total FROM (SELECT DISTINCT n, total FROM l)))
SELECT sample, component_id, side, {", ".join(f"round((1 - r) * a[{i}] + r * (1 - s) * b[{i}] + r * s * c[{i}], 6) + 0.0 AS {n}" for i, n in ((1, "x"), (2, "y"), (3, "z")))} FROM d JOIN l ON place >= hi - units AND place < hi""")
def surface_samples(spark, sf_dir):
    """As many points as the sides of all components' boxes have triangles, drawn from those by area."""
    boxed = components(spark, sf_dir).where("lo IS NOT NULL").select("component_id", "corners")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), *[F.col("corners")[v].alias(n) for v, n in zip(t, "abc", strict=True)]) for i, t in enumerate(_SIDES)]))
    faces = boxed.select("component_id", sides.alias("f")).select("component_id", "f.*")
    found = sampling.surface_samples(faces, ["component_id", "side"], faces.where(sampling.area(F.col("a"), F.col("b"), F.col("c")) > 0).count(), 5)
    return found.select("sample", "component_id", "side", *[rounded(F.col("p")[i]).alias(n) for i, n in enumerate("xyz")])
