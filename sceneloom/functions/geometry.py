"""Boxes, poses and cells as column expressions; points are arrays of three doubles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def axis(points: Column, i: int) -> Column:
    """The i-th coordinate of each point of an array of points."""
    return F.transform(points, lambda p: p[i])


def permuted(p: Column) -> Column:
    """(x, y, z) -> (y, z, x): stored frame to the viewer's."""
    return F.array(p[1], p[2], p[0])


def unpermuted(p: Column) -> Column:
    """The inverse of ``permuted``."""
    return F.array(p[2], p[0], p[1])


def permuted_box(corners: Column) -> Column:
    """The corners in the viewer's frame, and nothing else; null for a box without corners."""
    return F.transform(corners, permuted)


def low_high(corners: Column) -> tuple[Column, Column]:
    """Ends of the space diagonal of a box; null without corners."""
    some = F.size(corners) > 0
    ends = [F.when(some, F.array(*[f(axis(corners, i)) for i in range(3)])) for f in (F.array_min, F.array_max)]
    return ends[0], ends[1]


def box_corners(lo: Column, hi: Column) -> Column:
    """The eight corners: the lower face against the clock from the least corner, then the upper face."""
    ends = (lo, hi)
    return F.array(*[F.array(ends[x][0], ends[y][1], ends[z][2]) for z in (0, 1) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])


def centroid(corners: Column) -> Column:
    """Mean of the corners."""
    return F.array(*[F.aggregate(axis(corners, i), F.lit(0.0), lambda a, x: a + x) / F.size(corners) for i in range(3)])


def middle(lo: Column, hi: Column) -> Column:
    return F.transform(F.arrays_zip(lo.alias("a"), hi.alias("b")), lambda z: (z["a"] + z["b"]) / 2)


def extent(lo: Column, hi: Column) -> Column:
    return F.transform(F.arrays_zip(lo.alias("a"), hi.alias("b")), lambda z: z["b"] - z["a"])


def distance(a: Column, b: Column, axes: int = 3) -> Column:
    return F.sqrt(sum((F.pow(a[i] - b[i], F.lit(2.0)) for i in range(axes)), F.lit(0.0)))


def overlap_xy(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Closed intervals overlap on both horizontal axes; true where an end is missing."""
    meets = (lo[0] <= other_hi[0]) & (hi[0] >= other_lo[0]) & (lo[1] <= other_hi[1]) & (hi[1] >= other_lo[1])
    return F.coalesce(meets, F.lit(True))


def rotation(q: Column) -> list[list[Column]]:
    """Rows of the rotation matrix of a unit quaternion (w, x, y, z)."""
    w, x, y, z = (q[i] for i in range(4))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion(m: Sequence[Sequence[Column]]) -> Column:
    """The unit quaternion (w, x, y, z), w >= 0, of a rotation matrix: the largest component first, by which the others are divided."""
    t = [1 + m[0][0] + m[1][1] + m[2][2], 1 + m[0][0] - m[1][1] - m[2][2], 1 - m[0][0] + m[1][1] - m[2][2], 1 - m[0][0] - m[1][1] + m[2][2]]
    d = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    s = {(0, 1): m[0][1] + m[1][0], (0, 2): m[0][2] + m[2][0], (1, 2): m[1][2] + m[2][1]}
    rows = [[t[0], *d], [d[0], t[1], s[0, 1], s[0, 2]], [d[1], s[0, 1], t[2], s[1, 2]], [d[2], s[0, 2], s[1, 2], t[3]]]
    biggest = F.greatest(*t)
    chosen = F.coalesce(*[F.when(t[i] == biggest, F.array(*rows[i])) for i in range(4)])
    half = 2 * F.sqrt(biggest)
    sign = F.when(chosen[0] < 0, -1.0).otherwise(1.0)
    return F.transform(chosen, lambda c: sign * c / half)


def rotated(m: Sequence[Sequence[Column]], p: Column) -> list[Column]:
    return [sum((row[i] * p[i] for i in range(3)), F.lit(0.0)) for row in m]


def to_camera(q: Column, t: Column, p: Column) -> Column:
    """A world point in the camera's frame."""
    return F.array(*[r + t[i] for i, r in enumerate(rotated(rotation(q), p))])


def camera_centre(q: Column, t: Column) -> Column:
    """Where the camera stands: -R^T t."""
    m = rotation(q)
    return F.array(*[-sum((m[j][i] * t[j] for j in range(3)), F.lit(0.0)) for i in range(3)])


def signed_axes(p: Column, axes: list[int]) -> Column:
    """The point with other axes: each of ``axes`` is 1, 2 or 3 for a coordinate, with a minus for its opposite."""
    return F.array(*[p[abs(i) - 1] if i > 0 else -p[abs(i) - 1] for i in axes])


def moved(p: Column, rotation_rows: list[list[float]], shift: list[float], scale: float = 1.0) -> Column:
    """The point after a similarity transform: scale * R p + shift."""
    return F.array(*[scale * sum((F.lit(float(r[j])) * p[j] for j in range(3)), F.lit(0.0)) + shift[i] for i, r in enumerate(rotation_rows)])


def moved_pose(q: Column, t: Column, rotation_rows: list[list[float]], shift: list[float], scale: float = 1.0) -> tuple[Column, Column]:
    """(q, t) of a camera after the world moved by ``moved``: R' = R R_w^T, t' = scale * t - R' shift, so that projections stay where they are."""
    m = rotation(q)
    turned = [[sum((m[i][k] * float(rotation_rows[j][k]) for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    at = F.array(*[scale * t[i] - sum((turned[i][j] * float(shift[j]) for j in range(3)), F.lit(0.0)) for i in range(3)])
    return quaternion(turned), at


def intrinsics(model: Column, params: Column) -> Column:
    """(fx, fy, cx, cy) by camera model."""
    one_focal = model.isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE")
    return F.when(one_focal, F.array(params[0], params[0], params[1], params[2])).otherwise(F.slice(params, 1, 4))


def projected(q: Column, t: Column, model: Column, params: Column, p: Column, nearest: float = 1e-5) -> Column:
    """struct(u, v, depth, in_front) of a world point in an image; models with distortion are SIMPLE_RADIAL, RADIAL and OPENCV."""
    f = intrinsics(model, params)
    k1 = F.when(model.isin("SIMPLE_RADIAL", "RADIAL"), params[3]).when(model == "OPENCV", params[4]).otherwise(0.0)
    k2 = F.when(model == "RADIAL", F.get(params, F.lit(4))).when(model == "OPENCV", F.get(params, F.lit(5))).otherwise(0.0)
    p1, p2 = (F.when(model == "OPENCV", F.get(params, F.lit(i))).otherwise(0.0) for i in (6, 7))

    def flat(c: Column) -> Column:
        z = F.when(c[2] > nearest, c[2]).otherwise(1.0)
        return F.struct((c[0] / z).alias("x"), (c[1] / z).alias("y"), c[2].alias("depth"))

    def bent(n: Column) -> Column:
        r2 = n["x"] * n["x"] + n["y"] * n["y"]
        return F.struct(n["x"].alias("x"), n["y"].alias("y"), n["depth"].alias("depth"), r2.alias("r2"), (1 + k1 * r2 + k2 * r2 * r2).alias("radial"))

    def seen(n: Column) -> Column:
        x, y, r2 = n["x"], n["y"], n["r2"]
        u = f[0] * (x * n["radial"] + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) + f[2]
        v = f[1] * (y * n["radial"] + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) + f[3]
        return F.struct(u.alias("u"), v.alias("v"), n["depth"].alias("depth"), (n["depth"] > nearest).alias("in_front"))

    value = to_camera(q, t, p)
    for step in (flat, bent, seen):
        value = _let(value, step)
    return value


def depth_agrees(depth: Column, measured: Column, absolute: float = 0.05, relative: float = 0.02) -> Column:
    """A measured depth (0: none) is near enough to the expected one."""
    return (measured > 0) & (F.abs(measured - depth) <= F.greatest(F.lit(absolute), relative * measured))


def depth_pixel(u: Column, size: Column, depth_size: Column) -> Column:
    """The pixel of a depth map of another size that shows image pixel u."""
    return F.rint((u + 0.5) * depth_size / size - 0.5).cast("int")


def voxel(p: Column, lo: Column, hi: Column, size: float) -> Column:
    """Flat number of the voxel of a point in the box lo..hi with cells of about ``size``."""
    cells = [F.greatest(F.ceil((hi[i] - lo[i]) / size), F.lit(1)).cast("long") for i in range(3)]
    reach = [F.when(hi[i] > lo[i], hi[i] - lo[i]).otherwise(1.0) for i in range(3)]
    at = [F.least(F.greatest(((p[i] - lo[i]) / reach[i] * cells[i]).cast("long"), F.lit(0)), cells[i] - 1) for i in range(3)]
    return (at[0] * cells[1] + at[1]) * cells[2] + at[2]


def cell_of(value: Column, origin: Column, size: Column) -> Column:
    """Grid cell of a coordinate, truncated toward zero."""
    return ((value - origin) / size).cast("int")


def cell_centre(cell: Column, origin: Column, size: Column) -> Column:
    return origin + (cell + 0.5) * size


def segment_distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Least distance between the segments ab and cd, which may be points.

    The unconstrained optimum is clamped to one segment, the best point of the other is
    taken and clamped, and the first one is fitted to that again.
    """
    minus = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def dots(r: Column) -> Column:
        dot = lambda x, y: sum((r[x][i] * r[y][i] for i in range(3)), F.lit(0.0))
        return F.struct(r.alias("r"), *[dot(x, y).alias(x + y) for x, y in ("uu", "vv", "uv", "uw", "vw")])

    def first(k: Column) -> Column:
        det = k["uu"] * k["vv"] - k["uv"] * k["uv"]
        inner = unit((k["uv"] * k["vw"] - k["vv"] * k["uw"]) / det)
        s = F.when(k["uu"] <= 0, 0.0).when(k["vv"] <= 0, unit(-k["uw"] / k["uu"])).when(det <= 1e-12 * k["uu"] * k["vv"], 0.0).otherwise(inner)
        return F.struct(k.alias("k"), s.alias("s"))

    def second(m: Column) -> Column:
        k = m["k"]
        return F.struct(k.alias("k"), m["s"].alias("s"), F.when(k["vv"] <= 0, 0.0).otherwise((k["uv"] * m["s"] + k["vw"]) / k["vv"]).alias("t"))

    def fitted(m: Column) -> Column:
        k, t = m["k"], unit(m["t"])
        s = F.when(k["uu"] <= 0, 0.0).when(m["t"] == t, m["s"]).otherwise(unit((t * k["uv"] - k["uw"]) / k["uu"]))
        return F.struct(k["r"].alias("r"), s.alias("s"), t.alias("t"))

    def length(m: Column) -> Column:
        return F.sqrt(sum((F.pow(m["r"]["w"][i] + m["s"] * m["r"]["u"][i] - m["t"] * m["r"]["v"][i], F.lit(2.0)) for i in range(3)), F.lit(0.0)))

    value = F.struct(minus(b, a).alias("u"), minus(d, c).alias("v"), minus(a, c).alias("w"))
    for step in (dots, first, second, fitted):
        value = _let(value, step)
    return _let(value, length)


def clamped_crop(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Pixel bounds of a crop, rounded half to even and cut to the image; null if nothing is left."""
    left, top, right, bottom = (F.rint(c).cast("int") for c in (x0, y0, x1, y1))
    box = F.struct(F.greatest(left, F.lit(0)).alias("x0"), F.greatest(top, F.lit(0)).alias("y0"), F.least(right, width).alias("x1"), F.least(bottom, height).alias("y1"))
    return F.when((right > left) & (bottom > top) & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)
