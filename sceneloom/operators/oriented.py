"""Oriented boxes of point groups: hulls of hulls, then the boxes that lie on a face of the last one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.session import materialised

#: Points that one task makes a hull of until no group is larger or none shrinks any more; faces of one hull that a row deals out.
GROUP_POINTS, FACES = 4096, 64
#: Lengths below this share of a group's extent count as none.
FLAT = 1e-9

_POINTS = "component_id long, x double, y double, z double"
_BOX = "component_id long, center array<double>, extents array<double>, rotation array<array<double>>, volume double, rank int, hull_points long"


def _farthest(heights: np.ndarray, p: np.ndarray, origin: np.ndarray, eps: float) -> int:
    """The highest point; of equal ones that farthest from ``origin``, as it is a corner of what they span."""
    return int(np.where(heights >= heights.max() - eps, np.linalg.norm(p - origin, axis=1), -1).argmax())


def frame(p: np.ndarray) -> tuple[int, np.ndarray, list[int]]:
    """The dimension that points span (0 to 3), orthonormal axes of which the first ones span it, and the points that were farthest out."""
    shifted = p - p[0]
    scale, axes, picked = np.abs(shifted).max(initial=0.0), [], [0]
    rest = shifted
    for _ in range(3):
        lengths = np.linalg.norm(rest, axis=1)
        far = _farthest(lengths, p, p[0], FLAT * scale)
        if lengths[far] <= FLAT * scale or lengths[far] == 0:
            break
        axes.append(rest[far] / lengths[far])
        picked.append(far)
        rest = rest - np.outer(rest @ axes[-1], axes[-1])
    rank = len(axes)
    while len(axes) < 3:
        away = np.eye(3)[np.abs(np.array(axes).reshape(-1, 3)).sum(0).argmin()]
        for a in axes:
            away = away - (away @ a) * a
        axes.append(away / np.linalg.norm(away))
    return rank, np.array(axes), picked


def _ring(q: np.ndarray) -> np.ndarray:
    """Corners of the hull of points of a plane, in turn."""
    order = np.lexsort((q[:, 1], q[:, 0]))
    least = FLAT * np.ptp(q, axis=0).max() ** 2

    def chain(ids: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1 and np.linalg.det([q[out[-1]] - q[out[-2]], q[i] - q[out[-2]]]) <= least:
                out.pop()
            out.append(int(i))
        return out[:-1]

    return np.array(chain(order) + chain(order[::-1]))


def _planes(p: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    normals = np.cross(p[faces[:, 1]] - p[faces[:, 0]], p[faces[:, 2]] - p[faces[:, 0]])
    lengths = np.linalg.norm(normals, axis=1, keepdims=True)
    normals = normals / np.where(lengths == 0, 1, lengths)
    return normals, np.einsum("ij,ij->i", normals, p[faces[:, 0]])


def hull_faces(p: np.ndarray, picked: list[int]) -> np.ndarray:
    """Triangles (outward) of the hull of points that span space, grown from four of them by the point farthest outside a face."""
    eps = FLAT * np.abs(p - p[0]).max()
    a, b, c, d = picked
    if np.linalg.det([p[b] - p[a], p[c] - p[a], p[d] - p[a]]) > 0:
        b, c = c, b
    faces = np.array([(a, b, c), (a, c, d), (a, d, b), (b, d, c)])
    normals, offsets = _planes(p, faces)

    def dealt(ids: np.ndarray, normals: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        over = p[ids] @ normals.T - offsets
        home = over.argmax(1)
        out = over.max(1, initial=-np.inf) > eps
        return [ids[out & (home == k)] for k in range(len(normals))]

    outside = dealt(np.arange(len(p)), normals, offsets)
    while (at := next((k for k, ids in enumerate(outside) if len(ids)), None)) is not None:
        new = outside[at][_farthest(p[outside[at]] @ normals[at], p[outside[at]], p[faces[at, 0]], eps)]
        seen = normals @ p[new] - offsets > eps
        seen[at] = True
        edges = faces[seen][:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2)
        inner = set(map(tuple, edges[:, ::-1].tolist()))
        rim = np.array([e for e in edges.tolist() if tuple(e) not in inner])
        grown = np.column_stack([rim, np.full(len(rim), new)])
        grown_normals, grown_offsets = _planes(p, grown)
        loose = np.concatenate([ids for ids, s in zip(outside, seen, strict=True) if s])
        outside = [ids for ids, s in zip(outside, seen, strict=True) if not s] + dealt(loose[loose != new], grown_normals, grown_offsets)
        faces, normals, offsets = np.concatenate([faces[~seen], grown]), np.concatenate([normals[~seen], grown_normals]), np.concatenate([offsets[~seen], grown_offsets])
    return faces


def corners_of(p: np.ndarray) -> np.ndarray:
    """The points of ``p`` that are corners of its hull, each once, ascending."""
    p = np.unique(p, axis=0)
    rank, axes, picked = frame(p)
    if rank == 3:
        return p[np.unique(hull_faces(p, picked))]
    if rank == 2:
        return p[np.sort(_ring((p - p[0]) @ axes[:2].T))]
    along = (p - p[0]) @ axes[0]
    return p[np.unique([along.argmin(), along.argmax()])]


def directions(p: np.ndarray) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """The dimension of corners ``p`` and, for each face of their hull, its normal and the directions in its plane that a least box may take.

    Seen along the normal, the outline of the hull is made of the edges between faces turned to and away from the onlooker; a least rectangle lies on one of them.
    """
    rank, axes, picked = frame(p)
    if rank == 3:
        faces = hull_faces(p, picked)
        normals, _ = _planes(p, faces)
        side = {(i, j): k for k, f in enumerate(faces.tolist()) for i, j in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))}
        pairs = np.array([(i, j, k, side[j, i]) for (i, j), k in side.items() if i < j and (j, i) in side])
        out = []
        for n in normals[np.linalg.norm(normals, axis=1) > 0]:
            front = normals @ n > FLAT
            rim = pairs[front[pairs[:, 2]] != front[pairs[:, 3]]]
            out.append((n, p[rim[:, 1]] - p[rim[:, 0]]))
        return rank, out
    if rank == 2:
        ring = _ring((p - p[0]) @ axes[:2].T)
        return rank, [(axes[2], p[np.roll(ring, -1)] - p[ring])]
    return rank, [(axes[2], axes[:1])]


def least_box(p: np.ndarray, faces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, extents and rotation (columns are the box's axes) of the least box over ``faces``; the first of equal ones."""
    best, least = None, np.inf
    middle = p.mean(0)
    q = p - middle
    for n, edges in faces:
        flat = edges - np.outer(edges @ n, n)
        lengths = np.linalg.norm(flat, axis=1)
        u = flat[lengths > FLAT * np.abs(q).max(initial=0)] / lengths[lengths > FLAT * np.abs(q).max(initial=0), None]
        if not len(u):
            continue
        v = np.cross(n, u)
        along, across, up = q @ u.T, q @ v.T, q @ n
        area = np.ptp(along, axis=0) * np.ptp(across, axis=0)
        k = int(area.argmin())
        if best is None or area[k] * np.ptp(up) < least:
            least = area[k] * np.ptp(up)
            best = np.column_stack([u[k], v[k], n])
    best = np.eye(3) if best is None else best
    turned = q @ best
    return middle + best @ ((turned.max(0) + turned.min(0)) / 2), np.ptp(turned, axis=0), best


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The corners of each group's rows in a batch: what goes into a shuffle."""
    for batch in batches:
        for component, rows in batch.groupby("component_id", sort=False):
            yield _hull(rows.assign(component_id=component))


def _hull(rows: pd.DataFrame) -> pd.DataFrame:
    p = corners_of(rows[["x", "y", "z"]].to_numpy())
    return pd.DataFrame({"component_id": rows["component_id"].iloc[0], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})


def hulls(points: DataFrame, group_points: int = GROUP_POINTS) -> DataFrame:
    """component_id, x, y, z: the corners of the hull of each group of ``points`` (component_id, x, y, z).

    Corners of a part's hull are all that the whole can need: batches are thinned before they are shuffled, and groups above ``group_points`` are dealt by a hash of
    place to parts whose corners go on, until every group is small or a round takes less than a tenth away.  Rows with a null or non-finite coordinate, or without
    component, drop out; repeated points count once.  A group whose points nearly all are corners (a sphere's) ends in one task with those.
    """
    whole = F.col("component_id").isNotNull()
    for a in "xyz":
        whole = whole & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < float("inf"))
    rows = points.select(F.col("component_id").cast("long").alias("component_id"), *[F.col(a).cast("double").alias(a) for a in "xyz"]).where(whole)
    held = materialised(rows.mapInPandas(_partial, _POINTS))
    while True:
        sizes = held.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
        before = sizes.where(F.col("size") > group_points).agg(F.sum("size")).first()[0]
        if not before:
            break
        parted = held.join(sizes, "component_id").withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), F.ceil(F.col("size") / group_points)))
        thinned = parted.groupBy("component_id", "part").applyInPandas(lambda key, rows: _hull(rows), _POINTS)
        held = materialised(thinned)
        after = held.join(sizes.where(F.col("size") > group_points), "component_id", "left_semi").count()
        if after > 0.9 * before:
            break
    return held.groupBy("component_id").applyInPandas(_hull, _POINTS)


def _faces(rows: pd.DataFrame) -> pd.DataFrame:
    p = rows[["x", "y", "z"]].sort_values(["x", "y", "z"]).to_numpy()
    rank, found = directions(p)
    normals = np.array([n for n, _ in found])
    starts = range(0, len(found), FACES)
    return pd.DataFrame({
        "component_id": rows["component_id"].iloc[0], "chunk": [*starts], "rank": rank, "corners": [p.ravel()] * len(starts),
        "normals": [normals[i : i + FACES].ravel() for i in starts], "edges": [np.concatenate([e for _, e in found[i : i + FACES]]).ravel() for i in starts], "sizes": [[len(e) for _, e in found[i : i + FACES]] for i in starts],
    })


def _boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples():
            p, normals, edges = (np.asarray(a).reshape(-1, 3) for a in (r.corners, r.normals, r.edges))
            center, extents, turn = least_box(p, list(zip(normals, np.split(edges, np.cumsum(r.sizes)[:-1]), strict=True)))
            out.append((r.component_id, center.tolist(), extents.tolist(), turn.tolist(), float(extents.prod()), r.rank, len(p), r.chunk))
        yield pd.DataFrame(out, columns=["component_id", "center", "extents", "rotation", "volume", "rank", "hull_points", "chunk"])


def oriented_boxes(points: DataFrame, group_points: int = GROUP_POINTS) -> DataFrame:
    """component_id, center, extents, rotation, corners, volume, rank, hull_points: for each group of ``points`` the least box with a side on a face of its hull.

    ``rotation`` has the box's axes as columns, right-handed, the face's normal last; ``extents`` go along them, and the eight ``corners`` round the bottom, then round the top.
    ``rank`` is the dimension that the points span: 3, or 2 (one plane), 1 (one line) and 0 (one place), whose boxes have extents of about 0 and are least within the plane or line.
    Faces are dealt over tasks with their corners; the least volume wins, of equal ones that of the first face.  Rows that drop out: see ``hulls``; a group of which nothing is left has no row.
    """
    dealt = hulls(points, group_points).groupBy("component_id").applyInPandas(_faces, "component_id long, chunk long, rank int, corners array<double>, normals array<double>, edges array<double>, sizes array<long>")
    each = dealt.repartition("component_id", "chunk").mapInPandas(_boxes, _BOX + ", chunk long")
    least = each.groupBy("component_id").agg(F.min_by(F.struct("center", "extents", "rotation", "volume", "rank", "hull_points"), F.struct("volume", "chunk")).alias("box")).select("component_id", "box.*")
    signs = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
    along = lambda i, s: sum((F.col("rotation")[i][j] * F.col("extents")[j] * (s[j] / 2) for j in range(3)), F.col("center")[i])
    return least.withColumn("corners", F.array(*[F.array(*[along(i, s) for i in range(3)]) for s in signs])).select("component_id", "center", "extents", "rotation", "corners", "volume", "rank", "hull_points")
