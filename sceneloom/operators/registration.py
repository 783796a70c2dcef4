"""Rigid alignment of two point clouds: features of neighbourhoods, seeded draws of matches, closest points on planes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sceneloom.functions.geometry import distance, moved
from sceneloom.operators.cluster import normals, normals_of
from sceneloom.operators.spatial import _first_side
from sceneloom.operators.windows import renumbered
from sceneloom.session import materialised

#: Features of a cloud that one task compares with as many of the other, about.
BLOCK = 2_000
#: Parts of each of the three histograms of a feature.
BINS = 11
#: Neighbours that a normal and a feature are made of at most.
NORMAL_NEIGHBOURS, FEATURE_NEIGHBOURS = 12, 40
#: The shorter of two matching edges has this share of the longer at least.
EDGE = 0.8


@dataclass(frozen=True)
class Motion:
    """R p + shift; the share of the points or matches it was tried on that comes within reach, and the root mean square distance of that share."""

    rotation: tuple[tuple[float, ...], ...] = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    shift: tuple[float, ...] = (0.0, 0.0, 0.0)
    fitness: float = 0.0
    rmse: float = 0.0

    def apply(self, p: Column) -> Column:
        return moved(p, [list(r) for r in self.rotation], list(self.shift))

    def inverse(self) -> Motion:
        r = np.array(self.rotation).T
        return Motion(_rows(r), tuple((-r @ np.array(self.shift)).tolist()), self.fitness, self.rmse)


def _rows(matrix: np.ndarray) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(r) for r in matrix.tolist())


def _dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Column, b: Column) -> Column:
    return F.array(*[a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def finite(points: DataFrame) -> DataFrame:
    """id, p of the points whose three coordinates are finite."""
    return points.where((F.size("p") == 3) & F.forall("p", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("id", "p")


def thinned(points: DataFrame, voxel: float) -> DataFrame:
    """id, p: one point for each voxel with points, their mean, under their least id."""
    cell = [F.floor(F.col("p")[i] / voxel).alias(f"c{i}") for i in range(3)]
    return points.groupBy(*cell).agg(F.min("id").alias("id"), F.array(*[F.round(F.avg(F.col("p")[i]), 10) for i in range(3)]).alias("p")).select("id", "p")


def outward(points: DataFrame, found: DataFrame) -> DataFrame:
    """id, p, normal: the normals (id, normal) that were found, turned away from the mean of all points, so that they move with the cloud."""
    middle = points.agg(F.array(*[F.avg(F.col("p")[i]) for i in range(3)]).alias("middle"))
    each = points.join(found.hint("merge"), "id").crossJoin(F.broadcast(middle))
    inward = _dot(F.col("normal"), F.zip_with("p", "middle", lambda a, b: a - b)) < 0
    return each.select("id", "p", F.when(inward, F.transform("normal", lambda x: -x)).otherwise(F.col("normal")).alias("normal"))


def features(points: DataFrame, voxel: float) -> DataFrame:
    """id, embedding: fast point feature histograms of thinned ``points`` (id, p), three of ``BINS`` parts each, of length 1.

    A pair's three angles are those between its line and the normals of its ends in the frame of
    the first.  A point's own histograms count the pairs with its neighbours within five voxels, ``FEATURE_NEIGHBOURS`` at
    most; those of the neighbours are added, weighed by one over the distance.  A point without neighbours has no feature.
    """
    ranked = met(points, points, 5 * voxel).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "target_id"))).where(F.col("rank") <= FEATURE_NEIGHBOURS + 1)
    every = materialised(ranked.select(F.col("id").alias("query_id"), F.col("target_id").alias("point_id"), "distance", "rank"))
    placed = materialised(outward(points, normals_of(every.where(F.col("rank") <= NORMAL_NEIGHBOURS), points)))
    near = every.where("query_id <> point_id AND distance > 1e-12").drop("rank")
    pairs = near.join(placed.select(F.col("id").alias("query_id"), F.col("p").alias("p"), F.col("normal").alias("u")), "query_id").join(placed.select(F.col("id").alias("point_id"), F.col("p").alias("q"), F.col("normal").alias("n")), "point_id")
    lines = pairs.withColumn("d", F.transform(F.zip_with("q", "p", lambda a, b: a - b), lambda x: x / F.col("distance"))).withColumn("v", _cross(F.col("d"), F.col("u")))
    length = F.sqrt(_dot(F.col("v"), F.col("v")))
    framed = lines.withColumn("v", F.when(length > 1e-9, F.transform("v", lambda x: x / length)).otherwise(F.array(*[F.lit(0.0)] * 3))).withColumn("w", _cross(F.col("u"), F.col("v")))
    angles = [(_dot(F.col("v"), F.col("n")) + 1) / 2, (_dot(F.col("u"), F.col("d")) + 1) / 2, F.atan2(_dot(F.col("w"), F.col("n")), _dot(F.col("u"), F.col("n"))) / (2 * np.pi) + 0.5]
    # a little is taken off so that angles on an edge fall alike in both clouds
    binned = framed.select("query_id", *[F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(a * BINS - 1e-6))).alias(f"a{i}") for i, a in enumerate(angles)])
    own = materialised(binned.groupBy("query_id").agg(F.array(*[F.count_if(F.col(f"a{i}") == b) / F.count(F.lit(1)) for i in range(3) for b in range(BINS)]).alias("h")))
    others = near.join(own.withColumnsRenamed({"query_id": "point_id"}), "point_id").groupBy("query_id").agg(F.array(*[F.sum(F.col("h")[i] * voxel / F.col("distance")) / F.count(F.lit(1)) for i in range(3 * BINS)]).alias("o"))
    summed = own.join(others, "query_id").select(F.col("query_id").alias("id"), F.zip_with("h", "o", lambda a, b: a + b).alias("f"))
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x))
    return summed.select("id", F.transform("f", lambda x: x / norm).alias("embedding"))


def likest(source: DataFrame, target: DataFrame) -> DataFrame:
    """of_source, id, other: for each feature of either cloud (id, embedding) that of the other of the largest dot product; equal ones (to nine decimals) by id.

    All features are compared: both clouds are dealt into blocks of about ``BLOCK``, two blocks are one task's work, and it sends on one row for each feature.
    """
    parts = [max(1, math.ceil(c.count() / BLOCK)) for c in (source, target)]
    own = lambda c, n, name: c.where("embedding IS NOT NULL").withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    every = lambda c, n, name: c.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = every(own(source, parts[0], "i"), parts[1], "j")
    right = every(own(target, parts[1], "j"), parts[0], "i")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"of_source": [], "id": [], "other": [], "score": []}
        if len(a) and len(b):
            a, b = a.sort_values("id"), b.sort_values("id")
            u, v = (np.array(c["embedding"].tolist(), float) for c in (a, b))
            ids, others = a["id"].to_numpy(), b["id"].to_numpy()
            top, at = np.full(len(b), -np.inf), np.zeros(len(b), int)
            for lo in range(0, len(a), 256):
                score = np.round(u[lo : lo + 256] @ v.T, 9)
                first, held = score.argmax(1), score.max(0)
                out["of_source"] += [True] * len(score)
                out["id"] += ids[lo : lo + 256].tolist()
                out["other"] += others[first].tolist()
                out["score"] += score[np.arange(len(score)), first].tolist()
                better = held > top
                at[better], top[better] = lo + score.argmax(0)[better], held[better]
            out["of_source"] += [False] * len(b)
            out["id"] += others.tolist()
            out["other"] += ids[at].tolist()
            out["score"] += top.tolist()
        return pd.DataFrame(out)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "of_source boolean, id long, other long, score double")
    return found.groupBy("of_source", "id").agg(F.min_by("other", F.struct(-F.col("score"), F.col("other"))).alias("other"))


def matches(source: DataFrame, target: DataFrame, voxel: float) -> DataFrame:
    """source_id, target_id, p, q: points of two thinned clouds each of which has the other as the one of the likest feature."""
    best = materialised(likest(*(materialised(features(c, voxel)) for c in (source, target))))
    there = best.where("of_source").select(F.col("id").alias("source_id"), F.col("other").alias("target_id"))
    back = best.where("NOT of_source").select(F.col("other").alias("source_id"), F.col("id").alias("target_id"))
    return there.join(back, ["source_id", "target_id"]).join(source.withColumnsRenamed({"id": "source_id"}), "source_id").join(target.withColumnsRenamed({"id": "target_id", "p": "q"}), "target_id").select("source_id", "target_id", "p", "q")


def rigid(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and shifts of least squares that bring each row's points ``p`` (n, m, 3) to ``q``."""
    a, b = p.mean(1, keepdims=True), q.mean(1, keepdims=True)
    u, _, vt = np.linalg.svd(np.swapaxes(p - a, 1, 2) @ (q - b))
    turn = np.tile(np.eye(3), (len(p), 1, 1))
    turn[:, 2, 2] = np.sign(np.linalg.det(u @ vt))
    r = np.swapaxes(u @ turn @ vt, 1, 2)
    return r, b[:, 0] - np.einsum("nij,nj->ni", r, a[:, 0])


def _motions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            p, q = (np.array([[list(x) for x in row] for row in pdf[c]], float) for c in "pq")
            r, t = rigid(p, q)
            off = np.linalg.norm(np.einsum("nij,nmj->nmi", r, p) + t[:, None] - q, axis=2).max(1)
            yield pd.DataFrame({"trial": pdf["trial"], "m": list(np.concatenate([r.reshape(-1, 9), t], 1)), "off": off})


def drawn(pairs: DataFrame, reach: float, trials: int = 20_000, seed: int = 0) -> Motion | None:
    """The motion, of those that ``trials`` draws of three matches give, that brings most matches within ``reach``; None if no draw passes.

    Draws depend on the seed and the ids only.  A draw goes if its edges differ (``EDGE``) or its own three miss.
    What is left, at most twelve numbers a trial, goes through the driver to where the matches are, and each task
    sends back two sums a motion.  Equal motions: the smaller sum of squares, then the earlier draw.
    """
    spark = pairs.sparkSession
    numbered = materialised(renumbered(pairs.select("source_id", "p", "q"), "source_id").select("new_id", "p", "q"))
    n = numbered.count()
    if n < 3:
        return None
    trial = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j)), F.lit(n)).alias("new_id")) for j in range(3)])).alias("d")).select("trial", "d.j", "d.new_id")
    three = trial.join(numbered, "new_id").groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("j", "p", "q"))).alias("t"), F.count_distinct("new_id").alias("n")).where("n = 3")
    sides = [(distance(F.col("t")[i]["p"], F.col("t")[j]["p"]), distance(F.col("t")[i]["q"], F.col("t")[j]["q"])) for i, j in ((0, 1), (1, 2), (0, 2))]
    for a, b in sides:
        three = three.where((a >= EDGE * b) & (b >= EDGE * a) & (a > 0))
    kept = three.select("trial", F.col("t.p").alias("p"), F.col("t.q").alias("q")).mapInPandas(_motions, "trial long, m array<double>, off double").where(F.col("off") <= reach).orderBy("trial").collect()
    if not kept:
        return None
    ids, all_m = np.array([r["trial"] for r in kept]), np.array([r["m"] for r in kept])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, squares = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for pdf in batches:
            p, q = (np.array(pdf[c].tolist(), float).reshape(-1, 3) for c in "pq")
            for lo in range(0, len(ids), 64):
                m = all_m[lo : lo + 64]
                d = ((np.einsum("kij,nj->kni", m[:, :9].reshape(-1, 3, 3), p) + m[:, None, 9:] - q) ** 2).sum(2)
                inside = d <= reach * reach
                near[lo : lo + 64] += inside.sum(1)
                squares[lo : lo + 64] += np.where(inside, d, 0).sum(1)
        some = near > 0
        yield pd.DataFrame({"trial": ids[some], "near": near[some], "squares": squares[some]})

    sums = numbered.select("p", "q").mapInPandas(counted, "trial long, near long, squares double").groupBy("trial").agg(F.sum("near").alias("near"), F.sum("squares").alias("squares"))
    best = sums.orderBy(F.desc("near"), F.round("squares", 9), "trial").first()
    m = all_m[int(np.searchsorted(ids, best["trial"]))]
    return Motion(_rows(m[:9].reshape(3, 3)), tuple(m[9:].tolist()), best["near"] / n, float(np.sqrt(best["squares"] / best["near"])))


def met(source: DataFrame, target: DataFrame, reach: float) -> DataFrame:
    """id, p, target_id, q, distance and the target's further columns: pairs of points at most ``reach`` apart, by cells of twice that side.

    A target point is in each cell that it reaches, mostly eight.  Both clouds are shuffled: the file that a cloud comes from does not tell of these copies, so that a join left
    to choose would send them all through the driver.
    """
    side, wide = 2 * reach, reach * (1 + 1e-9)
    at = lambda x: F.floor(x / side)
    x, y, z = (F.sequence(at(F.col("q")[i] - wide), at(F.col("q")[i] + wide)) for i in range(3))
    cells = F.flatten(F.transform(x, lambda i: F.flatten(F.transform(y, lambda j: F.transform(z, lambda k: F.struct(i.alias("x"), j.alias("y"), k.alias("z")))))))
    extra = [c for c in target.columns if c not in ("id", "p")]
    there = target.select(F.col("id").alias("target_id"), F.col("p").alias("q"), *extra).withColumn("cell", F.explode(cells))
    here = source.select("id", "p", F.struct(*[at(F.col("p")[i]).alias("xyz"[i]) for i in range(3)]).alias("cell"))
    return here.join(there.hint("merge"), "cell").drop("cell").withColumn("distance", distance(F.col("p"), F.col("q"))).where(F.col("distance") <= reach)


def closest(source: DataFrame, target: DataFrame, reach: float) -> DataFrame:
    """id, p, q, distance and the target's further columns: each point of the source with the nearest of the target within ``reach``; ties by id."""
    extra = [c for c in target.columns if c not in ("id", "p")]
    return met(source, target, reach).groupBy("id").agg(F.min_by(F.struct("p", "q", "distance", *extra), F.struct("distance", "target_id")).alias("m")).select("id", "m.*")


def fitted(source: DataFrame, target: DataFrame, motions: list[Motion], reach: float) -> list[Motion]:
    """The motions with their fitness and error over all points of the source."""
    each = source.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), m.apply(F.col("p")).alias("p")) for k, m in enumerate(motions)])).alias("m"))
    near = closest(each.select(F.struct("m.k", "id").alias("id"), "m.p"), target.select("id", "p"), reach)
    sums = {r["k"]: r for r in near.groupBy("id.k").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("distance") ** 2)).alias("rmse")).collect()}
    n = max(1, source.count())
    return [Motion(m.rotation, m.shift, sums[k]["n"] / n, sums[k]["rmse"]) if k in sums else Motion(m.rotation, m.shift) for k, m in enumerate(motions)]


def refined(source: DataFrame, target: DataFrame, motion: Motion, reach: float, rounds: int = 30, still: float = 1e-10) -> Motion:
    """Iterative closest points: steps of least squares to the planes of the nearest target points (id, p, normal), or to the points themselves (id, p).

    A round is one join and 28 sums, which alone come to the driver.  It ends when a step moves nothing by more than ``still`` of the reach.
    """
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    axes = F.explode(F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)]))
    for _ in range(rounds):
        near = closest(source.select("id", motion.apply(F.col("p")).alias("p")), target, reach)
        near = near if "normal" in target.columns else near.withColumn("normal", axes)
        row = near.select(F.concat(_cross(F.col("p"), F.col("normal")), F.col("normal")).alias("g"), _dot(F.zip_with("q", "p", lambda a, b: a - b), F.col("normal")).alias("r"))
        sums = row.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("g")[i] * F.col("g")[j]).alias(f"a{i}{j}") for i, j in pairs], *[F.sum(F.col("g")[i] * F.col("r")).alias(f"b{i}") for i in range(6)]).first()
        if sums["n"] < 6:
            break
        a = np.zeros((6, 6))
        for i, j in pairs:
            a[i, j] = a[j, i] = sums[f"a{i}{j}"]
        step = np.linalg.lstsq(a, np.array([sums[f"b{i}"] for i in range(6)]), rcond=1e-12)[0]
        turn = float(np.linalg.norm(step[:3]))
        axis = step[:3] / turn if turn else step[:3]
        k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
        r = np.eye(3) + np.sin(turn) * k + (1 - np.cos(turn)) * k @ k
        motion = Motion(_rows(r @ np.array(motion.rotation)), tuple((r @ np.array(motion.shift) + step[3:]).tolist()))
        if np.abs(step).max() <= still * reach:
            break
    return motion


def spread(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The mean of points (p), and the axes along which they spread as columns, the least first."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    row = points.agg(*[F.avg(F.col("p")[i]) for i in range(3)], *[F.covar_pop(F.col("p")[i], F.col("p")[j]) for i, j in pairs]).first()
    m = np.zeros((3, 3))
    for (i, j), x in zip(pairs, row[3:], strict=True):
        m[i, j] = m[j, i] = x
    return np.array(row[:3]), np.linalg.eigh(m)[1]


def guesses(source: DataFrame, target: DataFrame) -> list[Motion]:
    """The shift of one mean to the other, and the four turns there that bring the axes of the source's spread to the target's: right for whole copies, however dense."""
    (a, u), (b, v) = spread(source), spread(target)
    turns = [np.eye(3)]
    for x, y in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
        r = v @ np.diag([x, y, x * y * np.linalg.det(u) * np.linalg.det(v)]) @ u.T
        turns.append(r)
    return [Motion(_rows(r), tuple((b - r @ a).tolist())) for r in turns]


def polished(source: DataFrame, target: DataFrame, motion: Motion, reach: float, rounds: int = 30) -> Motion:
    """The motion fitted to the points themselves, none of them thinned, as long as that brings more of the source within reach, or as many with less error.

    The reach is halved until few points share a cell of that side, and quartered after each success.  Points of one place are one.
    """
    a, b = (materialised(c.groupBy("p").agg(F.min("id").alias("id")).select("id", "p")) for c in (source, target))
    reach = least = _first_side(b, 12, reach)
    while reach > least / 64:
        before, after = fitted(a, b, [motion, refined(a, b, motion, reach, rounds)], reach)
        if (after.fitness, -after.rmse) <= (before.fitness, -before.rmse):
            break
        motion, reach = after, reach / 4
        if after.rmse <= 1e-9 * reach:
            break
    return motion


def aligned(source: DataFrame, target: DataFrame, voxel: float | None = None, scales: tuple[float, ...] = (4, 2, 1), trials: int = 20_000, seed: int = 0, rounds: int = 30) -> Motion:
    """The rigid motion that brings ``source`` (id, p) onto ``target`` (id, p); ids are unique, points that are not finite are left out.

    ``voxel`` is a fiftieth of the diagonal of the target's box by default.  At each scale both clouds are thinned to voxels of that
    many times the side, matched by features, and a motion is drawn; what means and axes say (``guesses``) are candidates, too.
    The candidate of the largest fitness (then least error) over both clouds at half a voxel is refined to planes, first over one point a voxel,
    then over one a quarter with quarters of the reach as long as half of the points that were met still are, and last to the points
    themselves (``polished``); fitness and error are within one and a half voxels.  An empty cloud gives the identity with fitness 0.
    The same rows and seed give the same draws.
    """
    source, target = finite(source), finite(target)
    box = target.agg(*[F.max(F.col("p")[i]) - F.min(F.col("p")[i]) for i in range(3)]).first()
    if box[0] is None or not source.limit(1).count():
        return Motion()
    voxel = voxel or float(np.linalg.norm(list(box))) / 50 or 1.0
    found = guesses(source, target)
    for scale in scales:
        a, b = (materialised(thinned(c, scale * voxel)) for c in (source, target))
        best = drawn(materialised(matches(a, b, scale * voxel)), 1.5 * scale * voxel, trials, seed)
        found += [best] if best else []
    half = [materialised(thinned(c, voxel / 2)) for c in (source, target)]
    motion, reach, side = max(fitted(*half, found, 1.5 * voxel), key=lambda m: (m.fitness, -m.rmse)), 2 * voxel, voxel
    share = motion.fitness
    while reach > voxel / 64:
        if side >= voxel / 4:
            a, b = (materialised(thinned(c, side)) for c in (source, target))
            b, side = materialised(outward(b, normals(b, NORMAL_NEIGHBOURS, voxel))), side / 4
        better = fitted(a, b, [refined(a, b, motion, reach, rounds, still=1e-4)], reach)[0]
        if better.fitness < 0.5 * share or not share:
            break
        motion, share, reach = better, better.fitness, reach / 4
    return fitted(*half, [polished(source, target, motion, voxel / 8, rounds)], 1.5 * voxel)[0]
