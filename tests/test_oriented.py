"""Oriented boxes against all triples of points as faces and all pairs as directions."""

from itertools import combinations

import numpy as np
import pytest

from sceneloom.operators import oriented


def turned(p, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    return p @ q.T


def brute(p):
    """The least volume over every triple with all points on one side, and every pair's direction in its plane."""
    least = np.inf
    pairs = np.array(list(combinations(range(len(p)), 2)))
    lines = p[pairs[:, 1]] - p[pairs[:, 0]]
    for i, j, k in combinations(range(len(p)), 3):
        n = np.cross(p[j] - p[i], p[k] - p[i])
        n /= np.linalg.norm(n)
        up = (p - p[i]) @ n
        if up.min() < -1e-9 and up.max() > 1e-9:
            continue
        u = lines - np.outer(lines @ n, n)
        u = u[np.linalg.norm(u, axis=1) > 1e-9]
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        area = np.ptp(p @ u.T, axis=0) * np.ptp(p @ np.cross(n, u).T, axis=0)
        least = min(least, area.min() * np.ptp(up))
    return least


def frame_of(spark, groups):
    rows = [(c, *map(float, x)) for c, p in groups.items() for x in p]
    return spark.createDataFrame(rows, "component_id long, x double, y double, z double").repartition(3)


def found(spark, groups, **options):
    return {r["component_id"]: r for r in oriented.oriented_boxes(frame_of(spark, groups), **options).collect()}


def inside(p, r):
    q = (p - np.array(r["center"])) @ np.array(r["rotation"])
    return (np.abs(q) <= np.array(r["extents"]) / 2 + 1e-7).all()


def test_boxes_are_the_least_of_all_faces(spark):
    rng = np.random.default_rng(3)
    groups = {i: turned(rng.normal(size=(n, 3)) * [1, 2, 5], i) for i, n in enumerate((4, 5, 8, 13, 20))}
    got = found(spark, groups)
    for i, p in groups.items():
        r = got[i]
        assert r["volume"] == pytest.approx(brute(p), rel=1e-9) and r["rank"] == 3 and inside(p, r)
        assert np.linalg.det(r["rotation"]) == pytest.approx(1) and r["volume"] == pytest.approx(np.prod(r["extents"]))
        corners = np.array(r["corners"])
        assert np.allclose(corners.mean(0), r["center"]) and np.allclose(np.linalg.norm(corners[1] - corners[0]), r["extents"][0]) and np.allclose(np.linalg.norm(corners[4] - corners[0]), r["extents"][2])


def test_a_turned_room_is_found_in_parts(spark):
    """A box with a grid on its sides, points within and each point twice; parts of 64 points give what one part gives."""
    grid = np.stack(np.meshgrid(*[np.linspace(0, 1, 9)] * 3), -1).reshape(-1, 3)
    p = turned(np.concatenate([grid, grid]) * [2, 3, 7] + [10, -4, 2])
    for size in (64, 10_000):
        r = found(spark, {1: p}, group_points=size)[1]
        assert sorted(r["extents"]) == pytest.approx([2, 3, 7]) and 8 <= r["hull_points"] <= 12 and inside(p, r)


def test_spheres_end_although_no_round_thins_them(spark):
    p = np.random.default_rng(5).normal(size=(600, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    r = found(spark, {1: p}, group_points=50)[1]
    assert r["hull_points"] == 600 and 7.0 < r["volume"] <= 8.0 and inside(p, r)


def test_flat_thin_and_single_groups(spark):
    rng = np.random.default_rng(7)
    square = np.array([[0, 0, 0], [2, 0, 0], [2, 1, 0], [0, 1, 0], [1, 0.5, 0]])
    line = np.outer([0, 1, 2, 5], [1, 1, 0])
    groups = {1: turned(square), 2: line, 3: np.array([[4.0, 5, 6]] * 3), 4: turned(np.c_[rng.random((30, 2)), np.zeros(30)])}
    got = found(spark, groups)
    assert [got[i]["rank"] for i in (1, 2, 3, 4)] == [2, 1, 0, 2]
    assert got[1]["extents"] == pytest.approx(sorted(got[1]["extents"][:2])[::-1] + [0]) or got[1]["extents"] == pytest.approx(sorted(got[1]["extents"][:2]) + [0])
    assert sorted(got[1]["extents"]) == pytest.approx([0, 1, 2]) and sorted(got[2]["extents"]) == pytest.approx([0, 0, 5 * 2**0.5]) and got[3]["extents"] == [0, 0, 0]
    assert got[3]["center"] == [4, 5, 6] and all(inside(groups[i], got[i]) for i in groups)


def test_rows_without_place_drop_out(spark):
    rows = [(1, 0.0, 0.0, None), (1, float("nan"), 0.0, 0.0), (1, 0.0, float("inf"), 1.0), (None, 1.0, 1.0, 1.0), (2, 1.0, 2.0, 3.0)]
    got = oriented.oriented_boxes(spark.createDataFrame(rows, "component_id long, x double, y double, z double")).collect()
    assert [(r["component_id"], r["center"]) for r in got] == [(2, [1, 2, 3])]
    assert oriented.oriented_boxes(spark.createDataFrame([], "component_id long, x double, y double, z double")).count() == 0
