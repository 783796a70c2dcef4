import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.operators import registration as reg

AXIS = np.array([1.0, 2.0, -1.0]) / np.sqrt(6)
TURN = 1.1


def rotation(axis=AXIS, turn=TURN):
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(turn) * k + (1 - np.cos(turn)) * k @ k


def cloud(spark, p):
    return spark.createDataFrame([(i, x) for i, x in enumerate(p.tolist())], "id long, p array<double>")


@pytest.fixture(scope="module")
def room():
    """Points on three walls of different sizes and a ball, so that no other motion fits."""
    rng = np.random.default_rng(4)
    walls = [rng.random((220, 3)) * [4, 3, 0], rng.random((160, 3)) * [4, 0, 2], rng.random((120, 3)) * [0, 3, 2]]
    ball = rng.normal(size=(150, 3))
    return np.concatenate([*walls, [2.6, 1.9, 0.7] + 0.6 * ball / np.linalg.norm(ball, axis=1, keepdims=True)])


def test_rigid_motions_of_least_squares():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(5, 4, 3))
    r, t = reg.rigid(p, p @ rotation().T + [1, 2, 3])
    assert np.allclose(r, rotation()) and np.allclose(t, [1, 2, 3])


def test_features_move_with_the_cloud(spark, room):
    a, b = cloud(spark, room[::2]), cloud(spark, room[::2] @ rotation().T + [1.0, -2.0, 3.0])
    f, g = ({r["id"]: np.array(r["embedding"]) for r in reg.features(c, 0.15).collect()} for c in (a, b))
    assert f.keys() == g.keys() and len(f) > 300
    like = np.array([f[i] @ g[i] for i in f])
    assert np.median(like) > 0.999 and all(abs(x @ x - 1) < 1e-9 for x in f.values())


def test_closest_is_the_nested_loop(spark):
    rng = np.random.default_rng(8)
    p, q = rng.random((80, 3)), rng.random((90, 3))
    got = {r["id"]: r["distance"] for r in reg.closest(cloud(spark, p), cloud(spark, q), 0.12).collect()}
    d = np.linalg.norm(p[:, None] - q, axis=2).min(1)
    assert got == pytest.approx({i: x for i, x in enumerate(d.tolist()) if x <= 0.12})


def test_draws_with_wrong_matches(spark):
    """Of 300 matches two thirds are wrong; the same seed gives the same motion, and too few matches give none."""
    rng = np.random.default_rng(3)
    p = rng.random((300, 3)) * 5
    q = p @ rotation().T + [1, 2, 3]
    q[100:] = rng.random((200, 3)) * 5
    pairs = spark.createDataFrame([(i, i, x, y) for i, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True))], "source_id long, target_id long, p array<double>, q array<double>")
    found = [reg.drawn(pairs.repartition(n), 0.05, 2000, 5) for n in (2, 5)]
    assert np.allclose(found[0].rotation, rotation()) and np.allclose(found[0].shift, [1, 2, 3]) and 100 <= 300 * found[0].fitness < 110
    assert found[0] == found[1] and reg.drawn(pairs.limit(2), 0.05) is None


def test_a_known_motion_is_found(spark, room):
    """Each cloud lacks fifty points of the other and the source has noise: every point within a fifth of a voxel."""
    rng = np.random.default_rng(9)
    r, t = rotation(), np.array([5.0, -1.0, 2.0])
    kept = rng.permutation(len(room))
    source = (room[kept[:600]] - t) @ r + rng.normal(scale=0.002, size=(600, 3))  # r p + t is the room
    found = reg.aligned(cloud(spark, source), cloud(spark, room[kept[50:]]), 0.1, (2,), 4000, 7, 8)
    assert found.fitness > 0.8
    assert np.abs(np.array(found.rotation) @ source.T + np.array(found.shift)[:, None] - room[kept[:600]].T).max() < 0.02
    p = cloud(spark, source[:5]).select(found.inverse().apply(found.apply(F.col("p"))).alias("p")).collect()
    assert np.allclose([x["p"] for x in p], source[:5])


def test_nothing_to_align(spark):
    none, some = cloud(spark, np.zeros((0, 3))), spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [float("nan"), 0.0, 0.0]), (3, None), (4, [None, 1.0, 1.0])], "id long, p array<double>")
    assert reg.aligned(none, some) == reg.Motion() == reg.aligned(some, none)
    one = reg.aligned(some, some.withColumn("p", F.when(F.col("id") == 1, F.array(F.lit(3.0), F.lit(0.0), F.lit(0.0)))), 1.0, (1,), 10)
    assert one.shift == pytest.approx((3, 0, 0)) and one.fitness == 1


def test_likest_features_are_those_of_the_exact_search(spark, monkeypatch):
    """Blocks of seven give both directions of what ``similar`` finds, ties by id included."""
    from sceneloom.operators.similar import similar

    rng = np.random.default_rng(4)
    rows = [[(i, v.tolist()) for i, v in enumerate(np.vstack([w[:3], w]))] for w in (rng.normal(size=(20, 5)), rng.normal(size=(31, 5)))]
    a, b = (spark.createDataFrame(r, "id long, embedding array<double>") for r in rows)
    monkeypatch.setattr(reg, "BLOCK", 7)
    got = {(r["of_source"], r["id"]): r["other"] for r in reg.likest(a, b).collect()}
    for own, other, side in ((a, b, True), (b, a, False)):
        want = similar(other.withColumnRenamed("id", "component_id"), own.withColumnRenamed("id", "query_id"), 1).collect()
        assert {(side, r["query_id"]): r["component_id"] for r in want}.items() <= got.items()
    assert len(got) == 23 + 34


def test_copies_are_brought_back_to_the_last_digit(spark):
    """A dense ball, where thinned clouds differ as they are turned: the motion is that of the points themselves, those of one place and the farthest included."""
    rng = np.random.default_rng(6)
    p = rng.normal(size=(3000, 3)) * [1.2, 1.25, 1.3]
    p = np.concatenate([p, p[:200]])
    q = p @ rotation().T + [1.0, -2.0, 3.0]
    found = reg.aligned(cloud(spark, p), cloud(spark, q).withColumn("id", -F.col("id")), scales=(1,), trials=1000)
    assert np.abs(np.array(found.rotation) @ p.T + np.array(found.shift)[:, None] - q.T).max() < 1e-11 and found.fitness == 1


def test_cells_of_a_cloud_do_not_pass_the_driver(spark, monkeypatch):
    """No join of points by cells is a broadcast, although the files are small."""
    from sceneloom.operators import spatial

    seen, write = [], spatial.materialised
    monkeypatch.setattr(spatial, "materialised", lambda rows: seen.append(rows) or write(rows))
    points = cloud(spark, np.random.default_rng(7).random((300, 3)))
    spatial.nearest(points, points, 3, 0.2)
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in (*seen, reg.met(points, points, 0.2))]
    cells = [p for p in plans if "Generate explode" in p]
    assert len(cells) >= 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in cells)


def test_met_is_the_nested_loop_on_edges_of_cells(spark):
    """Points on a grid as wide as the reach, so that pairs lie on edges of cells and just as far apart as the reach."""
    p = np.stack(np.meshgrid(*[np.arange(-2, 3) * 0.5] * 3), -1).reshape(-1, 3)
    got = {(r["id"], r["target_id"]) for r in reg.met(cloud(spark, p), cloud(spark, p), 0.5).collect()}
    d = np.linalg.norm(p[:, None] - p, axis=2)
    assert got == {(i, j) for i, j in np.argwhere(d <= 0.5).tolist()}
