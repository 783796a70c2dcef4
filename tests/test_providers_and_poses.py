"""Ways of searching, checks of parameters, statistics rows, frames and poses."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.functions.geometry import camera_centre, rotation
from sceneloom.functions.text import contains_folded
from sceneloom.operators import components as comp
from sceneloom.operators import graph, tools
from sceneloom.sources import poses


@pytest.fixture
def captions(spark):
    return spark.createDataFrame([(1, "red chair"), (2, "blue chair"), (3, "old chair"), (4, "chair of oak"), (5, "lamp")], "component_id int, caption string")


def test_reranked(captions):
    seen = []

    def rerank(text):
        seen.append(text)
        return json.dumps({"component_ids": "3, 77, 1, 3", "reason": "by age"})

    got = tools.retrieved_and_reranked(captions, lambda q: "chair", rerank, "the oldest seat").orderBy("rank").collect()
    assert [(r["component_id"], r["reason"]) for r in got] == [(3, "by age"), (1, "by age")]
    assert "Component 2: blue chair" in seen[0] and "lamp" not in seen[0]
    for broken in (lambda _: "no json", lambda _: 1 / 0):
        assert tools.retrieved_and_reranked(captions, lambda q: "chair", broken, "?").count() == 3
    assert tools.retrieved_and_reranked(captions, lambda q: "chair", lambda _: '{"component_ids": ""}', "?").count() == 0
    assert tools.retrieved_and_reranked(captions, lambda q: "zebra", lambda _: "{", "?").count() == 0


def test_ways_of_searching(captions):
    def fails(components, question):
        raise RuntimeError("no model")

    ways = tools.Providers({"hall": captions}.get)
    ways.ways["broken"] = fails
    status, rows = ways.search("hall", "lamp")
    assert status == 200 and [r["component_id"] for r in rows.collect()] == [5]
    assert [ways.search(*a)[0] for a in ((None, "q"), ("hall", " "), ("attic", "q"), ("hall", "q", "none"), ("hall", "q", "broken"))] == [400, 400, 404, 400, 503]


def test_parameters():
    tools.checked_parameters({"tau": 1.0}, {"percentile": 100}, {"batch": 1})
    with pytest.raises(ValueError, match="tau.*percentile.*batch"):
        tools.checked_parameters({"tau": 0.0, "fraction": 0.5}, {"percentile": 100.5}, {"batch": 0})


def test_output_for_a_model():
    assert tools.shown({"n": 1, "images": []}) == '{"n": 1, "images": []}'
    assert tools.shown({"n": 1, "images": ["data:x"]}) == [{"type": "input_text", "text": '{"n": 1}'}, {"type": "input_image", "image_url": "data:x"}]
    assert tools.shown({"images": ["data:x"]}) == [{"type": "input_image", "image_url": "data:x"}]


def test_statistics(spark, captions):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    assert tuple(graph.statistics(nodes, edges).first()) == (3, 3, 1.0, 2)
    assert tuple(graph.statistics(nodes, edges.limit(0)).first()) == (None,) * 4
    assert tuple(comp.caption_statistics(captions).first()) == (5, pytest.approx(8.8), 4, 12)
    assert tuple(comp.caption_statistics(captions.limit(0)).first()) == (0, None, None, None)
    frames = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "frame_no int, labels array<string>")
    assert tuple(comp.label_statistics(frames).first()) == (2, 1.0, 0, 2)
    assert tuple(comp.label_statistics(frames.limit(0)).first()) == (0, 0.0, 0, 0)
    assert captions.where(contains_folded(F.col("caption"), F.lit("CHAIR"))).count() == 4


def pose(seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = q * np.sign(np.linalg.det(q)), [seed, 2.0, -1.0]
    return m


@pytest.fixture
def folder(tmp_path):
    for name in ("0.jpg", "1.png", "2.JPG", "10.webp", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    return tmp_path


def test_frames(spark, folder):
    got = {(r["name"], r["stem"]) for r in poses.frames(spark, str(folder)).collect()}
    assert got == {("0.jpg", "0"), ("1.png", "1"), ("2.JPG", "2"), ("10.webp", "10")}


def test_matrix_views(spark, folder, tmp_path_factory):
    given = tmp_path_factory.mktemp("pose")
    for i in (0, 1, 2, 10):
        np.savetxt(given / f"{i}.txt", pose(i))
    images = poses.frames(spark, str(folder))
    views = poses.matrix_views(spark, str(given), images)
    m = rotation(F.col("qvec"))
    rows = views.select("*", camera_centre(F.col("qvec"), F.col("tvec")).alias("centre"), F.array(*[x for row in m for x in row]).alias("m")).orderBy("image_id").collect()
    assert [(r["image_id"], r["name"]) for r in rows] == [(1, "0.jpg"), (2, "1.png"), (3, "2.JPG"), (4, "10.webp")]
    for r, i in zip(rows, (0, 1, 2, 10), strict=True):
        assert r["centre"] == pytest.approx([i, 2.0, -1.0])
        assert np.reshape(r["m"], (3, 3)) == pytest.approx(pose(i)[:3, :3].T)
    assert [r["name"] for r in poses.matrix_views(spark, str(given), images, 3).orderBy("image_id").collect()] == ["0.jpg", "1.png", "10.webp"]
    np.savetxt(given / "1.txt", np.eye(3))
    with pytest.raises(Exception, match="not a 4 x 4 matrix: 1"):
        poses.matrix_views(spark, str(given), images).collect()


def test_matrix_camera(spark, tmp_path):
    np.savetxt(tmp_path / "intrinsic.txt", [[500, 0, 320, 0], [0, 510, 240, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    assert tuple(poses.matrix_camera(spark, str(tmp_path / "intrinsic.txt"), 640, 480).first()) == (1, "PINHOLE", 640, 480, [500.0, 510.0, 320.0, 240.0])


def test_phone_poses(spark, folder, tmp_path_factory):
    images, given = poses.frames(spark, str(folder)), tmp_path_factory.mktemp("phone")
    order = ["0.jpg", "1.png", "10.webp", "2.JPG"]
    (given / "list.json").write_text(json.dumps({"intrinsic": np.eye(3).tolist(), "aligned_poses": [pose(i).tolist() for i in range(5)]}))
    rows = poses.phone_poses(spark, str(given / "list.json"), images).orderBy("name").collect()
    assert [r["name"] for r in rows] == order and [r["pose"][0][3] for r in rows] == [0.0, 1.0, 2.0, 3.0] and rows[0]["intrinsic"] == np.eye(3).tolist()
    entry = lambda i, n=4: {"intrinsic": (np.eye(3) * (i + 1)).tolist(), "aligned_pose": pose(i)[:n].tolist()}
    (given / "map.json").write_text(json.dumps({n.split(".")[0]: entry(i) for i, n in enumerate(order)}))
    rows = poses.phone_poses(spark, str(given / "map.json"), images).orderBy("name").collect()
    assert [r["pose"][0][3] for r in rows] == [0.0, 1.0, 2.0, 3.0] and all(r["intrinsic"] == np.eye(3).tolist() for r in rows)
    (given / "less.json").write_text(json.dumps({"0": entry(0)}))
    (given / "odd.json").write_text(json.dumps({n.split(".")[0]: entry(i, 3) for i, n in enumerate(order)}))
    for name in ("less.json", "odd.json"):
        with pytest.raises(Exception, match="not a 4 x 4 matrix"):
            poses.phone_poses(spark, str(given / name), images).collect()
