"""Behaviour that the tables cannot show, on hand-made rows."""

import itertools
import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.functions import geometry as geo
from sceneloom.functions import text
from sceneloom.operators import boxes, cluster, evaluation, graph, lexical, masks, occupancy, spatial, windows
from sceneloom.operators import components as comp
from sceneloom.operators import similar as similar_module
from sceneloom.operators.similar import similar, similar_until_drop
from sceneloom.operators.spatial import nearest, within_radius
from sceneloom.sources import artifacts, colmap
from sceneloom.streaming import events


def one(df):
    return df.first()[0]


def test_segment_distance(spark):
    rng = random.Random(1)
    rows = [tuple([rng.uniform(-2, 2) for _ in range(3)] for _ in range(4)) for _ in range(60)]
    rows += [([0.0] * 3, [0.0] * 3, [1.0] * 3, [1.0] * 3), ([0.0] * 3, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 1.0, 0.0]), ([0.0] * 3, [2.0, 0.0, 0.0], [1.0, 1.0, 0.0], [1.0, 1.0, 0.0])]
    got = [r["d"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<double>, b array<double>, c array<double>, d array<double>").withColumn("d", geo.segment_distance(*map(F.col, "abcd"))).orderBy("i").collect()]
    grid = np.linspace(0, 1, 201)
    for (a, b, c, d), value in zip(rows, got, strict=True):
        p = np.array(a) + grid[:, None] * (np.array(b) - np.array(a))
        q = np.array(c) + grid[:, None] * (np.array(d) - np.array(c))
        brute = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).min()
        assert value <= brute + 1e-9 and value >= brute - 0.03


def test_quaternions_come_back(spark):
    rng = np.random.default_rng(2)
    q = rng.normal(size=(40, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q *= np.where(q[:, :1] < 0, -1, 1)
    rows = spark.createDataFrame([(x.tolist(),) for x in q], "q array<double>")
    for r in rows.select("q", geo.quaternion(geo.rotation(F.col("q"))).alias("b"), geo.camera_centre(F.col("q"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("c")).withColumn("z", geo.to_camera(F.col("q"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("c"))).collect():
        assert np.allclose(r["q"], r["b"], atol=1e-9) and np.allclose(r["z"], 0, atol=1e-9)


def test_radius_join_is_the_nested_loop(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, *(sorted(rng.uniform(0, 4) for _ in range(2)) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame([(i, [x[0], y[0], z[0]], [x[1], y[1], z[1]]) for i, x, y, z in rows] + [(99, None, None)], "component_id int, lo array<double>, hi array<double>")
    for few in (0, 100):
        monkeypatch.setattr(spatial, "FEW", few)
        got = {(r[0], r[1]) for r in within_radius(df, df, 0.7).collect()}
        a, b = df.alias("a"), df.alias("b")
        want = {(r[0], r[1]) for r in a.join(b, F.col("a.component_id") != F.col("b.component_id")).where(geo.segment_distance(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi")) <= 0.7).select("a.component_id", "b.component_id").collect()}
        assert got == want


def test_nearest_with_far_points(spark):
    rows = [(i, [float(i * i), 0.0, 0.0]) for i in range(20)]
    p = spark.createDataFrame(rows, "id long, p array<double>")
    got = {(r["query_id"], r["rank"]): r["point_id"] for r in nearest(p, p, 3, 0.5).collect()}
    for i, (x, *_) in rows:
        best = sorted((abs(x - y), j) for j, (y, *_) in rows)[:3]
        assert [got[i, n] for n in (1, 2, 3)] == [j for _, j in best]
    assert nearest(p, p.limit(2), 3, 0.5).count() == 40


def test_runs_longer_than(spark):
    rows = [(i, "a") for i in (1, 2, 3, 4, 5, 6, 9, 10)] + [(i, "b") for i in range(20, 25)]
    df = spark.createDataFrame(rows, "frame_no int, label string")
    assert [(r["label"], r["first_frame"], r["frames"]) for r in windows.runs(df, 5).collect()] == [("a", 1, 6)]
    holes = spark.createDataFrame([(1, "a"), (2, "z"), (4, "z"), (5, "a"), (9, "a"), (7, "z")], "frame_no int, label string")
    assert {(r["frame_no"], r["label"]) for r in windows.filled(holes, 3).where("filled").collect()} == {(2, "a"), (4, "a"), (7, "a"), (5, "z")}


def test_dense_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r["k"] == r["new_id"] for r in windows.renumbered(df, "k").collect())


def test_dense_numbers_of_wide_rows(spark, tmp_path):
    """Written out, with wide rows in several ranges: all are there, dense and in order."""
    rows = spark.range(0, 60_000, 1, 6).select((F.col("id") * 7919 % 60_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    windows.renumbered(rows, "k").write.parquet(f"{tmp_path}/n")
    got = spark.read.parquet(f"{tmp_path}/n").agg(F.count(F.lit(1)), F.sum((F.col("k") == F.col("new_id")).cast("long")), F.countDistinct("wide")).first()
    assert tuple(got) == (60_000, 60_000, 60_000)


def test_elbows(spark):
    scores = [9.0, 8.5, 8.1, 5.0, 4.9, 0.0]
    ranked = spark.createDataFrame([(i + 1, i, s) for i, s in enumerate(scores)], "rank int, component_id int, score double")
    assert lexical.elbow(ranked, 1.0, 0.7).count() == 3
    assert lexical.elbow(ranked, None, None).count() == 5
    assert lexical.elbow(ranked.limit(1).withColumn("score", F.lit(0.0)), 1.0, 0.7).count() == 0


def test_blank_terms_find_nothing(spark):
    rows = spark.createDataFrame([(1, "a red lamp"), (2, None)], "component_id int, caption string")
    assert lexical.search(rows, "  ").count() == 0
    assert lexical.search(rows, ["", " "]).count() == 0
    assert [r["component_id"] for r in lexical.search(rows, "red").collect()] == [1]
    assert lexical.search(rows, ["red", "lamp"], elbow_on=True).first()["matched_terms"] == ["red", "lamp"]


def test_constrained_components_keep_instances_apart(spark):
    nodes = spark.createDataFrame([(1, "s", "cup"), (2, "t", "cup"), (3, "s", "cup"), (4, "u", "cup"), (5, "v", "cup")], "node long, seq string, slug string")
    edges = spark.createDataFrame([(1, 2, 0.9, 0.1), (2, 3, 0.8, None), (3, 4, 0.5, 0.0)], "a long, b long, jaccard double, clip_distance double")
    got = {r["node"]: r["component"] for r in graph.constrained_components(nodes, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).withColumnRenamed("id", "node")
    edges = spark.range(198).where("id <> 99").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert all(got[i] == (0 if i < 100 else 100 if i < 199 else 199) for i in range(200))


def test_hop_path(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (8, 9)], "a long, b long")
    assert [r["node"] for r in graph.hop_path(edges, 1, 4).orderBy("step").collect()] == [1, 5, 4]
    assert graph.hop_path(edges, 1, 9).count() == 0
    assert [r["node"] for r in graph.hop_path(edges, 3, 3).collect()] == [3]


def test_hop_path_has_no_bound(spark):
    edges = spark.range(1, 53).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).coalesce(1)
    assert [r["node"] for r in graph.hop_path(edges, 1, 53).orderBy("step").collect()] == list(range(1, 54))


def test_pairs(spark):
    pairs = spark.createDataFrame([(2, 1), (1, 2), (3, 1)], "a long, b long")
    assert graph.canonical(pairs).count() == 2 and graph.symmetric(pairs).count() == 6


def dbscan_brute(points, eps, least):
    near = {i: [j for j, q in points if math.dist(p, q) <= eps] for i, p in points}
    core = {i for i in near if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = i
                    stack += [y for y in near[x] if y in core]
    for i, _ in points:
        if i not in core and (own := [label[j] for j in near[i] if j in core]):
            label[i] = min(own)
    return {i: label.get(i) for i, _ in points}


def test_dbscan(spark):
    rng = random.Random(5)
    points = [(i, [rng.gauss(c, 0.3) for _ in range(3)]) for i, c in enumerate([0] * 30 + [3] * 30 + [9] * 2)]
    df = spark.createDataFrame([(7, i, p) for i, p in points], "component_id int, id long, p array<double>")
    assert {r["id"]: r["cluster"] for r in cluster.dbscan(df, 0.5, 5).collect()} == dbscan_brute(points, 0.5, 5)
    lone = spark.createDataFrame([(1, 5, [0.0, 0.0, 0.0])], "component_id int, id long, p array<double>")
    assert cluster.cleaned(lone, 0.5, 5, 1).count() == 1 and cluster.cleaned(lone, 0.5, 5, 2).count() == 0


def test_level_ground(spark):
    rows = [(i * 20 + j, [i * 0.1, j * 0.1, 0.001 * ((i * j) % 3)]) for i in range(20) for j in range(20)]
    rows += [(1000 + i * 20 + j, [5.0 + 0.001 * ((i + j) % 2), i * 0.1, 5 + j * 0.1]) for i in range(20) for j in range(20)]
    got = {r["id"] for r in cluster.level_points(spark.createDataFrame(rows, "id long, p array<double>"), 15, 20.0, 0.2).collect()}
    assert len([i for i in got if i < 1000]) > 380 and len([i for i in got if i >= 1000]) < 10


def test_label_clusters(spark):
    rows = [("g", "cup", [1.0, 0.0]), ("g", "mug", [0.99, 0.05]), ("g", "door", [0.0, 1.0]), ("h", "cup", [1.0, 0.0])]
    got = {(r["group"], r["label"]): r["representative"] for r in cluster.label_clusters(spark.createDataFrame(rows, "group string, label string, vector array<double>"), 0.1).collect()}
    assert got["g", "cup"] == got["g", "mug"] != got["g", "door"] == "door" and got["h", "cup"] == "cup"


def test_paths():
    wall = {(r, 3) for r in range(6)}
    path = occupancy.shortest_path(wall, 7, 7, (0, 0), (0, 6))
    assert path[0] == (0, 0) and path[-1] == (0, 6) and not wall & set(path)
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in itertools.pairwise(path))
    assert occupancy.shortest_path(wall | {(6, 3)}, 7, 7, (0, 0), (0, 6)) == []
    assert occupancy.shortest_path(wall, 7, 7, (9, 9), (0, 0)) == []
    assert occupancy.nearest_free({(1, 1)}, 3, 3, (1, 1)) == (0, 0)
    assert occupancy.nearest_free({(0, 0)}, 1, 1, (0, 0)) is None
    strict = occupancy.shortest_path(wall, 7, 7, (0, 0), (0, 6), strict=True)
    assert len(strict) <= len(path)


def counts_of(mask):
    """The compressed form of a 0/1 column-major mask, written out for the test."""
    runs, last, n = [], 0, 0
    for v in mask:
        if v != last:
            runs.append(n)
            last, n = v, 0
        n += 1
    runs.append(n)
    out = ""
    for i, r in enumerate(runs):
        x = r - runs[i - 2] if i > 2 else r
        more = True
        while more:
            c = x & 31
            x >>= 5
            more = x != -1 if c & 16 else x != 0
            out += chr((c | 32 if more else c) + 48)
    return out


def test_points_in_masks(spark):
    h, w = 40, 50
    big, small = np.zeros((h, w), int), np.zeros((h, w), int)
    big[5:35, 4:44], small[10:20, 10:20] = 1, 1
    rows = spark.createDataFrame([("f", i, h, counts_of(m.T.ravel().tolist())) for i, m in enumerate((big, small))], "frame string, mask int, height int, counts string")
    runs = masks.column_runs(rows)
    assert {r["mask"]: r["pixels"] for r in masks.extents(runs).collect()} == {0: 1200, 1: 100}
    keys = spark.createDataFrame([("f", 12.9, 15.2, 1), ("f", 30.0, 30.0, 2), ("f", 0.0, 0.0, 3), ("f", 12.0, 12.0, -1)], "frame string, x double, y double, point3d_id long")
    assert {(r["point3d_id"], r["mask"]) for r in masks.points_in_masks(keys, runs).collect()} == {(1, 1), (2, 0)}
    assert masks.points_in_any(keys, runs).count() == 2


def test_bleu(spark):
    df = spark.createDataFrame([("the cat sat on the mat".split(), "the cat sat on the mat".split()), ("a b".split(), "x y z".split()), ("a b c d".split(), [])], "r array<string>, p array<string>")
    got = [r["b"] for r in df.select(evaluation.bleu(F.col("r"), F.col("p"), 4).alias("b")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1:] == [0.0, 0.0]


def test_views_of_boxes(spark):
    lo, hi = F.array(*[F.lit(-1.0)] * 3), F.array(*[F.lit(1.0)] * 3)
    cube = spark.range(1).select(F.col("id").cast("int").alias("component_id"), geo.box_corners(lo, hi).alias("corners"))
    views = spark.createDataFrame([(0, i, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, z], "PINHOLE", [100.0, 100.0, 50.0, 50.0], 100, 100) for i, z in enumerate((5.0, -5.0))], "component_id int, image_id int, qvec array<double>, tvec array<double>, model string, params array<double>, width long, height long")
    got = boxes.box_views(cube, views).collect()
    assert [(r["image_id"], r["x0"], r["x1"], r["inside"]) for r in got] == [(0, 25.0, 75.0, True)]


def test_table_changes(spark):
    empty = spark.createDataFrame([], "component_id int, caption string")
    assert one(comp.next_id(empty)) == 1
    assert comp.added(empty, spark.createDataFrame([("x",)], "caption string")).collect()[0]["component_id"] == 1
    assert comp.by_ids(empty, []).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("big_cup_seq_3_12", "a_mask_1_mask_7", "no number", "My File!.json")], "i string, m string, f string, n string")
    r = df.select(text.instance_parts(F.col("i")).alias("i"), text.mask_parts(F.col("m")).alias("m"), text.frame_number(F.col("f")).alias("f"), text.file_name(F.col("n")).alias("n"), text.instance_parts(F.col("f")).alias("none")).first()
    assert tuple(r["i"]) == ("big_cup", 3, 12) and tuple(r["m"]) == ("a_mask_1", 7) and r["f"] is None and r["n"] == "My_File_.json" and r["none"] is None


def test_model_files(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 510 320 240\n2 SIMPLE_RADIAL 10 20 1 2 3 4\n")
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 .5 0 2 1 a.png\n1 2 7 3.5 4 -1\n2 1 0 0 0 0 0 0 2 b.png\n\n")
    (tmp_path / "points3D.txt").write_text("# p\n7 1 2 3 9 8 255 0.5 1 0 2 4\n8 0 0 1 0 0 0 0.1\n")
    cameras, images, points = (f(spark, str(tmp_path / n)) for f, n in ((colmap.read_cameras, "cameras.txt"), (colmap.read_images, "images.txt"), (colmap.read_points, "points3D.txt")))
    assert [(r["camera_id"], r["model"], r["params"]) for r in cameras.orderBy("camera_id").collect()] == [(1, "PINHOLE", [500, 510, 320, 240]), (2, "SIMPLE_RADIAL", [1, 2, 3, 4])]
    a, b = images.orderBy("image_id").collect()
    assert a["name"] == "a.png" and [tuple(o) for o in a["observations"]] == [(1, 2, 7), (3.5, 4, -1)] and b["observations"] == [] and b["camera_id"] == 2
    p, q = points.orderBy("point3d_id").collect()
    assert [tuple(t) for t in p["track"]] == [(1, 0), (2, 4)] and q["track"] == [] and p["rgb"] == [9, 8, 255]
    for name, frame, write in (("c", cameras, colmap.text_of_cameras), ("i", images, colmap.text_of_images), ("p", points, colmap.text_of_points)):
        colmap.write_text(write(frame).coalesce(1), str(tmp_path / name))
    again = colmap.read_points(spark, str(tmp_path / "p"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, points.collect()))
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 3, 1, 640, 480, 1, 2, 3, 4))
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<i7di", 5, 1, 0, 0, 0, 0, 0, 1, 3) + b"x.png\0" + struct.pack("<Qddq", 1, 1.5, 2.5, 7))
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<Q3d3BdQ", 7, 1, 2, 3, 9, 8, 255, 0.5, 1) + struct.pack("<ii", 5, 0))
    assert colmap.read_binary(spark, str(tmp_path / "cameras.bin"), "cameras").first()["model"] == "PINHOLE"
    assert tuple(colmap.read_binary(spark, str(tmp_path / "images.bin"), "images").first()["observations"][0]) == (1.5, 2.5, 7)
    assert colmap.read_binary(spark, str(tmp_path / "points3D.bin"), "points3D").first()["rgb"] == [9, 8, 255]


def test_artifacts(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and str(tmp_path / name)
    captions = put("captions.json", [{"component_id": 1, "caption": "a cup", "num_images_used": 2, "crop_filenames": ["x"]}, {"component_id": 2}])
    assert [r["caption"] for r in artifacts.captions(spark, captions).orderBy("component_id").collect()] == ["a cup", None]
    box = put("boxes.json", [{"connected_comp_id": 4, "bbox": {"corners": [[0.0, 1.0, 2.0]]}}])
    assert artifacts.box_corners(spark, box).first()["bbox"]["corners"] == [[0, 1, 2]]
    crops = put("manifest.json", {"3": {"component_id": 3, "total_crops": 1, "crops": [{"crop_filename": "c.png", "crop_index": 0, "fraction_visible": 0.5}]}})
    assert artifacts.crops(spark, crops).first()["crop_filename"] == "c.png"
    image = put("imageId_1.json", {"image_id": 1, "image_name": "f.png", "mask_point3d_sets": [[1, 2, 3], [4]], "H": 1, "W": 1})
    assert {r["mask_id"] for r in artifacts.image_associations(spark, image, 2).collect()} == {"f_mask_0"}
    objects = put("objects.json", {"cup": {"seq_1": {"2": [5, 6]}}, "Wall": {"seq_1": {"0": [9]}}})
    assert {(r["slug"], r["obj_id"], r["point3d_id"]) for r in artifacts.object_associations(spark, objects, 1, ["wall"]).collect()} == {("cup", 2, 5), ("cup", 2, 6)}
    frames = put("inventory.json", {"frame_00002": ["cup", " "], "frame_00010": []})
    assert [(r["frame_no"], r["label"]) for r in artifacts.inventory(spark, frames).collect()] == [(2, "cup")]
    with pytest.raises(Exception, match="no frame number"):
        artifacts.inventory(spark, put("bad.json", {"frame": ["cup"]})).collect()
    mask = {"obj_id": 1, "segmentation": {"size": [4, 5], "counts": "abc"}, "area": 3.0}
    for name, value in (("m1.json", [mask]), ("m2.json", {"annotations": [mask]})):
        r = artifacts.masks(spark, put(name, value)).first()
        assert (r["height"], r["width"], r["counts"], r["frame"]) == (4, 5, "abc", name[:2])
    assert artifacts.floor_points(spark, put("floor.json", [{"point_id": 1, "coords": [1.0, 2.0, 3.0]}])).first()["z"] == 3
    groups = put("groups.json", {"segGroups": [{"id": 1, "objectId": 1, "label": "cup", "segments": [1, 2]}, {"id": 2, "objectId": 2, "label": "SPLIT", "segments": [3]}]})
    assert artifacts.segment_groups(spark, groups).count() == 2
    assert artifacts.segments(spark, put("seg.json", {"segIndices": [5, 5, 6]})).count() == 3
    (tmp_path / "runs" / "none").mkdir(parents=True)
    put("runs/none/q_result.json", {"question": "where?", "metrics": {"EM": 1.0}})
    r = artifacts.results(spark, str(tmp_path / "runs")).first()
    assert r["ablation"] == "none" and r["metrics"] == {"EM": 1.0}


def test_event_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    lines = [": ping", 'data: {"type": "thinking", "content": "hm"}', "data: {broken", 'data: {"type": "result", "component_ids": [3], "reason": "r"}', 'data: {"type": "thinking", "content": "late"}']
    (source / "a.txt").write_text("\n".join(lines))
    run = lambda: events.appended(events.event_lines(spark, str(source)), str(out), str(tmp_path / "state")).awaitTermination()
    run()
    assert spark.read.parquet(str(out)).count() == 3
    (source / "b.txt").write_text(lines[1])
    run()
    assert spark.read.parquet(str(out)).count() == 4
    numbered = spark.createDataFrame(list(enumerate(lines)), "nth int, line string").select(F.lit("a").alias("stream"), "nth", artifacts.event_of(F.col("line")).alias("event"))
    assert [r["event"]["type"] for r in artifacts.until_end(numbered).orderBy("nth").collect()] == ["thinking", "result"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.25)], "id int, k string, v double")
    artifacts.write_partition(rows, str(tmp_path / "p"), "k")
    artifacts.write_partition(rows.where("k = 'a'").withColumn("id", F.lit(9)), str(tmp_path / "p"), "k")
    assert {(r["id"], r["k"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(9, "a"), (2, "b")}
    artifacts.write_pivot(rows, str(tmp_path / "c"), ["v"])
    assert {r["v"] for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {"0.5000", "0.2500"}


def test_radius_of_nothing(spark):
    rows = [(1, [0.0] * 3, [1.0] * 3), (2, [1.0] * 3, [2.0] * 3), (3, [1.5, 1.5, 1.6], [3.0] * 3), (4, [5.0] * 3, [5.0] * 3), (5, [5.0] * 3, [5.0] * 3)]
    df = spark.createDataFrame(rows, "component_id int, lo array<double>, hi array<double>")
    assert {(r[0], r[1]) for r in within_radius(df, df, 0.0).collect()} == {(1, 2), (2, 1), (4, 5), (5, 4)}
    points = df.where("component_id > 3")
    assert within_radius(points, points, 0.0).count() == 2


def test_nearest_without_coordinates(spark):
    nan, inf = float("nan"), float("inf")
    p = spark.createDataFrame([(1, [0.0] * 3), (2, [nan, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [inf, 0.0, 0.0]), (5, [None, 0.0, 0.0]), (6, None)], "id long, p array<double>")
    assert {(r["query_id"], r["point_id"]) for r in nearest(p, p, 2).collect()} == {(1, 1), (1, 3), (3, 3), (3, 1)}


def test_stemmed_search_finds_other_forms(spark):
    rows = spark.createDataFrame([(1, "a red widget"), (2, "two rings"), (3, "nothing here")], "component_id int, caption string")
    assert [r["component_id"] for r in lexical.search(rows, ["widgets", "the ring"], tokenise=lexical.stemmed_tokens).orderBy("component_id").collect()] == [1, 2]
    assert lexical.search(rows, "widgets").count() == 0


def test_images_of_several_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"images{n}.txt").write_text(f"# i\n{n} 1 0 0 0 .5 0 2 1 a{n}.png\n{n} 2 7\n{n + 10} 1 0 0 0 0 0 0 2 b{n}.png\n\n")
    got = {r["image_id"]: (r["name"], [tuple(o) for o in r["observations"]]) for r in colmap.read_images(spark, str(tmp_path)).collect()}
    assert got == {n: (f"a{n}.png", [(n, 2, 7)]) for n in range(3)} | {n + 10: (f"b{n}.png", []) for n in range(3)}


def test_model_of_a_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        colmap.read_model(spark, str(tmp_path))
    for name, text_ in (("cameras", "1 PINHOLE 640 480 500 510 320 240\n"), ("images", "1 1 0 0 0 .5 0 2 1 a.png\n\n"), ("points3D", "7 1 2 3 9 8 255 0.5 1 0\n")):
        (tmp_path / f"{name}.txt").write_text(text_)
    assert colmap.read_model(spark, str(tmp_path))["images"].first()["name"] == "a.png"
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 3, 1, 640, 480, 1, 2, 3, 4))
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 0))
    assert colmap.read_model(spark, str(tmp_path))["cameras"].first()["camera_id"] == 1  # the binary model is not whole
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 0))
    assert colmap.read_model(spark, str(tmp_path))["cameras"].first()["camera_id"] == 3


def test_moved_model_projects_alike(spark):
    rng = np.random.default_rng(4)
    q = rng.normal(size=4)
    q = (q / np.linalg.norm(q) * np.sign(q[0])).tolist()
    turn = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    rows = spark.createDataFrame([(rng.normal(size=3).tolist(), rng.normal(size=3).tolist()) for _ in range(20)], "p array<double>, t array<double>")
    pose = F.array(*map(F.lit, q))
    again, at = geo.moved_pose(pose, F.col("t"), turn, [1.0, 2.0, 3.0], 2.5)
    for r in rows.select(geo.to_camera(pose, F.col("t"), F.col("p")).alias("a"), geo.to_camera(again, at, geo.moved(F.col("p"), turn, [1.0, 2.0, 3.0], 2.5)).alias("b")).collect():
        assert np.allclose(np.array(r["a"]) * 2.5, r["b"], atol=1e-9)
    assert rows.select(geo.signed_axes(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), [1, -3, 2])).first()[0] == [1.0, -3.0, 2.0]


def test_valid_ids_by_join(spark):
    rows = spark.createDataFrame([(1, [5, 4, 9, 4]), (2, [9]), (3, [])], "k int, ids array<int>")
    valid = spark.createDataFrame([(4,), (5,), (2,)], "id int")
    assert {r["k"]: r["ids"] for r in comp.only_valid(rows, valid, "k").collect()} == {1: [5, 4, 4], 2: [2], 3: [2]}


def test_similar_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(50, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "component_id int, embedding array<double>")
    queries = df.where("component_id < 3 OR component_id = 99").select(F.col("component_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["component_id"] for r in similar(df, queries, 4).collect()}
    assert got == {(i, n + 1): int(j) for i in range(3) for n, j in enumerate(np.argsort(-(v @ v[i]), kind="stable")[:4])}
    assert similar_until_drop(df, 0, gap=0.01).first()["component_id"] == 0
    monkeypatch.setattr(similar_module, "QUERIES", 1)
    assert {(r["query_id"], r["rank"]): r["component_id"] for r in similar(df, queries, 4).collect()} == got


def test_average_linkage_holds_no_pairs():
    import tracemalloc

    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    found = cluster.linked(v, 0.6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * 2000 * 8 / 8 and sorted(i for g in found for i in g) == list(range(2000))
    want = [[i] for i in range(60)]
    far = 1 - v[:60] @ v[:60].T
    while True:
        least, i, j = min((far[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(want) for j, b in enumerate(want) if i < j)
        if least >= 0.6:
            break
        want[i] += want.pop(j)
    assert sorted(map(sorted, want)) == sorted(cluster.linked(v[:60], 0.6))


def test_routes_of_one_scene_are_dealt_into_parts(spark, monkeypatch):
    cells = spark.createDataFrame([("s", r, c, int(c == 3 and r < 5)) for r in range(8) for c in range(8)], "scene string, row int, col int, occupied int")
    grids = spark.createDataFrame([("s", 0.0, 0.0, 1.0, 8, 8)], "scene string, min_x double, min_y double, size double, rows int, cols int")
    asked = spark.createDataFrame([(i, "s", 0.5, 0.5 + i % 8, 7.5, 0.5 + i % 5) for i in range(40)], "route_id int, scene string, x0 double, y0 double, x1 double, y1 double")
    whole = sorted(map(tuple, occupancy.routes(asked, cells, grids).collect()))
    monkeypatch.setattr(occupancy, "ROUTES", 1)
    assert whole and sorted(map(tuple, occupancy.routes(asked, cells, grids).collect())) == whole
    free = cells.withColumn("occupied", F.lit(0))
    assert occupancy.routes(asked, free, grids).select("route_id").distinct().count() == 40


def test_nearest_of_crowded_points(spark):
    """Copies in one place and a dense middle: cells become smaller, ties go by id, no point is lost."""
    rng = np.random.default_rng(2)
    at = [[1.0, 1.0, 1.0]] * 60 + rng.normal(0, 0.05, (150, 3)).tolist() + rng.uniform(-9, 9, (30, 3)).tolist()
    p = spark.createDataFrame(list(enumerate(at)), "id long, p array<double>")
    assert spatial._first_side(p.where("id >= 60"), 5, 0.5) < 0.2
    got = {(r["query_id"], r["rank"]): r["point_id"] for r in nearest(p, p, 5, 0.5).collect()}
    xyz = np.array(at)
    for i in range(len(at)):
        far = np.sqrt(((xyz - xyz[i]) ** 2).sum(1))
        assert [got[i, n + 1] for n in range(5)] == sorted(range(len(at)), key=lambda j: (far[j], j))[:5]
    assert len(got) == 5 * len(at)


def unions_in_order(nodes, edges):
    group = {n: {n} for n, *_ in nodes}
    key = {n: (s, g) for n, s, g in nodes}
    for a, b, *_ in sorted(edges, key=lambda e: (-e[2], 1.0 if e[3] is None else e[3], e[0], e[1])):
        x, y = group[a], group[b]
        if x is not y and not {key[n] for n in x} & {key[n] for n in y}:
            x |= y
            group |= dict.fromkeys(y, x)
    return {n: min(x) for n, x in group.items()}


@pytest.mark.parametrize("last", [5, 200_000])
def test_constrained_components_are_the_unions_in_order(spark, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST_LINKS", last)
    rng = random.Random(11)
    nodes = [(i, f"s{rng.randrange(9)}", rng.choice("ab")) for i in range(120)]
    pairs = {tuple(sorted(rng.sample(range(110), 2))) for _ in range(400)}
    edges = [(a, b, rng.randrange(1, 8) / 8, rng.choice([None, 0.25, 0.5])) for a, b in sorted(pairs)]
    n, e = spark.createDataFrame(nodes, "node long, seq string, slug string"), spark.createDataFrame(edges, "a long, b long, jaccard double, clip_distance double")
    got = {r["node"]: r["component"] for r in graph.constrained_components(n, e).collect()}
    assert got == unions_in_order(nodes, edges) and len(set(got.values())) < 100


def test_dbscan_of_dense_and_parted_points(spark):
    rng = random.Random(8)
    rows = [[rng.gauss(0, 0.4) for _ in range(3)] for _ in range(150)] + [[rng.uniform(-4, 4) for _ in range(3)] for _ in range(250)]
    rows += [[9.0 + 0.01 * i, 9.0, 9.0] for i in range(20)] + [[9.0 + 0.01 * i, 9.0 + g, 9.0] for g in (0.49, 1.05) for i in range(20)]
    points = [(i, p) for i, p in enumerate(rows)]
    rng.shuffle(points)
    df = spark.createDataFrame([(7, i, p) for i, p in points], "component_id int, id long, p array<double>")
    assert {r["id"]: r["cluster"] for r in cluster.dbscan(df, 0.5, 5).collect()} == dbscan_brute(points, 0.5, 5)


def test_dbscan_compares_what_the_outermost_points_leave_open(spark):
    # two cells, whose outermost points are all farther apart than their nearest ones
    ring = [[0.0, 0.14, 0.14], [0.28, 0.14, 0.14], [0.14, 0.0, 0.14], [0.14, 0.28, 0.14], [0.14, 0.14, 0.0], [0.14, 0.14, 0.28]]
    rows = [*ring, [0.279, 0.279, 0.279], *[[x + 0.29 * 2, y + 0.29 * 2, z + 0.29 * 2] for x, y, z in ring], [0.581, 0.581, 0.565]]
    df = spark.createDataFrame([(7, i, p) for i, p in enumerate(rows)], "component_id int, id long, p array<double>")
    assert {r["id"]: r["cluster"] for r in cluster.dbscan(df, 0.52, 5).collect()} == dbscan_brute(list(enumerate(rows)), 0.52, 5)


def test_stable_ids_looks_only_at_sets_with_the_rarest_instance(spark, monkeypatch):
    rng = random.Random(4)
    old = {i: set(rng.sample(range(40), rng.randrange(1, 4))) | {99} for i in range(60)}
    new = {k: set(rng.sample(range(40), rng.randrange(3, 12))) | {99} for k in range(50)} | {100: {7000}, 101: set(old[5])}
    frame = lambda sets, name: spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], f"{name} long, instances array<long>")
    written, rows = graph.materialised, []
    monkeypatch.setattr(graph, "materialised", lambda df: (out := written(df), rows.append((set(df.columns), out.count())))[0])
    got = {r["key"]: r["component_id"] for r in graph.stable_ids(frame(new, "key"), frame(old, "component_id")).collect()}
    want, top = {}, max(old)
    for k, x in sorted(new.items()):
        inside = [i for i, y in old.items() if y <= x]
        same = [i for i in inside if old[i] == x]
        want[k] = min(same or inside) if inside else (top := top + 1)
    assert got == want
    pairs = [n for columns, n in rows if {"key", "component_id", "size"} <= columns]
    assert len(pairs) == 1 and pairs[0] < len(old) * len(new) / 2  # 99 is in all of them


def test_hop_path_to_the_largest_node_reached(spark):
    edges = spark.createDataFrame([(1, 2), (2, 7), (7, 3), (1, 3), (3, 4), (8, 9)], "a long, b long")
    assert [r["node"] for r in graph.hop_path(edges, 1).orderBy("step").collect()] == [1, 2, 7]


def test_visibility_makes_more_tasks_of_more_rows(spark, monkeypatch):
    monkeypatch.setattr(boxes, "TASK_ROWS", 10)
    members = spark.createDataFrame([(c, p) for c in range(20) for p in range(c, c + 10)], "component_id long, point3d_id long")
    track = spark.createDataFrame([(p, p % 3) for p in range(30)] * 2, "point3d_id long, image_id long")
    sizes, written = [], boxes.materialised
    monkeypatch.setattr(boxes, "materialised", lambda df: (sizes.append(df.rdd.getNumPartitions()) if "times" in df.columns and "component_id" in df.columns else None, written(df))[1])
    got = {(r["component_id"], r["image_id"]): (r["visible_points"], r["total_points"]) for r in boxes.visibility(members, track).collect()}
    assert got == {(c, i): (2 * sum(p % 3 == i for p in range(c, c + 10)), 10) for c in range(20) for i in range(3)}
    assert sizes and sizes[0] >= 20
