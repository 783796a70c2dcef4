import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.operators import sampling
from sceneloom.sources.gltf import read_glb


def glb(path, primitives, meshes):
    """Writes a file of ``primitives`` (places, numbers or None, mode, bytes between places); a mesh lists some of them."""
    blob, views, accessors, made = b"", [], [], []
    for places, numbers, mode, gap in primitives:
        rows = b"".join(np.asarray(p, "<f4").tobytes() + b"\xff" * gap for p in places)
        views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": len(rows), **({"byteStride": 12 + gap} if gap else {})})
        accessors.append({"bufferView": len(views) - 1, "componentType": 5126, "type": "VEC3", "count": len(places)})
        entry = {"attributes": {"POSITION": len(accessors) - 1}, **({} if mode == 4 else {"mode": mode})}
        blob += rows
        if numbers is not None:
            numbers = np.asarray(numbers)
            code = {"uint8": 5121, "uint16": 5123, "uint32": 5125}[numbers.dtype.name]
            views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": numbers.nbytes})
            accessors.append({"bufferView": len(views) - 1, "componentType": code, "type": "SCALAR", "count": len(numbers)})
            entry["indices"] = len(accessors) - 1
            blob += numbers.tobytes() + b"\0" * (-numbers.nbytes % 4)
        made.append(entry)
    doc = json.dumps({"asset": {"version": "2.0"}, "buffers": [{"byteLength": len(blob)}], "bufferViews": views, "accessors": accessors, "meshes": [{"primitives": [made[i] for i in m]} for m in meshes]}).encode()
    doc += b" " * (-len(doc) % 4)
    body = struct.pack("<II", len(doc), 0x4E4F534A) + doc + struct.pack("<II", len(blob), 0x004E4942) + blob
    path.write_bytes(struct.pack("<III", 0x46546C67, 2, 12 + len(body)) + body)
    return str(path)


SQUARE = [(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0)]


def test_indexed_plain_strip_and_fan(spark, tmp_path):
    path = glb(tmp_path / "a.glb", [(SQUARE, np.array([0, 1, 2, 0, 2, 3], "u2"), 4, 4), (SQUARE[:3], None, 4, 0), (SQUARE, np.array([0, 1, 3, 2], "u1"), 5, 0), (SQUARE, None, 6, 0), (SQUARE, None, 1, 0)], [[0, 1], [2, 3, 4]])
    v = {(r["mesh"], r["primitive"], r["index"]): (r["x"], r["y"], r["z"]) for r in read_glb(spark, path).collect()}
    assert len(v) == 4 + 3 + 4 + 4 and v[0, 0, 2] == (2, 2, 0)
    split = read_glb(spark, path, "triangle", part_bytes=8)
    assert split.rdd.getNumPartitions() == 6
    got = sorted(tuple(r) for r in split.collect())
    assert got == [(0, 0, 0, 0, 1, 2), (0, 0, 1, 0, 2, 3), (0, 1, 0, 0, 1, 2), (1, 0, 0, 0, 1, 3), (1, 0, 1, 1, 2, 3), (1, 1, 0, 1, 2, 0), (1, 1, 1, 2, 3, 0)]


def test_files_that_cannot_be_read(spark, tmp_path):
    bad = tmp_path / "b.glb"
    bad.write_bytes(b"not such a file, but long enough")
    with pytest.raises(Exception, match="no binary glTF"):
        read_glb(spark, str(bad)).collect()
    cut = tmp_path / "c.glb"
    glb(cut, [(SQUARE, None, 6, 0)], [[0]])
    cut.write_bytes(cut.read_bytes()[:-8])
    with pytest.raises(Exception, match="ends inside an array"):
        read_glb(spark, str(cut)).collect()


def test_shares_are_those_of_the_areas(spark, tmp_path):
    """Three squares of area 4, 16 and 1 in two meshes: every face gets its share, every point lies on its face, z is up."""
    square = np.array(SQUARE, float)
    six = np.array([0, 1, 2, 0, 2, 3], "u4")
    path = glb(tmp_path / "d.glb", [(square, six, 4, 0), (square * 2 + [0, 0, 5], six, 4, 0), (square / 2 + [0, 0, 9], six, 4, 0)], [[0, 1], [2]])
    rows = sampling.mesh_samples(spark, path, 2100, 7).collect()
    assert sorted(r["sample"] for r in rows) == [*range(2100)]
    for (mesh, primitive), (share, side, height) in {(0, 0): (200, 2, 0), (0, 1): (800, 4, 5), (1, 0): (50, 1, 9)}.items():
        for face in (0, 1):
            p = np.array([(r["x"], r["y"], r["z"]) for r in rows if (r["mesh"], r["primitive"], r["index"]) == (mesh, primitive, face)])
            assert abs(len(p) - share) <= 2 and np.allclose(p[:, 1], -height) and ((p[:, [0, 2]] >= 0) & (p[:, [0, 2]] <= side + 1e-9)).all()
            assert ((p[:, 2] <= p[:, 0] + 1e-12) if face == 0 else (p[:, 2] >= p[:, 0] - 1e-12)).all()
            middle = np.array([2, 1] if face == 0 else [1, 2]) * side / 3
            assert np.abs(p[:, [0, 2]].mean(0) - middle).max() < side * 0.24 * 4 / len(p) ** 0.5


def test_same_seed_same_rows_in_any_number_of_tasks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *(rng.random((3, 3)) * 10.0 ** -rng.integers(0, 6)).tolist()) for i in range(400)]
    faces = spark.createDataFrame(rows, "id long, a array<double>, b array<double>, c array<double>")
    draw = lambda seed, parts, listed=65_536: {r["sample"]: (r["id"], tuple(r["p"])) for r in sampling.surface_samples(faces.repartition(parts), ["id"], 1000, seed).collect()}
    one = draw(1, 1)
    assert len(one) == 1000 and one == draw(1, 7) and one != draw(2, 7)
    sizes = np.array([np.linalg.norm(np.cross(np.subtract(b, a), np.subtract(c, a))) for _, a, b, c in rows])
    counts = np.bincount([i for i, _ in one.values()], minlength=400)
    assert np.abs(counts - 1000 * sizes / sizes.sum()).max() <= 2


def test_more_draws_than_a_face_lists_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(sampling, "LISTED", 16)
    faces = spark.createDataFrame([(1, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 0.0], [1e-6, 0.0, 0.0], [0.0, 1e-6, 0.0])], "id long, a array<double>, b array<double>, c array<double>")
    got = sampling.surface_samples(faces, ["id"], 333, 1)
    assert sorted(r["sample"] for r in got.collect()) == [*range(333)]
    p = np.array([r["p"] for r in got.collect()])
    assert (p >= 0).all() and (p.sum(1) <= 1 + 1e-12).all()


def test_faces_without_area_get_nothing(spark):
    schema = "id long, a array<double>, b array<double>, c array<double>"
    none = [(1, [0.0] * 3, [1.0] * 3, [2.0] * 3), (2, None, [1.0] * 3, [2.0, 0.0, 0.0]), (3, [float("nan"), 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), (4, [float("inf"), 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])]
    assert sampling.surface_samples(spark.createDataFrame(none, schema), ["id"], 10).count() == 0
    assert sampling.surface_samples(spark.createDataFrame([], schema), ["id"], 10).count() == 0
    some = spark.createDataFrame([*none, (5, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], schema)
    assert [r["id"] for r in sampling.surface_samples(some, ["id"], 10).select("id").distinct().collect()] == [5]
    assert sampling.surface_samples(some, ["id"], 0).count() == 0
