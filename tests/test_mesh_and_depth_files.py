"""Polygon files there and back, and depth images against their definition."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.functions.geometry import depth_agrees
from sceneloom.sources.depth import decoded, depth_images
from sceneloom.sources.ply import read_ply, write_ply


@pytest.mark.parametrize("form", ["binary", "ascii"])
def test_points_come_back(spark, tmp_path, form):
    rng = random.Random(3)
    given = [(rng.uniform(-5, 5), float(np.float32(rng.random())), rng.randrange(256), rng.randrange(-9, 9)) for _ in range(500)]
    points = spark.createDataFrame(given, "x double, y float, red smallint, label int").coalesce(3)
    path = str(tmp_path / "points.ply")
    write_ply(points, path, form)
    got = read_ply(spark, path, part_bytes=1500)
    assert got.rdd.getNumPartitions() > 3
    rows = got.orderBy("index").collect()
    assert [tuple(r)[1:] for r in rows] == [tuple(r) for r in points.collect()] and [r["index"] for r in rows] == list(range(500))
    write_ply(points.limit(0), path, form)
    assert read_ply(spark, path).collect() == [] and [p.name for p in tmp_path.iterdir()] == ["points.ply"]


VERTICES = [(0.0, 0.5, 1.0), (2.0, 0.25, -1.0), (3.5, 0.0, 0.0), (1.0, 1.0, 1.0)]
FACES = [(0, 1, 2), (0, 1, 2, 3), (3, 2, 1)]
HEAD = "ply\nformat {} 1.0\ncomment made by hand\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 3\nproperty list uchar int vertex_indices\nproperty ushort part\nend_header\n"


@pytest.mark.parametrize("order", ["<", ">", "ascii"])
def test_meshes(spark, tmp_path, order):
    if order == "ascii":
        body = "".join(f"{x} {y} {z}\n" for x, y, z in VERTICES) + "".join(f"{len(f)} {' '.join(map(str, f))} {40000 + i}\n" for i, f in enumerate(FACES))
        data = HEAD.format("ascii").encode() + body.encode()
    else:
        data = HEAD.format("binary_little_endian" if order == "<" else "binary_big_endian").encode()
        data += b"".join(struct.pack(order + "3f", *v) for v in VERTICES) + b"".join(struct.pack(f"{order}B{len(f)}iH", len(f), *f, 40000 + i) for i, f in enumerate(FACES))
    (tmp_path / "m.ply").write_bytes(data)
    for part_bytes in (1, 1 << 20):
        assert [tuple(r) for r in read_ply(spark, str(tmp_path / "m.ply"), "vertex", part_bytes).orderBy("index").collect()] == [(i, *v) for i, v in enumerate(VERTICES)]
        assert [tuple(r) for r in read_ply(spark, str(tmp_path / "m.ply"), "face", part_bytes).orderBy("index").collect()] == [(i, list(f), 40000 + i) for i, f in enumerate(FACES)]
    (tmp_path / "short.ply").write_bytes(data[:-3] if order != "ascii" else data[:-15])
    with pytest.raises(Exception, match="file ends"):
        read_ply(spark, str(tmp_path / "short.ply"), "face").collect()
    (tmp_path / "none.ply").write_bytes(b"no such file")
    with pytest.raises(Exception, match="no polygon file"):
        read_ply(spark, str(tmp_path / "none.ply")).collect()


def png(image, kinds, depth=16):
    """A PNG file whose lines have the filters ``kinds``, made by their definition."""
    raw, before = b"", [0] * (2 * image.shape[1])
    for v, row in enumerate(image):
        own = list(row.astype(">u2").tobytes())
        left, corner = [0, 0, *own[:-2]], [0, 0, *before[:-2]]
        kind, guess = kinds[v % len(kinds)], []
        for a, b, c in zip(left, before, corner, strict=True):
            near = sorted((abs(a + b - c - x), i, x) for i, x in enumerate((a, b, c)))[0][2]
            guess.append((0, a, b, (a + b) // 2, near)[kind])
        raw += bytes([kind, *[(x - g) % 256 for x, g in zip(own, guess, strict=True)]])
        before = own
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    packed = zlib.compress(raw)
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", packed[:20]) + part(b"IDAT", packed[20:]) + part(b"IEND", b"")


def test_depth_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {f"f{i}": rng.integers(0, 65536, (70 + i, 9 + i)).astype(np.uint16) * (rng.random((70 + i, 9 + i)) < 0.8) for i in range(3)}
    for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (decoded(png(images["f1"].astype(np.uint16), kinds)) == images["f1"]).all()
    for name, image in images.items():
        (tmp_path / f"{name}.png").write_bytes(png(image.astype(np.uint16), [1, 4, 2, 3]))
    (tmp_path / "notes.txt").write_text("no image")
    got = depth_images(spark, str(tmp_path))
    rows = got.collect()
    assert len(rows) == sum(i.size for i in images.values())
    assert all(r["depth"] is None if not (d := int(images[r["frame"]][r["v"], r["u"]])) else r["depth"] == d / 1000 for r in rows)
    near = got.withColumn("ok", depth_agrees(F.col("depth") + 0.01, F.coalesce("depth", F.lit(0.0))))
    assert {tuple(r) for r in near.select(F.col("depth").isNull(), F.coalesce("ok", F.lit(False))).distinct().collect()} == {(True, False), (False, True)}


def test_other_images_are_errors():
    image = np.zeros((2, 2), np.uint16)
    broken = bytearray(png(image, [0]))
    broken[-20] ^= 1
    for content in (b"", b"GIF89a", png(image, [0], depth=8), bytes(broken), png(image, [0])[:30]):
        with pytest.raises(ValueError):
            decoded(content)
