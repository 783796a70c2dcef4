"""Binary models: in parts, there and back, and as the readers of text have them."""

import random
import struct

import pytest

from sceneloom.schema import CAMERA, IMAGE, POINT
from sceneloom.sources import colmap, model_files as mf


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(6)
    cameras = spark.createDataFrame([(1, "PINHOLE", 640, 480, [500.0, 510.0, 320.0, 240.0]), (7, "SIMPLE_RADIAL", 10, 20, [1.0, 2.0, 3.0, 4.5])], CAMERA)
    number = lambda: round(rng.uniform(-9, 9), 3)
    images = [(i, [number() for _ in range(4)], [number() for _ in range(3)], 1, f"bild_ä_{i}.png", [(number(), number(), rng.choice([-1, 5])) for _ in range(rng.choice([0, 1, 30]))]) for i in range(1, 90)]
    points = [(i, [number() for _ in range(3)], [rng.randrange(256) for _ in range(3)], number(), [(rng.randrange(90), j) for j in range(rng.choice([0, 2, 50]))]) for i in range(300)]
    return {"cameras": cameras, "images": spark.createDataFrame(images, IMAGE).repartition(5), "points3D": spark.createDataFrame(points, POINT).repartition(7)}


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_round_trip_in_several_tasks(spark, model, tmp_path):
    mf.write_model(model["cameras"], model["images"], model["points3D"], str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["cameras.bin", "images.bin", "points3D.bin"]
    for kind, given in model.items():
        got = mf.read_file(spark, str(tmp_path / f"{kind}.bin"), kind, 2000)
        assert rows(got) == rows(given) and got.schema.simpleString() == given.schema.simpleString()
        assert rows(colmap.read_binary(spark, str(tmp_path / f"{kind}.bin"), kind)) == rows(given)
        assert got.rdd.getNumPartitions() > 1 or kind == "cameras"
    assert [r[0] for r in mf.read_file(spark, f"file://{tmp_path}/points3D.bin", "points3D").collect()] == list(range(300))


def test_equals_the_text_model(spark, model, tmp_path):
    for kind, text, read in (("cameras", colmap.text_of_cameras, colmap.read_cameras), ("images", colmap.text_of_images, colmap.read_images), ("points3D", colmap.text_of_points, colmap.read_points)):
        colmap.write_text(text(model[kind]).coalesce(1), str(tmp_path / kind))
        mf.write_file(read(spark, str(tmp_path / kind)), str(tmp_path / f"{kind}.bin"), kind)
        assert rows(mf.read_file(spark, str(tmp_path / f"{kind}.bin"), kind, 500)) == rows(model[kind])


def test_empty_and_broken_files(spark, model, tmp_path):
    mf.write_file(model["points3D"].limit(0), str(tmp_path / "none.bin"), "points3D")
    assert (tmp_path / "none.bin").read_bytes() == struct.pack("<Q", 0) and mf.read_file(spark, str(tmp_path / "none.bin"), "points3D").collect() == []
    mf.write_file(model["images"], str(tmp_path / "images.bin"), "images")
    (tmp_path / "short.bin").write_bytes((tmp_path / "images.bin").read_bytes()[:-5])
    with pytest.raises(Exception, match="ends inside a record"):
        mf.read_file(spark, str(tmp_path / "short.bin"), "images").collect()


def test_a_failed_write_leaves_what_was_there(spark, model, tmp_path):
    path = tmp_path / "cameras.bin"
    mf.write_file(model["cameras"], str(path), "cameras")
    before = path.read_bytes()
    odd = spark.createDataFrame([(1, "NO SUCH MODEL", 1, 1, [1.0])], CAMERA)
    with pytest.raises(Exception, match="NO SUCH MODEL"):
        mf.write_file(odd, str(path), "cameras")
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["cameras.bin"]
