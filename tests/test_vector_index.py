"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.operators import vector_index as vi
from sceneloom.operators.similar import similar
from sceneloom.plans import all_queries


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = np.random.default_rng(7).normal(size=(20, dim))[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize(("n", "dim"), [(1, 4), (40, 8), (3000, 32)])
def test_graph_finds_what_a_scan_finds(n, dim):
    x = clustered(n, dim, n)
    order, layers = vi.layers_of(x, 16, 100)
    assert sorted(order) == list(range(n)) and len(layers[0]) == n and all(len(a) >= len(b) for a, b in zip(layers, layers[1:], strict=False))
    queries = clustered(200, dim, 99)
    nodes, scores = vi.search_layers(x[order], layers, queries, 10, 80)
    exact = np.argsort(-(queries @ x.T), 1)[:, :10]
    hits = [len(set(order[a[a >= 0]]) & set(b)) / len(b) for a, b in zip(nodes, exact, strict=True)]
    assert np.mean(hits) >= 0.95 * min(1, n / 10)
    assert all((layer < len(layer)).all() and (layer[np.arange(len(layer))] != np.arange(len(layer))[:, None]).all() for layer in layers)


def test_index_of_several_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "QUERY_CHUNK", 50)
    x = clustered(2400, 24, 5)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], "component_id long, embedding array<float>")
    vi.write_index(vectors, str(tmp_path / "index"), links=16, width=100, shard_rows=700)
    index = vi.read_index(spark, str(tmp_path / "index"))
    assert index.count() == 2400 and index.select("shard").distinct().count() == 4
    queries = vectors.where("component_id % 20 = 0").select(F.col("component_id").alias("query_id"), "embedding")
    found = vi.search_index(index, queries.unionByName(spark.createDataFrame([(-1, None)], queries.schema)), 10)
    got = vi.recall(found, similar(vectors, queries, 10)).agg(F.avg("recall"), F.count(F.lit(1))).first()
    assert got[0] >= 0.95 and got[1] == 120
    rows = found.where("query_id = 40").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and rows[0]["component_id"] == 40 and rows[0]["score"] == pytest.approx(1, abs=1e-5)


def test_equal_vectors_and_empty_tables(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(90)], "component_id long, embedding array<float>")
    vi.write_index(same, str(tmp_path / "a"), links=4, width=20)
    asked = same.limit(1).select(F.col("component_id").alias("query_id"), "embedding")
    assert len(vi.search_index(vi.read_index(spark, str(tmp_path / "a")), asked, 5).collect()) == 5
    vi.write_index(same.limit(0), str(tmp_path / "b"))
    assert vi.search_index(vi.read_index(spark, str(tmp_path / "b")), asked, 5).collect() == []


def test_query_reaches_nine_in_ten(spark):
    folder = "/root/testdata/sf0.01"
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("component_id"), "embedding")
    exact = similar(v, v.select(F.col("component_id").alias("query_id"), "embedding"), 10)
    found = all_queries()["vector_index_topk"](spark, folder)
    got = vi.recall(found, exact).agg(F.avg("recall"), F.count(F.lit(1))).first()
    assert got[0] >= 0.9 and got[1] == v.count()


def test_cells_find_nine_in_ten_and_not_all_are_needed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "CELL_BLOCK", 700)
    monkeypatch.setattr(vi, "CELL_CHUNK", 900)
    x = clustered(2400, 24, 5)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], "component_id long, embedding array<float>")
    queries = vectors.select(F.col("component_id").alias("query_id"), "embedding")
    vi.write_cells(vectors, str(tmp_path / "cells"))
    found = vi.search_cells(spark, str(tmp_path / "cells"), queries)
    got = vi.recall(found, similar(vectors, queries, 10)).agg(F.avg("recall"), F.count(F.lit(1))).first()
    assert got[0] >= 0.9 and got[1] == 2400
    known = spark.read.parquet(str(tmp_path / "cells/centres")).orderBy("cell").toArrow()
    centres, names = vi._matrix(known["centre"]), known["cell"].to_numpy()
    assert 2 * vi._probes(spark.read.parquet(str(tmp_path / "cells/rows")), centres, names, x[::20], 10, vi.TARGET) < len(names)
    rows = found.where("query_id = 40").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and rows[0]["component_id"] == 40 and rows[0]["score"] == pytest.approx(1, abs=1e-5)


def test_scan_compares_probed_cells_only():
    x, q = clustered(300, 8, 1), clustered(40, 8, 2)
    cell = np.sort(np.arange(300) % 5)
    probed = np.random.default_rng(3).random((40, 5)) < 0.5
    places, scores = vi.scan(q, probed, x, cell, 10)
    for i in range(40):
        exact = np.where(probed[i, cell], x @ q[i], -np.inf)
        assert sorted(scores[i][places[i] >= 0], reverse=True) == pytest.approx(np.sort(exact[exact > -np.inf])[::-1][:10], abs=1e-6)


def test_cells_of_equal_vectors_and_of_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "CELL_BLOCK", 20)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(90)], "component_id long, embedding array<float>")
    asked = same.select(F.col("component_id").alias("query_id"), "embedding")
    vi.write_cells(same, str(tmp_path / "a"))
    assert vi.search_cells(spark, str(tmp_path / "a"), asked, 5).count() == 450
    vi.write_cells(same.limit(0), str(tmp_path / "b"))
    assert vi.search_cells(spark, str(tmp_path / "b"), asked, 5).collect() == []
