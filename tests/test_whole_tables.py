"""Queries without SQL that once left rows out."""

from sceneloom.plans import graphs, search, spatial
from test_queries import DATA


def test_search_around_term_ranks_all_neighbours(spark, monkeypatch):
    rows = spark.range(80).selectExpr("CAST(id AS INT) AS component_id", "concat('red lamp ', repeat('x y ', CAST(id % 7 AS INT))) AS caption")
    monkeypatch.setattr(search, "components", lambda *_: rows)
    monkeypatch.setattr(search, "around", lambda near, *_: near)
    got = search.search_around_term(spark, str(DATA)).collect()
    assert sorted(r["component_id"] for r in got) == list(range(80)) and sorted(r["rank"] for r in got) == list(range(1, 81))


def test_routes_and_label_clusters_cover_the_table(spark):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    assert {int(r["label"]) for r in graphs.label_clusters(spark, str(DATA)).collect()} == ids
    found = {r["route_id"] for r in spatial.route(spark, str(DATA)).select("route_id").distinct().collect()}
    assert found <= {i for i in ids if i + 1 in ids} and len(found) > len(ids) // 50
