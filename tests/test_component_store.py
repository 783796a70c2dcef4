"""The component table with its indexes."""

from pyspark.sql import functions as F

from sceneloom.operators.spatial import within_radius
from sceneloom.plans.tables import components
from sceneloom.sources.component_store import read_store, write_store

DATA = "/root/testdata/sf0.001"


def test_store_answers_as_scans(spark, tmp_path):
    rows = components(spark, DATA)
    write_store(rows, str(tmp_path))
    store = read_store(spark, str(tmp_path))
    assert store.table.count() == rows.count() and {r["component_id"] for r in store.by_ids([3, 5, -1]).collect()} == {3, 5}
    some = rows.where("component_id % 3 = 0")
    want = {(r[0], r[1]) for r in within_radius(some, rows, 0.5).collect()}
    assert {(r[0], r[1]) for r in store.near(some, 0.5).collect()} == want and len(want) > 100
    inside = rows.where("lo[0] <= 1 AND hi[0] >= 0 AND lo[1] <= 1 AND hi[1] >= 0 AND lo[2] <= 1 AND hi[2] >= 0")
    assert {r[0] for r in store.inside([0.0] * 3, [1.0] * 3).collect()} == {r["component_id"] for r in inside.collect()}
    red = rows.where(F.lower("caption").rlike(r"\bred\b")).orderBy("component_id")
    assert [r["component_id"] for r in store.prefilter("RED or missing", 4).orderBy("component_id").collect()] == [r["component_id"] for r in red.limit(4).collect()]
    assert {r["component_id"] for r in store.prefilter("red", None, some).collect()} == {r["component_id"] for r in red.where("component_id % 3 = 0").collect()}
    assert store.search("red", 3).count() == 3
