"""Tools, scripted agents and injected models on a small component table."""

import pytest
from pyspark.sql import functions as F

from sceneloom.functions.geometry import box_corners
from sceneloom.operators import meshes, tools


@pytest.fixture
def components(spark):
    rows = [(i, f"{c} chair", [float(i), 0.0, float(i % 2)], [i + 0.5, 1.0, i % 2 + 0.5]) for i, c in enumerate(("red", "blue", "green", "old red"))]
    df = spark.createDataFrame(rows, "component_id int, caption string, lo array<double>, hi array<double>")
    return df.withColumns({"corners": box_corners(F.col("lo"), F.col("hi")), "center": F.transform(F.arrays_zip("lo", "hi"), lambda z: (z["lo"] + z["hi"]) / 2)})


def test_registry(components):
    kit = tools.Tools(components, allowed=["search_terms", "get_distance"])
    assert kit.names() == ["get_distance", "search_terms"]
    assert kit.parameters("search_terms") == {"query_terms": True, "top_k": False}
    assert "error" in kit.call("get_component_info", {"component_id": 1})
    assert "error" in kit.call("search_terms", {"wrong": 1})
    assert "error" in kit.call("search_terms", "{not json")
    assert {r["component_id"] for r in kit.call("search_terms", '{"query_terms": ["red"]}').collect()} == {0, 3}
    assert kit.call("get_distance", {"component_id_1": 0, "component_id_2": 2}).first()["distance"] == pytest.approx(2.0)
    assert kit.call("get_distance", {"component_id_1": 1, "component_id_2": 1}).count() == 0


def test_around_with_words(components):
    kit = tools.Tools(components)
    assert {r["component_id"] for r in kit.call("search_around_component", {"component_id": 1, "radius": 1.6}).collect()} >= {0, 2}
    assert [r["component_id"] for r in kit.call("search_around_component", {"component_id": 1, "radius": 1.6, "search_term": "green"}).collect()] == [2]


def test_scripted_agent(components):
    def policy(seen):
        if len(seen) == 1:
            return {"type": "tool_call", "name": "search_terms", "arguments": {"query_terms": ["blue"]}}
        return {"type": "result", "component_ids": [r["component_id"] for r in seen[-1]["content"]], "reason": "found"}

    steps = list(tools.answered(tools.Tools(components), policy, "the blue one?"))
    assert [s["type"] for s in steps] == ["tool_call_result", "result"] and steps[-1]["component_ids"] == [1]
    endless = lambda seen: {"type": "tool_call", "name": "none"}
    assert [s["type"] for s in tools.answered(tools.Tools(components), endless, "?", rounds=2)][-1] == "error"


def test_full_context(components):
    asked = lambda text: 'Sure: {"component_ids": [3, 77, 0], "reason": "red"}' if "Component 3: old red chair" in text else "{}"
    got = tools.asked_in_full(components, asked, "red?").orderBy("rank").collect()
    assert [r["component_id"] for r in got] == [3, 0]
    assert [r["component_id"] for r in tools.asked_in_full(components, lambda _: "no idea", "red?").collect()] == [0]


def test_models_by_batch(components):
    got = tools.batched(components.select("component_id", "caption"), lambda xs: [x.upper() for x in xs], "caption", "loud").collect()
    assert all(r["loud"] == r["caption"].upper() for r in got)


def test_question_answer_lists(spark):
    rows = spark.createDataFrame([('[{"Question": "q", "Answer": "a", "Type": "t"}, {"Question": "q"}]',), ("broken",)], "reply string")
    assert [tuple(r) for r in tools.checked_pairs(rows).collect()] == [("q", "a", "t")]


def test_vertices_seen_with_depth(spark):
    vertices = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 0.0, 0.0, 3.0), (3, 0.0, 0.0, -1.0), (4, 9.0, 0.0, 1.0)], "vertex long, x double, y double, z double")
    views = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], "PINHOLE", [10.0, 10.0, 5.0, 5.0], 11, 11, 11, 11)], "image_id int, qvec array<double>, tvec array<double>, model string, params array<double>, width int, height int, depth_width int, depth_height int")
    depths = spark.createDataFrame([(0, 5, 5, 2.01)], "image_id int, u int, v int, depth double")
    assert {r["vertex"] for r in meshes.visible_vertices(vertices, views).collect()} == {1, 2}
    assert {r["vertex"] for r in meshes.visible_vertices(vertices, views, depths).collect()} == {1}


def test_segments_in_two_groups(spark):
    groups = spark.createDataFrame([(1, 5), (2, 5)], "object_id int, segment long")
    with pytest.raises(Exception, match="is in 2 groups"):
        meshes.segment_owners(groups).collect()


def test_component_points(spark):
    vertices = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [5.0, 0.0, 0.0])], "id long, p array<double>")
    points = spark.createDataFrame([(7, [0.1, 0.0, 0.0]), (8, [4.0, 0.0, 0.0])], "id long, p array<double>")
    members = spark.createDataFrame([(1, 3), (2, -1)], "vertex long, object_id long")
    assert [tuple(r) for r in meshes.component_points(members, vertices, points).collect()] == [(3, 7)]
