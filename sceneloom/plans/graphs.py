"""Mask graphs, their components, frame sequences and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.catalog import query
from sceneloom.operators import cluster, graph, windows
from sceneloom.plans.tables import FRAMES, INCIDENCE, POINTS, frames, incidence, points, table
from sceneloom.session import materialised

_EDGES = f"""{INCIDENCE}, d AS (SELECT DISTINCT node, point FROM i), z AS (SELECT node, count(*) AS size FROM d GROUP BY node HAVING count(*) >= 3), n AS (SELECT DISTINCT node, image FROM i),
k AS (SELECT node, point FROM d JOIN z USING (node)),
s AS (SELECT a.node AS a, b.node AS b, count(*) AS overlap FROM k a JOIN k b ON a.point = b.point AND a.node < b.node GROUP BY ALL),
e AS (SELECT s.a, s.b, overlap, overlap / (za.size + zb.size - overlap) AS jaccard FROM s JOIN z za ON s.a = za.node JOIN z zb ON s.b = zb.node JOIN n na ON s.a = na.node JOIN n nb ON s.b = nb.node
      WHERE na.image <> nb.image AND (overlap >= 2 OR overlap / (za.size + zb.size - overlap) >= 0.12))"""


def _edges(spark, sf_dir):
    i = incidence(spark, sf_dir)
    return graph.jaccard_edges(i, i.select("node", "image").distinct(), 2, 0.12, 3)


@query("mask_edges", f"WITH {_EDGES} SELECT a, b, overlap, round(jaccard, 9) AS jaccard FROM e")
def mask_edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("jaccard", F.round("jaccard", 9))


@query("mask_degrees", f"WITH {_EDGES}, x AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e), g AS (SELECT node, count(*) AS degree FROM x GROUP BY node) SELECT z.node, coalesce(degree, 0) AS degree FROM z LEFT JOIN g ON z.node = g.node")
def mask_degrees(spark, sf_dir):
    i = incidence(spark, sf_dir)
    big = i.groupBy("node").agg(F.count_distinct("point").alias("size")).where("size >= 3")
    return graph.degrees(big, _edges(spark, sf_dir))


@query("mask_components", f"""WITH RECURSIVE {_EDGES}, y AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, reached) AS (SELECT DISTINCT a, a FROM y UNION SELECT w.node, y.b FROM w JOIN y ON w.reached = y.a)
SELECT node, min(reached) AS component FROM w GROUP BY node""")
def mask_components(spark, sf_dir):
    e = _edges(spark, sf_dir)
    ends = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return graph.components(ends, e)


@query("mask_statistics", f"""WITH RECURSIVE {_EDGES}, y AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, reached) AS (SELECT node, node FROM z UNION SELECT w.node, y.b FROM w JOIN y ON w.reached = y.a),
l AS (SELECT node, min(reached) AS component FROM w GROUP BY node), p AS (SELECT component, count(*) AS size FROM l GROUP BY component),
g AS (SELECT node, count(y.a) AS degree FROM z LEFT JOIN y ON z.node = y.a GROUP BY node)
SELECT (SELECT count(*) FROM p) AS connected_components, (SELECT max(size) FROM p) AS largest_component_size, round((SELECT avg(degree) FROM g), 9) AS average_degree, (SELECT max(degree) FROM g) AS max_degree""")
def mask_statistics(spark, sf_dir):
    i = incidence(spark, sf_dir)
    big = i.groupBy("node").agg(F.count_distinct("point").alias("size")).where("size >= 3").select("node")
    return graph.statistics(big, _edges(spark, sf_dir)).withColumn("average_degree", F.round("average_degree", 9))


def _instances(nodes):
    return nodes.select("node", F.format_string("seq %d", F.col("node") % 7).alias("seq"), F.lit("thing").alias("slug"))


@query("constrained_components")
def constrained_components(spark, sf_dir):
    """Unions in order of confidence, under a constraint (order dependent, no SQL form)."""
    e = _edges(spark, sf_dir)
    ends = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return graph.constrained_components(_instances(ends), e)


@query("guarded_edges", f"""WITH {_EDGES}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT e.a, e.b, 1 - list_inner_product(va.v, vb.v) AS far FROM e LEFT JOIN v va ON e.a // 1000 = va.vec_id LEFT JOIN v vb ON e.b // 1000 = vb.vec_id)
SELECT a, b, round(far, 5) AS clip_distance, far IS NOT NULL AND far > 1 AS rejected FROM m""")
def guarded_edges(spark, sf_dir):
    """Edges kept or rejected by the distance of the two ends' vectors."""
    e = _edges(spark, sf_dir)
    ends = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    v = ends.join(table(spark, sf_dir, "embeddings"), F.floor(F.col("node") / 1000) == F.col("vec_id")).select("node", F.col("embedding").alias("vector"))
    kept, rejected = graph.guarded(e, v, 1.0)
    both = kept.withColumn("rejected", F.lit(False)).unionByName(rejected.drop("rejection_reason").withColumn("rejected", F.lit(True)))
    return both.select("a", "b", F.round("clip_distance", 5).alias("clip_distance"), "rejected")


@query("stable_ids", """WITH o AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS x FROM lineitem WHERE l_linenumber <= 1 + l_suppkey % 3), m AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS x FROM lineitem WHERE l_linenumber <= 2),
os AS (SELECT id, count(*) AS n FROM o GROUP BY id), ms AS (SELECT key, count(*) AS n FROM m GROUP BY key), s AS (SELECT key, id, count(*) AS shared FROM m JOIN o USING (x) GROUP BY key, id),
r AS (SELECT s.key, s.id, row_number() OVER (PARTITION BY s.key ORDER BY CASE WHEN os.n = ms.n THEN 0 ELSE 1 END, s.id) AS nth FROM s JOIN os ON s.id = os.id JOIN ms ON s.key = ms.key WHERE shared = os.n)
SELECT key, id AS component_id FROM r WHERE nth = 1 UNION ALL SELECT key, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY key) FROM ms WHERE key NOT IN (SELECT key FROM r)""")
def stable_ids(spark, sf_dir):
    """A third of the suppliers had fewer parts before, a third the same, a third more."""
    rows = table(spark, sf_dir, "lineitem")
    sets = lambda lines, name: rows.where(F.col("l_linenumber") <= lines).groupBy(F.col("l_suppkey").alias(name)).agg(F.collect_set("l_partkey").alias("instances"))
    return graph.stable_ids(sets(F.lit(2), "key"), sets(1 + F.col("l_suppkey") % 3, "component_id"))


@query("hop_path")
def hop_path(spark, sf_dir):
    """A path of the fewest edges between the least and the largest node of one component."""
    e = materialised(_edges(spark, sf_dir).select("a", "b"))
    start = e.agg(F.min("a").alias("a")).first()["a"]
    return graph.hop_path(e, start) if start is not None else spark.createDataFrame([], "step int, node long")


@query("frame_runs", f"WITH {FRAMES}, g AS (SELECT label, frame_no, frame_no - row_number() OVER (PARTITION BY label ORDER BY frame_no) AS island FROM f), r AS (SELECT label, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) AS frames FROM g GROUP BY label, island HAVING count(*) > 5) SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY first_frame) AS INTEGER) AS run_no FROM r")
def frame_runs(spark, sf_dir):
    return windows.runs(frames(spark, sf_dir), 5).select("label", "first_frame", "last_frame", "frames", "run_no")


@query("frames_filled", f"WITH {FRAMES}, g AS (SELECT label, frame_no, lead(frame_no) OVER (PARTITION BY label ORDER BY frame_no) AS next FROM f), h AS (SELECT label, unnest(range(frame_no + 1, next)) AS frame_no FROM g WHERE next - frame_no - 1 BETWEEN 1 AND 3) SELECT CAST(frame_no AS INTEGER) AS frame_no, label, false AS filled FROM f UNION ALL SELECT CAST(frame_no AS INTEGER), label, true FROM h WHERE frame_no IN (SELECT frame_no FROM f)")
def frames_filled(spark, sf_dir):
    return windows.filled(frames(spark, sf_dir), 3).select("frame_no", "label", "filled")


@query("frame_inventory", f"WITH {FRAMES}, g AS (SELECT label, frame_no, lead(frame_no) OVER (PARTITION BY label ORDER BY frame_no) AS next FROM f), h AS (SELECT label, unnest(range(frame_no + 1, next)) AS frame_no FROM g WHERE next - frame_no - 1 BETWEEN 1 AND 3), x AS (SELECT frame_no, label, 0 AS o FROM f UNION ALL SELECT frame_no, label, 1 FROM h WHERE frame_no IN (SELECT frame_no FROM f)) SELECT CAST(frame_no AS INTEGER) AS frame_no, string_agg(label, ',' ORDER BY o, label) AS labels FROM x GROUP BY frame_no")
def frame_inventory(spark, sf_dir):
    return windows.inventory(windows.filled(frames(spark, sf_dir), 3)).select("frame_no", F.array_join("labels", ",").alias("labels"))


_NEAR = f"""{POINTS}, nb AS (SELECT a.label, a.point3d_id AS a, b.point3d_id AS b FROM p a JOIN p b ON a.label = b.label AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.9),
core AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= 4), ce AS (SELECT a, b FROM nb WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
w(node, reached) AS (SELECT a, a FROM core UNION SELECT w.node, ce.b FROM w JOIN ce ON w.reached = ce.a), cc AS (SELECT node, min(reached) AS cluster FROM w GROUP BY node),
al AS (SELECT node AS id, cluster FROM cc UNION ALL SELECT nb.a, min(cluster) FROM nb JOIN cc ON nb.b = cc.node WHERE nb.a NOT IN (SELECT a FROM core) GROUP BY nb.a)"""


def _members(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("label").alias("component_id"), F.col("point3d_id").alias("id"), F.array("x", "y", "z").alias("p"))


@query("density_clusters", f"WITH RECURSIVE {_NEAR} SELECT label AS component_id, point3d_id AS id, cluster FROM p LEFT JOIN al ON point3d_id = id")
def density_clusters(spark, sf_dir):
    return cluster.dbscan(_members(spark, sf_dir), 0.9, 4).select("component_id", "id", "cluster")


@query("cleaned_components", f"WITH RECURSIVE {_NEAR}, k AS (SELECT label AS component_id, cluster, point3d_id AS id FROM p JOIN al ON point3d_id = id), s AS (SELECT component_id, cluster FROM k GROUP BY ALL HAVING count(*) >= 5) SELECT component_id, k.cluster, id FROM k JOIN s USING (component_id, cluster)")
def cleaned_components(spark, sf_dir):
    return cluster.cleaned(_members(spark, sf_dir), 0.9, 4, 5, split=True)


@query("label_clusters")
def label_clusters(spark, sf_dir):
    """Average-linkage clusters of vectors within a scene (iterative, no SQL form)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("group"), F.col("vec_id").cast("string").alias("label"), F.col("embedding").alias("vector"))
    return cluster.label_clusters(v, 0.9)
