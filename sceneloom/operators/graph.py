"""Overlap graphs of masks: edges by shared points or voxels, components with and without constraints."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.vectors import cosine_distance
from sceneloom.operators.windows import renumbered
from sceneloom.session import materialised


def overlaps(incidence: DataFrame, least_likeness: float | None = None, differ: str | None = None) -> DataFrame:
    """a, b, overlap, size_a, size_b: pairs of nodes (a < b) that share points (node, point), with how many.

    Pairs are counted point by point with partial sums before the shuffle.  A point of m nodes gives m (m - 1) / 2 pairs at most: of
    them go, before they are counted, those whose sizes alone rule out a Jaccard likeness of ``least_likeness``, and those that have the column
    ``differ`` of ``incidence`` (one value a node) in common.
    """
    own = ["node"] if differ is None else ["node", differ]
    each = incidence.select(*own, "point").distinct()
    each = materialised(each.join(each.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "node"))
    side = lambda n: each.select("point", *[F.col(c).alias(f"{c}_{n}") for c in (*own, "size")]).withColumnRenamed(f"node_{n}", n)
    met = side("a").join(side("b"), "point").where("a < b")
    if least_likeness is not None:
        met = met.where(F.least("size_a", "size_b") >= least_likeness * F.greatest("size_a", "size_b"))
    if differ is not None:
        met = met.where(F.col(f"{differ}_a") != F.col(f"{differ}_b"))
    return met.groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("overlap")).select("a", "b", "overlap", "size_a", "size_b")


def jaccard_edges(incidence: DataFrame, nodes: DataFrame, min_overlap: int | None = None, tau: float = 0.1, min_points: int = 1, cross: str | None = "image") -> DataFrame:
    """a, b, overlap, jaccard of pairs that share ``min_overlap`` points or have Jaccard ``tau`` or more.

    ``nodes`` (node, and the column ``cross``) tells what must differ between the two;
    nodes of fewer than ``min_points`` points are left out.
    """
    big = incidence.groupBy("node").agg(F.count_distinct("point").alias("points")).where(F.col("points") >= min_points).select("node")
    kept = incidence.select("node", "point").join(big, "node", "left_semi")
    if cross is not None:
        kept = kept.join(nodes.select("node", cross), "node")
    found = overlaps(kept, tau if min_overlap is None else None, cross).withColumn("jaccard", F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")))
    enough = F.col("jaccard") >= tau
    return found.where(enough if min_overlap is None else enough | (F.col("overlap") >= min_overlap)).select("a", "b", "overlap", "jaccard")


def guarded(edges: DataFrame, vectors: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): edges with clip_distance of their nodes' vectors (node, vector); too far apart is rejected, without vector passes."""
    side = lambda n: vectors.select(F.col("node").alias(n), F.col("vector").alias(f"v_{n}"))
    measured = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("clip_distance", cosine_distance(F.col("v_a"), F.col("v_b"))).drop("v_a", "v_b")
    far = F.coalesce(F.col("clip_distance") > limit, F.lit(False))
    return measured.where(~far), measured.where(far).withColumn("rejection_reason", F.lit("clip_distance"))


def distinct_instances(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges but for those between two instances of one (seq, slug)."""
    side = lambda n: nodes.select(F.col("node").alias(n), F.struct("seq", "slug").alias(f"key_{n}"))
    return edges.join(side("a"), "a").join(side("b"), "b").where(F.col("key_a") != F.col("key_b")).drop("key_a", "key_b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node that edges (a, b) connect each node with.

    Alternating stars: each node hands its larger neighbours to the least of its neighbourhood, then its
    smaller ones and itself, until all that is left are stars around least nodes.  Only edges are rewritten, and
    they become fewer from round to round; nodes without any join at the end.
    """
    stars = materialised(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (state := stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()) != before:
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        stars = materialised(small.select("e.u", "e.v").where("u <> v").distinct())
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree: 0 without edges."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: connected_components, largest_component_size, average_degree, max_degree, nodes without edges included; without any edge all null."""
    sizes = components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    parts = sizes.agg(F.count(F.lit(1)).alias("connected_components"), F.max("size").alias("largest_component_size"))
    own = degrees(nodes, edges).agg(F.avg("degree").alias("average_degree"), F.max("degree").alias("max_degree"))
    any_edge = F.col("max_degree") > 0
    return parts.crossJoin(own).select(*[F.when(any_edge, F.col(c)).alias(c) for c in ("connected_components", "largest_component_size", "average_degree", "max_degree")])


#: Links that one task may work off at the end of ``constrained_components``.
LAST_LINKS = 200_000


def constrained_components(nodes: DataFrame, edges: DataFrame, distance: str = "clip_distance") -> DataFrame:
    """node, component: unions in the order of confidence, none that would put two instances of one (seq, slug) together.

    ``nodes`` has node, seq and slug, ``edges`` a, b, jaccard and perhaps ``distance``
    (null counts as 1).  Edges are taken by falling jaccard, rising distance, a, b.  An edge that comes first among all that are
    left at both of its groups is taken whatever happens elsewhere, for nothing can change the two before it; and what may not be joined once never
    may.  So all such edges are taken in one round, what joins a group with itself or two of one instance goes, and when
    ``LAST_LINKS`` are left, one task takes those in order.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    clip = F.coalesce(F.col(distance).cast("double"), F.lit(1.0)) if distance in edges.columns else F.lit(1.0)
    unsure = F.col("jaccard").isNull() | F.isnan("jaccard")
    order = F.struct(F.when(unsure, float("inf")).otherwise(0.0 - F.col("jaccard")).alias("fall"), clip.alias("clip"), "a", "b").alias("order")
    groups = nodes.select(F.col("node").alias("head"), F.array(F.struct("seq", "slug")).alias("keys"))

    def allowed(links: DataFrame, groups: DataFrame) -> DataFrame:
        side = lambda n: groups.select(F.col("head").alias(n), F.col("keys").alias(f"keys_{n}"))
        both = links.where("x <> y").join(side("x"), "x").join(side("y"), "y")
        return materialised(both.where(~F.arrays_overlap("keys_x", "keys_y")).select("x", "y", "order"))

    links, unions = allowed(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), order), groups), []
    while links.count() > LAST_LINKS:
        first = links.select(F.explode(F.array("x", "y")).alias("head"), "order").groupBy("head").agg(F.min("order").alias("order"))
        taken = first.groupBy("order").agg(F.count(F.lit(1)).alias("ends"), F.max("head").alias("gone"), F.min("head").alias("into")).where("ends = 2")
        unions.append(materialised(taken.select("gone", "into")))
        moved = lambda rows, n: rows.join(unions[-1].withColumnRenamed("gone", n), n, "left").withColumn(n, F.coalesce("into", n)).drop("into")
        ends = links.select(F.explode(F.array("x", "y")).alias("head")).distinct()
        groups = materialised(moved(groups.join(ends, "head", "left_semi"), "head").groupBy("head").agg(F.flatten(F.collect_list("keys")).alias("keys")))
        links = allowed(moved(moved(links, "x"), "y"), groups)

    def merge(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        head = {n: n for n in own["head"]}
        keys = {n: {(k["seq"], k["slug"]) for k in held} for n, held in own[["head", "keys"]].itertuples(index=False)}
        group = {n: [n] for n in head}
        for x, y in links.sort_values(["fall", "clip", "a", "b"])[["x", "y"]].itertuples(index=False):
            x, y = head[x], head[y]
            if x == y or keys[x] & keys[y]:
                continue
            if len(group[x]) < len(group[y]):
                x, y = y, x
            for n in group.pop(y):
                head[n] = x
                group[x].append(n)
            keys[x] |= keys.pop(y)
        least = {x: min(members) for x, members in group.items()}
        return pd.DataFrame([(n, least[x]) for n, x in head.items() if n != least[x]], columns=["gone", "into"])

    last = links.select("x", "y", "order.*", F.lit(0).alias("all"))
    held = groups.join(links.select(F.explode(F.array("x", "y")).alias("head")).distinct(), "head", "left_semi").withColumn("all", F.lit(0))
    unions.append(materialised(held.groupBy("all").cogroup(last.groupBy("all")).applyInPandas(merge, f"gone {kind}, into {kind}")))
    return components(nodes, reduce(DataFrame.unionByName, unions).select(F.col("gone").alias("a"), F.col("into").alias("b")))


def stable_ids(new: DataFrame, old: DataFrame) -> DataFrame:
    """key, component_id: of new components (key, instances) those of old ones (component_id, instances): the same set's, else the least id of a subset, else a new id by key.

    A set within another shares its rarest instance with it, too: only the new sets that hold the instance of an old set that
    fewest new sets hold are looked at.
    """
    named = materialised(new.select("key", F.explode("instances").alias("instance"), F.size("instances").alias("size")))
    known = materialised(old.select("component_id", F.explode("instances").alias("instance"), F.size("instances").alias("old_size")))
    often = named.groupBy("instance").agg(F.count(F.lit(1)).alias("often"))
    rare = F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "instance")).alias("rare")
    rarest = known.join(often, "instance", "left").groupBy("component_id", "old_size").agg(rare).where("rare.often > 0").select("component_id", "old_size", "rare.instance")
    asked = materialised(rarest.join(named, "instance").where("old_size <= size").select("key", "component_id", "size", "old_size"))
    each = asked.join(known.drop("old_size"), "component_id").join(named.select("key", "instance"), ["key", "instance"], "left_semi")
    inside = each.groupBy("key", "component_id", "size", "old_size").agg(F.count(F.lit(1)).alias("shared")).where("shared = old_size")
    reused = inside.groupBy("key").agg(F.min_by("component_id", F.struct((F.col("size") != F.col("old_size")).alias("grown"), "component_id")).alias("component_id"))
    reused = materialised(reused)
    top = old.agg(F.coalesce(F.max("component_id"), F.lit(-1)).alias("top"))
    fresh = renumbered(new.select("key").join(reused, "key", "left_anti"), "key").crossJoin(F.broadcast(top))
    return reused.unionByName(fresh.select("key", (F.col("top") + 1 + F.col("new_id")).alias("component_id")))


def hop_path(edges: DataFrame, start: int, goal: int | None = None) -> DataFrame:
    """step, node: a path of the fewest edges, among those the one of least nodes from the goal back; no rows if there is none.  Ends when the goal is reached or a hop reaches nothing new.

    Without a goal the path leads to the largest node that can be reached.
    """
    spark = edges.sparkSession
    both = materialised(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    kind = edges.schema["a"].dataType.simpleString()
    fronts = [materialised(spark.createDataFrame([(start, None)], f"node {kind}, parent {kind}"))]  # one written table a hop
    while goal is None or not fronts[-1].where(F.col("node") == goal).limit(1).count():
        seen = reduce(DataFrame.unionByName, fronts[-2:]).select("node")  # what a front reaches lies in the one before it, in itself, or in none
        front = fronts[-1].select(F.col("node").alias("a"))
        reached = both.join(front, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")).join(seen, "node", "left_anti").select("node", "parent")
        fronts.append(materialised(reached))
        if not fronts[-1].limit(1).count():
            if goal is not None:
                return spark.createDataFrame([], f"step int, node {kind}")
            fronts.pop()
            goal = reduce(DataFrame.unionByName, fronts).agg(F.max("node")).first()[0]
            while not fronts[-1].where(F.col("node") == goal).limit(1).count():
                fronts.pop()
            break
    path, node = [], goal
    for step in range(len(fronts) - 1, -1, -1):
        path.append((step, node))
        node = fronts[step].where(F.col("node") == node).first()["parent"]
    return spark.createDataFrame(path[::-1], f"step int, node {kind}")


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both orders of each pair (a, b, ...)."""
    return pairs.unionByName(pairs.withColumns({"a": F.col("b"), "b": F.col("a")}))


def canonical(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first."""
    return pairs.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).dropDuplicates(["a", "b"])

