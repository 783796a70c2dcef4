"""Tables joined, filtered, counted and changed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sceneloom.catalog import query
from sceneloom.functions.text import contains_folded
from sceneloom.operators import boxes
from sceneloom.operators import components as comp
from sceneloom.plans.tables import COMPONENTS, POINTS, components, points, rounded, table


@query("component_table", f"WITH {COMPONENTS}, b AS (SELECT l_partkey, arg_min(l_orderkey, (-l_discount, l_orderkey, l_linenumber)) AS crop FROM lineitem GROUP BY l_partkey) SELECT component_id, caption, lo IS NOT NULL AS has_box, crop AS best_crop FROM c LEFT JOIN b ON component_id = l_partkey")
def component_table(spark, sf_dir):
    """Captions with boxes and best crops, both optional."""
    c = components(spark, sf_dir)
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("component_id")).agg(F.min_by("l_orderkey", F.struct(-F.col("l_discount"), "l_orderkey", "l_linenumber")).alias("best_crop"))
    return comp.described(c.select("component_id", "caption"), c.select("component_id", F.col("lo").isNotNull().alias("has_box")), best)


@query("caption_statistics", f"WITH {COMPONENTS} SELECT count(caption) AS captions, round(avg(length(caption)), 9) AS mean_length, min(length(caption)) AS min_length, max(length(caption)) AS max_length FROM c")
def caption_statistics(spark, sf_dir):
    return comp.caption_statistics(components(spark, sf_dir)).withColumn("mean_length", F.round("mean_length", 9))


@query("captions_with", f"WITH {COMPONENTS} SELECT component_id FROM c WHERE contains(lower(caption), lower('economy'))")
def captions_with(spark, sf_dir):
    return components(spark, sf_dir).where(contains_folded(F.col("caption"), F.lit("economy"))).select("component_id")


@query("component_lookup", f"WITH {COMPONENTS} SELECT component_id, caption FROM c WHERE component_id IN (5, 3, 1999, -4)")
def component_lookup(spark, sf_dir):
    return comp.by_ids(components(spark, sf_dir), [5, 3, 1999, -4]).select("component_id", "caption")


@query("component_first", f"WITH {COMPONENTS} SELECT component_id, caption FROM c ORDER BY component_id LIMIT 1")
def component_first(spark, sf_dir):
    return components(spark, sf_dir).orderBy("component_id").limit(1).select("component_id", "caption")


_RANKED = "r AS (SELECT * FROM (VALUES (1, 40), (2, 7), (3, 999999), (4, 12)) v(rank, component_id))"


@query("ranked_rows", f"WITH {COMPONENTS}, {_RANKED} SELECT rank, component_id, caption FROM r JOIN c USING (component_id)")
def ranked_rows(spark, sf_dir):
    """Rows of ranked ids, unknown ones left out."""
    ranked = spark.createDataFrame([(1, 40), (2, 7), (3, 999999), (4, 12)], "rank int, component_id long")
    return comp.in_rank_order(ranked, components(spark, sf_dir)).select("rank", "component_id", "caption")


@query("ranked_rows_fallback", f"WITH {COMPONENTS} SELECT 1 AS rank, component_id, caption FROM c ORDER BY component_id LIMIT 1")
def ranked_rows_fallback(spark, sf_dir):
    """With no known id the first component is given."""
    ranked = spark.createDataFrame([(1, -40)], "rank int, component_id long")
    return comp.in_rank_order(ranked, components(spark, sf_dir)).select("rank", "component_id", "caption")


@query("component_update", f"WITH {COMPONENTS} SELECT component_id, CASE WHEN component_id = 11 THEN 'a green lamp' ELSE caption END AS caption, (SELECT count(*) FROM c WHERE component_id = 11) AS rowcount FROM c")
def component_update(spark, sf_dir):
    c = components(spark, sf_dir)
    return comp.updated(c, 11, caption="a green lamp").select("component_id", "caption").crossJoin(F.broadcast(comp.matching(c, 11)))


@query("component_update_box", f"WITH {COMPONENTS} SELECT component_id, CASE WHEN component_id <> 11 THEN lo IS NOT NULL ELSE false END AS has_box FROM c")
def component_update_box(spark, sf_dir):
    """A box without corners takes the geometry away."""
    return comp.updated(components(spark, sf_dir), 11, corners=F.array().cast("array<array<double>>")).select("component_id", F.col("lo").isNotNull().alias("has_box"))


@query("component_add", f"WITH {COMPONENTS} SELECT component_id, caption FROM c UNION ALL SELECT coalesce(max(component_id), 0) + 1, 'a new chair' FROM c")
def component_add(spark, sf_dir):
    row = spark.createDataFrame([("a new chair",)], "caption string")
    return comp.added(components(spark, sf_dir), row).select("component_id", "caption")


@query("component_delete", f"WITH {COMPONENTS} SELECT component_id, caption FROM c WHERE component_id <> 11")
def component_delete(spark, sf_dir):
    return comp.deleted(components(spark, sf_dir), 11).select("component_id", "caption")


@query("upsert", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 20 UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderkey < 20")
def upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return comp.upserted(orders, orders.where("o_orderkey < 20").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


@query("resume", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05)")
def resume(spark, sf_dir):
    """What earlier runs have not done yet."""
    done = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return comp.remaining(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("best_crops", "SELECT component_id, crop, rank FROM (SELECT l_partkey AS component_id, l_orderkey AS crop, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5")
def best_crops(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "component_id")
    best = comp.best_by(rows, "component_id", [F.desc("l_discount"), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5)
    return best.select("component_id", F.col("l_orderkey").alias("crop"), F.col("rank").cast("long").alias("rank"))


@query("crop_manifest", "SELECT l_orderkey AS component_id, count(*) AS total_crops, string_agg('crop_' || l_linenumber || '_' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS crops FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem) GROUP BY l_orderkey")
def crop_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").distinct()
    crops = rows.select(F.col("l_orderkey").alias("component_id"), F.struct("l_linenumber", "l_partkey").alias("crop_index"), F.format_string("crop_%d_%d", "l_linenumber", "l_partkey").alias("crop_filename"), F.lit("").alias("source_image"), F.col("l_discount").alias("fraction_visible"))
    return comp.manifest(crops).select("component_id", "total_crops", F.array_join(F.transform("crops", lambda c: c["crop_filename"]), ",").alias("crops"))


@query("percentile_boxes", f"""WITH {POINTS}, q AS (SELECT label AS component_id, count(*) AS n, quantile_cont(x, 0.025) AS x0, quantile_cont(x, 0.975) AS x1, quantile_cont(y, 0.025) AS y0, quantile_cont(y, 0.975) AS y1, quantile_cont(z, 0.025) AS z0, quantile_cont(z, 0.975) AS z1 FROM p GROUP BY label)
SELECT component_id, any_value(n) AS num_point3d_ids, count(*) AS num_points_used, any_value(n) - count(*) AS num_filtered, round(min(x), 6) + 0.0 AS x0, round(min(y), 6) + 0.0 AS y0, round(min(z), 6) + 0.0 AS z0, round(max(x), 6) + 0.0 AS x1, round(max(y), 6) + 0.0 AS y1, round(max(z), 6) + 0.0 AS z1, round((min(x) + max(x)) / 2, 6) + 0.0 AS cx
FROM p JOIN q ON label = component_id WHERE x BETWEEN q.x0 AND q.x1 AND y BETWEEN q.y0 AND q.y1 AND z BETWEEN q.z0 AND q.z1 GROUP BY component_id""")
def percentile_boxes(spark, sf_dir):
    p = points(spark, sf_dir)
    found = boxes.percentile_boxes(p.select(F.col("label").alias("component_id"), "point3d_id"), p)
    ends = [rounded(F.col(c)[i]).alias(f"{a}{n}") for n, c in ((0, "lo"), (1, "hi")) for i, a in enumerate("xyz")]
    return found.select("component_id", "num_point3d_ids", "num_points_used", "num_filtered", *ends, rounded(F.col("center")[0]).alias("cx"))


@query("box_statistics", f"WITH {COMPONENTS}, v AS (SELECT hi[1] - lo[1] AS x, hi[2] - lo[2] AS y, hi[3] - lo[3] AS z FROM c WHERE lo IS NOT NULL) SELECT round(min(x * y * z), 6) AS min_volume, round(max(x * y * z), 6) AS max_volume, round(avg(x * y * z), 6) AS mean_volume, round(median(x * y * z), 6) AS median_volume, " + ", ".join(f"round({f}({a}), 6) AS {n}_{a}" for a in "xyz" for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"))) + " FROM v")
def box_statistics(spark, sf_dir):
    c = components(spark, sf_dir).where("lo IS NOT NULL").withColumn("size", F.zip_with("hi", "lo", lambda h, l: h - l))
    found = boxes.box_statistics(c)
    return found.select(*[F.round(n, 6).alias(n) for n in found.columns])


@query("visible_images", "WITH t AS (SELECT l_partkey AS component_id, count(*) AS total_points FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY 1), m AS (SELECT DISTINCT l_partkey AS component_id, l_orderkey AS point FROM lineitem), v AS (SELECT component_id, l_suppkey % 5 AS image_id, count(*) AS visible_points FROM m JOIN lineitem ON l_orderkey = point GROUP BY 1, 2) SELECT v.component_id, CAST(image_id AS BIGINT) AS image_id, visible_points, total_points, round(visible_points / total_points, 6) AS fraction_visible FROM v JOIN t ON v.component_id = t.component_id WHERE visible_points >= greatest(1, floor(total_points * 0.9))")
def visible_images(spark, sf_dir):
    """Images that see enough of a component's points, by the points' tracks."""
    rows = table(spark, sf_dir, "lineitem")
    members = rows.select(F.col("l_partkey").alias("component_id"), F.col("l_orderkey").alias("point3d_id")).distinct()
    track = rows.select(F.col("l_orderkey").alias("point3d_id"), (F.col("l_suppkey") % 5).alias("image_id"))
    return boxes.visible_enough(boxes.visibility(members, track), 0.9).withColumn("fraction_visible", F.round("fraction_visible", 6))


@query("inverted_index", "SELECT event_type AS label, count(DISTINCT user_id) AS frames, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS users FROM events GROUP BY event_type")
def inverted_index(spark, sf_dir):
    """Labels with the frames that show them."""
    users = F.array_sort(F.collect_set(F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count_distinct("user_id").alias("frames"), F.array_join(users, ",").alias("users"))


@query("label_frequency", "SELECT user_id AS label, count(DISTINCT CAST(ts AS DATE)) AS frames FROM events GROUP BY user_id")
def label_frequency(spark, sf_dir):
    """On how many days each label is seen."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("label")).agg(F.count_distinct(F.col("ts").cast("date")).alias("frames"))


@query("first_seen", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def first_seen(spark, sf_dir):
    from sceneloom.operators.windows import first_seen as first

    return first(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", "event_type", "event_id")


@query("prompt", f"WITH {COMPONENTS} SELECT string_agg('Component ' || component_id || ': ' || caption || chr(10) || chr(10), '' ORDER BY component_id) AS prompt FROM c WHERE component_id < 50")
def prompt(spark, sf_dir):
    from sceneloom.functions.text import prompt_line

    rows = components(spark, sf_dir).where("component_id < 50").select("component_id", prompt_line(F.col("component_id"), F.col("caption")).alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("component_id", "line"))), lambda x: x["line"]), "").alias("prompt"))


@query("sampled_frames", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders) SELECT DISTINCT o_orderkey FROM o, (SELECT unnest(range(0, 60)) AS i) k WHERE n = CAST(trunc(i * (total - 1) / 59.0) AS BIGINT)")
def sampled_frames(spark, sf_dir):
    """Sixty rows at even distances in the order of keys, numbered without one task for all."""
    from sceneloom.operators.windows import renumbered

    orders = renumbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    wanted = total.select(F.explode(F.expr("transform(sequence(0, 59), i -> CAST(i * (total - 1) / 59.0D AS BIGINT))")).alias("new_id")).distinct()
    return orders.join(F.broadcast(wanted), "new_id").select("o_orderkey")


@query("even_counts", "SELECT o_orderstatus, CAST(sum(CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY o_orderstatus")
def even_counts(spark, sf_dir):
    """Dense numbers within groups."""
    numbered = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey")) - 1)
    return numbered.groupBy("o_orderstatus").agg(F.sum((F.col("n") % 2 == 0).cast("long")).alias("even"))
