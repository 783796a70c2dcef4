"""The component table: lookups, ranked joins and copy-on-write changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sceneloom.functions.geometry import low_high, permuted_box


def by_id(components: DataFrame, component_id: int) -> DataFrame:
    return components.where(F.col("component_id") == component_id)


def by_ids(components: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of some ids; none for an empty list."""
    return components.where(F.col("component_id").isin(ids)) if ids else components.limit(0)


def only_valid(rows: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """key, ids: of each row's ``ids`` (array) those that ``valid`` (id) has, in their order; the least valid id if there is none.

    The ids are joined one by one and gathered again by row, so the valid ones may be many.
    """
    each = rows.select(key, F.posexplode("ids").alias("at", "id")).join(valid.select("id").distinct(), "id")
    kept = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("kept"))
    least = valid.agg(F.min("id").alias("least"))
    return rows.select(key).join(kept, key, "left").crossJoin(F.broadcast(least)).select(key, F.coalesce("kept", F.array("least")).alias("ids"))


def shown(components: DataFrame) -> DataFrame:
    """As results are given out: corners in the viewer's frame, a text where there is no caption, ids as strings."""
    return components.withColumns({"corners": permuted_box(F.col("corners")), "caption": F.coalesce("caption", F.lit("No caption available")), "component_id": F.col("component_id").cast("string")})


def in_rank_order(ranked: DataFrame, components: DataFrame, fallback: bool = True) -> DataFrame:
    """The rows of ranked ids (rank, component_id) with their rank; unknown ids drop out.

    With ``fallback`` the row of the least id (rank 1) is given where no ranked id is known.
    """
    found = ranked.select("rank", "component_id").join(components, "component_id")
    if not fallback:
        return found
    first = components.orderBy("component_id").limit(1).withColumn("rank", F.lit(1))
    none = found.agg(F.count(F.lit(1)).alias("known")).where("known = 0").select(F.lit(1).alias("rank"))
    return found.unionByName(first.join(F.broadcast(none), "rank", "left_semi").select(found.columns))


def next_id(components: DataFrame) -> DataFrame:
    """One row: the greatest id and one, 1 for an empty table."""
    return components.agg((F.coalesce(F.max("component_id"), F.lit(0)) + 1).alias("next_id"))


def updated(components: DataFrame, component_id: int, caption: str | None = None, corners: Column | None = None) -> DataFrame:
    """The table with one row changed; lo and hi follow the corners (null for none).  Without fields it is as it was."""
    here = F.col("component_id") == component_id
    change: dict[str, Column] = {}
    if caption is not None:
        change["caption"] = F.when(here, F.lit(caption)).otherwise(F.col("caption"))
    if corners is not None:
        lo, hi = low_high(corners)
        change |= {"corners": F.when(here, corners).otherwise(F.col("corners")), "lo": F.when(here, lo).otherwise(F.col("lo")), "hi": F.when(here, hi).otherwise(F.col("hi"))}
    return components.withColumns(change) if change else components


def matching(components: DataFrame, component_id: int) -> DataFrame:
    """One row: how many rows a change of this id touches."""
    return by_id(components, component_id).agg(F.count(F.lit(1)).alias("rowcount"))


def added(components: DataFrame, row: DataFrame) -> DataFrame:
    """With ``row`` under the next id; columns that it lacks are null."""
    return components.unionByName(row.drop("component_id").crossJoin(F.broadcast(next_id(components))).withColumnRenamed("next_id", "component_id"), allowMissingColumns=True)


def deleted(components: DataFrame, component_id: int) -> DataFrame:
    return components.where(F.col("component_id") != component_id)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` in place of those of ``table`` with the same keys, and the others."""
    return table.join(rows.select(keys), keys, "left_anti").unionByName(rows)


def remaining(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a repeated run has still to do."""
    return inputs.join(done.select(keys).distinct(), keys, "left_anti")


def best_by(rows: DataFrame, group: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in the given (total) order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def manifest(crops: DataFrame) -> DataFrame:
    """component_id, total_crops and the crops as an array, by crop_index."""
    return crops.groupBy("component_id").agg(F.count(F.lit(1)).alias("total_crops"), F.array_sort(F.collect_list(F.struct("crop_index", "crop_filename", "source_image", "fraction_visible"))).alias("crops"))


def described(captions: DataFrame, boxes: DataFrame, best_crops: DataFrame) -> DataFrame:
    """Captions with boxes and best crops, both optional; a blank caption counts as none."""
    return captions.join(boxes, "component_id", "left").join(best_crops, "component_id", "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def caption_statistics(captions: DataFrame) -> DataFrame:
    """One row: captions, and the mean, least and greatest number of their characters (null without captions)."""
    size = F.length("caption")
    return captions.agg(F.count("caption").alias("captions"), F.avg(size).alias("mean_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"))


def label_statistics(inventory: DataFrame) -> DataFrame:
    """One row: frames, and the mean, least and greatest number of labels (frame_no, labels) a frame has; 0 without frames."""
    size = F.size("labels")
    return inventory.agg(F.count(F.lit(1)).alias("frames"), *[F.coalesce(f(size), F.lit(0)).alias(n) for f, n in ((F.avg, "mean_labels"), (F.min, "min_labels"), (F.max, "max_labels"))])
