"""Readers and writers of scene artefacts (JSON, event lines, tables); schemas are explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom import schema as S


def json_table(spark: SparkSession, path: str, ddl: str, many: bool = True) -> DataFrame:
    """A JSON document for each file, an array of records or (``many`` false) one object with the given fields; records that do not parse are null."""
    whole = spark.read.text(path, wholetext=True)
    kind = f"ARRAY<STRUCT<{_fields(ddl)}>>" if many else f"STRUCT<{_fields(ddl)}>"
    parsed = whole.select(F.from_json("value", kind).alias("j"))
    return (parsed.select(F.explode("j").alias("j")) if many else parsed).select("j.*")


def _fields(ddl: str) -> str:
    """DDL columns as struct fields: the first blank of each top-level column becomes a colon."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"`{name}`: {kind}")
            start = i + 1
    return ", ".join(out)


def json_map(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """file, j: a JSON document for each file that is a map of the given type."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", ddl).alias("j"))


def captions(spark: SparkSession, path: str) -> DataFrame:
    return json_table(spark, path, S.CAPTION)


def box_corners(spark: SparkSession, path: str) -> DataFrame:
    """component_id and bbox; boxes may lack all but their corners."""
    ddl = f"connected_comp_id INT, num_point3d_ids INT, num_points_used INT, num_filtered INT, bbox STRUCT<{_fields(S.BOX)}>"
    return json_table(spark, path, ddl).withColumnRenamed("connected_comp_id", "component_id")


def crops(spark: SparkSession, path: str) -> DataFrame:
    """component_id and the fields of each crop of a manifest (a map of components)."""
    each = json_map(spark, path, S.MANIFEST).select(F.explode("j").alias("key", "m"))
    return each.select(F.coalesce("m.component_id", F.col("key").cast("int")).alias("component_id"), F.explode("m.crops").alias("c")).select("component_id", "c.*")


def image_associations(spark: SparkSession, path: str, min_points: int = 10) -> DataFrame:
    """image_id, mask_id, mask, point3d_id of masks with ``min_points`` points at least; files without mask ids get <stem>_mask_<i>."""
    rows = json_table(spark, path, S.IMAGE_ASSOCIATION, many=False)
    each = rows.select("image_id", "image_name", "mask_ids", F.posexplode("mask_point3d_sets").alias("mask", "points")).where(F.size("points") >= min_points)
    stem = F.regexp_replace("image_name", r"\.[^.]*$", "")
    made = F.concat(stem, F.lit("_mask_"), F.col("mask").cast("string"))
    return each.select("image_id", F.coalesce(F.get("mask_ids", F.col("mask")), made).alias("mask_id"), "mask", F.explode("points").alias("point3d_id"))


def object_associations(spark: SparkSession, path: str, min_points: int = 1, discard: list[str] | None = None) -> DataFrame:
    """slug, seq, obj_id, point3d_id of a three-level map; labels to discard are compared without case."""
    each = json_map(spark, path, S.OBJECT_ASSOCIATION).select(F.explode("j").alias("slug", "a")).select("slug", F.explode("a").alias("seq", "b")).select("slug", "seq", F.explode("b").alias("obj_id", "points"))
    kept = each.where(F.size("points") >= min_points)
    kept = kept.where(~F.lower("slug").isin([d.lower() for d in discard])) if discard else kept
    return kept.select("slug", "seq", F.col("obj_id").cast("int").alias("obj_id"), F.explode("points").alias("point3d_id"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """frame_no, label, position from a map of frame names; a frame name without a number is an error."""
    each = json_map(spark, path, S.INVENTORY).select(F.explode("j").alias("name", "labels"))
    number = F.nullif(F.regexp_extract("name", r"(\d+)$", 1), F.lit("")).cast("int")
    checked = F.when(number.isNull(), F.raise_error(F.concat(F.lit("no frame number in "), F.col("name"))).cast("int")).otherwise(number)
    return each.select(checked.alias("frame_no"), F.posexplode("labels").alias("position", "label")).where(F.trim("label") != "")


def masks(spark: SparkSession, path: str) -> DataFrame:
    """frame, mask, obj_id, height, width, counts of mask files that are a list or an object with ``annotations``."""
    whole = spark.read.text(path, wholetext=True).withColumn("frame", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    kind = f"ARRAY<STRUCT<{_fields(S.MASK)}>>"
    either = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"STRUCT<annotations: {kind}>")["annotations"])
    return whole.select("frame", F.posexplode(either).alias("mask", "m")).select("frame", "mask", "m.obj_id", F.col("m.segmentation.size")[0].alias("height"), F.col("m.segmentation.size")[1].alias("width"), "m.segmentation.counts", "m.area")


def floor_points(spark: SparkSession, path: str) -> DataFrame:
    rows = json_table(spark, path, S.FLOOR_POINT)
    return rows.select("point_id", *[F.col("coords")[i].alias(a) for i, a in enumerate("xyz")])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """vertex, segment of a mesh."""
    return json_table(spark, path, "segIndices ARRAY<BIGINT>", many=False).select(F.posexplode("segIndices").alias("vertex", "segment"))


def segment_groups(spark: SparkSession, path: str) -> DataFrame:
    """object_id, label, segment; groups called SPLIT are left out."""
    each = json_table(spark, path, S.SEG_GROUPS, many=False).select(F.explode("segGroups").alias("g")).where("g.label <> 'SPLIT'")
    return each.select(F.coalesce("g.objectId", "g.id").alias("object_id"), "g.label", F.explode("g.segments").alias("segment"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result files below a folder, with the folder's name as ``ablation``."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*_result.json", recursiveFileLookup=True)
    return whole.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("ablation"), F.from_json("value", S.RESULT).alias("j")).select("ablation", "j.*")


_EVENT = "type STRING, content STRING, name STRING, arguments STRING, component_ids ARRAY<INT>, reason STRING"


def event_of(line: Column) -> Column:
    """The object of a ``data: `` line; null for other lines and what does not parse."""
    return F.when(line.startswith("data: "), F.from_json(F.substring(line, F.lit(7), F.length(line)), _EVENT))


def until_end(events: DataFrame, stream: str = "stream", order: str = "nth") -> DataFrame:
    """The events (stream, nth, event) of each stream up to its first result or error."""
    from pyspark.sql.window import Window

    ended = F.max(F.col("event.type").isin("result", "error").cast("int")).over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.where("event.type IS NOT NULL").withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0").drop("ended")


def write_partition(rows: DataFrame, path: str, by: str) -> None:
    """The partitions that ``rows`` has, overwritten; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_pivot(wide: DataFrame, path: str, values: list[str]) -> None:
    """A CSV table with a header and four decimals."""
    wide.select(*[c for c in wide.columns if c not in values], *[F.format_string("%.4f", F.col(f"`{v}`")).alias(v) for v in values]).write.mode("overwrite").csv(path, header=True)
