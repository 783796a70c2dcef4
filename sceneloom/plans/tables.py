"""Scene tables made from the tables of a folder, and the same as SQL.

A component is a part with its name, brand and type as caption; the first six elements of
the vector with its id span its box (ten units to one), and a part without vector has no
geometry.  Elements seven to nine of a vector make a point, line items say which mask
(part) sees which point (order) in which image (supplier), events are frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions.geometry import box_corners, middle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, vectors = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    e = lambda i: F.col("embedding")[i].cast("double") * 10
    some = F.col("embedding").isNotNull()
    joined = part.join(vectors, part.p_partkey == vectors.vec_id, "left").select(
        F.col("p_partkey").alias("component_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("caption"),
        F.when(some, F.array(*[F.least(e(i), e(i + 3)) for i in range(3)])).alias("lo"), F.when(some, F.array(*[F.greatest(e(i), e(i + 3)) for i in range(3)])).alias("hi"), "label",
    )
    return joined.withColumns({"center": F.when(F.col("lo").isNotNull(), middle(F.col("lo"), F.col("hi"))), "corners": F.when(F.col("lo").isNotNull(), box_corners(F.col("lo"), F.col("hi")))})


COMPONENTS = """
c AS (SELECT p_partkey AS component_id, p_name || ' ' || p_brand || ' ' || p_type AS caption, label,
        CASE WHEN embedding IS NOT NULL THEN [least(e[1], e[4]), least(e[2], e[5]), least(e[3], e[6])] END AS lo,
        CASE WHEN embedding IS NOT NULL THEN [greatest(e[1], e[4]), greatest(e[2], e[5]), greatest(e[3], e[6])] END AS hi
      FROM (SELECT part.*, embedding, label, [CAST(x AS DOUBLE) * 10 for x in embedding] AS e FROM part LEFT JOIN embeddings ON p_partkey = vec_id))
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double") * 10
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point3d_id"), e(6).alias("x"), e(7).alias("y"), e(8).alias("z"), "label")


POINTS = "p AS (SELECT vec_id AS point3d_id, CAST(embedding[7] AS DOUBLE) * 10 AS x, CAST(embedding[8] AS DOUBLE) * 10 AS y, CAST(embedding[9] AS DOUBLE) * 10 AS z, label FROM embeddings)"


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node (a supplier's part), point (order), image (supplier)"""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 1000 + F.col("l_suppkey") % 5).alias("node"), F.col("l_orderkey").alias("point"), (F.col("l_suppkey") % 5).alias("image"))


INCIDENCE = "i AS (SELECT l_partkey * 1000 + l_suppkey % 5 AS node, l_orderkey AS point, l_suppkey % 5 AS image FROM lineitem)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no (half days of January), label (user)"""
    return table(spark, sf_dir, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 43_200_000_000).cast("int").alias("frame_no"), F.format_string("user %d", F.col("user_id")).alias("label")).distinct()


FRAMES = "f AS (SELECT DISTINCT CAST(floor(epoch_us(ts) / 43200000000) AS INTEGER) AS frame_no, 'user ' || user_id AS label FROM events)"
