"""Exact vector search: queries against all vectors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sceneloom.functions.vectors import dot, similarity_of_reported
from sceneloom.operators import lexical
from sceneloom.session import materialised

#: Queries that are broadcast at a time; more of them are searched in several goes.
QUERIES = 10_000


def similar(vectors: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """query_id, component_id, score, rank: of all ``vectors`` (component_id, embedding) the ``k`` (all, if None) of the largest dot product with each query (query_id, embedding).

    Equal scores (to nine decimals) go by id.  Vectors and queries that are null are not
    compared.  The queries are broadcast, ``QUERIES`` at a time; the vectors stay where they are, and
    each task keeps its own best before anything is shuffled.
    """
    if queries.limit(QUERIES + 1).count() > QUERIES:
        goes = math.ceil(queries.count() / QUERIES) * 2  # so that hardly any go has more
        dealt = materialised(queries.withColumn("go", F.pmod(F.xxhash64("query_id"), F.lit(goes))))
        return reduce(DataFrame.unionByName, [_similar(vectors, dealt.where(F.col("go") == i).drop("go"), k) for i in range(goes)])
    return _similar(vectors, queries, k)


def _similar(vectors: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    asked = queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").alias("q"))
    scored = vectors.where("embedding IS NOT NULL").crossJoin(F.broadcast(asked)).select("query_id", "component_id", dot(F.col("embedding"), F.col("q")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "component_id"))
    ranked = scored.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def similar_to(vectors: DataFrame, component_id: int, k: int | None = 10) -> DataFrame:
    """``similar`` to one of the vectors itself."""
    return similar(vectors, vectors.where(F.col("component_id") == component_id).select(F.col("component_id").alias("query_id"), "embedding"), k)


def similar_until_drop(vectors: DataFrame, component_id: int, k: int = 50, gap: float | None = 0.05, ratio: float | None = None) -> DataFrame:
    """rank, component_id, score of the likeness that the service reports for one vector's neighbours, before its first drop (see ``lexical.elbow``)."""
    found = similar_to(vectors, component_id, None).select("component_id", similarity_of_reported(2 - 2 * F.col("score")).alias("score"))
    return lexical.elbow(lexical.top_k(found, k), gap, ratio, positive=False)
