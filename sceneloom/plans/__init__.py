"""Complete queries, each an operator or a chain of them applied to the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sceneloom.catalog import ORACLES, QUERIES
from sceneloom.plans import evaluation, graphs, relational, scalars, scenes, search, spatial


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_bm25(spark, sf_dir)

__all__ = ["all_oracles", "all_queries", "evaluation", "flagship", "graphs", "relational", "scalars", "scenes", "search", "spatial"]
