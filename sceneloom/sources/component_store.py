"""The component table with its indexes, in one folder: boxes in a tree, captions in a positional index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.operators import fulltext
from sceneloom.operators.spatial import within_radius
from sceneloom.operators.spatial_index import SIDES, BoxTree, corners_of, read_tree, window, write_tree


@dataclass(frozen=True)
class ComponentStore:
    table: DataFrame
    tree: BoxTree
    text: fulltext.TextIndex

    def by_ids(self, ids: list[int]) -> DataFrame:
        """The rows of some ids; row groups of others are skipped, as the table is in order of ids."""
        return self.table.where(F.col("component_id").isin(ids))

    def near(self, components: DataFrame, radius: float) -> DataFrame:
        """left_id, right_id, distance of ``components`` (component_id, lo, hi) and what is stored within ``radius`` of them."""
        return within_radius(components, self.table, radius, self.tree)

    def inside(self, lo: list[float], hi: list[float]) -> DataFrame:
        """component_id of the boxes that touch one box."""
        return window(self.tree, lo, hi).withColumnRenamed("box_id", "component_id")

    def prefilter(self, query: str, limit: int | None = 1000, candidates: DataFrame | None = None) -> DataFrame:
        """The rows that satisfy ``query``, of ``candidates`` (component_id) if given: those of the ``limit`` least ids (all, if None)."""
        met = fulltext.matching(self.text, query)
        met = met if candidates is None else met.join(candidates.select("component_id"), "component_id", "left_semi")
        met = met if limit is None else met.orderBy("component_id").limit(limit)
        return self.table.join(met, "component_id", "left_semi")

    def search(self, query: str, k: int | None = 10) -> DataFrame:
        """rank, component_id, score of the best rows."""
        return fulltext.search(self.text, query, k)


def write_store(components: DataFrame, path: str) -> None:
    """Writes ``components`` (component_id, caption, lo, hi, ...; ids are one row's each) and its indexes to ``path``; rows without box or caption are in the table all the same."""
    rows = components.withColumn("component_id", F.col("component_id").cast("long"))
    rows.repartitionByRange("component_id").sortWithinPartitions("component_id").write.mode("overwrite").parquet(f"{path}/table")
    stored = rows.sparkSession.read.parquet(f"{path}/table")
    write_tree(corners_of(stored).select(F.col("component_id").alias("box_id"), *SIDES), f"{path}/tree")
    fulltext.write_index(stored, f"{path}/text")


def read_store(spark: SparkSession, path: str) -> ComponentStore:
    return ComponentStore(spark.read.parquet(f"{path}/table"), read_tree(spark, f"{path}/tree"), fulltext.read_index(spark, f"{path}/text"))
