"""Run-length masks, and which mask a keypoint lies in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_lengths(counts: str) -> list[int]:
    """Lengths of alternate runs, first of 0s, of the compressed form: five bits a letter, signed, from the fourth on as differences to the one before last."""
    out: list[int] = []
    value = shift = 0
    for letter in counts:
        bits = ord(letter) - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            if bits & 16:
                value -= 1 << shift
            out.append(value + out[-2] if len(out) > 2 else value)
            value = shift = 0
    return out


def column_runs(masks: DataFrame) -> DataFrame:
    """frame, mask, x, y0, y1 (end excluded): the runs of masks (frame, mask, height, counts) within each image column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m in pdf.itertuples(index=False):
                ends = np.cumsum(run_lengths(m.counts))
                for a, b in zip(ends[0::2].tolist(), ends[1::2].tolist(), strict=False):
                    while a < b:
                        x, y = divmod(a, m.height)
                        stop = min(b, (x + 1) * m.height)
                        rows.append((m.frame, m.mask, x, y, y + stop - a))
                        a = stop
            yield pd.DataFrame(rows, columns=["frame", "mask", "x", "y0", "y1"])

    return masks.select("frame", "mask", "height", "counts").mapInPandas(run, "frame string, mask int, x int, y0 int, y1 int")


def extents(runs: DataFrame) -> DataFrame:
    """frame, mask, pixels and the area of the box around each mask."""
    ends = runs.groupBy("frame", "mask").agg(F.sum(F.col("y1") - F.col("y0")).alias("pixels"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return ends.withColumn("box_area", (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0")))


def points_in_masks(keypoints: DataFrame, runs: DataFrame) -> DataFrame:
    """frame, point3d_id, mask: the mask that each keypoint (frame, x, y, point3d_id) lies in; of several the one with the smallest box, then the first.

    Keypoints without a point (-1) match nothing; coordinates are truncated to pixels.
    """
    real = keypoints.where("point3d_id <> -1").select("frame", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "point3d_id")
    met = real.join(runs, ["frame", "x"]).where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))).select("frame", "x", "y", "point3d_id", "mask")
    first = Window.partitionBy("frame", "x", "y", "point3d_id").orderBy("box_area", "mask")
    return met.join(extents(runs).select("frame", "mask", "box_area"), ["frame", "mask"]).withColumn("n", F.row_number().over(first)).where("n = 1").select("frame", "point3d_id", "mask").distinct()


def points_in_any(keypoints: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct points whose keypoints lie in some mask."""
    return points_in_masks(keypoints, runs).select("point3d_id").distinct()


def accumulated(hits: DataFrame) -> DataFrame:
    """The points of each (slug, seq, obj_id) over all frames, ascending."""
    return hits.groupBy("slug", "seq", "obj_id").agg(F.sort_array(F.collect_set("point3d_id")).alias("points"))
