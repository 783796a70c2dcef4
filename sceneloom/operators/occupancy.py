"""Occupancy grids as tables of cells, and routes over them."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.geometry import box_corners
from sceneloom.session import materialised


def frame(points: DataFrame, size: float) -> DataFrame:
    """One row: min_x, min_y, rows, cols of the grid over points (x, y), padded by two cells on each side."""
    pad = 2 * size
    ends = points.agg((F.min("x") - pad).alias("min_x"), (F.min("y") - pad).alias("min_y"), (F.max("x") + pad).alias("max_x"), (F.max("y") + pad).alias("max_y"))
    return ends.select("min_x", "min_y", F.ceil((F.col("max_y") - F.col("min_y")) / size).cast("int").alias("rows"), F.ceil((F.col("max_x") - F.col("min_x")) / size).cast("int").alias("cols"))


def occupancy(points: DataFrame, floor: DataFrame, size: float = 0.3, threshold: float = 0.7) -> DataFrame:
    """row, col, total, floor, occupied of every cell; free are cells without points and those with ``threshold`` of floor points among all.

    Floor points need not be among ``points``, so their share may exceed 1.  Both are
    counted by cell before they meet; the grid is made row by row.
    """
    grid = F.broadcast(frame(points, size))
    counted = lambda df, n: df.crossJoin(grid).groupBy(F.floor((F.col("y") - F.col("min_y")) / size).cast("int").alias("row"), F.floor((F.col("x") - F.col("min_x")) / size).cast("int").alias("col")).agg(F.count(F.lit(1)).alias(n))
    cells = frame(points, size).select(F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols").repartition("row").select("row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    joined = cells.join(counted(points, "total"), ["row", "col"], "left").join(counted(floor, "floor"), ["row", "col"], "left").na.fill(0, ["total", "floor"])
    return joined.withColumn("occupied", F.when((F.col("total") == 0) | (F.col("floor") / F.col("total") >= threshold), 0).otherwise(1))


def statistics(cells: DataFrame) -> DataFrame:
    taken = F.sum("occupied")
    return cells.agg(F.count(F.lit(1)).alias("total_cells"), (F.count(F.lit(1)) - taken).alias("floor_cells"), taken.alias("occupied_cells"), (100 * (F.count(F.lit(1)) - taken) / F.count(F.lit(1))).alias("floor_percentage"))


def ascii_rows(cells: DataFrame) -> DataFrame:
    """row, line: '.' for free, '#' for taken."""
    marks = F.array_sort(F.collect_list(F.struct("col", F.when(F.col("occupied") == 1, "#").otherwise(".").alias("mark"))))
    return cells.groupBy("row").agg(F.array_join(F.transform(marks, lambda m: m["mark"]), "").alias("line"))


def free_boxes(cells: DataFrame, points: DataFrame, size: float, up: str = "z", height: float = 0.1) -> DataFrame:
    """row, col and corners of a flat box for each free cell, at the height that a tenth of the points lie under."""
    grid = frame(points, size).crossJoin(points.agg(F.percentile(up, F.lit(0.1)).alias("level")))
    x, y = F.col("min_x") + F.col("col") * size, F.col("min_y") + F.col("row") * size
    order = {"z": (0, 1, 2), "y": (0, 2, 1), "x": (2, 0, 1)}[up]
    low, high = [x, y, F.col("level")], [x + size, y + size, F.col("level") + height]
    place = lambda v: F.array(*[v[i] for i in order])
    return cells.where("occupied = 0").crossJoin(F.broadcast(grid)).select("row", "col", box_corners(place(low), place(high)).alias("corners"))


#: Requests of a part of a scene, at least.
ROUTES = 500

# Fixed value: the eight neighbours in the order in which ties are settled.
_STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def nearest_free(taken: set[tuple[int, int]], rows: int, cols: int, start: tuple[int, int], reach: int = 50) -> tuple[int, int] | None:
    """The first free cell in rings around ``start``, neighbours in reading order."""
    if start not in taken:
        return start
    ring, seen = [start], {start}
    for _ in range(reach + 1):
        following = []
        for r, c in ring:
            for dr, dc in _STEPS:
                cell = (r + dr, c + dc)
                if 0 <= cell[0] < rows and 0 <= cell[1] < cols and cell not in seen:
                    if cell not in taken:
                        return cell
                    seen.add(cell)
                    following.append(cell)
        ring = following
    return None


def shortest_path(taken: set[tuple[int, int]], rows: int, cols: int, start: tuple[int, int], goal: tuple[int, int], strict: bool = False) -> list[tuple[int, int]]:
    """A* over eight neighbours (corners may be cut), empty if there is no way.

    Cells in the queue keep the place they have when a better way to them is found, unless
    ``strict``; so a path may be somewhat longer than the shortest.
    """
    within = lambda c: 0 <= c[0] < rows and 0 <= c[1] < cols
    if not within(start) or not within(goal):
        return []
    first, last = nearest_free(taken, rows, cols, start), nearest_free(taken, rows, cols, goal)
    if first is None or last is None:
        return []
    cost, back, waiting, queue, nth = {first: 0.0}, {}, {first}, [(0.0, 0, first)], 0
    while queue:
        cell = heapq.heappop(queue)[2]
        waiting.discard(cell)
        if cell == last:
            path = [cell]
            while path[-1] in back:
                path.append(back[path[-1]])
            return path[::-1]
        for dr, dc in _STEPS:
            to = (cell[0] + dr, cell[1] + dc)
            if not within(to) or to in taken:
                continue
            through = cost[cell] + (math.sqrt(2) if dr and dc else 1.0)
            if through < cost.get(to, math.inf):
                cost[to], back[to] = through, cell
                if strict or to not in waiting:
                    nth += 1
                    heapq.heappush(queue, (through + math.dist(to, last), nth, to))
                    waiting.add(to)
    return []


def routes(requests: DataFrame, cells: DataFrame, grids: DataFrame) -> DataFrame:
    """route_id, step, row, col, x, y: the way of each request over the grid of its scene.

    ``requests`` has route_id, scene, x0, y0, x1, y1, ``cells`` scene, row, col, occupied, ``grids`` scene, min_x, min_y, size, rows, cols.
    The requests of a scene are dealt into parts, of ``ROUTES`` of them or of as many as its grid has taken cells if that is more,
    and a part and the taken cells are one task's: cells are sent no more often than there are requests.
    """

    def walk(asked: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        out = []
        taken = {(int(r), int(c)) for r, c in grid[["row", "col"]].itertuples(index=False)}
        for q in asked.itertuples(index=False):
            cell = lambda x, y, q=q: (int((y - q.min_y) / q.size), int((x - q.min_x) / q.size))
            for i, (r, c) in enumerate(shortest_path(taken, int(q.rows), int(q.cols), cell(q.x0, q.y0), cell(q.x1, q.y1))):
                out.append((q.route_id, i, r, c, q.min_x + (c + 0.5) * q.size, q.min_y + (r + 0.5) * q.size))
        return pd.DataFrame(out, columns=["route_id", "step", "row", "col", "x", "y"])

    taken = cells.where("occupied = 1").select("scene", "row", "col")
    sizes = taken.groupBy("scene").agg(F.count(F.lit(1)).alias("taken"))
    parts = requests.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).join(sizes, "scene", "left").select("scene", F.ceil(F.col("n") / F.greatest(F.lit(ROUTES), "taken")).alias("parts"))
    parts = materialised(parts)
    asked = requests.join(grids, "scene").join(parts, "scene").withColumn("part", F.pmod(F.xxhash64("route_id", "x0", "y0", "x1", "y1"), F.col("parts"))).drop("parts")
    sent = taken.join(parts, "scene").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return asked.groupBy("scene", "part").cogroup(sent.groupBy("scene", "part")).applyInPandas(walk, "route_id int, step int, row int, col int, x double, y double")
