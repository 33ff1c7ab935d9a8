"""Scattered points on a grid by inverse distance within a window."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import Grid

#: Cells along a side of a block whose points meet first.
BLOCK = 64
#: Cells of the grid that a task makes at most, where there are more than tasks run at once.
TASK_CELLS = 1 << 18


def inverse_distance(points: DataFrame, grid: Grid, radius: float | None = None, power: float = 1.0) -> DataFrame:
    """(row_i, col_i, points, value) of every cell of the grid: the mean of the points (x, y, z) within `radius` of its centre, weighted
    by distance to the power; points at a centre decide alone (their mean), and a cell without a point in reach is null.

    The radius is a cell's size times the root of 2 unless given. A point goes to the cells around it only. Points of a block of
    cells meet first, in parts that Spark splits and joins by their size, so a task's sums are of the cells of its part and not of
    the whole grid; sums are made before the second shuffle, so a cell with very many points costs no task more than others.
    """
    radius = grid.resolution * math.sqrt(2.0) if radius is None else float(radius)
    res = float(grid.resolution)
    near = lambda v, first, last: F.explode(F.sequence(F.greatest(F.lit(0), F.floor(first).cast("int")), F.least(F.lit(last - 1), F.floor(v).cast("int"))))
    row = lambda y: (F.lit(grid.top) - y) / res
    col = lambda x: (x - grid.left) / res
    x, y = F.col("x"), F.col("y")
    reach = points.filter((row(y - radius) >= 0) & (row(y + radius) < grid.rows) & (col(x + radius) >= 0) & (col(x - radius) < grid.cols) & F.col("z").isNotNull() & ~F.isnan("z"))
    parts = reach.select("x", "y", "z", F.floor(row(y) / BLOCK).alias("block_r"), F.floor(col(x) / BLOCK).alias("block_c")).hint("rebalance", F.col("block_r"), F.col("block_c"))
    dealt = parts.withColumn("row_i", near(row(y - radius), row(y + radius), grid.rows)).withColumn("col_i", near(col(x + radius), col(x - radius), grid.cols))
    d = F.sqrt((x - (grid.left + res * (F.col("col_i") + 0.5))) ** 2 + (y - (grid.top - res * (F.col("row_i") + 0.5))) ** 2)
    weighed = dealt.withColumn("d", d).filter(F.col("d") <= radius).withColumn("w", F.when(F.col("d") > 0, F.pow(F.col("d"), F.lit(-power))))
    # Cells take part in the sums as rows without a point: one grouping, no join; a task of theirs holds few of them.
    cells = grid.rows * grid.cols
    every = points.sparkSession.range(0, cells, 1, max(points.sparkSession.sparkContext.defaultParallelism, cells // TASK_CELLS))
    none = [F.lit(None).cast("double").alias(c) for c in ("z", "d", "w")]
    every = every.select(F.expr(f"cast(id div {grid.cols} as int)").alias("row_i"), (F.col("id") % grid.cols).cast("int").alias("col_i"), *none)
    sums = weighed.select("row_i", "col_i", "z", "d", "w").unionByName(every).groupBy("row_i", "col_i")
    sums = sums.agg(F.count("d").alias("points"), F.sum(F.col("w") * F.col("z")).alias("zw"), F.sum("w").alias("w"), F.avg(F.when(F.col("d") == 0, F.col("z"))).alias("exact"))
    return sums.select("row_i", "col_i", "points", F.coalesce("exact", F.col("zw") / F.col("w")).alias("value"))
