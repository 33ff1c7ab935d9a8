"""A raster on another grid: target cells meet the source cells around their centres by position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Upper left corner, cell size, rows and columns."""

    left: float
    top: float
    resolution: float
    rows: int
    cols: int


def _centres(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """(row_t, col_t, fr, fc): target cells and their centres in source cells, where 0 is the centre of the first one."""
    spark = cells.sparkSession
    at = spark.range(target.rows * target.cols).select(F.expr(f"cast(id div {target.cols} as int)").alias("row_t"), (F.col("id") % target.cols).cast("int").alias("col_t"))
    y = F.lit(target.top) - target.resolution * (F.col("row_t") + 0.5)
    x = F.lit(target.left) + target.resolution * (F.col("col_t") + 0.5)
    return at.withColumn("fr", (F.lit(source.top) - y) / source.resolution - 0.5).withColumn("fc", (x - source.left) / source.resolution - 0.5)


def bilinear(cells: DataFrame, value: str, source: Grid, target: Grid) -> DataFrame:
    """(row_t, col_t, value): mean of the four source cells around each centre by how near they are; missing ones are left out."""
    corner = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)]))
    part = lambda f, side: F.when(F.col(side) == 0, 1 - (F.col(f) - F.floor(f))).otherwise(F.col(f) - F.floor(f))
    near = _centres(cells, source, target).withColumn("k", corner).withColumn("w", part("fr", "k.r") * part("fc", "k.c")).filter("w > 0")
    near = near.select("row_t", "col_t", "w", (F.floor("fr") + F.col("k.r")).cast("int").alias("row_i"), (F.floor("fc") + F.col("k.c")).cast("int").alias("col_i"))
    met = near.join(cells.select("row_i", "col_i", F.col(value).alias("z")).filter("z is not null and not isnan(z)"), ["row_i", "col_i"])
    return met.groupBy("row_t", "col_t").agg(F.round(F.sum(F.col("w") * F.col("z")) / F.sum("w"), 9).alias(value))


def nearest(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """(row_t, col_t, value) of the source cell (row_i, col_i, value) that holds each centre."""
    at = _centres(cells, source, target).select("row_t", "col_t", F.floor(F.col("fr") + 0.5).cast("int").alias("row_i"), F.floor(F.col("fc") + 0.5).cast("int").alias("col_i"))
    return at.join(cells, ["row_i", "col_i"]).select("row_t", "col_t", "value")
