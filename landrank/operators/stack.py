"""The feature stack: one cell table from raster layers and vectors on one grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from . import distance, polygons, spatial
from .resample import Grid


def valid(cells: DataFrame, core: Sequence[str]) -> DataFrame:
    """Cells that have every core layer, NaN counting as missing."""
    for c in core:
        cells = cells.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return cells


def build(grid: Grid, layers: Mapping[str, DataFrame], core: Sequence[str], burnt: Mapping[str, tuple[DataFrame, str]] | None = None, nearest: Mapping[str, tuple[DataFrame, str, str]] | None = None, gridded: Mapping[str, tuple[DataFrame, str, str]] | None = None, area: DataFrame | None = None) -> DataFrame:
    """(row_i, col_i, easting, northing, layers, nearest, gridded, burnt) of the cells that have every core layer.

    layers: (row_i, col_i, value) each, met in one aggregation by position; a cell off the grid, or two values of a layer in one
    cell, is an error of that layer when it is read. burnt: segments and the column that touched cells take, else 0.
    nearest: segments, the column of the nearest one, and that column's name. gridded: the same, but measured between centres to
    the nearest cell that a segment touches, where the later segment wins. area: polygons as edges (poly, x1, y1, x2, y2); cells whose
    centre lies in none of them go, distances are still to everything.
    """
    if missing := [c for c in core if c not in layers]:
        raise ValueError(f"no layer {', '.join(missing)}; there are: {', '.join(layers)}")
    long = None
    for name, layer in layers.items():
        off = ~(F.col("row_i").between(0, grid.rows - 1) & F.col("col_i").between(0, grid.cols - 1))
        one = layer.select(F.when(off, F.raise_error(F.lit(f"{name} is not on the grid"))).otherwise(F.col("row_i")).cast("int").alias("row_i"), F.col("col_i").cast("int").alias("col_i"), F.lit(name).alias("layer"), F.col("value").cast("double").alias("value"))
        long = one if long is None else long.unionByName(one)
    at = lambda n: F.col("layer") == n
    once = [F.when(F.count(F.when(at(n), 1)) > 1, F.raise_error(F.lit(f"{n} has two values in one cell"))).otherwise(F.max(F.when(at(n), F.col("value")))).alias(n) for n in layers]
    cells = valid(long.groupBy("row_i", "col_i").agg(*once), core)
    cells = cells.withColumn("easting", F.lit(grid.left) + grid.resolution * (F.col("col_i") + 0.5)).withColumn("northing", F.lit(grid.top) - grid.resolution * (F.col("row_i") + 0.5))
    if area is not None:
        centres = cells.select("row_i", "col_i", F.col("easting").alias("x"), F.col("northing").alias("y"))
        cells = cells.join(polygons.points_inside(centres, area, 16 * grid.resolution).select("row_i", "col_i").distinct(), ["row_i", "col_i"], "left_semi")
    if nearest:
        # Read several times below; made once.
        cells = durable(cells)
    for name, (segments, value, order) in (nearest or {}).items():
        points = cells.withColumn("__key", F.col("row_i").cast("long") * grid.cols + F.col("col_i")).withColumn("x", F.col("easting")).withColumn("y", F.col("northing"))
        found = spatial.nearest_segment(points.select("__key", "x", "y"), segments, "__key", None, value).select("__key", F.col("dist").alias(name), F.col(value).alias(order))
        cells = points.join(found, "__key", "left").drop("__key", "x", "y")
    touching = lambda segments, value, name: spatial.burn(segments, grid.left, grid.top, grid.resolution, grid.rows, grid.cols).groupBy("row_i", "col_i").agg(F.max_by(value, "id").alias(name))
    for name, (segments, value, order) in (gridded or {}).items():
        found = distance.distance_to_marked(touching(segments, value, order), grid.rows, grid.cols, grid.resolution, order)
        cells = cells.join(found.withColumnRenamed("dist", name), ["row_i", "col_i"], "left")
    for name, (segments, value) in (burnt or {}).items():
        touched = touching(segments, value, name)
        cells = cells.join(touched, ["row_i", "col_i"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return cells.select("row_i", "col_i", "easting", "northing", *layers, *[c for more in (nearest, gridded) for n, (_, _, o) in (more or {}).items() for c in (n, o)], *(burnt or {}))
