"""Firing rules at places: cells of a disc beyond a percentile of the ring around it, in connected clusters; and null places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import segment_meets_box
from ..storage import durable
from . import discs, spatial
from .discs import LEAST_RING
from .resample import Grid


def fire(places: DataFrame, cells: DataFrame, resolution: float, disc_m: float, ring_m: float, percentile: float = 0.9, min_cells: int = 4, gate: Column | None = None, least_ring: int = LEAST_RING) -> DataFrame:
    """(id, n_ring, n_disc, evaluable, fired_high, fired_low, cluster_high, cluster_low) of places (id, x, y).

    cells: (x, y, z). A place fires on a tail when a connected cluster of at least min_cells of its disc's cells lies beyond the
    percentile of its ring, and the cluster passes the gate (over the columns of discs.clusters). Places without enough
    cells are gaps: fired is null. cluster_*: cells of the largest cluster. One shuffle: a disc and its ring meet in one group.
    """
    tails = {"high": "high", "low": "low"}
    return discs.each_place(places.select("id", "x", "y"), lambda one: _fired(discs.clusters(one, cells.select("x", "y", F.col("z").alias("high"), F.col("z").alias("low")), tails, resolution, disc_m, ring_m, percentile, min_cells, least_ring), min_cells, gate))


def _fired(found: DataFrame, min_cells: int, gate: Column | None) -> DataFrame:
    passes = F.col("cells") >= min_cells if gate is None else (F.col("cells") >= min_cells) & gate
    most = lambda tail: F.max(F.when((F.col("surface") == tail) & passes, F.col("cells")))
    of = found.groupBy("id").agg(F.max("n_ring").alias("n_ring"), F.max("n_disc").alias("n_disc"), F.bool_or("valid").alias("evaluable"), most("high").alias("high"), most("low").alias("low"))
    fine = F.col("evaluable")
    return of.select(
        "id", "n_ring", "n_disc", "evaluable", F.when(fine, F.col("high").isNotNull()).alias("fired_high"), F.when(fine, F.col("low").isNotNull()).alias("fired_low"),
        F.when(fine, F.coalesce("high", F.lit(0).cast("long"))).alias("cluster_high"), F.when(fine, F.coalesce("low", F.lit(0).cast("long"))).alias("cluster_low"),
    )


def within(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Pairs (all columns) of places a (id, x, y) and b (other, u, v) at most `reach` apart."""
    boxes = b.select("other", "u", "v", (F.col("u") - reach).alias("xmin"), (F.col("u") + reach).alias("xmax"), (F.col("v") - reach).alias("ymin"), (F.col("v") + reach).alias("ymax"))
    return spatial.points_in_boxes(a, boxes, max(2 * reach, 1.0)).filter((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2 < reach * reach)


def null_places(tries: DataFrame, sites: DataFrame, clear_m: float, apart_m: float) -> DataFrame:
    """Tries (id, x, y) at least clear_m from every site (x, y), thinned so that none is nearer than apart_m to an earlier one
    that stays: in rounds, those without an earlier undecided neighbour stay and put their neighbours out."""
    far = tries.join(within(tries, sites.select(F.lit(0).alias("other"), F.col("x").alias("u"), F.col("y").alias("v")), clear_m).select("id").distinct(), "id", "left_anti")
    open_ = durable(far)
    pairs = durable(within(open_, open_.select(F.col("id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v")), apart_m).filter("other < id").select("id", "other"))
    kept = open_.limit(0)
    while not open_.isEmpty():
        blocked = pairs.join(open_.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
        stay = durable(open_.join(blocked, "id", "left_anti"))
        kept = durable(kept.unionByName(stay))
        out = pairs.join(stay.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
        open_ = durable(open_.join(stay.select("id"), "id", "left_anti").join(out, "id", "left_anti"))
    return kept


def exclude_near(zones: DataFrame, segments: DataFrame, distance: float, grid: Grid) -> DataFrame:
    """(zone, cells, covered): zones of which at most half the cells come within `distance` of a segment; a zone goes whole or stays
    whole, so no fragment of what is excluded is left.

    zones: (zone, row_i, col_i). Segments that miss the grid altogether are an error: an empty source is a gap in the data, not a
    reason to keep every zone.
    """
    right, bottom = grid.left + grid.resolution * grid.cols, grid.top - grid.resolution * grid.rows
    here = segment_meets_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(grid.left), F.lit(bottom), F.lit(right), F.lit(grid.top))
    if segments.filter(here).isEmpty():
        raise ValueError("the source of the exclusion has nothing in this frame; load it first")
    under = spatial.cells_near(zones.select("row_i", "col_i"), segments, distance, grid.left, grid.top, grid.resolution).distinct().withColumn("hit", F.lit(1.0))
    share = zones.join(under, ["row_i", "col_i"], "left").groupBy("zone").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("covered"))
    return share.filter("covered <= 0.5")
