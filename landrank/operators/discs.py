"""Clusters in discs around places, on several surfaces at once, and the rules between clusters of one disc.

All cells of a disc and the ring around it meet in one group, a bounded one: cut, labelling and shapes are found there, so there is
one shuffle and no round. Rules between clusters join the clusters of a place with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from . import spatial

#: Fewest cells of a ring that make a place evaluable.
LEAST_RING = 100
_SCHEMA = "id long, surface string, n_ring long, n_disc long, valid boolean, extreme_pct double, cluster int, cells long, row_c double, col_c double, elongation double, span double, fill double, enclosed double"


def labelled(on: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, 0 outside, else 1, 2, ... in the order of their first cells."""
    number = np.arange(on.size).reshape(on.shape)
    pairs = [(number[:, :-1], number[:, 1:], on[:, :-1] & on[:, 1:]), (number[:-1], number[1:], on[:-1] & on[1:])]
    a, b = (np.concatenate([p[k][p[2]] for p in pairs]) for k in (0, 1))
    least = np.arange(on.size)
    while True:
        u, v = least[a], least[b]
        apart = u != v
        if not apart.any():
            break
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
        while (least[least] != least).any():
            least = least[least]
    out = np.zeros(on.size, int)
    out[on.ravel()] = np.unique(least[on.ravel()], return_inverse=True)[1] + 1
    return out.reshape(on.shape)


def shape(row: np.ndarray, col: np.ndarray) -> tuple[float, float, float]:
    """(elongation, span, fill) of a cluster's cells: ratio of its principal axes, length along the longer one, share of the box along
    both that it fills. Below 4 cells 1, 0 and 1; a line is as elongated as it has cells."""
    if len(row) < 4:
        return 1.0, 0.0, 1.0
    # Moments that are equal but for rounding must not decide the axes.
    (vr, cov), (_, vc) = np.round(np.cov(row, col), 9)
    half, root = (vr + vc) / 2, np.sqrt(((vr - vc) / 2) ** 2 + cov**2)
    turn = 0.5 * np.arctan2(2 * cov, vc - vr)
    u, v = col * np.cos(turn) + row * np.sin(turn), row * np.cos(turn) - col * np.sin(turn)
    long, wide = np.ptp(u) + 1.0, np.ptp(v) + 1.0
    ratio = np.sqrt((half + root) / (half - root)) if half - root > 1e-9 else len(row)
    return float(np.round(ratio, 1)), float(np.round(long + 1e-9, 1)), float(np.round(len(row) / (long * wide) + 1e-9, 2))


def enclosed(row: np.ndarray, col: np.ndarray) -> float:
    """Share of the filled cluster that it only encloses: cells that its own cells cut off from outside."""
    free = np.ones((np.ptp(row) + 3, np.ptp(col) + 3), bool)
    free[row - row.min() + 1, col - col.min() + 1] = False
    of = labelled(free)
    holes = int((of > 1).sum())  # the first component holds the corner, which is outside
    return float(np.round(holes / (len(row) + holes), 2))


def clusters(places: DataFrame, cells: DataFrame, surfaces: Mapping[str, str], resolution: float, disc_m: float, ring_m: float, percentile: float = 0.9, min_cells: int = 4, least_ring: int = LEAST_RING) -> DataFrame:
    """(id, surface, n_ring, n_disc, valid, extreme_pct, cluster, cells, row_c, col_c, elongation, span, fill, enclosed) of places (id, x, y).

    cells: (x, y, a column a surface); surfaces: their tails, 'high' or 'low'. A cluster is a connected set of a disc's cells at or
    beyond the percentile of its ring; clusters are numbered in the order of their first cells, from the north-west. A surface
    without a cluster has one row with none. Without enough cells a surface is not valid: a gap, not a miss. extreme_pct: share of the
    ring that the disc's extreme goes beyond.
    """
    if odd := set(surfaces.values()) - {"high", "low"}:
        raise ValueError(f"a tail is high or low, not {', '.join(sorted(odd))}")
    boxes = places.select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), *[(F.col(c) + s * ring_m).alias(n) for n, c, s in (("xmin", "x", -1), ("xmax", "x", 1), ("ymin", "y", -1), ("ymax", "y", 1))])
    window = spatial.points_in_boxes(cells.select("x", "y", *surfaces), boxes, 2 * ring_m).select("id", "sx", "sy", "x", "y", *surfaces)
    across = int(2 * disc_m // resolution) + 3

    def look(key, table):
        x, y, sx, sy = (table.column(c).to_numpy() for c in ("x", "y", "sx", "sy"))
        d = np.sqrt((x - sx) ** 2 + (y - sy) ** 2)
        row, col = np.floor((sy + disc_m - y) / resolution).astype(int) + 1, np.floor((x - sx + disc_m) / resolution).astype(int) + 1
        out = []
        for name, tail in surfaces.items():
            z = table.column(name).to_numpy(zero_copy_only=False).astype(float)
            there = ~np.isnan(z)
            ring, disc = z[there & (d > disc_m) & (d <= ring_m)], there & (d <= disc_m)
            about = [key[0].as_py(), name, len(ring), int(disc.sum())]
            if len(ring) < least_ring or disc.sum() < min_cells:
                out.append((*about, False, *[None] * 9))
                continue
            high = tail == "high"
            cut = np.quantile(ring, percentile if high else round(1 - percentile, 12))
            extreme = z[disc].max() if high else z[disc].min()
            about += [True, float(np.mean(ring < extreme if high else ring > extreme) * 100)]
            beyond = disc & (z >= cut if high else z <= cut)
            on = np.zeros((across, across), bool)
            on[row[beyond], col[beyond]] = True
            of = labelled(on)
            for k in range(1, of.max() + 1):
                r, c = np.nonzero(of == k)
                out.append((*about, k, len(r), float(r.mean()), float(c.mean()), *shape(r, c), enclosed(r, c)))
            if not of.any():
                out.append((*about, *[None] * 8))
        names, kinds = zip(*(f.split(" ") for f in _SCHEMA.split(", ")), strict=True)
        types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
        return pa.table([pa.array(list(v), types[k]) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    found = window.groupBy("id").applyInArrow(look, _SCHEMA)
    # Places without a single cell around them are gaps on every surface.
    every = places.select("id", F.explode(F.array(*[F.lit(n) for n in surfaces])).alias("surface"))
    return every.join(found, ["id", "surface"], "left").select("id", "surface", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_ring", "n_disc")], F.coalesce("valid", F.lit(False)).alias("valid"), "extreme_pct", "cluster", "cells", "row_c", "col_c", "elongation", "span", "fill", "enclosed")


def each_place(places: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `rule` gives by id for places (id, x, y), asked once where several have the same coordinates and told to all of them."""
    first = durable(places.groupBy("x", "y").agg(F.min("id").alias("place")))
    found = rule(first.select(F.col("place").alias("id"), "x", "y"))
    same = places.select("id", F.col("x").alias("u"), F.col("y").alias("v")).join(first, F.col("u").eqNullSafe(F.col("x")) & F.col("v").eqNullSafe(F.col("y"))).select("id", "place")
    return same.join(found.withColumnRenamed("id", "place"), "place").select(found.columns)


def paired(found: DataFrame, a: str, b: str, max_gap_m: float, resolution: float, gate: Column, most: int | None = 5) -> DataFrame:
    """(id, valid, fired_a, fired_b, paired, hit): whether clusters that pass the gate lie on both surfaces at most max_gap_m apart, centre
    to centre. A place is hit if a surface fired and the pair holds. Of a surface the first `most` clusters that pass count, all with None."""
    passes = found.withColumn("passes", F.coalesce(gate, F.lit(False)))
    some = passes.filter("passes")
    if most is not None:
        some = some.withColumn("k", F.row_number().over(Window.partitionBy("id", "surface").orderBy("cluster"))).filter(F.col("k") <= most)
    p, q = (some.filter(F.col("surface") == s).select("id", F.col("row_c").alias(f"r{n}"), F.col("col_c").alias(f"c{n}")) for s, n in ((a, 1), (b, 2)))
    near = F.sqrt((F.col("r1") - F.col("r2")) ** 2 + (F.col("c1") - F.col("c2")) ** 2) <= max_gap_m / resolution
    both = p.join(q, "id").filter(near).select("id").distinct().withColumn("paired", F.lit(True))
    on = lambda s: F.coalesce(F.bool_or(F.when(F.col("surface") == s, F.col("passes"))), F.lit(False))
    fired = passes.groupBy("id").agg(F.bool_or("valid").alias("valid"), on(a).alias("fired_a"), on(b).alias("fired_b"))
    out = fired.join(both, "id", "left").withColumn("paired", F.coalesce("paired", F.lit(False)))
    return out.withColumn("hit", (F.col("fired_a") | F.col("fired_b")) & F.col("paired"))


def several(found: DataFrame, surface: str, least: int, nearest_max_m: float, cv_max: float, resolution: float, element: Column) -> DataFrame:
    """(id, valid, elements, nn_mean_m, nn_cv, satisfied): clusters of a surface that are elements, the mean distance to the nearest
    other one of the place to one digit, its variation to two, and whether there are `least`, near and regular. Means of fewer are null."""
    mine = found.filter(F.col("surface") == surface)
    some = mine.filter(F.coalesce(element, F.lit(False))).select("id", "cluster", "row_c", "col_c")
    other = some.select("id", F.col("cluster").alias("o"), F.col("row_c").alias("r"), F.col("col_c").alias("c"))
    gap = F.sqrt((F.col("row_c") - F.col("r")) ** 2 + (F.col("col_c") - F.col("c")) ** 2) * resolution
    near = some.join(other, "id").filter("cluster <> o").groupBy("id", "cluster").agg(F.min(gap).alias("near"))
    spread = near.groupBy("id").agg(F.round(F.avg("near") + 1e-9, 1).alias("nn_mean_m"), F.round(F.stddev_pop("near") / F.greatest(F.avg("near"), F.lit(1e-9)) + 1e-9, 2).alias("nn_cv"))
    out = mine.groupBy("id").agg(F.bool_or("valid").alias("valid")).join(some.groupBy("id").agg(F.count(F.lit(1)).alias("elements")), "id", "left").join(spread, "id", "left")
    enough = F.coalesce("elements", F.lit(0)) >= least
    fine = enough & (F.col("nn_mean_m") <= nearest_max_m) & (F.col("nn_cv") <= cv_max)
    return out.select("id", "valid", F.coalesce("elements", F.lit(0).cast("long")).alias("elements"), *[F.when(enough, F.col(c)).alias(c) for c in ("nn_mean_m", "nn_cv")], F.coalesce(fine, F.lit(False)).alias("satisfied"))
