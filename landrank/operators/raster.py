"""Raster operators over long cell tables (row_i, col_i, value); neighbourhoods are stencils over tiles (see tiles)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from .tiles import TILE, seen, stencil

#: The 8 ways from a cell, 0 = north and clockwise.
WAYS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
#: Stands for the slope of a direction in which nothing is seen: all but straight down.
OPEN = -1000.0


def horizon_offsets(radius: int, directions: int = 16) -> list[tuple[int, int, int, float]]:
    """(direction, row shift, column shift, distance in cells): distinct rounded places every third of a cell along each direction."""
    out = []
    for k in range(directions):
        angle = 2 * math.pi * k / directions
        places = {(round(math.cos(angle) * step / 3), round(math.sin(angle) * step / 3)) for step in range(3, 3 * radius + 1)}
        out += [(k, dr, dc, math.hypot(dr, dc)) for dr, dc in places]
    return sorted(out, key=lambda o: (o[0], o[3], o[1], o[2]))


def openness(cells: DataFrame, value: str, rows: int, cols: int, resolution: float, radius_m: float, directions: int = 16, negative: bool = False, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, openness): mean over the directions of 90 degrees less the steepest rise within a radius in metres, two
    cells at least; of the inverted surface if negative.

    The raster is mirrored at its borders without repeating them. Missing cells rise nowhere; a direction in which there is
    nothing else is open to straight below; a missing cell has no openness.
    """
    radius = max(2, round(radius_m / resolution))
    offsets, sign = horizon_offsets(radius, directions), -1.0 if negative else 1.0

    def work(grid):
        here = sign * seen(grid, radius, 0, 0)
        steep = np.full((directions, *here.shape), OPEN)
        for k, dr, dc, d in offsets:
            np.fmax(steep[k], (sign * seen(grid, radius, dr, dc) - here) / (d * resolution), out=steep[k])
        return np.where(np.isnan(here), np.nan, np.round(90.0 - np.degrees(np.arctan(steep)).mean(0), 5))

    return stencil(cells, value, rows, cols, radius, work, "openness", tile=tile)


def local_relief(cells: DataFrame, value: str, rows: int, cols: int, radius: int, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, relief): value less its Gaussian mean (sigma radius / 2, cut at the radius, missing neighbours left out);
    the raster is mirrored at its borders, which are repeated."""
    sigma = radius / 2

    def work(grid):
        total = weight = np.zeros_like(seen(grid, radius, 0, 0))
        for dr in range(-radius, radius + 1):
            for dc in range(-radius, radius + 1):
                z, w = seen(grid, radius, dr, dc), math.exp(-(dr * dr + dc * dc) / (2 * sigma * sigma))
                total, weight = total + np.where(np.isnan(z), 0.0, z * w), weight + np.where(np.isnan(z), 0.0, w)
        with np.errstate(invalid="ignore"):
            return np.round(seen(grid, radius, 0, 0) - total / weight, 6)

    return stencil(cells, value, rows, cols, radius, work, "relief", pad="symmetric", tile=tile)


def flow_direction(cells: DataFrame, value: str, rows: int, cols: int, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, dir): the steepest of the 8 ways down, 0 = north and clockwise, null in a pit; equal ways go to the first."""

    def work(grid):
        here = seen(grid, 1, 0, 0)
        drops = np.stack([np.rint((here - seen(grid, 1, dr, dc)) / math.hypot(dr, dc) * 1e6) for dr, dc in WAYS])
        drops = np.where(np.isnan(drops), -np.inf, drops)
        return np.where(drops.max(0) > 0, drops.argmax(0), np.nan)

    return stencil(cells, value, rows, cols, 1, work, "dir", "int", "nan", tile)


def _tile_flow(row: np.ndarray, col: np.ndarray, way: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the cells of a tile: what drains through each from within, the last cell of its way inside, and where each flows to."""
    r0, c0, width = row.min(), col.min(), int(col.max() - col.min()) + 1
    place = np.full((int(row.max() - r0) + 1) * width, -1)
    place[(row - r0) * width + (col - c0)] = np.arange(len(row))
    step = np.array([*WAYS, (0, 0)])[way]
    to_r, to_c = row + step[:, 0], col + step[:, 1]
    inside = (way < len(WAYS)) & (to_r >= r0) & (to_r <= row.max()) & (to_c >= c0) & (to_c <= col.max())
    down = np.where(inside, place[np.where(inside, (to_r - r0) * width + (to_c - c0), 0)], -1)
    total, waits = weight.astype(np.int64), np.bincount(down[down >= 0], minlength=len(row))
    front = np.flatnonzero(waits == 0)
    while len(front):
        front = front[down[front] >= 0]
        np.add.at(total, down[front], total[front])
        np.subtract.at(waits, down[front], 1)
        front = np.unique(down[front])
        front = front[waits[front] == 0]
    last = np.where(down >= 0, down, np.arange(len(row)))
    while (last[last] != last).any():
        last = last[last]
    return total, last, to_r, to_c


def flow_accumulation(cells: DataFrame, value: str, rows: int, cols: int, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, cells): cells that drain through each cell, itself included.

    A tile adds up its own flow in one task. What leaves tiles walks from outlet to outlet, a round a tile on the longest way,
    as a table of outlets only; then each tile adds up once more with what comes in over its border.
    """
    ways = durable(flow_direction(cells, value, rows, cols, tile))
    keyed = ways.select("row_i", "col_i", F.coalesce("dir", F.lit(len(WAYS))).alias("way"), F.expr(f"row_i div {tile}").alias("tr"), F.expr(f"col_i div {tile}").alias("tc"))

    def border(key, table):
        r, c, way = (table.column(n).to_numpy() for n in ("row_i", "col_i", "way"))
        total, last, to_r, to_c = _tile_flow(r, c, way, np.ones(len(r), np.int64))
        leaves = (way < len(WAYS)) & ((to_r // tile != key[0].as_py()) | (to_c // tile != key[1].as_py()))
        edge = leaves[last] & ((r % tile == 0) | (r % tile == tile - 1) | (c % tile == 0) | (c % tile == tile - 1))
        at = np.flatnonzero(edge)
        out = [r[at], c[at], r[last[at]], c[last[at]], np.where(leaves[at], to_r[at], -1), np.where(leaves[at], to_c[at], -1)]
        return pa.table([*(pa.array(x.astype(np.int32)) for x in out), pa.array(total[at])], ["row_i", "col_i", "out_r", "out_c", "to_r", "to_c", "n"])

    edges = durable(keyed.groupBy("tr", "tc").applyInArrow(border, "row_i int, col_i int, out_r int, out_c int, to_r int, to_c int, n long"))
    outlets = edges.filter("to_r >= 0").select("out_r", "out_c", "to_r", "to_c", "n")
    following = durable(outlets.join(edges.select(F.col("row_i").alias("to_r"), F.col("col_i").alias("to_c"), F.col("out_r").alias("next_r"), F.col("out_c").alias("next_c")), ["to_r", "to_c"]).select("out_r", "out_c", "next_r", "next_c"))
    moving = total = outlets.select("out_r", "out_c", "n")
    while True:
        moving = durable(moving.join(following, ["out_r", "out_c"]).groupBy(F.col("next_r").alias("out_r"), F.col("next_c").alias("out_c")).agg(F.sum("n").alias("n")))
        if moving.isEmpty():
            break
        total = durable(total.unionByName(moving).groupBy("out_r", "out_c").agg(F.sum("n").alias("n")))
    coming = total.join(outlets.select("out_r", "out_c", "to_r", "to_c"), ["out_r", "out_c"]).groupBy(F.col("to_r").alias("row_i"), F.col("to_c").alias("col_i")).agg(F.sum("n").alias("more"))

    def add(key, table):
        r, c, way, weight = (table.column(n).to_numpy() for n in ("row_i", "col_i", "way", "weight"))
        return pa.table([table.column("row_i"), table.column("col_i"), pa.array(_tile_flow(r, c, way, weight)[0])], ["row_i", "col_i", "cells"])

    fed = keyed.join(coming, ["row_i", "col_i"], "left").withColumn("weight", 1 + F.coalesce("more", F.lit(0)))
    return fed.groupBy("tr", "tc").applyInArrow(add, "row_i int, col_i int, cells long")


def hand(cells: DataFrame, value: str, rows: int, cols: int, least_cells: int, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, hand): height above the stream cell that each cell drains to, a stream being where at least `least_cells`
    drain through; null where a way ends before one. Ways are followed by doubling: rounds grow with the logarithm of their length."""
    z = cells.select(F.col("row_i").cast("int").alias("row_i"), F.col("col_i").cast("int").alias("col_i"), F.col(value).alias("z"))
    step = F.element_at(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in WAYS]), F.col("dir") + 1)
    stream = flow_accumulation(cells, value, rows, cols, tile).select("row_i", "col_i", (F.col("cells") >= least_cells).alias("stream"))
    ways = flow_direction(cells, value, rows, cols, tile).withColumn("s", step).join(stream, ["row_i", "col_i"])
    stays = F.col("stream") | F.col("dir").isNull()
    way = durable(ways.select("row_i", "col_i", "stream", F.when(stays, F.col("row_i")).otherwise(F.col("row_i") + F.col("s.r")).alias("r2"), F.when(stays, F.col("col_i")).otherwise(F.col("col_i") + F.col("s.c")).alias("c2")))
    while True:
        further = way.select(F.col("row_i").alias("r2"), F.col("col_i").alias("c2"), F.col("r2").alias("r3"), F.col("c2").alias("c3"))
        hop = durable(way.join(further, ["r2", "c2"]).select("row_i", "col_i", "stream", F.col("r3").alias("r2"), F.col("c3").alias("c2"), ((F.col("r2") != F.col("r3")) | (F.col("c2") != F.col("c3"))).alias("moved")))
        way = hop.drop("moved")
        if hop.filter("moved").isEmpty():
            break
    ends = z.join(way.filter("stream").select("row_i", "col_i"), ["row_i", "col_i"]).select(F.col("row_i").alias("r2"), F.col("col_i").alias("c2"), F.col("z").alias("base"))
    return way.join(z, ["row_i", "col_i"]).join(ends, ["r2", "c2"], "left").select("row_i", "col_i", F.round(F.col("z") - F.col("base"), 6).alias("hand"))


def slope(cells: DataFrame, value: str, rows: int, cols: int, resolution: float, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, slope_deg) by the weighted differences of all 8 neighbours; null at borders and beside missing cells."""

    def work(grid):
        at = {(r, c): seen(grid, 1, r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)}
        dx = (at[-1, 1] + 2 * at[0, 1] + at[1, 1] - at[-1, -1] - 2 * at[0, -1] - at[1, -1]) / (8 * resolution)
        dy = (at[1, -1] + 2 * at[1, 0] + at[1, 1] - at[-1, -1] - 2 * at[-1, 0] - at[-1, 1]) / (8 * resolution)
        return np.round(np.degrees(np.arctan(np.hypot(dx, dy))) + 0 * at[0, 0], 6)

    return stencil(cells, value, rows, cols, 1, work, "slope_deg", pad="nan", tile=tile)


def wetness(flow: DataFrame, slopes: DataFrame, resolution: float, least_deg: float = 0.1) -> DataFrame:
    """(row_i, col_i, twi): logarithm of the specific catchment area over the tangent of the slope, which is `least_deg` at least."""
    area = F.col("cells") * float(resolution)
    return flow.join(slopes, ["row_i", "col_i"]).select("row_i", "col_i", F.round(F.log(area / F.tan(F.radians(F.greatest("slope_deg", F.lit(least_deg))))), 6).alias("twi"))


def components(cells: DataFrame, tile: int = 256) -> DataFrame:
    """(row_i, col_i, zone): 4-connected components of the given cells, zone being the smallest row-major key in each.

    Tiles are labelled by union-find in their own task (a tile has at most tile ** 2 cells); then only labels that touch
    across a tile border are joined, as a graph that is contracted until it stands still.
    """

    def label(key, table):
        rows, cols = table.column("row_i").to_pylist(), table.column("col_i").to_pylist()
        parent = {(r, c): (r, c) for r, c in zip(rows, cols, strict=True)}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r, c in zip(rows, cols, strict=True):
            for other in ((r + 1, c), (r, c + 1)):
                if other in parent:
                    a, b = sorted((find((r, c)), find(other)))
                    parent[b] = a
        least = [find((r, c)) for r, c in zip(rows, cols, strict=True)]
        return pa.table([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array([(r << 32) | c for r, c in least], pa.int64())], ["row_i", "col_i", "part"])

    keyed = cells.select(F.col("row_i").cast("int"), F.col("col_i").cast("int"), F.floor(F.col("row_i") / tile).alias("tr"), F.floor(F.col("col_i") / tile).alias("tc"))
    parts = keyed.groupBy("tr", "tc").applyInArrow(label, "row_i int, col_i int, part long")
    seam = parts.filter((F.pmod(F.col("row_i"), F.lit(tile)) == tile - 1) | (F.pmod(F.col("col_i"), F.lit(tile)) == tile - 1))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")), F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc"))))
    ahead = seam.select("part", "row_i", "col_i", steps.alias("s")).select(F.col("part").alias("a"), (F.col("row_i") + F.col("s.dr")).alias("row_i"), (F.col("col_i") + F.col("s.dc")).alias("col_i"))
    edges = ahead.join(parts, ["row_i", "col_i"]).filter("a <> part").select("a", F.col("part").alias("b")).distinct()
    joined = contract(edges)
    return parts.join(joined, parts.part == joined.node, "left").select("row_i", "col_i", F.coalesce("least", "part").alias("zone"))


def contract(edges: DataFrame) -> DataFrame:
    """(node, least) of edges (a, b): rounds of smallest neighbour and shortcut until nothing changes.

    Each round is checkpointed to the shared folder.
    """
    both = durable(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    label = durable(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("least")))
    while True:
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("least").alias("m"))
        hop = label.join(near, "node").select("node", F.least("least", "m").alias("least"), F.col("least").alias("before"))
        up = label.select(F.col("node").alias("least"), F.col("least").alias("root"))
        new = durable(hop.join(up, "least", "left").select("node", F.least(F.col("least"), F.coalesce("root", "least")).alias("least"), "before"))
        if new.filter("least <> before").isEmpty():
            return new.select("node", "least")
        label = new.select("node", "least")


def morphometry(zones: DataFrame) -> DataFrame:
    """(zone, cells, elongation, span, fill, row_c, col_c) by the principal axes of a zone's cells, from sample covariances.

    A second pass turns cells onto the axes for the box they fill. Zones below 4 cells have elongation 1, span 0 and fill 1.
    """
    # Moments that are equal but for rounding must not decide the axes.
    moment = lambda m: F.round(F.coalesce(m, F.lit(0.0)), 9)
    base = zones.groupBy("zone").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("row_i").alias("row_c"), F.avg("col_i").alias("col_c"), moment(F.var_samp("row_i")).alias("vr"),
        moment(F.var_samp("col_i")).alias("vc"), moment(F.covar_samp("row_i", "col_i")).alias("cov"),
    )
    half, root = (F.col("vr") + F.col("vc")) / 2.0, F.sqrt(((F.col("vr") - F.col("vc")) / 2.0) ** 2 + F.col("cov") ** 2)
    base = base.withColumn("big", half + root).withColumn("small", half - root).withColumn("turn", 0.5 * F.atan2(2.0 * F.col("cov"), F.col("vc") - F.col("vr")))
    turned = zones.join(base.select("zone", "turn"), "zone")
    u = F.col("col_i") * F.cos("turn") + F.col("row_i") * F.sin("turn")
    v = F.col("row_i") * F.cos("turn") - F.col("col_i") * F.sin("turn")
    box = turned.groupBy("zone").agg((F.max(u) - F.min(u) + 1.0).alias("long"), (F.max(v) - F.min(v) + 1.0).alias("wide"))
    few = F.col("cells") < 4
    elongation = F.when(few, 1.0).when(F.col("small") > 1e-9, F.sqrt(F.col("big") / F.when(F.col("small") > 1e-9, F.col("small")))).otherwise(F.col("cells").cast("double"))
    return base.join(box, "zone").select(
        "zone", "cells", F.round(elongation, 1).alias("elongation"), F.when(few, 0.0).otherwise(F.round(F.col("long") + 1e-9, 1)).alias("span"),
        F.when(few, 1.0).otherwise(F.round(F.col("cells") / (F.col("long") * F.col("wide")) + 1e-9, 2)).alias("fill"), F.round("row_c", 6).alias("row_c"), F.round("col_c", 6).alias("col_c"),
    )


def enclosure(zones: DataFrame, width: int = 256) -> DataFrame:
    """(zone, holes, enclosed): cells outside a zone that its own cells cut off from the edge of its box, and their share of the filled zone.

    zones: (zone, row_i, col_i), other zones count as outside. Only the gaps between a zone's cells in a row are looked at, never
    its box: gaps of neighbouring rows that overlap, met in tiles of `width` columns, are one piece, and a piece is a hole unless
    some gap of it sees past the ends of a neighbouring row.
    """
    by_row = Window.partitionBy("zone", "row_i").orderBy("col_i")
    runs = durable(zones.select("zone", "row_i", "col_i").withColumn("next", F.lead("col_i").over(by_row)))
    sizes = runs.groupBy("zone").agg(F.count(F.lit(1)).alias("cells"))
    ends = runs.groupBy("zone", "row_i").agg(F.min("col_i").alias("first"), F.max("col_i").alias("last"))
    gaps = runs.filter("next > col_i + 1").select("zone", "row_i", (F.col("col_i") + 1).alias("a"), (F.col("next") - 1).alias("b"), F.monotonically_increasing_id().alias("gap"))
    gaps = durable(gaps)
    beside = gaps.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("d")).withColumn("row_i", F.col("row_i") + F.col("d"))
    past = F.col("first").isNull() | (F.col("a") < F.col("first")) | (F.col("b") > F.col("last"))
    open_ = beside.join(ends, ["zone", "row_i"], "left").groupBy("gap").agg(F.bool_or(past).alias("open"))
    tiled = gaps.withColumn("t", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    below = tiled.select("zone", (F.col("row_i") - 1).alias("row_i"), "t", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("gap").alias("other"))
    meets = tiled.join(below, ["zone", "row_i", "t"]).filter("a <= b2 and a2 <= b").select(F.col("gap").alias("a"), F.col("other").alias("b"))
    joined = contract(meets.distinct())
    pieces = gaps.join(joined, gaps.gap == joined.node, "left").join(open_, "gap").groupBy("zone", F.coalesce("least", "gap").alias("piece"))
    holes = pieces.agg(F.sum(F.col("b") - F.col("a") + 1).alias("n"), F.bool_or("open").alias("open")).filter("not open").groupBy("zone").agg(F.sum("n").alias("holes"))
    n = F.coalesce("holes", F.lit(0)).cast("long")
    return sizes.join(holes, "zone", "left").select("zone", n.alias("holes"), F.round(n / (F.col("cells") + n), 2).alias("enclosed"))
