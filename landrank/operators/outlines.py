"""Outlines of zones of cells: rings of corners, holes included, and polygons as text.

A side of a cell whose neighbour is of another zone is an edge, walked with the cell on the right: outer rings run clockwise on the
map and holes the other way. Where two cells of a zone touch in a point only, each ring stays with its own cell, so they do not
merge. What follows an edge is told by the cells around it, so tiles with a halo of one cell trace their own edges into closed rings
and chains; chains that cross tile borders are joined as linked lists by doubling, in rounds that grow with the logarithm of
the chains in the longest ring. Neither rings nor their numbers depend on the tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .tiles import TILE, dealt, grids, seen

#: Sides of a cell, clockwise from its top: the neighbour beyond each, and the corner where it begins (row and column of corners).
_BEYOND = [(-1, 0), (0, 1), (1, 0), (0, -1)]
_CORNER = [(0, 0), (0, 1), (1, 1), (1, 0)]
_CHAIN = "head long, next long, least long, n_edges long, area2 long, zone long, xs array<int>, ys array<int>"


def _trace(z: np.ndarray, r0: int, c0: int, cols: int) -> list[tuple]:
    """Chains of a tile (z with a halo of one cell): first edge, the edge after the last or null if closed, and what they sum up to.

    An edge's number is its cell's times 4 plus its side.
    """
    here = seen(z, 1, 0, 0)
    h, w = here.shape
    same = lambda dr, dc: seen(z, 1, dr, dc) == here
    rows, zone_of = [], here.ravel()
    following, corner, exits = np.full(4 * h * w, -1), np.zeros(4 * h * w, bool), np.zeros(4 * h * w, np.int64)
    edge = np.zeros(4 * h * w, bool)
    r, c = np.divmod(np.arange(h * w), w)
    for s, (dr, dc) in enumerate(_BEYOND):
        ar, ac = _BEYOND[(s + 1) % 4]
        br, bc = _BEYOND[(s + 3) % 4]
        on = ~np.isnan(here) & ~same(dr, dc)
        ahead, beside = same(ar, ac), same(ar + dr, ac + dc)
        # Own next side; straight on along the cell ahead; or left along the cell beside that.
        to_r = np.where(~ahead, 0, np.where(beside, ar + dr, ar)).ravel() + r
        to_c = np.where(~ahead, 0, np.where(beside, ac + dc, ac)).ravel() + c
        side = np.where(~ahead, (s + 1) % 4, np.where(beside, (s + 3) % 4, s)).ravel()
        inside = (to_r >= 0) & (to_r < h) & (to_c >= 0) & (to_c < w)
        at = 4 * np.arange(h * w) + s
        edge[at] = on.ravel()
        following[at] = np.where(inside, 4 * (to_r * w + to_c) + side, -1)
        exits[at] = 4 * ((to_r + r0) * cols + to_c + c0) + side
        # An edge goes straight on from the one before if the cell behind is of the zone and has a free side here too.
        corner[at] = ~(same(br, bc) & ~same(br + dr, bc + dc)).ravel()
    edges = np.flatnonzero(edge)
    entered = np.zeros(4 * h * w, bool)
    inner = following[edges]
    entered[inner[inner >= 0]] = True
    number = 4 * ((r + r0) * cols + c + c0)[edges // 4] + edges % 4
    known = dict(zip(edges.tolist(), number.tolist(), strict=True))
    after, turns, leaves = dict(zip(edges.tolist(), inner.tolist(), strict=True)), corner.tolist(), exits.tolist()
    done: set[int] = set()
    for first in [*edges[~entered[edges]].tolist(), *edges.tolist()]:
        if first in done:
            continue
        path, at = [], first
        while at >= 0 and at not in done:
            done.add(at)
            path.append(at)
            at = after[at]
        p = np.array(path)
        cell, side = p // 4, p % 4
        y = r[cell] + r0 + np.array([k[0] for k in _CORNER])[side]
        x = c[cell] + c0 + np.array([k[1] for k in _CORNER])[side]
        # Twice the area to the axis of columns, with rows counted down: each edge adds its row step times its column.
        area2 = int((2 * x * np.array([0, 1, 0, -1])[side]).sum())
        turn = np.array([turns[e] for e in path])
        least = min(known[e] for e in path)
        if at >= 0:
            # A closed ring begins at its smallest edge.
            k = path.index(next(e for e in path if known[e] == least))
            x, y, turn = np.roll(x, -k), np.roll(y, -k), np.roll(turn, -k)
        rows.append((known[path[0]], None if at >= 0 else leaves[path[-1]], least, len(path), area2, int(zone_of[path[0] // 4]), x[turn].tolist(), y[turn].tolist()))
    return rows


def linked(links: DataFrame) -> tuple[DataFrame, int]:
    """((head, ring, left), rounds) of links (head, next, least, n) that form closed lists: ring is the smallest `least` of a list, and
    left the sum of n from a link to the list's end, the link that holds `ring` coming first.

    All learn their ring by looking twice as far each round, and their place by adding what lies ahead the same way.
    """
    state, rounds = durable(links.select("head", "next", "least")), 0
    while not state.isEmpty():
        ahead = state.select(F.col("head").alias("next"), F.col("next").alias("after"), F.col("least").alias("other"))
        state = durable(state.join(ahead, "next").select("head", F.col("after").alias("next"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("changed")))
        rounds += 1
        if state.filter("changed").isEmpty():
            break
        state = state.drop("changed")
    found = durable(links.join(state.select("head", F.col("least").alias("ring")), "head"))
    leaders = found.filter("least = ring").select(F.col("head").alias("next"), F.lit(True).alias("first"))
    left = durable(found.join(leaders, "next", "left").select("head", F.when(F.col("first").isNull(), F.col("next")).alias("next"), "n"))
    while not left.filter("next is not null").isEmpty():
        ahead = left.select(F.col("head").alias("next"), F.col("next").alias("after"), F.col("n").alias("more"))
        left = durable(left.join(ahead, "next", "left").select("head", F.col("after").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        rounds += 1
    return found.select("head", "ring").join(left.select("head", F.col("n").alias("left")), "head"), rounds


def rings(zones: DataFrame, rows: int, cols: int, tile: int = TILE) -> tuple[DataFrame, int]:
    """((zone, ring, seq, x, y, n_edges, area2), rounds): the corners of each ring in order, x and y in columns and rows of corners.

    ring: number of its smallest edge; area2: twice its area in cells, negative for a hole; seq runs from 0 in the order of the walk,
    from any corner. zones: (zone long below 2**53, row_i, col_i), one row a cell.
    """
    spread = dealt(zones, {"zone": "zone"}, rows, cols, 1, tile)

    def trace(key, table):
        r0, c0, got = grids(key, table, ["zone"], rows, cols, 1, tile)
        found = _trace(got["zone"], r0, c0, cols)
        kinds = (*(pa.int64(),) * 6, pa.list_(pa.int32()), pa.list_(pa.int32()))
        columns = list(zip(*found, strict=True)) or [[]] * 8
        return pa.table([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], ["head", "next", "least", "n_edges", "area2", "zone", "xs", "ys"])

    chains = durable(spread.groupBy("tr", "tc").applyInArrow(trace, _CHAIN))
    closed = chains.filter("next is null").select("zone", F.col("least").alias("ring"), F.lit(0).cast("long").alias("before"), "xs", "ys", "n_edges", "area2")
    chain = durable(chains.filter("next is not null"))
    placed, rounds = linked(chain.select("head", "next", "least", F.size("xs").cast("long").alias("n")))
    chain = durable(chain.join(placed, "head"))
    sums = chain.groupBy("ring").agg(F.sum("n_edges").alias("n_edges"), F.sum("area2").alias("area2"), F.sum(F.size("xs")).alias("total"))
    opened = chain.select("zone", "ring", "xs", "ys", "left").join(sums, "ring")
    opened = opened.select("zone", "ring", (F.col("total") - F.col("left")).alias("before"), "xs", "ys", "n_edges", "area2")
    each = closed.unionByName(opened).select("zone", "ring", "before", "n_edges", "area2", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p"))
    return each.select("zone", "ring", (F.col("before") + F.col("i")).alias("seq"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), "n_edges", "area2"), rounds


def ring_sums(corners: DataFrame) -> DataFrame:
    """(zone, ring, corners, n_edges, area2, hole) of each ring."""
    return corners.groupBy("zone", "ring").agg(F.count(F.lit(1)).alias("corners"), F.first("n_edges").alias("n_edges"), F.first("area2").alias("area2")).withColumn("hole", F.col("area2") < 0)


def polygons(corners: DataFrame, left: float, top: float, resolution: float) -> DataFrame:
    """(zone, wkt): each zone as POLYGON text on the map, its outer ring first, then holes by number; rings begin and end at their
    topmost, then leftmost corner.

    A zone's text is one value, so this is for zones that people draw; `rings` itself keeps corners as rows.
    """
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    x, y = number(F.lit(left) + resolution * F.col("x")), number(F.lit(top) - resolution * F.col("y"))
    points = corners.withColumn("p", F.struct("seq", F.concat_ws(" ", x, y).alias("at")))
    ring = points.groupBy("zone", "ring").agg(F.sort_array(F.collect_list("p"))["at"].alias("at"), F.min_by(F.col("seq").cast("int"), F.struct("y", "x")).alias("k"), (F.first("area2") < 0).alias("hole"))
    ring = ring.withColumn("at", F.concat(F.slice("at", F.col("k") + 1, F.size("at")), F.slice("at", F.lit(1), F.col("k"))))
    ring = ring.withColumn("text", F.concat(F.lit("("), F.array_join(F.concat("at", F.slice("at", 1, 1)), ", "), F.lit(")")))
    listed = F.array_join(F.sort_array(F.collect_list(F.struct("hole", "ring", "text")))["text"], ", ")
    return ring.groupBy("zone").agg(F.concat(F.lit("POLYGON ("), listed, F.lit(")")).alias("wkt"))
