"""Polygons as tables of edges (poly, x1, y1, x2, y2): any number of rings, holes and parts, inside being the even-odd rule.

Cover: tiles from one over everything down to `width`, a quarter as wide each time. A tile that no edge meets is taken whole or not
at all; only tiles that an edge meets are looked into, and only what lies in the smallest of them is tested against edges.
Points, cells and lines meet the cover by tile keys.

Repair: edges are cut where they cross; pieces that lie on each other cancel in pairs, so spikes go; each piece is turned to have the
inside on its left, and at a point where several meet a ring turns left as far as it can, so rings that touch stay apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import edge_crosses, segment_meets_box, segments_cross, tile
from ..storage import durable
from . import outlines

_ENDS = ("x1", "y1", "x2", "y2")
_WIDER = 4.0


def _met_tiles(edges: DataFrame, width: float, *keep: str) -> DataFrame:
    """(keep, tx, ty) of the tiles that edges meet, one row an edge and tile."""
    span = lambda a, b: F.explode(F.sequence(tile(F.least(a, b), width), tile(F.greatest(a, b), width)))
    tiled = edges.withColumn("tx", span("x1", "x2")).withColumn("ty", span("y1", "y2"))
    x, y = F.col("tx") * float(width), F.col("ty") * float(width)
    return tiled.filter(segment_meets_box(*[F.col(c) for c in _ENDS], x, y, x + float(width), y + float(width))).select(*keep, "tx", "ty")


def _inside(places: DataFrame, edges: DataFrame, width: float) -> DataFrame:
    """places (poly, x, y, more) inside their polygon: edges to the right of each are counted, met by rows of `width`."""
    rows = F.explode(F.sequence(tile(F.least("y1", "y2"), width), tile(F.greatest("y1", "y2"), width)))
    by_row = edges.select("poly", *_ENDS).withColumn("__ty", rows)
    keyed = places.withColumn("__ty", tile(F.col("y"), width))
    hit = keyed.join(by_row, ["poly", "__ty"]).filter(edge_crosses(*[F.col(c) for c in ("x", "y", *_ENDS)]))
    return hit.groupBy(*places.columns).agg((F.count(F.lit(1)) % 2).alias("__odd")).filter("__odd = 1").drop("__odd")


def cover(edges: DataFrame, width: float) -> tuple[DataFrame, int]:
    """((poly, level, tx, ty, whole), levels): tiles of width * 4 ** level that a polygon fills, and at level 0 those its edges meet."""
    far = edges.agg(*[F.max(F.abs(c)).alias(c) for c in _ENDS], *[F.min(F.least(F.col(a), F.col(b))).alias("lo" + a) for a, b in (("x1", "x2"), ("y1", "y2"))], *[F.max(F.greatest(F.col(a), F.col(b))).alias("hi" + a) for a, b in (("x1", "x2"), ("y1", "y2"))]).first()
    spread = max(far["hix1"] - far["lox1"], far["hiy1"] - far["loy1"], width) if far["x1"] is not None else width
    levels = math.ceil(math.log(spread / width, _WIDER))
    out, border = None, None
    for level in range(levels, -1, -1):
        size = width * _WIDER**level
        met = durable(_met_tiles(edges, size, "poly").distinct())
        if border is not None:
            step = F.explode(F.sequence(F.lit(0), F.lit(int(_WIDER) - 1)))
            inner = border.withColumn("i", step).withColumn("j", step).select("poly", (F.col("tx") * int(_WIDER) + F.col("i")).alias("tx"), (F.col("ty") * int(_WIDER) + F.col("j")).alias("ty"))
            inner = inner.join(met, ["poly", "tx", "ty"], "left_anti").withColumn("x", (F.col("tx") + 0.5) * size).withColumn("y", (F.col("ty") + 0.5) * size)
            whole = _inside(inner, edges, size).select("poly", F.lit(level).alias("level"), "tx", "ty", F.lit(True).alias("whole"))
            out = whole if out is None else out.unionByName(whole)
        border = met
    edge = border.select("poly", F.lit(0).alias("level"), "tx", "ty", F.lit(False).alias("whole"))
    return durable(edge if out is None else out.unionByName(edge)), levels


def _at_levels(points: DataFrame, width: float, levels: int) -> DataFrame:
    size = F.lit(float(width)) * F.pow(F.lit(_WIDER), F.col("level"))
    at = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return at.withColumn("tx", F.floor(F.col("x") / size).cast("long")).withColumn("ty", F.floor(F.col("y") / size).cast("long"))


def points_inside(points: DataFrame, edges: DataFrame, width: float = 80.0) -> DataFrame:
    """points (x, y, more, unlike each other) with poly for each polygon they lie in, and `tested`: whether edges were looked at."""
    covered, levels = cover(edges, width)
    met = _at_levels(points, width, levels).join(covered, ["level", "tx", "ty"]).drop("level", "tx", "ty")
    whole = met.filter("whole").drop("whole").withColumn("tested", F.lit(False))
    tested = _inside(met.filter("not whole").drop("whole"), edges, width).withColumn("tested", F.lit(True))
    return whole.unionByName(tested)


def tested_share(points: DataFrame, edges: DataFrame, width: float = 80.0) -> float:
    """Share of the points in tiles of the cover that had to be tested against edges."""
    covered, levels = cover(edges, width)
    row = _at_levels(points, width, levels).join(covered, ["level", "tx", "ty"]).agg(F.avg(F.when(F.col("whole"), 0.0).otherwise(1.0)).alias("share")).first()
    return row["share"] or 0.0


def segments_meeting(segments: DataFrame, edges: DataFrame, key: str, width: float = 80.0) -> DataFrame:
    """(key, poly) of the segments (key, x1, y1, x2, y2) that have a point in a polygon: they cross an edge of it or begin inside."""
    a = _met_tiles(segments.select(key, *_ENDS), width, key, *_ENDS)
    b = _met_tiles(edges, width, "poly", *_ENDS).select("poly", "tx", "ty", *[F.col(c).alias("e" + c) for c in _ENDS])
    cross = segments_cross({c: F.col(c) for c in _ENDS}, {c: F.col("e" + c) for c in _ENDS})
    crossing = a.join(b, ["tx", "ty"]).filter(cross).select(key, "poly")
    begins = points_inside(segments.select(key, F.col("x1").alias("x"), F.col("y1").alias("y")), edges, width).select(key, "poly")
    return crossing.unionByName(begins).distinct()


# --- repair ----------------------------------------------------------------------------------------------------------


def noded(edges: DataFrame, width: float = 200.0, digits: int = 6) -> DataFrame:
    """(poly, x1, y1, x2, y2): edges cut at every point where two of a polygon meet, coordinates rounded; what lies twice on the same
    place is gone, what lies thrice is there once."""
    ends = edges.select("poly", F.monotonically_increasing_id().alias("id"), *[F.round(c, digits).alias(c) for c in _ENDS]).filter("x1 <> x2 or y1 <> y2")
    ends = durable(ends)
    tiled = _met_tiles(ends, width, "poly", "id", *_ENDS)
    other = tiled.select("poly", "tx", "ty", F.col("id").alias("o"), *[F.col(c).alias("o" + c) for c in _ENDS])
    pairs = tiled.join(other, ["poly", "tx", "ty"]).filter("id <> o").drop("tx", "ty").distinct()
    dx, dy, ox, oy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    turn = dx * oy - dy * ox
    gx, gy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    t, u = F.try_divide(gx * oy - gy * ox, turn), F.try_divide(gx * dy - gy * dx, turn)
    # The crossing point comes from the edge of the smaller number, so that both are cut at the same place.
    first = F.col("id") < F.col("o")
    px = F.when(first, F.col("x1") + t * dx).otherwise(F.col("ox1") + u * ox)
    py = F.when(first, F.col("y1") + t * dy).otherwise(F.col("oy1") + u * oy)
    meet = pairs.filter((turn != 0) & t.between(0.0, 1.0) & u.between(0.0, 1.0)).select("poly", "id", F.round(px, digits).alias("x"), F.round(py, digits).alias("y"))
    # Of edges in one line, the ends of one that lie on the other.
    level = (turn == 0) & (F.abs(gx * dy - gy * dx) <= 1e-6 * F.sqrt(dx * dx + dy * dy))
    on = pairs.filter(level).select("poly", "id", *_ENDS, F.explode(F.array(*[F.struct(F.col(f"ox{k}").alias("x"), F.col(f"oy{k}").alias("y")) for k in (1, 2)])).alias("p"))
    within = ((F.col("p.x") - F.col("x1")) * dx + (F.col("p.y") - F.col("y1")) * dy) / (dx * dx + dy * dy)
    along = on.filter(within.between(0.0, 1.0)).select("poly", "id", "p.x", "p.y")
    corners = ends.select("poly", "id", F.explode(F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)])).alias("p")).select("poly", "id", "p.x", "p.y")
    cuts = meet.unionByName(along).unionByName(corners).distinct().join(ends, ["poly", "id"])
    place = ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy).alias("place")
    points = cuts.groupBy("poly", "id").agg(F.sort_array(F.collect_list(F.struct(place, "x", "y"))).alias("p"))
    pieces = points.select("poly", F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("s"))
    a, b = F.struct(F.col("s.a.x").alias("x"), F.col("s.a.y").alias("y")), F.struct(F.col("s.b.x").alias("x"), F.col("s.b.y").alias("y"))
    sides = pieces.filter(a != b).select("poly", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    odd = sides.groupBy("poly", "a", "b").agg((F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1")
    return odd.select("poly", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def repaired(edges: DataFrame, width: float = 200.0) -> tuple[DataFrame, int]:
    """((poly, ring, seq, x, y), rounds): corners of simple rings with the same even-odd inside; outer rings run counter-clockwise and
    holes clockwise. A polygon without area has no rings."""
    # Numbers follow from the pieces themselves, so that a task that runs again gives the same ones.
    pieces = durable(noded(edges, width).withColumn("id", F.xxhash64("poly", *_ENDS)))
    middle_x, middle_y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    step = F.least(F.lit(1e-4), length * 1e-3)
    left = pieces.select("poly", "id", (middle_x - (F.col("y2") - F.col("y1")) / length * step).alias("x"), (middle_y + (F.col("x2") - F.col("x1")) / length * step).alias("y"))
    inside = _inside(left, pieces, width).select("poly", "id", F.lit(True).alias("inner"))
    swap = lambda a, b: F.when(F.col("inner").isNull(), F.col(b)).otherwise(F.col(a))
    turned = durable(pieces.join(inside, ["poly", "id"], "left").select("poly", "id", swap("x1", "x2").alias("x1"), swap("y1", "y2").alias("y1"), swap("x2", "x1").alias("x2"), swap("y2", "y1").alias("y2")))
    after = turned.select("poly", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("id").alias("next"))
    heading = lambda ax, ay, bx, by: F.atan2(F.col(by) - F.col(ay), F.col(bx) - F.col(ax))
    bend = F.pmod(heading("x2", "y2", "x3", "y3") - heading("x1", "y1", "x2", "y2") + math.pi, F.lit(2 * math.pi))
    links = turned.join(after, ["poly", "x2", "y2"]).groupBy("poly", "id").agg(F.max_by("next", bend).alias("next"))
    placed, rounds = outlines.linked(links.select(F.col("id").alias("head"), "next", F.col("id").alias("least"), F.lit(1).cast("long").alias("n")))
    corner = turned.join(placed.select(F.col("head").alias("id"), "ring", "left"), "id")
    size = corner.groupBy("poly", "ring").agg(F.count(F.lit(1)).alias("n"))
    return corner.join(size, ["poly", "ring"]).select("poly", "ring", (F.col("n") - F.col("left")).alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y")), rounds


def ring_areas(corners: DataFrame) -> DataFrame:
    """(poly, ring, corners, area): signed area of rings (poly, ring, seq, x, y), holes negative; coordinates are taken from each ring's
    first corner, so that large ones do not cost digits."""
    base = corners.filter("seq = 0").select("poly", "ring", F.col("x").alias("x0"), F.col("y").alias("y0"))
    after = corners.select("poly", "ring", F.col("seq").alias("to"), F.col("x").alias("u"), F.col("y").alias("v"))
    sizes = corners.groupBy("poly", "ring").agg(F.count(F.lit(1)).alias("n"))
    both = corners.join(sizes, ["poly", "ring"]).withColumn("to", (F.col("seq") + 1) % F.col("n")).join(after, ["poly", "ring", "to"]).join(base, ["poly", "ring"])
    cross = (F.col("x") - F.col("x0")) * (F.col("v") - F.col("y0")) - (F.col("u") - F.col("x0")) * (F.col("y") - F.col("y0"))
    return both.groupBy("poly", "ring").agg(F.count(F.lit(1)).alias("corners"), (F.sum(cross) / 2).alias("area"))

