"""Spatial joins over tile keys: an equi-join on tiles first, geometry on what is left."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_box, segment_box_distance, segment_distance, segments_cross, tile
from ..storage import durable

#: Ids that a row holds while pairs of places become pairs of ids.
BLOCK = 64


def _tiles(low, high, width: float):
    return F.explode(F.sequence(tile(low, width), tile(high, width)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, width: float = 200.0) -> DataFrame:
    """All columns of both for each point (x, y) in a box (xmin, ymin, xmax, ymax), bounds included."""
    tiled = boxes.withColumn("__tx", _tiles(F.col("xmin"), F.col("xmax"), width)).withColumn("__ty", _tiles(F.col("ymin"), F.col("ymax"), width))
    keyed = points.withColumn("__tx", tile(F.col("x"), width)).withColumn("__ty", tile(F.col("y"), width))
    inside = in_box(F.col("x"), F.col("y"), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return keyed.join(tiled, ["__tx", "__ty"]).filter(inside).drop("__tx", "__ty")


def nearest_candidates(points: DataFrame, segments: DataFrame, key: str, value: str, width: float = 80.0) -> tuple[DataFrame, DataFrame] | None:
    """((key, x, y, px, py), (px, py, x1..y2, s)): points with their tiles, and the segments that can be the nearest one of some point
    of a tile, s being the lowest id and its value. None without a place.

    Tiles of points meet tiles of segments from one tile over everything down to tiles of `width`, a quarter as wide each time.
    A pair goes on unless a point of some segment is nearer to all four corners of the tile of points than anything in the other
    tile: what is nearer to that point than to another place is convex, so then no point of the tile can be nearest there. The
    bound is a proof, so nothing is cut off by distance, and far tiles keep few pairs.
    """
    coords = ("x1", "y1", "x2", "y2")
    low, high = {"x": F.least("x1", "x2"), "y": F.least("y1", "y2")}, {"x": F.greatest("x1", "x2"), "y": F.greatest("y1", "y2")}
    # Segments that lie on each other are one: the lowest id wins every tie.
    distinct = durable(segments.groupBy(*coords).agg(F.min(F.struct(F.col("id"), F.col(value).alias("v"))).alias("s")))
    ends = [points.select("x", "y"), distinct.select(*[low[c].alias(c) for c in "xy"]), distinct.select(*[high[c].alias(c) for c in "xy"])]
    x0, x9, y0, y9 = ends[0].unionByName(ends[1]).unionByName(ends[2]).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None or y0 is None:
        return None
    levels, tasks = 0, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while width * 4**levels <= max(x9 - x0, y9 - y0):
        levels += 1
    half, slack = math.sqrt(0.5) * width, 1e-5
    laid = distinct.withColumn("qx", _tiles(low["x"] - x0, high["x"] - x0, width)).withColumn("qy", _tiles(low["y"] - y0, high["y"] - y0, width))
    centre = lambda at, zero: zero + (F.col(at) + 0.5) * width
    laid = durable(laid.filter(segment_distance(centre("qx", x0), centre("qy", y0), *[F.col(c) for c in coords]) <= half + slack))
    keyed = points.withColumn("px", tile(F.col("x") - x0, width)).withColumn("py", tile(F.col("y") - y0, width)).select(key, "x", "y", "px", "py")
    # Of each tile of segments the ends furthest to the west, south, east and north: places that a segment has for certain.
    end = [F.struct(F.col("x" + n).alias("x"), F.col("y" + n).alias("y")) for n in "12"]
    turned = [F.struct(F.col("y" + n).alias("y"), F.col("x" + n).alias("x")) for n in "12"]
    marks = {"w": (F.min, F.least(*end)), "s": (F.min, F.least(*turned)), "e": (F.max, F.greatest(*end)), "n": (F.max, F.greatest(*turned))}
    # And the box of what they have in the tile.
    tile_side = {"x": (x0 + F.col("qx") * width, x0 + (F.col("qx") + 1) * width), "y": (y0 + F.col("qy") * width, y0 + (F.col("qy") + 1) * width)}
    for c in "xy":
        marks["lo" + c], marks["hi" + c] = (F.min, F.greatest(low[c], tile_side[c][0])), (F.max, F.least(high[c], tile_side[c][1]))
    places = [(F.col(n + ".x"), F.col(n + ".y")) for n in "wsen"]
    tiles_p = durable(keyed.select("px", "py").distinct().filter("px is not null and py is not null"))
    tiles_q = durable(laid.groupBy("qx", "qy").agg(*[how(c).alias(n) for n, (how, c) in marks.items()]))
    up = lambda c, n: F.shiftright(c, 2 * n)

    def tiles(of: DataFrame, a: str, b: str, level: int) -> DataFrame:
        """Tiles of a level with the tile above each, and the marks of those of segments."""
        above = of.groupBy(up(a, level).alias(a), up(b, level).alias(b)).agg(F.count(F.lit(1)).alias("tiles"), *[how(n).alias(n) for n, (how, _) in marks.items() if n in of.columns])
        return above.drop("tiles").withColumns({a + "_up": up(a, 1), b + "_up": up(b, 1)})

    def corners(size: float) -> list[tuple]:
        return [(x0 + (F.col("px") + i) * size, y0 + (F.col("py") + j) * size) for i in (0, 1) for j in (0, 1)]

    def gap(x, y, u, v):
        return F.sqrt((x - u) * (x - u) + (y - v) * (y - v))

    def best(found: DataFrame, size: float, places: list[tuple]) -> DataFrame:
        """With bx and by, of the places of a tile's pairs the one nearest to its middle."""
        mx, my = x0 + (F.col("px") + 0.5) * size, y0 + (F.col("py") + 0.5) * size
        near = F.least(*[F.struct(gap(mx, my, u, v).alias("d"), u.alias("bx"), v.alias("by")) for u, v in places]) if len(places) > 1 else F.struct(gap(mx, my, *places[0]).alias("d"), places[0][0].alias("bx"), places[0][1].alias("by"))
        return found.withColumn("b", F.min(near).over(Window.partitionBy("px", "py"))).withColumns({"bx": F.col("b.bx"), "by": F.col("b.by")}).drop("b")

    def open_(size: float, apart):
        """Whether a corner of the tile of points is no nearer to its best place than to what is `apart`(corner) away."""
        return F.greatest(*[gap(x, y, F.col("bx"), F.col("by")) - apart(x, y) for x, y in corners(size)]) >= -slack

    def box_open(size: float, lo: dict, hi: dict):
        side = lambda v, c: F.greatest(lo[c] - v, v - hi[c], F.lit(0.0))
        return open_(size, lambda x, y: F.sqrt(side(x, "x") * side(x, "x") + side(y, "y") * side(y, "y")))

    def kept(met: DataFrame, size: float) -> DataFrame:
        return best(met, size, places).filter(box_open(size, *[{c: F.col(n + c) for c in "xy"} for n in ("lo", "hi")])).select("px", "py", "qx", "qy", "bx", "by", *marks)

    pairs = tiles(tiles_p, "px", "py", levels).select("px", "py").crossJoin(tiles(tiles_q, "qx", "qy", levels).select("qx", "qy", *marks))
    for level in range(levels - 1, -1, -1):
        size = width * 4**level
        above = pairs.select(F.col("px").alias("px_up"), F.col("py").alias("py_up"), "qx", "qy", *marks)
        met = kept(above.join(tiles(tiles_p, "px", "py", level), ["px_up", "py_up"]).drop("px_up", "py_up"), size)
        above = met.select("px", "py", F.col("qx").alias("qx_up"), F.col("qy").alias("qy_up"))
        pairs = kept(above.join(tiles(tiles_q, "qx", "qy", level), ["qx_up", "qy_up"]).drop("qx_up", "qy_up"), size)
    seg = [F.col(c) for c in coords]
    to_segment = lambda x, y: segment_distance(x, y, *seg)
    # Few bytes but much to compute: not to be merged into few tasks.
    pairs = (pairs if levels else best(pairs, width, places)).select("px", "py", "qx", "qy", "bx", "by").repartition(tasks, "px", "py", "qx", "qy")
    met = pairs.join(laid, ["qx", "qy"]).filter(box_open(width, low, high) & open_(width, to_segment)).select("px", "py", *coords, "s").distinct()
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    squared = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((centre("px", x0) - F.col("x1")) * dx + (centre("py", y0) - F.col("y1")) * dy) / F.when(squared > 0, squared), F.lit(0.0))))
    met = best(met, width, [(F.col("x1") + t * dx, F.col("y1") + t * dy)]).filter(open_(width, to_segment))
    return keyed, met.select("px", "py", *coords, "s")


def nearest_segment(points: DataFrame, segments: DataFrame, key: str, reach: float | None, value: str, width: float = 80.0) -> DataFrame:
    """points with dist and the value of the nearest segment (id, x1..y2, value), however far; ties go to the lowest id. With a reach,
    what lies beyond it is null."""
    found = nearest_candidates(points, segments, key, value, width)
    if found is None:
        return points.withColumn("dist", F.lit(None).cast("double")).withColumn(value, F.lit(None).cast(segments.schema[value].dataType))
    keyed, met = found
    near = keyed.join(met, ["px", "py"]).withColumn("__d", segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]))
    if reach is not None:
        near = near.filter(F.col("__d") <= reach)
    best_of = near.groupBy(key).agg(F.min(F.struct(F.round("__d", 6).alias("d"), F.col("s.id"), F.col("s.v"))).alias("b"))
    return points.join(best_of.select(key, F.col("b.d").alias("dist"), F.col("b.v").alias(value)), key, "left")


def crossings(segments: DataFrame, keep: Callable[[Column, Column], Column] | None = None, width: float = 200.0) -> DataFrame:
    """(id, stream_order and ends of _a and _b): pairs of segments a < b that touch, and whose orders pass `keep`.

    Segments that lie on each other with one order meet others once, through shared tiles of their boxes; only then do their ids
    pair, block by block, so what is sorted and told apart grows with the places of segments and not with pairs of ids.
    """
    cols = ("x1", "y1", "x2", "y2")
    own = ("stream_order", *cols)
    ids = durable(segments.groupBy(*own).agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("place", F.monotonically_increasing_id()))
    tiled = ids.select("place", *own).withColumn("__tx", _tiles(F.least("x1", "x2"), F.greatest("x1", "x2"), width)).withColumn("__ty", _tiles(F.least("y1", "y2"), F.greatest("y1", "y2"), width))
    a, b = (tiled.select("__tx", "__ty", *[F.col(c).alias(c + s) for c in ("place", *own)]) for s in ("_a", "_b"))
    met = segments_cross(*({c: F.col(c + s) for c in cols} for s in ("_a", "_b")))
    if keep is not None:
        met = met & keep(F.col("stream_order_a"), F.col("stream_order_b"))
    places = a.join(b, ["__tx", "__ty"]).filter(met).drop("__tx", "__ty").distinct()
    blocks = ids.select("place", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / BLOCK).cast("int")), lambda i: F.slice("ids", i * BLOCK + 1, BLOCK))).alias("block", "ids"))
    for s in ("_a", "_b"):
        places = places.join(blocks.select(*[F.col(c).alias(c + s) for c in ("place", "block", "ids")]), "place" + s)
    # Few bytes but many pairs: not to be merged into few tasks.
    spread = places.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place_a", "place_b", "block_a", "block_b")
    pairs = spread.withColumn("id_a", F.explode("ids_a")).withColumn("id_b", F.explode(F.filter("ids_b", lambda i: i > F.col("id_a"))))
    return pairs.select(*[c + s for s in ("_a", "_b") for c in ("id", *own)])


def burn(segments: DataFrame, left: float, top: float, resolution: float, rows: int, cols: int) -> DataFrame:
    """Columns of segments (x1, y1, x2, y2) with row_i and col_i of every cell that each of them touches, row by row."""
    step, low, high = float(resolution), F.least("y1", "y2"), F.greatest("y1", "y2")
    row = lambda y: F.floor((F.lit(top) - y) / step).cast("int")
    first, last = F.greatest(F.lit(0), row(high)), F.least(F.lit(rows - 1), row(low))
    banded = segments.filter(first <= last).withColumn("row_i", F.explode(F.sequence(first, last)))
    edge = F.lit(top) - step * F.col("row_i")
    # Where the segment enters and leaves the row; a level one keeps its ends.
    at = lambda y, end: F.coalesce(F.col("x1") + (y - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.col(end))
    xa, xb = at(F.greatest(edge - step, low), "x1"), at(F.least(edge, high), "x2")
    col = lambda x: F.floor((x - left) / step).cast("int")
    spans = banded.withColumn("__a", F.greatest(F.lit(0), col(F.least(xa, xb)))).withColumn("__b", F.least(F.lit(cols - 1), col(F.greatest(xa, xb))))
    return spans.filter("__a <= __b").withColumn("col_i", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")


def cells_near(cells: DataFrame, segments: DataFrame, distance: float, left: float, top: float, resolution: float, width: float = 200.0) -> DataFrame:
    """The cells (row_i, col_i, more) whose square comes within `distance` of a segment (x1, y1, x2, y2), each once: what a buffer of
    that width would touch. Segments are cut into the tiles that their own buffer meets, so a slanting one takes no whole box of them."""
    seg = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    half, far = resolution / 2.0, float(distance) + resolution
    lines = segments.select(*seg).distinct().withColumn("__tx", _tiles(F.least("x1", "x2") - far, F.greatest("x1", "x2") + far, width)).withColumn("__ty", _tiles(F.least("y1", "y2") - far, F.greatest("y1", "y2") + far, width))
    x0, y0 = F.col("__tx") * float(width), F.col("__ty") * float(width)
    lines = lines.filter(segment_box_distance(seg, x0, y0, x0 + float(width), y0 + float(width)) <= far)
    x, y = F.lit(left) + resolution * (F.col("col_i") + 0.5), F.lit(top) - resolution * (F.col("row_i") + 0.5)
    keyed = cells.select("row_i", "col_i").distinct().withColumn("__x", x).withColumn("__y", y).withColumn("__tx", tile(F.col("__x"), width)).withColumn("__ty", tile(F.col("__y"), width))
    near = segment_box_distance(seg, F.col("__x") - half, F.col("__y") - half, F.col("__x") + half, F.col("__y") + half) <= float(distance)
    hit = keyed.join(lines, ["__tx", "__ty"]).filter(near).select("row_i", "col_i").distinct()
    return cells.join(hit, ["row_i", "col_i"], "left_semi")


def boxes_meet(a: DataFrame, b: DataFrame, width: float = 200.0) -> DataFrame:
    """All columns of pairs of boxes that overlap: a (xmin..ymax) and b (uxmin..uymax), met once in the tile of their lower corner."""
    tiled = lambda df, p: df.withColumn("__tx", _tiles(F.col(p + "xmin"), F.col(p + "xmax"), width)).withColumn("__ty", _tiles(F.col(p + "ymin"), F.col(p + "ymax"), width))
    both = tiled(a, "").join(tiled(b, "u"), ["__tx", "__ty"])
    over = (F.col("xmin") <= F.col("uxmax")) & (F.col("xmax") >= F.col("uxmin")) & (F.col("ymin") <= F.col("uymax")) & (F.col("ymax") >= F.col("uymin"))
    once = (F.col("__tx") == tile(F.greatest("xmin", "uxmin"), width)) & (F.col("__ty") == tile(F.greatest("ymin", "uymin"), width))
    return both.filter(over & once).drop("__tx", "__ty")


def nearest_other(points: DataFrame, group: str, key: str, width: float = 50.0) -> DataFrame:
    """(group, key, near): distance from each point (group, key, x, y) to the nearest other one of its group, none if it is alone.

    Points look into the tiles around their own; what they find within a tile's width is proven, and only the others look again
    in tiles four times as wide, until a tile covers everything.
    """
    spread = points.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    open_, found = durable(points.select(group, key, "x", "y")), None
    while True:
        last = spread is None or width > spread
        looks = open_.withColumn("o", around).select(group, key, "x", "y", (tile(F.col("x"), width) + F.col("o.i")).alias("tx"), (tile(F.col("y"), width) + F.col("o.j")).alias("ty"))
        others = points.select(group, F.col(key).alias("__k"), F.col("x").alias("u"), F.col("y").alias("v"), tile(F.col("x"), width).alias("tx"), tile(F.col("y"), width).alias("ty"))
        gap = F.round(F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2), 6)
        near = durable(looks.join(others, [group, "tx", "ty"]).filter(F.col(key) != F.col("__k")).groupBy(group, key).agg(F.min(gap).alias("near")))
        proven = near if last else near.filter(F.col("near") <= width)
        found = proven if found is None else found.unionByName(proven)
        if last:
            return found
        open_ = durable(open_.join(proven.select(group, key), [group, key], "left_anti"))
        if open_.isEmpty():
            return found
        width *= 4
