"""Breached flow, distances on the grid, outlines of zones, and what lies near lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection, discs, distance, gridding, hydrology, outlines, polygons, spatial, stack
from ..operators.resample import Grid
from ..sources import fixtures, layout, rasters
from ..storage import shared_folder
from . import query
from .shapes import _IN, _OUT, CORNERS, MASKED, masked, ring_edges
from .shapes import RINGS as AREA_RINGS
from .terrain import BURN, COLS, DOWN, HIGH, high_zones, surface
from .vectors import DISC_M, RING_M

#: Lowest steps between basins, the tree of Prim's rule over them (a row a basin), ways with the turned ones, and all cells on each way.
BREACH = DOWN + """, pi AS MATERIALIZED (SELECT r0 AS row_i, c0 AS col_i, r * 100 + c AS pit FROM walk JOIN di ON di.row_i = walk.r AND di.col_i = walk.c WHERE dir IS NULL),
k AS MATERIALIZED (SELECT row_i, col_i, row_i * 100 + col_i AS key, elev_m AS z, pit FROM fx_cell JOIN pi USING (row_i, col_i)),
ko AS (SELECT k.*, row_i + dr AS r, col_i + dc AS c FROM k, o),
st AS (SELECT ko.pit AS u, coalesce(n.pit, -1) AS v, greatest(ko.z, coalesce(n.z, ko.z)) AS h, ko.key AS a, coalesce(n.key, -1) AS b FROM ko LEFT JOIN k n ON n.row_i = ko.r AND n.col_i = ko.c WHERE n.pit IS NULL OR n.pit <> ko.pit),
lo AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h, least(a, b), greatest(a, b)) AS rank FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY h, least(a, b), greatest(a, b)) = 1)),
prim(n, seen, a, b) AS (SELECT 0, [-1::BIGINT], -1::BIGINT, -1::BIGINT UNION ALL SELECT n + 1, list_append(seen, arg_min(lo.u, rank)), arg_min(lo.a, rank), arg_min(lo.b, rank) FROM prim JOIN lo ON list_contains(seen, lo.v) AND NOT list_contains(seen, lo.u) GROUP BY n, seen),
hd AS MATERIALIZED (SELECT a // 100 AS row_i, a % 100 AS col_i, way FROM prim LEFT JOIN o ON b = a + dr * 100 + dc AND b >= 0 WHERE n > 0),
tu AS MATERIALIZED (SELECT go.r2 AS row_i, go.c2 AS col_i, (di.dir + 4) % 8 AS way FROM hd JOIN walk ON r0 = hd.row_i AND c0 = hd.col_i JOIN go ON go.row_i = walk.r AND go.col_i = walk.c JOIN di ON di.row_i = walk.r AND di.col_i = walk.c),
nw AS MATERIALIZED (SELECT di.row_i, di.col_i, CASE WHEN hd.row_i IS NOT NULL THEN hd.way WHEN tu.row_i IS NOT NULL THEN tu.way ELSE di.dir END AS dir FROM di LEFT JOIN hd USING (row_i, col_i) LEFT JOIN tu USING (row_i, col_i)),
gn AS MATERIALIZED (SELECT nw.row_i, nw.col_i, nw.row_i + dr AS r2, nw.col_i + dc AS c2 FROM nw JOIN o ON o.way = nw.dir),
fl(r0, c0, r, c) AS (SELECT row_i, col_i, row_i, col_i FROM fx_cell UNION ALL SELECT r0, c0, r2, c2 FROM fl JOIN gn ON gn.row_i = fl.r AND gn.col_i = fl.c),
br AS MATERIALIZED (SELECT fl.r AS row_i, fl.c AS col_i, min(elev_m) AS breached, count(*) AS cells FROM fl JOIN fx_cell ON row_i = r0 AND col_i = c0 GROUP BY fl.r, fl.c)"""


@query(BREACH + " SELECT row_i, col_i, dir, breached FROM nw JOIN br USING (row_i, col_i)")
def flow_breached(spark, sf_dir):
    """Way of each cell once every pit is breached at its basin's lowest step, and heights along the cuts; null where a way leaves."""
    cells, rows = surface(spark, sf_dir)
    return hydrology.breached(cells, "elev_m", rows, COLS)


@query(BREACH + " SELECT row_i, col_i, cells FROM br")
def flow_accumulation_breached(spark, sf_dir):
    """Cells that drain through each cell of the breached surface: ways go on to the border."""
    cells, rows = surface(spark, sf_dir)
    return hydrology.breached_accumulation(cells, "elev_m", rows, COLS).withColumn("cells", F.col("cells").cast("long"))


@query(BREACH + """, ft AS (SELECT r0, c0, max(breached) AS base FROM fl JOIN br ON br.row_i = fl.r AND br.col_i = fl.c WHERE br.cells >= 100 GROUP BY r0, c0)
SELECT row_i, col_i, round(breached - base, 6) AS hand FROM br LEFT JOIN ft ON r0 = row_i AND c0 = col_i""")
def height_above_stream_breached(spark, sf_dir):
    """Height of each cell of the breached surface above the stream cell that it drains to."""
    cells, rows = surface(spark, sf_dir)
    return hydrology.breached_above_stream(cells, "elev_m", rows, COLS, 100)


#: Nearest touched cell of each cell, by all pairs.
ALL_PAIRS = BURN + """, sp AS (SELECT c.row_i, c.col_i, arg_min(struct_pack(d := (c.row_i - w.row_i) ** 2 + (c.col_i - w.col_i) ** 2, o := w.stream_order), struct_pack(d := (c.row_i - w.row_i) ** 2 + (c.col_i - w.col_i) ** 2, r := w.row_i, k := w.col_i)) AS n FROM fx_cell c, won w GROUP BY c.row_i, c.col_i),
gd AS (SELECT row_i, col_i, round(10.0::DOUBLE * sqrt(n.d), 6) AS dist_m, n.o::DOUBLE AS stream_order FROM sp)"""


@query(ALL_PAIRS + " SELECT row_i, col_i, dist_m, stream_order FROM gd")
def grid_distance(spark, sf_dir):
    """Distance of each cell to the nearest cell that a line touches, centre to centre, and that cell's order."""
    _, rows = surface(spark, sf_dir)
    burnt = spatial.burn(fixtures.flowlines(spark, sf_dir), 500000.0, 4000010.0, 10.0, rows, COLS)
    won = burnt.groupBy("row_i", "col_i").agg(F.max_by("stream_order", "id").alias("stream_order"))
    found = distance.distance_to_marked(won, rows, COLS, 10.0, "stream_order")
    return found.select("row_i", "col_i", F.round("dist", 6).alias("dist_m"), "stream_order")


@query(ALL_PAIRS + f" SELECT row_i, col_i, easting, northing, hand, slope, dist_m AS dist_to_stream_m, stream_order AS stream_order_nearest FROM ({MASKED}) JOIN gd USING (row_i, col_i) WHERE hand IS NOT NULL AND NOT isnan(slope)")
def feature_stack_gridded(spark, sf_dir):
    """The cell table with distances measured on the grid, to the nearest cell that a line touches."""
    cells = masked(spark, sf_dir)
    grid = Grid(500000.0, 4000010.0, 10.0, surface(spark, sf_dir)[1], COLS)
    layers = {n: cells.select("row_i", "col_i", F.col(n).alias("value")) for n in ("hand", "slope")}
    out = stack.build(grid, layers, core=("hand", "slope"), gridded={"dist_to_stream_m": (fixtures.flowlines(spark, sf_dir), "stream_order", "stream_order_nearest")})
    return out.withColumn("dist_to_stream_m", F.round("dist_to_stream_m", 6))


#: Distance of a line to a cell's square: 0 where they meet, else that of a corner to the line or of an end to the square.
_GAP = "sqrt(greatest(xmin - {0}, {0} - xmax, 0) ** 2 + greatest(ymin - {1}, {1} - ymax, 0) ** 2)"
_PS = "sqrt(({0} - (x1 + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({0} - x1) * (x2 - x1) + ({1} - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (x2 - x1))) ** 2 + ({1} - (y1 + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({0} - x1) * (x2 - x1) + ({1} - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (y2 - y1))) ** 2)"
_NEAR = f"CASE WHEN {_IN} <= {_OUT} THEN 0.0::DOUBLE ELSE least(" + ", ".join(_PS.format(x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax")) + ", " + _GAP.format("x1", "y1") + ", " + _GAP.format("x2", "y2") + ") END"


@query(HIGH + f""", sq AS (SELECT zone, row_i, col_i, 500000.0::DOUBLE + 10 * col_i AS xmin, 500010.0::DOUBLE + 10 * col_i AS xmax, 4000000.0::DOUBLE - 10 * row_i AS ymin, 4000010.0::DOUBLE - 10 * row_i AS ymax FROM zc),
un AS (SELECT DISTINCT row_i, col_i FROM sq JOIN fx_line ON xmin <= greatest(x1, x2) + 20 AND xmax >= least(x1, x2) - 20 AND ymin <= greatest(y1, y2) + 20 AND ymax >= least(y1, y2) - 20 WHERE {_NEAR} <= 20)
SELECT zone, cells, round(c, 6) AS covered FROM (SELECT zone, count(*) AS cells, avg(CASE WHEN un.row_i IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS c FROM zc LEFT JOIN un USING (row_i, col_i) GROUP BY zone) WHERE c <= 0.5""")
def detect_zones_excluded(spark, sf_dir):
    """Zones without those of which more than half the cells are touched by a line's buffer of 20 m."""
    _, rows = surface(spark, sf_dir)
    zones = high_zones(spark, sf_dir).select("zone", "row_i", "col_i")
    kept = detection.exclude_near(zones, fixtures.flowlines(spark, sf_dir), 20.0, Grid(500000.0, 4000010.0, 10.0, rows, COLS))
    return kept.select("zone", "cells", F.round("covered", 6).alias("covered"))


#: Edges of zones by cell and side, what follows each, and the smallest edge of its ring.
RINGS = HIGH + """, sd(s, dr, dc) AS (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)),
ed AS MATERIALIZED (SELECT zc.zone, zc.row_i, zc.col_i, s FROM zc, sd WHERE NOT EXISTS (SELECT 1 FROM zc n WHERE n.zone = zc.zone AND n.row_i = zc.row_i + dr AND n.col_i = zc.col_i + dc)),
ah AS (SELECT ed.*, a.dr AS ar, a.dc AS ac, sd.dr, sd.dc FROM ed JOIN sd USING (s) JOIN sd a ON a.s = (ed.s + 1) % 4),
fo AS (SELECT ah.zone, ah.row_i, ah.col_i, ah.s, (ah.row_i * 100 + ah.col_i) * 4 + ah.s AS id, CASE WHEN n.zone IS NULL THEN (ah.row_i * 100 + ah.col_i) * 4 + (ah.s + 1) % 4 WHEN b.zone IS NULL THEN (n.row_i * 100 + n.col_i) * 4 + ah.s ELSE (b.row_i * 100 + b.col_i) * 4 + (ah.s + 3) % 4 END AS next
FROM ah LEFT JOIN zc n ON n.zone = ah.zone AND n.row_i = ah.row_i + ar AND n.col_i = ah.col_i + ac LEFT JOIN zc b ON b.zone = ah.zone AND b.row_i = ah.row_i + ar + dr AND b.col_i = ah.col_i + ac + dc),
fm AS MATERIALIZED (SELECT *, next % 4 <> s AS turns FROM fo),
wk(id, pos, n) AS (SELECT id, next, 1 FROM fm UNION ALL SELECT wk.id, fm.next, n + 1 FROM wk JOIN fm ON fm.id = wk.pos WHERE wk.pos > wk.id),
rg AS (SELECT wk.id AS ring, wk.pos AS id FROM wk JOIN (SELECT id FROM wk WHERE pos = id) l ON l.id = wk.id)"""


@query(RINGS + """ SELECT zone, ring, count(*) FILTER (WHERE turns) AS corners, count(*) AS n_edges, CAST(sum(CASE s WHEN 1 THEN 2 * (col_i + 1) WHEN 3 THEN -2 * col_i ELSE 0 END) AS BIGINT) AS area2, sum(CASE s WHEN 1 THEN 2 * (col_i + 1) WHEN 3 THEN -2 * col_i ELSE 0 END) < 0 AS hole FROM rg JOIN fm USING (id) GROUP BY zone, ring""")
def zone_rings(spark, sf_dir):
    """Rings of the zones of the highest fifth: corners, length and area of each, holes negative."""
    _, rows = surface(spark, sf_dir)
    return outlines.ring_sums(outlines.rings(high_zones(spark, sf_dir).select("zone", "row_i", "col_i"), rows, COLS)[0])


@query(HIGH + " SELECT zone, count(*) * 100.0::DOUBLE AS area_m2, count(*) * 100.0::DOUBLE AS ring_area_m2 FROM zc GROUP BY zone")
def zone_ring_area(spark, sf_dir):
    """Area of each zone from its cells and from its rings."""
    _, rows = surface(spark, sf_dir)
    zones = high_zones(spark, sf_dir).select("zone", "row_i", "col_i")
    by_cells = zones.groupBy("zone").agg((F.count(F.lit(1)) * 100.0).alias("area_m2"))
    by_rings = outlines.ring_sums(outlines.rings(zones, rows, COLS)[0]).groupBy("zone").agg((F.sum("area2") * 50.0).alias("ring_area_m2"))
    return by_cells.join(by_rings, "zone")


#: A hole of two fifths in every other ring of an area, and a triangle beside each, in half widths and half heights.
TRIANGLE = [(1.5, 1.5), (1.9, 1.5), (1.7, 1.9)]
PARTS = AREA_RINGS + ", ct(k, a, b) AS (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(TRIANGLE)) + """),
vh AS (SELECT aoi_id, 5 AS n, k, round(cx + 0.4::DOUBLE * a * hw, 3) AS x, round(cy + 0.4::DOUBLE * b * hh, 3) AS y FROM rc, cn WHERE aoi_id % 2 = 0 UNION ALL SELECT aoi_id, 3, k, round(cx + a * hw, 3), round(cy + b * hh, 3) FROM rc, ct),
mp AS MATERIALIZED (SELECT aoi_id AS poly, x1, y1, x2, y2 FROM ed UNION ALL SELECT p.aoi_id, p.x, p.y, q.x, q.y FROM vh p JOIN vh q ON p.aoi_id = q.aoi_id AND p.n = q.n AND q.k = (p.k + 1) % p.n)"""
_CROSS = "sign(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))"


def area_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poly, x1, y1, x2, y2): polygons of several rings for each area; some cross themselves, some have a hole, all have two parts."""
    a = fixtures.areas(spark, sf_dir)
    cx, cy, hw, hh = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, (F.col("xmax") - F.col("xmin")) / 2, (F.col("ymax") - F.col("ymin")) / 2
    out = ring_edges(spark, sf_dir).select(F.col("aoi_id").alias("poly"), "x1", "y1", "x2", "y2")
    for scale, corners, only in ((0.4, CORNERS, "aoi_id % 2 = 0"), (1.0, TRIANGLE, "true")):
        points = [(F.round(cx + scale * x * hw, 3), F.round(cy + scale * y * hh, 3)) for x, y in corners]
        sides = [F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")) for p, q in zip(points, points[1:] + points[:1], strict=True)]
        out = out.unionByName(a.filter(only).select(F.col("aoi_id").alias("poly"), F.explode(F.array(*sides)).alias("s")).select("poly", "s.*"))
    return out


@query(PARTS + """, ic AS (SELECT poly, cell_id, any_value(elev_m) AS elev_m FROM fx_cell JOIN mp ON (y1 > northing) <> (y2 > northing) AND easting < (x2 - x1) * (northing - y1) / (y2 - y1) + x1 GROUP BY poly, cell_id HAVING count(*) % 2 = 1)
SELECT poly, count(*) AS cells, round(avg(elev_m), 6) AS mean_elev, min(elev_m) AS least, max(elev_m) AS most FROM ic GROUP BY poly""")
def zonal_stats_by_polygon(spark, sf_dir):
    """Raster statistics of each polygon, holes and parts included: whole tiles of cells are taken without a look at edges."""
    cells = fixtures.cells(spark, sf_dir).select("cell_id", "elev_m", F.col("easting").alias("x"), F.col("northing").alias("y"))
    inside = polygons.points_inside(cells, area_parts(spark, sf_dir), 40.0)
    return inside.groupBy("poly").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("elev_m"), 6).alias("mean_elev"), F.min("elev_m").alias("least"), F.max("elev_m").alias("most"))


@query(PARTS + f""", cr AS (SELECT id, poly FROM fx_line l JOIN mp e ON {_CROSS.format("e.x1", "e.y1", "e.x2", "e.y2", "l.x1", "l.y1")} * {_CROSS.format("e.x1", "e.y1", "e.x2", "e.y2", "l.x2", "l.y2")} <= 0 AND {_CROSS.format("l.x1", "l.y1", "l.x2", "l.y2", "e.x1", "e.y1")} * {_CROSS.format("l.x1", "l.y1", "l.x2", "l.y2", "e.x2", "e.y2")} <= 0 AND NOT ({_CROSS.format("e.x1", "e.y1", "e.x2", "e.y2", "l.x1", "l.y1")} = 0 AND {_CROSS.format("e.x1", "e.y1", "e.x2", "e.y2", "l.x2", "l.y2")} = 0)),
bg AS (SELECT id, poly FROM fx_line l JOIN mp e ON (e.y1 > l.y1) <> (e.y2 > l.y1) AND l.x1 < (e.x2 - e.x1) * (l.y1 - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY id, poly HAVING count(*) % 2 = 1)
SELECT id, poly FROM cr UNION SELECT id, poly FROM bg""")
def lines_in_polygons(spark, sf_dir):
    """Lines that have a point in a polygon, and which one."""
    return polygons.segments_meeting(fixtures.flowlines(spark, sf_dir), area_parts(spark, sf_dir), "id", 40.0)


@query(PARTS + """, pr AS (SELECT p.poly, p.y1 + ((p.x1 - q.x1) * (q.y1 - q.y2) - (p.y1 - q.y1) * (q.x1 - q.x2)) / ((p.x1 - p.x2) * (q.y1 - q.y2) - (p.y1 - p.y2) * (q.x1 - q.x2)) * (p.y2 - p.y1) AS y FROM mp p JOIN mp q ON p.poly = q.poly AND abs((p.x1 - p.x2) * (q.y1 - q.y2) - (p.y1 - p.y2) * (q.x1 - q.x2)) > 1e-9
WHERE ((p.x1 - q.x1) * (q.y1 - q.y2) - (p.y1 - q.y1) * (q.x1 - q.x2)) / ((p.x1 - p.x2) * (q.y1 - q.y2) - (p.y1 - p.y2) * (q.x1 - q.x2)) BETWEEN 0 AND 1 AND -((p.x1 - p.x2) * (p.y1 - q.y1) - (p.y1 - p.y2) * (p.x1 - q.x1)) / ((p.x1 - p.x2) * (q.y1 - q.y2) - (p.y1 - p.y2) * (q.x1 - q.x2)) BETWEEN 0 AND 1),
ys AS (SELECT poly, y1 AS y FROM mp UNION SELECT poly, y FROM pr), sb AS (SELECT poly, y AS lo, lead(y) OVER (PARTITION BY poly ORDER BY y) AS hi FROM ys),
xs AS (SELECT sb.poly, lo, hi, x1 + ((lo + hi) / 2 - y1) * (x2 - x1) / (y2 - y1) AS x FROM sb JOIN mp ON mp.poly = sb.poly AND (y1 > (lo + hi) / 2) <> (y2 > (lo + hi) / 2) WHERE hi > lo),
nm AS (SELECT *, row_number() OVER (PARTITION BY poly, lo ORDER BY x) AS k FROM xs)
SELECT poly, round(sum((hi - lo) * x * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END), 2) AS area_m2 FROM nm GROUP BY poly""")
def ring_repair(spark, sf_dir):
    """Area of each polygon after its rings are cut where they cross and joined anew: that of the even-odd inside."""
    corners, _ = polygons.repaired(area_parts(spark, sf_dir))
    return polygons.ring_areas(corners).groupBy("poly").agg(F.round(F.sum("area"), 2).alias("area_m2"))


@query(PARTS + f""", ic AS (SELECT DISTINCT cell_id FROM (SELECT poly, cell_id FROM fx_cell JOIN mp ON (y1 > northing) <> (y2 > northing) AND easting < (x2 - x1) * (northing - y1) / (y2 - y1) + x1 WHERE poly % 4 = 2 GROUP BY poly, cell_id HAVING count(*) % 2 = 1))
SELECT row_i, col_i, easting, northing, hand, slope FROM ({MASKED}) JOIN ic USING (cell_id) WHERE hand IS NOT NULL AND NOT isnan(slope)""")
def feature_stack_clipped(spark, sf_dir):
    """The cell table of the prospects' polygons."""
    cells = masked(spark, sf_dir)
    grid = Grid(500000.0, 4000010.0, 10.0, surface(spark, sf_dir)[1], COLS)
    layers = {n: cells.select("row_i", "col_i", F.col(n).alias("value")) for n in ("hand", "slope")}
    return stack.build(grid, layers, core=("hand", "slope"), area=area_parts(spark, sf_dir).filter("poly % 4 = 2"))


def elevation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface written as tiled raster files, and what reads them."""
    cells, rows = surface(spark, sf_dir)
    folder = shared_folder(spark, "elevation")
    rasters.write(cells, folder, Grid(500000.0, 4000010.0, 10.0, rows, COLS), "elev_m", "float64", tile=32, block=4)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(rasters.TiledRaster)
    return spark.read.format("tiled_raster").load(folder)


@query("SELECT row_i, col_i, easting AS x, northing AS y, elev_m AS value FROM fx_cell")
def raster_round_trip(spark, sf_dir):
    """Cells from the files that they were written to."""
    return elevation_files(spark, sf_dir)


@query("SELECT count(*) AS cells, round(avg(elev_m), 6) AS mean_elev FROM fx_cell WHERE easting BETWEEN 500300 AND 500500 AND northing >= 3999800 AND (easting - 500400) ** 2 + (northing - 3999900) ** 2 <= 10000")
def raster_window(spark, sf_dir):
    """A disc of the surface: only the file tiles that its box meets are read."""
    disc = (F.col("x") - 500400) ** 2 + (F.col("y") - 3999900) ** 2 <= 10000
    return elevation_files(spark, sf_dir).filter(F.col("x").between(500300, 500500) & (F.col("y") >= 3999800) & disc).agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("value"), 6).alias("mean_elev"))


_PX = "(500000.0::DOUBLE + (l_partkey * 37 + l_suppkey * 11) % 1000 + l_linenumber / 8.0::DOUBLE)"
_PY = "(4000010.0::DOUBLE - (l_orderkey * 13 + l_partkey) % greatest(10, last * 10) - l_quantity / 64.0::DOUBLE)"


@query(f""", pt AS (SELECT {_PX} AS x, {_PY} AS y, l_extendedprice AS z FROM lineitem, (SELECT max(row_i) AS last FROM fx_cell) WHERE l_returnflag <> 'R'),
ne AS (SELECT c.row_i, c.col_i, z, sqrt((x - easting) ** 2 + (y - northing) ** 2) AS d FROM pt, range(-2, 3) i, range(-2, 3) j JOIN fx_cell c ON c.row_i = floor((4000010.0 - y) / 10.0)::INT + i.range AND c.col_i = floor((x - 500000.0) / 10.0)::INT + j.range),
su AS (SELECT row_i, col_i, count(*) AS points, sum(z / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0) AS idw, avg(z) FILTER (d = 0) AS exact FROM ne WHERE d <= 10.0::DOUBLE * sqrt(2.0::DOUBLE) GROUP BY row_i, col_i)
SELECT row_i, col_i, coalesce(points, 0) AS ground, round(coalesce(exact, idw), 4) AS idw FROM fx_cell LEFT JOIN su USING (row_i, col_i)""")
def point_grid(spark, sf_dir):
    """Points of the ground class gridded by inverse distance from their coordinates, with the number in reach of each cell's centre."""
    _, rows = surface(spark, sf_dir)
    k = {c: F.col("l_" + c) for c in ("partkey", "suppkey", "orderkey", "linenumber", "quantity", "extendedprice")}
    x = 500000.0 + (k["partkey"] * 37 + k["suppkey"] * 11) % 1000 + k["linenumber"] / 8.0
    y = 4000010.0 - (k["orderkey"] * 13 + k["partkey"]) % max(10, (rows - 1) * 10) - k["quantity"] / 64.0
    points = fixtures.table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(x.alias("x"), y.alias("y"), k["extendedprice"].alias("z"))
    out = gridding.inverse_distance(points, Grid(500000.0, 4000010.0, 10.0, rows, COLS))
    return out.select("row_i", "col_i", F.col("points").alias("ground"), F.round("value", 4).alias("idw"))


#: Clusters of a disc's cells beyond a fifth of the ring, high in height and low above drainage, with their centres and shapes.
CLUSTERS = f""", h AS (SELECT site_id AS id, x, y FROM fx_site WHERE review_status = 'confirmed'),
w AS (SELECT h.id, k.range AS k, row_i, col_i, CASE k.range WHEN 0 THEN elev_m ELSE hand_m END AS v, sqrt((easting - h.x) ** 2 + (northing - h.y) ** 2) AS d FROM h JOIN fx_cell ON easting BETWEEN h.x - {RING_M} AND h.x + {RING_M} AND northing BETWEEN h.y - {RING_M} AND h.y + {RING_M}, range(0, 2) k),
t AS (SELECT id, k, count(*) FILTER (d > {DISC_M} AND d <= {RING_M}) AS n_ring, count(*) FILTER (d <= {DISC_M}) AS n_disc, CASE k WHEN 0 THEN quantile_cont(v, 0.8) FILTER (d > {DISC_M} AND d <= {RING_M}) ELSE quantile_cont(v, 0.2) FILTER (d > {DISC_M} AND d <= {RING_M}) END AS cut FROM w GROUP BY id, k),
va AS (SELECT h.id, k.range AS k, coalesce(n_ring >= 100 AND n_disc >= 3, false) AS valid FROM h CROSS JOIN range(0, 2) k LEFT JOIN t ON t.id = h.id AND t.k = k.range),
u AS MATERIALIZED (SELECT id, k, row_i, col_i, row_i::BIGINT * 4294967296 + col_i AS key FROM w JOIN t USING (id, k) WHERE d <= {DISC_M} AND n_ring >= 100 AND n_disc >= 3 AND CASE k WHEN 0 THEN v >= cut ELSE v <= cut END),
fl(id, k, seed, key) AS (SELECT id, k, key, key FROM u UNION SELECT u.id, u.k, fl.seed, u.key FROM fl JOIN u ON u.id = fl.id AND u.k = fl.k AND u.key IN (fl.key + 1, fl.key - 1, fl.key + 4294967296, fl.key - 4294967296) AND u.key > fl.seed),
ce AS (SELECT id, k, key, min(seed) AS seed FROM fl GROUP BY id, k, key),
mo AS (SELECT id, k, seed, count(*) AS cells, avg(row_i) AS rc, avg(col_i) AS cc, round(coalesce(var_samp(row_i), 0), 9) AS vr, round(coalesce(var_samp(col_i), 0), 9) AS vc, round(coalesce(covar_samp(row_i, col_i), 0), 9) AS cov FROM ce JOIN u USING (id, k, key) GROUP BY id, k, seed),
cl AS MATERIALIZED (SELECT id, k, seed, cells, rc, cc, CASE WHEN cells < 4 THEN 1.0::DOUBLE WHEN (vr + vc) / 2 - sqrt(((vr - vc) / 2) ** 2 + cov ** 2) > 1e-9 THEN round(sqrt(((vr + vc) / 2 + sqrt(((vr - vc) / 2) ** 2 + cov ** 2)) / ((vr + vc) / 2 - sqrt(((vr - vc) / 2) ** 2 + cov ** 2))), 1) ELSE cells::DOUBLE END AS elongation FROM mo)"""


def site_rule(spark: SparkSession, sf_dir: str, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A rule over the clusters in the discs of confirmed sites, each place looked at once."""
    sites = fixtures.sites(spark, sf_dir).filter("review_status = 'confirmed'").select(F.col("site_id").alias("id"), "x", "y")
    cells = fixtures.cells(spark, sf_dir).select(F.col("easting").alias("x"), F.col("northing").alias("y"), "elev_m", "hand_m")
    return discs.each_place(sites, lambda one: rule(discs.clusters(one, cells, {"elev_m": "high", "hand_m": "low"}, 10.0, DISC_M, RING_M, 0.8, 3)))


@query(CLUSTERS + """, qu AS (SELECT * FROM cl WHERE cells >= 3 AND elongation <= 4.0),
pr AS (SELECT DISTINCT a.id FROM qu a JOIN qu b ON a.id = b.id AND a.k = 0 AND b.k = 1 AND sqrt((a.rc - b.rc) ** 2 + (a.cc - b.cc) ** 2) <= 3.0)
SELECT site_id, valid, fired_high, fired_low, paired, (fired_high OR fired_low) AND paired AS hit FROM (SELECT va.id AS site_id, bool_or(valid) AS valid, EXISTS (SELECT 1 FROM qu WHERE qu.id = va.id AND qu.k = 0) AS fired_high, EXISTS (SELECT 1 FROM qu WHERE qu.id = va.id AND qu.k = 1) AS fired_low, va.id IN (SELECT id FROM pr) AS paired FROM va GROUP BY va.id)""")
def pair_rule(spark, sf_dir):
    """Sites whose disc holds a high cluster of one surface and a low one of another, at most 30 m apart: all clusters that pass are compared."""
    gate = (F.col("cells") >= 3) & (F.col("elongation") <= 4.0)
    out = site_rule(spark, sf_dir, lambda found: discs.paired(found, "elev_m", "hand_m", 30.0, 10.0, gate, most=None))
    return out.select(F.col("id").alias("site_id"), "valid", F.col("fired_a").alias("fired_high"), F.col("fired_b").alias("fired_low"), "paired", "hit")


@query(CLUSTERS + """, el AS (SELECT * FROM cl WHERE k = 1 AND cells BETWEEN 1 AND 6 AND elongation <= 3.0),
nn AS (SELECT a.id, a.seed, min(sqrt((a.rc - b.rc) ** 2 + (a.cc - b.cc) ** 2)) * 10.0::DOUBLE AS near FROM el a JOIN el b ON a.id = b.id AND a.seed <> b.seed GROUP BY a.id, a.seed),
sp AS (SELECT id, round(avg(near) + 1e-9::DOUBLE, 1) AS nn_mean_m, round(stddev_pop(near) / greatest(avg(near), 1e-9::DOUBLE) + 1e-9::DOUBLE, 2) AS nn_cv FROM nn GROUP BY id),
co AS (SELECT va.id, valid, (SELECT count(*) FROM el WHERE el.id = va.id) AS elements FROM va WHERE k = 1)
SELECT co.id AS site_id, valid, elements, CASE WHEN elements >= 3 THEN nn_mean_m END AS nn_mean_m, CASE WHEN elements >= 3 THEN nn_cv END AS nn_cv, coalesce(elements >= 3 AND nn_mean_m <= 30.0 AND nn_cv <= 0.3, false) AS satisfied FROM co LEFT JOIN sp USING (id)""")
def multi_element_rule(spark, sf_dir):
    """Sites whose disc holds three or more small low clusters at regular distances."""
    element = F.col("cells").between(1, 6) & (F.col("elongation") <= 3.0)
    out = site_rule(spark, sf_dir, lambda found: discs.several(found, "hand_m", 3, 30.0, 0.3, 10.0, element))
    return out.withColumnRenamed("id", "site_id")


@query("SELECT cell_id, row_i, col_i, elev_m FROM fx_cell WHERE easting + 5 >= 500310 AND easting - 5 <= 500480 AND northing + 5 >= 3999700 AND northing - 5 <= 3999850")
def box_scan_cells(spark, sf_dir):
    """Cells whose square meets a box, from a table laid out by tiles: ranges of tile numbers and the box reach the scan."""
    path = shared_folder(spark, "cells")
    e, n = F.col("easting"), F.col("northing")
    layout.write(fixtures.cells(spark, sf_dir).select("cell_id", "row_i", "col_i", "elev_m", "easting", "northing"), path, (e - 5, n - 5, e + 5, n + 5), 80.0)
    return layout.read(spark, path, 500310.0, 3999700.0, 500480.0, 3999850.0).select("cell_id", "row_i", "col_i", "elev_m")


@query("SELECT id, stream_order FROM fx_line WHERE greatest(x1, x2) >= 500310 AND least(x1, x2) <= 500480 AND greatest(y1, y2) >= 3999700 AND least(y1, y2) <= 3999850")
def box_scan_lines(spark, sf_dir):
    """Lines whose box meets a box, from a table laid out by tiles."""
    path = shared_folder(spark, "lines")
    lines = fixtures.flowlines(spark, sf_dir)
    layout.write(lines, path, (F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")), 80.0)
    return layout.read(spark, path, 500310.0, 3999700.0, 500480.0, 3999850.0).select("id", "stream_order")
