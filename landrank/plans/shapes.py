"""Polygons, moved footprints, grids onto grids, and the feature stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import params, stats
from ..functions.geometry import edge_crosses, grown, moved, segment_meets_box, segments_cross, turned
from ..operators import raster, resample, spatial, stack
from ..sources import fixtures
from . import ORACLE_SQL, query
from .scoring import E_SQL, LAYERS, scored
from .terrain import BURN, COLS, DOWN, HIGH, high_zones, surface, terrace_labels
from .vectors import SEG

#: Corners of a five-sided ring around an area's centre, in half widths and half heights; every fourth ring crosses itself.
CORNERS = [(-1.1, -0.9), (0.2, -1.2), (1.3, 0.1), (0.1, 1.2), (-1.0, 0.8)]
RINGS = ", rc AS (SELECT aoi_id, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, (xmax - xmin) / 2 AS hw, (ymax - ymin) / 2 AS hh FROM fx_aoi), cn(k, a, b) AS (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(CORNERS)) + """),
vx AS (SELECT aoi_id, k, round(cx + a * hw, 3) AS x, round(cy + b * hh, 3) AS y FROM rc, cn),
vo AS (SELECT aoi_id, CASE WHEN aoi_id % 4 = 3 AND k = 1 THEN 2 WHEN aoi_id % 4 = 3 AND k = 2 THEN 1 ELSE k END AS k, x, y FROM vx),
ed AS (SELECT p.aoi_id, p.k, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM vo p JOIN vo q ON p.aoi_id = q.aoi_id AND q.k = (p.k + 1) % 5)"""


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aoi_id, k, x1, y1, x2, y2): edges of a ring for each area, in order."""
    a = fixtures.areas(spark, sf_dir)
    cx, cy, hw, hh = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, (F.col("xmax") - F.col("xmin")) / 2, (F.col("ymax") - F.col("ymin")) / 2
    plain = [F.struct(F.round(cx + x * hw, 3).alias("x"), F.round(cy + y * hh, 3).alias("y")) for x, y in CORNERS]
    crossed = [plain[0], plain[2], plain[1], *plain[3:]]
    ring = a.select("aoi_id", F.when(F.col("aoi_id") % 4 == 3, F.array(*crossed)).otherwise(F.array(*plain)).alias("ring"))
    edges = ring.select("aoi_id", "ring", F.posexplode("ring").alias("k", "p"))
    after = F.element_at("ring", (F.col("k") + 1) % len(CORNERS) + 1)
    return edges.select("aoi_id", "k", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), after["x"].alias("x2"), after["y"].alias("y2"))


def ring_boxes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("aoi_id").agg(F.min("x1").alias("xmin"), F.max("x1").alias("xmax"), F.min("y1").alias("ymin"), F.max("y1").alias("ymax"))


@query(RINGS + " SELECT aoi_id, count(*) AS cells FROM (SELECT aoi_id, cell_id FROM fx_cell JOIN ed ON (y1 > northing) <> (y2 > northing) AND easting < (x2 - x1) * (northing - y1) / (y2 - y1) + x1 GROUP BY aoi_id, cell_id HAVING count(*) % 2 = 1) GROUP BY aoi_id")
def cells_in_rings(spark, sf_dir):
    """Cells of each ring of a table of polygons: boxes meet cells through tiles, then edges to the right are counted."""
    edges = ring_edges(spark, sf_dir)
    cells = fixtures.cells(spark, sf_dir).select("cell_id", F.col("easting").alias("x"), F.col("northing").alias("y"))
    near = spatial.points_in_boxes(cells, ring_boxes(edges)).select("aoi_id", "cell_id", "x", "y").join(edges, "aoi_id")
    hit = near.filter(edge_crosses(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])).groupBy("aoi_id", "cell_id").count().filter("count % 2 = 1")
    return hit.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("cells"))


@query(RINGS + """, cr AS (SELECT p.aoi_id, sign((q.x2 - q.x1) * (p.y1 - q.y1) - (q.y2 - q.y1) * (p.x1 - q.x1)) * sign((q.x2 - q.x1) * (p.y2 - q.y1) - (q.y2 - q.y1) * (p.x2 - q.x1)) AS a,
sign((p.x2 - p.x1) * (q.y1 - p.y1) - (p.y2 - p.y1) * (q.x1 - p.x1)) * sign((p.x2 - p.x1) * (q.y2 - p.y1) - (p.y2 - p.y1) * (q.x2 - p.x1)) AS b FROM ed p JOIN ed q ON p.aoi_id = q.aoi_id AND q.k > p.k + 1 AND NOT (p.k = 0 AND q.k = 4))
SELECT aoi_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 3) AS area_m2, NOT EXISTS (SELECT 1 FROM cr WHERE cr.aoi_id = ed.aoi_id AND a <= 0 AND b <= 0) AS valid FROM ed GROUP BY aoi_id""")
def ring_validity(spark, sf_dir):
    """Area of each ring, and whether none of its edges meets another one that is not next to it."""
    edges = ring_edges(spark, sf_dir)
    q = edges.select("aoi_id", *[F.col(c).alias("q" + c) for c in ("k", "x1", "y1", "x2", "y2")])
    apart = (F.col("qk") > F.col("k") + 1) & ~((F.col("k") == 0) & (F.col("qk") == len(CORNERS) - 1))
    sides = ({c: F.col(p + c) for c in ("x1", "y1", "x2", "y2")} for p in ("", "q"))
    bad = edges.join(q, "aoi_id").filter(apart & segments_cross(*sides)).select("aoi_id").distinct().withColumn("bad", F.lit(True))
    area = edges.groupBy("aoi_id").agg(F.round(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2, 3).alias("area_m2"))
    return area.join(bad, "aoi_id", "left").select("aoi_id", "area_m2", F.col("bad").isNull().alias("valid"))


@query("""SELECT c.aoi_id AS control_id, f.aoi_id AS frame_id, round((least(c.xmax, f.xmax + 60) - greatest(c.xmin, f.xmin - 60)) * (least(c.ymax, f.ymax + 60) - greatest(c.ymin, f.ymin - 60)), 3) AS shared_m2
FROM fx_aoi c JOIN fx_aoi f ON c.role LIKE 'control%' AND f.role NOT LIKE 'control%' AND c.xmin <= f.xmax + 60 AND c.xmax >= f.xmin - 60 AND c.ymin <= f.ymax + 60 AND c.ymax >= f.ymin - 60""")
def controls_in_frames(spark, sf_dir):
    """Control areas that overlap a frame grown by 60 m, and by how much."""
    a = fixtures.areas(spark, sf_dir)
    controls = a.filter(F.col("role").startswith("control")).select(F.col("aoi_id").alias("control_id"), "xmin", "ymin", "xmax", "ymax")
    frames = a.filter(~F.col("role").startswith("control")).select(F.col("aoi_id").alias("frame_id"), *[(F.col(c) + s * 60).alias("u" + c) for c, s in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))])
    w = F.least("xmax", "uxmax") - F.greatest("xmin", "uxmin")
    h = F.least("ymax", "uymax") - F.greatest("ymin", "uymin")
    return spatial.boxes_meet(controls, frames).select("control_id", "frame_id", F.round(w * h, 3).alias("shared_m2"))


_T = "CASE WHEN {1} = {0} THEN CASE WHEN {0} BETWEEN {2} AND {3} THEN {4} ELSE {5} END ELSE {6}(({2} - {0}) / ({1} - {0}), ({3} - {0}) / ({1} - {0})) END"
_IN = "greatest(0.0::DOUBLE, " + _T.format("x1", "x2", "xmin", "xmax", "0.0::DOUBLE", "2.0::DOUBLE", "least") + ", " + _T.format("y1", "y2", "ymin", "ymax", "0.0::DOUBLE", "2.0::DOUBLE", "least") + ")"
_OUT = "least(1.0::DOUBLE, " + _T.format("x1", "x2", "xmin", "xmax", "1.0::DOUBLE", "-1.0::DOUBLE", "greatest") + ", " + _T.format("y1", "y2", "ymin", "ymax", "1.0::DOUBLE", "-1.0::DOUBLE", "greatest") + ")"


@query(f"SELECT id, stream_order FROM fx_line WHERE EXISTS (SELECT 1 FROM fx_aoi WHERE role = 'prospect' AND {_IN} <= {_OUT})")
def lines_in_areas(spark, sf_dir):
    """Lines that meet an area, clipped as a semi join: each line once, however many areas it meets."""
    lines = fixtures.flowlines(spark, sf_dir)
    boxed = lines.select("id", *[F.col(c).alias("s" + c) for c in ("x1", "y1", "x2", "y2")], *[f(a, b).alias(n) for f, a, b, n in ((F.least, "x1", "x2", "xmin"), (F.greatest, "x1", "x2", "xmax"), (F.least, "y1", "y2", "ymin"), (F.greatest, "y1", "y2", "ymax"))])
    areas = fixtures.areas(spark, sf_dir).filter("role = 'prospect'").select(*[F.col(c).alias("u" + c) for c in ("xmin", "ymin", "xmax", "ymax")])
    met = spatial.boxes_meet(boxed, areas).filter(segment_meets_box(*[F.col(c) for c in ("sx1", "sy1", "sx2", "sy2", "uxmin", "uymin", "uxmax", "uymax")]))
    return lines.join(met.select("id"), "id", "left_semi").select("id", "stream_order")


@query("SELECT cell_id, drainage_class FROM fx_cell WHERE easting + 5 >= (SELECT xmin FROM fx_aoi WHERE aoi_id = 7) AND easting - 5 <= (SELECT xmax FROM fx_aoi WHERE aoi_id = 7) AND northing + 5 >= (SELECT ymin FROM fx_aoi WHERE aoi_id = 7) AND northing - 5 <= (SELECT ymax FROM fx_aoi WHERE aoi_id = 7)")
def soils_over_area(spark, sf_dir):
    """Soil of the cells whose square meets one area's box; the box is one row."""
    box = fixtures.areas(spark, sf_dir).filter("aoi_id = 7").select("xmin", "ymin", "xmax", "ymax").limit(1)
    e, n = F.col("easting"), F.col("northing")
    meets = (e + 5 >= F.col("xmin")) & (e - 5 <= F.col("xmax")) & (n + 5 >= F.col("ymin")) & (n - 5 <= F.col("ymax"))
    return fixtures.cells(spark, sf_dir).join(F.broadcast(box), meets).select("cell_id", "drainage_class")


@query("""SELECT aoi_id, turns, xmin + 30.0 * turns + (xmax - xmin) / 2 - (CASE WHEN turns % 2 = 0 THEN xmax - xmin ELSE ymax - ymin END) / 2 - 15 AS xmin, xmin + 30.0 * turns + (xmax - xmin) / 2 + (CASE WHEN turns % 2 = 0 THEN xmax - xmin ELSE ymax - ymin END) / 2 + 15 AS xmax,
(ymin + ymax) / 2 - 20.0 * turns - (CASE WHEN turns % 2 = 0 THEN ymax - ymin ELSE xmax - xmin END) / 2 - 15 AS ymin, (ymin + ymax) / 2 - 20.0 * turns + (CASE WHEN turns % 2 = 0 THEN ymax - ymin ELSE xmax - xmin END) / 2 + 15 AS ymax FROM fx_aoi, range(0, 4) t(turns)""")
def moved_footprints(spark, sf_dir):
    """Footprints turned by right angles about their centre, moved, and grown by 15 m."""
    a = fixtures.areas(spark, sf_dir).withColumn("turns", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    box = {c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}
    out = grown(moved(turned(box, F.col("turns")), 30.0 * F.col("turns"), -20.0 * F.col("turns")), 15.0)
    return a.select("aoi_id", "turns", *[out[c].alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


TARGET = "SELECT i.range AS row_t, j.range AS col_t, (4000010.0 - (3999997.5 - 25.0 * i.range)) / 10.0 - 0.5 AS fr, ((500012.5 + 25.0 * j.range) - 500000.0) / 10.0 - 0.5 AS fc FROM range(0, (SELECT CAST((max(row_i) + 1) * 10 // 25 - 1 AS BIGINT) FROM fx_cell)) i, range(0, 39) j"


@query(f""", tg AS ({TARGET}), nb AS (SELECT row_t, col_t, r.range AS dr, c.range AS dc, floor(fr)::BIGINT + r.range AS row_i, floor(fc)::BIGINT + c.range AS col_i, (CASE WHEN r.range = 0 THEN 1 - (fr - floor(fr)) ELSE fr - floor(fr) END) * (CASE WHEN c.range = 0 THEN 1 - (fc - floor(fc)) ELSE fc - floor(fc) END) AS w FROM tg, range(0, 2) r, range(0, 2) c)
SELECT row_t::INT AS row_t, col_t::INT AS col_t, round(sum(w * elev_m) / sum(w), 9) AS elev_m FROM nb JOIN fx_cell USING (row_i, col_i) WHERE w > 0 GROUP BY row_t, col_t""")
def resample_bilinear(spark, sf_dir):
    """The surface on a grid of 25 m: each target cell from the four around its centre, those that are missing left out."""
    cells, rows = surface(spark, sf_dir)
    target = resample.Grid(500000.0, 4000010.0, 25.0, rows * 10 // 25 - 1, 39)
    return resample.bilinear(cells, "elev_m", resample.Grid(500000.0, 4000010.0, 10.0, rows, COLS), target)


@query(f", tg AS ({TARGET}) SELECT row_t::INT AS row_t, col_t::INT AS col_t, drainage_class AS value FROM tg JOIN fx_cell ON row_i = floor(fr + 0.5)::BIGINT AND col_i = floor(fc + 0.5)::BIGINT")
def resample_nearest(spark, sf_dir):
    """Classes on the same grid: the cell that holds the target's centre."""
    cells = fixtures.cells(spark, sf_dir)
    rows = surface(spark, sf_dir)[1]
    target = resample.Grid(500000.0, 4000010.0, 25.0, rows * 10 // 25 - 1, 39)
    return resample.nearest(cells.select("row_i", "col_i", F.col("drainage_class").alias("value")), resample.Grid(500000.0, 4000010.0, 10.0, rows, COLS), target)


MASKED = "SELECT *, CASE WHEN cell_id % 11 <> 0 THEN hand_m END AS hand, CASE WHEN cell_id % 13 = 0 THEN 'nan'::DOUBLE ELSE slope_deg END AS slope FROM fx_cell"


def masked(spark, sf_dir) -> DataFrame:
    """Cells of which some have no height above drainage and some no slope."""
    k = F.col("cell_id")
    return fixtures.cells(spark, sf_dir).withColumn("hand", F.when(k % 11 != 0, F.col("hand_m"))).withColumn("slope", F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("slope_deg")))


@query(f"SELECT cell_id, hand, slope FROM ({MASKED}) WHERE hand IS NOT NULL AND NOT isnan(slope)")
def valid_cells(spark, sf_dir):
    """Cells with both height above drainage and slope: the mask of a feature stack."""
    return stack.valid(masked(spark, sf_dir), ("hand", "slope")).select("cell_id", "hand", "slope")


@query(SEG.format(points="(SELECT cell_id, easting AS x, northing AS y FROM fx_cell)", key="cell_id") + BURN + f""" SELECT row_i, col_i, easting, northing, hand, slope, twi, dist AS dist_to_stream_m, nn.stream_order AS stream_order_nearest, coalesce(won.stream_order, 0) AS stream_here
FROM ({MASKED}) JOIN nn USING (cell_id) LEFT JOIN won USING (row_i, col_i) WHERE hand IS NOT NULL AND NOT isnan(slope)""")
def feature_stack(spark, sf_dir):
    """Cell table from rasters and vectors: layers meet by position, lines are burnt in and measured to, cells without a core layer go."""
    cells = masked(spark, sf_dir)
    rows = surface(spark, sf_dir)[1]
    lines = fixtures.flowlines(spark, sf_dir)
    grid = resample.Grid(500000.0, 4000010.0, 10.0, rows, COLS)
    layers = {n: cells.select("row_i", "col_i", F.col(n).alias("value")) for n in ("hand", "slope", "twi")}
    return stack.build(grid, layers, core=("hand", "slope"), burnt={"stream_here": (lines, "stream_order")}, nearest={"dist_to_stream_m": (lines, "stream_order", "stream_order_nearest")})


@query(f"SELECT terrace, count(*) AS cells FROM ({ORACLE_SQL['terrace_labels']}) GROUP BY terrace")
def terrace_counts(spark, sf_dir):
    """Cells of each terrace class."""
    return terrace_labels(spark, sf_dir).groupBy("terrace").agg(F.count(F.lit(1)).alias("cells"))


@query(HIGH + """, b AS (SELECT zone, count(*) AS cells, coalesce(var_samp(row_i), 0) AS vr, coalesce(var_samp(col_i), 0) AS vc, coalesce(covar_samp(row_i, col_i), 0) AS cov FROM zc GROUP BY zone),
e AS (SELECT *, (vr + vc) / 2 + sqrt(((vr - vc) / 2) ** 2 + cov ** 2) AS big, (vr + vc) / 2 - sqrt(((vr - vc) / 2) ** 2 + cov ** 2) AS small FROM b)
SELECT zone, cells, elongation, cells >= 4 AND cells <= 900 AND elongation <= 3.5 AS qualifies FROM (SELECT zone, cells, round(CASE WHEN cells < 4 THEN 1.0::DOUBLE WHEN small > 1e-9 THEN sqrt(big / small) ELSE cells::DOUBLE END, 1) AS elongation FROM e)""")
def cluster_gates(spark, sf_dir):
    """Zones with the verdict of a class's shape gates; gates that the class does not set let all pass."""
    shapes = raster.morphometry(high_zones(spark, sf_dir))
    gate = params.gates(min_cells=4, max_cells=900, max_elongation=3.5, min_elongation=None, min_fill=None)
    return shapes.select("zone", "cells", "elongation", gate.alias("qualifies"))


@query("SELECT s.site_id, c.elev_m, round(sqrt((c.easting - s.x) ** 2 + (c.northing - s.y) ** 2), 6) AS off_m FROM fx_site s JOIN fx_cell c ON c.row_i = floor((4000010 - s.y) / 10) AND c.col_i = floor((s.x - 500000) / 10) WHERE review_status = 'confirmed'")
def sites_on_raster(spark, sf_dir):
    """Height under each confirmed site, and how far the cell's centre is off: an equi-join on cell indices."""
    x, y = F.col("x"), F.col("y")
    at = fixtures.sites(spark, sf_dir).filter("review_status = 'confirmed'").select("site_id", "x", "y", F.floor((4000010.0 - y) / 10.0).cast("int").alias("row_i"), F.floor((x - 500000.0) / 10.0).cast("int").alias("col_i"))
    both = at.join(fixtures.cells(spark, sf_dir).select("row_i", "col_i", "elev_m", "easting", "northing"), ["row_i", "col_i"])
    return both.select("site_id", "elev_m", F.round(F.sqrt((F.col("easting") - x) ** 2 + (F.col("northing") - y) ** 2), 6).alias("off_m"))


@query(DOWN + """, st AS (SELECT row_i, col_i, elev_m AS base FROM acc JOIN fx_cell USING (row_i, col_i) WHERE cells >= 100),
fst AS (SELECT r0, c0, max(base) AS base FROM walk JOIN st ON st.row_i = walk.r AND st.col_i = walk.c GROUP BY r0, c0)
SELECT row_i, col_i, round(elev_m - base, 6) AS hand FROM fx_cell LEFT JOIN fst ON r0 = row_i AND c0 = col_i""")
def height_above_stream(spark, sf_dir):
    """Height of each cell above the stream cell it drains to, which is the highest on its way."""
    cells, rows = surface(spark, sf_dir)
    return raster.hand(cells, "elev_m", rows, COLS, 100)


SLOPE = """, nb AS (SELECT x.row_i, x.col_i, sum(CASE z.col_i - x.col_i WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END * CASE WHEN z.row_i = x.row_i THEN 2 ELSE 1 END * z.elev_m) / 80.0 AS dx, sum(CASE z.row_i - x.row_i WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END * CASE WHEN z.col_i = x.col_i THEN 2 ELSE 1 END * z.elev_m) / 80.0 AS dy, count(*) AS n
FROM fx_cell x JOIN fx_cell z ON z.row_i BETWEEN x.row_i - 1 AND x.row_i + 1 AND z.col_i BETWEEN x.col_i - 1 AND x.col_i + 1 GROUP BY x.row_i, x.col_i),
sl AS (SELECT row_i, col_i, CASE WHEN n = 9 THEN round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) END AS slope_deg FROM nb)"""


@query(SLOPE + " SELECT row_i, col_i, slope_deg FROM sl")
def slope(spark, sf_dir):
    """Slope from the weighted differences of all eight neighbours."""
    cells, rows = surface(spark, sf_dir)
    return raster.slope(cells, "elev_m", rows, COLS, 10.0)


@query(DOWN + SLOPE + " SELECT row_i, col_i, round(ln(cells * 10.0::DOUBLE / tan(radians(greatest(slope_deg, 0.1::DOUBLE)))), 6) AS twi FROM acc JOIN sl USING (row_i, col_i) WHERE slope_deg IS NOT NULL")
def topographic_wetness(spark, sf_dir):
    """Wetness from flow and slope."""
    cells, rows = surface(spark, sf_dir)
    return raster.wetness(raster.flow_accumulation(cells, "elev_m", rows, COLS), raster.slope(cells, "elev_m", rows, COLS, 10.0).filter("slope_deg is not null"), 10.0)


@query(E_SQL + """, ef AS (SELECT least(3.0::DOUBLE, 9.0::DOUBLE / (3.0::DOUBLE + 2 * hand_slope + 2 * hand_twi + 2 * slope_twi)) AS n FROM r) SELECT cell_id, round((norm_hand + norm_slope + norm_twi) / 3.0::DOUBLE * (n / 3.0::DOUBLE), 6) AS combined FROM nrm, ef""")
def evidence_combined(spark, sf_dir):
    """Mean of a cell's indicators, discounted for layers that say the same: times effective over named layers."""
    cells = scored(spark, sf_dir)
    pairs = {(a, b): F.round(stats.correlation(f"norm_{a}", f"norm_{b}"), 6) for i, a in enumerate(LAYERS) for b in LAYERS[i + 1 :]}
    effective = cells.agg(stats.effective_count(LAYERS, pairs).alias("effective"))
    return cells.crossJoin(F.broadcast(effective)).select("cell_id", F.round(stats.combined([F.col(f"norm_{n}") for n in LAYERS], F.col("effective")), 6).alias("combined"))
