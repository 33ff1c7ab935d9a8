"""Surfaces over the raster of cells, zones on them, and detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, raster, spatial
from ..sources import fixtures
from ..storage import durable
from . import query
from .scoring import SCORED, scored

COLS = fixtures.COLS


def surface(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Cells with elev_m, and the number of rows, from one pass over the keys."""
    cells = fixtures.cells(spark, sf_dir).select("cell_id", "row_i", "col_i", "elev_m")
    return cells, (cells.agg(F.max("row_i")).first()[0] or 0) + 1


#: Search radius of openness, metres.
RADIUS_M = 50.0


def _openness_sql(radius: int, sign: str) -> str:
    """Horizon angles by joins: mirrored without the border repeated, nothing seen counts as a slope of -1000."""
    steps = ", ".join(f"({k}, {r}, {c}, {d * 10.0!r}::DOUBLE)" for k, r, c, d in raster.horizon_offsets(radius))
    return f""", o(k, dr, dc, d) AS (VALUES {steps}), m AS (SELECT max(row_i) AS last FROM fx_cell),
a AS (SELECT row_i, col_i, elev_m, k, d, row_i + dr AS r, col_i + dc AS c, last FROM fx_cell, o, m),
b AS (SELECT *, CASE WHEN r < 0 THEN -r WHEN r > last THEN 2 * last - r ELSE r END AS rr, CASE WHEN c < 0 THEN -c WHEN c > 99 THEN 198 - c ELSE c END AS cc FROM a),
s AS (SELECT b.row_i, b.col_i, k, greatest(-1000.0::DOUBLE, coalesce(max({sign}(z.elev_m - b.elev_m) / d), -1000.0::DOUBLE)) AS s FROM b LEFT JOIN fx_cell z ON z.row_i = rr AND z.col_i = cc GROUP BY b.row_i, b.col_i, k)
SELECT row_i, col_i, round(90.0::DOUBLE - avg(degrees(atan(s))), 5) AS openness FROM s GROUP BY row_i, col_i"""


@query(_openness_sql(5, ""))
def openness_pos(spark, sf_dir):
    cells, rows = surface(spark, sf_dir)
    return raster.openness(cells, "elev_m", rows, COLS, 10.0, RADIUS_M)


@query(_openness_sql(5, "-"))
def openness_neg(spark, sf_dir):
    cells, rows = surface(spark, sf_dir)
    return raster.openness(cells, "elev_m", rows, COLS, 10.0, RADIUS_M, negative=True)


@query(""", o AS (SELECT x.range AS dr, y.range AS dc, exp(-(x.range * x.range + y.range * y.range) / 2.0::DOUBLE) AS w FROM range(-2, 3) x, range(-2, 3) y), m AS (SELECT max(row_i) AS last FROM fx_cell),
a AS (SELECT row_i, col_i, elev_m, w, row_i + dr AS r, col_i + dc AS c, last FROM fx_cell, o, m),
b AS (SELECT *, CASE WHEN r < 0 THEN -r - 1 WHEN r > last THEN 2 * last + 1 - r ELSE r END AS rr, CASE WHEN c < 0 THEN -c - 1 WHEN c > 99 THEN 199 - c ELSE c END AS cc FROM a)
SELECT b.row_i, b.col_i, round(any_value(b.elev_m) - sum(z.elev_m * w) / sum(w), 6) AS relief FROM b JOIN fx_cell z ON z.row_i = rr AND z.col_i = cc GROUP BY b.row_i, b.col_i""")
def local_relief(spark, sf_dir):
    cells, rows = surface(spark, sf_dir)
    return raster.local_relief(cells, "elev_m", rows, COLS, 2)


FLOW = """, o(way, dr, dc, d) AS (VALUES (0, -1, 0, 1.0::DOUBLE), (1, -1, 1, sqrt(2.0)), (2, 0, 1, 1.0), (3, 1, 1, sqrt(2.0)), (4, 1, 0, 1.0), (5, 1, -1, sqrt(2.0)), (6, 0, -1, 1.0), (7, -1, -1, sqrt(2.0))),
s AS (SELECT x.row_i, x.col_i, way, round((x.elev_m - z.elev_m) / d, 6) AS drop_ FROM fx_cell x, o JOIN fx_cell z ON z.row_i = x.row_i + dr AND z.col_i = x.col_i + dc),
di AS MATERIALIZED (SELECT row_i, col_i, CASE WHEN max(drop_) > 0 THEN arg_max(way, (drop_, -way)) END AS dir FROM s GROUP BY row_i, col_i)"""
#: Each cell's way down to its end, all cells on it; and cells that drain through each.
DOWN = FLOW + """, go AS MATERIALIZED (SELECT di.row_i, di.col_i, di.row_i + dr AS r2, di.col_i + dc AS c2 FROM di JOIN o ON o.way = di.dir),
walk(r0, c0, r, c) AS (SELECT row_i, col_i, row_i, col_i FROM fx_cell UNION ALL SELECT r0, c0, r2, c2 FROM walk JOIN go ON go.row_i = walk.r AND go.col_i = walk.c),
acc AS MATERIALIZED (SELECT r AS row_i, c AS col_i, count(*) AS cells FROM walk GROUP BY r, c)"""


@query(FLOW + " SELECT row_i, col_i, dir FROM di")
def flow_d8_direction(spark, sf_dir):
    cells, rows = surface(spark, sf_dir)
    return raster.flow_direction(cells, "elev_m", rows, COLS)


HIGH = """, cut AS (SELECT quantile_cont(elev_m, 0.8) AS c FROM fx_cell), on_ AS (SELECT row_i, col_i, row_i::BIGINT * 4294967296 + col_i AS key, elev_m, cell_id FROM fx_cell, cut WHERE elev_m >= c),
flood(seed, key) AS (SELECT key, key FROM on_ UNION SELECT f.seed, n.key FROM flood f JOIN on_ n ON n.key IN (f.key + 1, f.key - 1, f.key + 4294967296, f.key - 4294967296) AND n.key > f.seed),
z AS (SELECT key, min(seed) AS zone FROM flood GROUP BY key), zc AS (SELECT row_i, col_i, elev_m, cell_id, zone FROM on_ JOIN z USING (key))"""


def high_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, row_i, col_i, elev_m, zone): 4-connected zones of the highest fifth."""
    cells, _ = surface(spark, sf_dir)
    cut = ranking.quantiles(cells, "elev_m", {"cut": 0.8})
    on = cells.crossJoin(F.broadcast(cut)).filter(F.col("elev_m") >= F.col("cut")).drop("cut")
    return raster.components(on.select("row_i", "col_i"), 64).join(on, ["row_i", "col_i"])


TOP = SCORED + """, on_ AS (SELECT row_i, col_i, row_i::BIGINT * 4294967296 + col_i AS key, cell_id, score, score_pct, hand_m FROM pct WHERE score_pct >= 95.0::DOUBLE),
flood(seed, key) AS (SELECT key, key FROM on_ UNION SELECT f.seed, n.key FROM flood f JOIN on_ n ON n.key IN (f.key + 1, f.key - 1, f.key + 4294967296, f.key - 4294967296) AND n.key > f.seed),
z AS (SELECT key, min(seed) AS zone FROM flood GROUP BY key)"""


@query(TOP + """, g AS (SELECT zone, count(*) AS cells, count(*) * 100.0::DOUBLE AS area_m2, round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(avg(score_pct) + 1e-9::DOUBLE, 6) AS pct_mean, round(avg(hand_m), 6) AS hand_mean
FROM on_ JOIN z USING (key) GROUP BY zone HAVING count(*) >= 4) SELECT zone, cells, area_m2, score_mean, score_max, pct_mean, hand_mean, row_number() OVER (ORDER BY pct_mean DESC, area_m2 DESC, zone) AS rank FROM g""")
def zones_ranked(spark, sf_dir):
    """Zones of touching cells of the top 5 percent by score, of at least 4 cells, ranked by their mean percentile."""
    top = durable(scored(spark, sf_dir).filter("score_pct >= 95").select("row_i", "col_i", "score", "score_pct", "hand_m"))
    out = raster.components(top.select("row_i", "col_i")).join(top, ["row_i", "col_i"]).groupBy("zone").agg(
        F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * 100.0).alias("area_m2"), F.round(F.avg("score"), 6).alias("score_mean"), F.round(F.max("score"), 6).alias("score_max"),
        F.round(F.avg("score_pct") + 1e-9, 6).alias("pct_mean"), F.round(F.avg("hand_m"), 6).alias("hand_mean"),
    )
    return ranking.numbered(out.filter("cells >= 4"), [F.desc("pct_mean"), F.desc("area_m2"), F.asc("zone")], "rank")


@query(HIGH + " SELECT zone, count(*) AS cells, min(row_i) AS row_lo, max(row_i) AS row_hi, min(col_i) AS col_lo, max(col_i) AS col_hi, round(max(elev_m), 6) AS top FROM zc GROUP BY zone HAVING count(*) BETWEEN 4 AND 100000")
def detect_zones_high(spark, sf_dir):
    return high_zones(spark, sf_dir).groupBy("zone").agg(
        F.count(F.lit(1)).alias("cells"), F.min("row_i").alias("row_lo"), F.max("row_i").alias("row_hi"), F.min("col_i").alias("col_lo"), F.max("col_i").alias("col_hi"), F.round(F.max("elev_m"), 6).alias("top")
    ).filter(F.col("cells").between(4, 100000))


@query(HIGH + """, b AS (SELECT zone, count(*) AS cells, avg(row_i) AS rc, avg(col_i) AS cc, coalesce(var_samp(row_i), 0) AS vr, coalesce(var_samp(col_i), 0) AS vc, coalesce(covar_samp(row_i, col_i), 0) AS cov FROM zc GROUP BY zone),
e AS (SELECT *, (vr + vc) / 2 + sqrt(((vr - vc) / 2) ** 2 + cov ** 2) AS big, (vr + vc) / 2 - sqrt(((vr - vc) / 2) ** 2 + cov ** 2) AS small FROM b)
SELECT zone, cells, round(CASE WHEN cells < 4 THEN 1.0::DOUBLE WHEN small > 1e-9 THEN sqrt(big / small) ELSE cells::DOUBLE END, 1) AS elongation, round(rc, 6) AS row_c, round(cc, 6) AS col_c FROM e""")
def cluster_morphometry(spark, sf_dir):
    return raster.morphometry(high_zones(spark, sf_dir)).select("zone", "cells", "elongation", "row_c", "col_c")


@query(HIGH + """, m AS (SELECT zone, count(*) AS cells, round(coalesce(var_samp(row_i), 0), 9) AS vr, round(coalesce(var_samp(col_i), 0), 9) AS vc, round(coalesce(covar_samp(row_i, col_i), 0), 9) AS cov FROM zc GROUP BY zone),
ax AS (SELECT *, 0.5::DOUBLE * atan2(2 * cov, vc - vr) AS turn FROM m), uv AS (SELECT zone, col_i * cos(turn) + row_i * sin(turn) AS u, row_i * cos(turn) - col_i * sin(turn) AS v FROM zc JOIN ax USING (zone)),
bx AS (SELECT zone, max(u) - min(u) + 1.0::DOUBLE AS long, max(v) - min(v) + 1.0::DOUBLE AS wide FROM uv GROUP BY zone),
lim AS (SELECT zone, min(row_i) - 1 AS r0, max(row_i) + 1 AS r1, min(col_i) - 1 AS c0, max(col_i) + 1 AS c1 FROM zc GROUP BY zone),
gr AS (SELECT zone, r0, c0, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT zone, r0, c0, c1, unnest(range(r0, r1 + 1)) AS r FROM lim)),
co AS MATERIALIZED (SELECT zone, r0, c0, r, c FROM gr WHERE NOT EXISTS (SELECT 1 FROM zc WHERE zc.zone = gr.zone AND zc.row_i = gr.r AND zc.col_i = gr.c)),
outer_(zone, r, c) AS (SELECT zone, r, c FROM co WHERE r = r0 AND c = c0 UNION SELECT co.zone, co.r, co.c FROM (SELECT zone, unnest([r + 1, r - 1, r, r]) AS r, unnest([c, c, c + 1, c - 1]) AS c FROM outer_) n JOIN co USING (zone, r, c)),
ho AS (SELECT zone, count(*) - (SELECT count(*) FROM outer_ WHERE outer_.zone = co.zone) AS holes FROM co GROUP BY zone)
SELECT zone, cells, CASE WHEN cells < 4 THEN 0.0::DOUBLE ELSE round(long + 1e-9::DOUBLE, 1) END AS span, CASE WHEN cells < 4 THEN 1.0::DOUBLE ELSE round(cells / (long * wide) + 1e-9::DOUBLE, 2) END AS fill,
holes, round(holes / (cells + holes)::DOUBLE, 2) AS enclosed FROM m JOIN bx USING (zone) JOIN ho USING (zone)""")
def cluster_boxes(spark, sf_dir):
    """Span and fill of a zone along its axes, and what it encloses."""
    zones = durable(high_zones(spark, sf_dir).select("zone", "row_i", "col_i"))
    return raster.morphometry(zones).select("zone", "cells", "span", "fill").join(raster.enclosure(zones), "zone")


@query(""", t AS (SELECT cell_id, hand_m, slope_deg FROM fx_cell), h AS (SELECT floor(hand_m) AS bin, count(*) AS n FROM t GROUP BY 1), w AS (SELECT bin, n, lag(n) OVER (ORDER BY bin) AS a, lead(n) OVER (ORDER BY bin) AS b FROM h),
m AS (SELECT bin + 0.5 AS mode, row_number() OVER (ORDER BY bin) AS k FROM w WHERE n > coalesce(a, 0) AND n >= coalesce(b, 0))
SELECT cell_id, coalesce((SELECT min(k) FROM m WHERE abs(hand_m - mode) <= 1.0 AND slope_deg <= 8.0), 0) AS terrace FROM t""")
def terrace_labels(spark, sf_dir):
    """Terraces: ascending modes of height above drainage, the first within a metre, on gentle slopes; 0 is none."""
    from pyspark.sql import Window

    cells = fixtures.cells(spark, sf_dir).select("cell_id", "hand_m", "slope_deg")
    # One row a metre of height: a window over a few thousand rows at most.
    order = Window.orderBy("bin")
    bins = cells.groupBy(F.floor("hand_m").alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("b", F.coalesce(F.lead("n").over(order), F.lit(0)))
    modes = bins.filter("n > a and n >= b").select((F.col("bin") + 0.5).alias("mode"), F.row_number().over(order).cast("long").alias("k"))
    listed = modes.agg(F.sort_array(F.collect_list(F.struct("k", "mode"))).alias("modes"))
    first = F.array_min(F.transform(F.filter("modes", lambda m: F.abs(F.col("hand_m") - m["mode"]) <= 1.0), lambda m: m["k"]))
    return cells.crossJoin(F.broadcast(listed)).select("cell_id", F.coalesce(F.when(F.col("slope_deg") <= 8.0, first), F.lit(0)).cast("long").alias("terrace"))


BURN = """, sr AS (SELECT id, stream_order, x1, y1, x2, y2, unnest(range(greatest(0, floor((4000010.0 - greatest(y1, y2)) / 10.0)::BIGINT), least(last, floor((4000010.0 - least(y1, y2)) / 10.0)::BIGINT) + 1)) AS r FROM fx_line, (SELECT max(row_i) AS last FROM fx_cell)),
sy AS (SELECT *, greatest(4000000.0 - 10.0 * r, least(y1, y2)) AS ya, least(4000010.0 - 10.0 * r, greatest(y1, y2)) AS yb FROM sr), sx AS (SELECT *, x1 + (ya - y1) * (x2 - x1) / (y2 - y1) AS xa, x1 + (yb - y1) * (x2 - x1) / (y2 - y1) AS xb FROM sy),
bu AS (SELECT id, stream_order, r AS row_i, unnest(range(greatest(0, floor((least(xa, xb) - 500000.0) / 10.0)::BIGINT), least(99, floor((greatest(xa, xb) - 500000.0) / 10.0)::BIGINT) + 1)) AS col_i FROM sx),
won AS (SELECT row_i, col_i, arg_max(stream_order, id) AS stream_order FROM bu GROUP BY row_i, col_i)"""


@query(BURN + " SELECT row_i, col_i, coalesce(stream_order, 0) AS stream_order FROM fx_cell LEFT JOIN won USING (row_i, col_i)")
def rasterize_lines(spark, sf_dir):
    """Cells that a line touches take its order, 0 elsewhere; where lines meet the later one wins."""
    cells, rows = surface(spark, sf_dir)
    burnt = spatial.burn(fixtures.flowlines(spark, sf_dir), 500000.0, 4000010.0, 10.0, rows, COLS)
    won = burnt.groupBy("row_i", "col_i").agg(F.max_by("stream_order", "id").alias("stream_order"))
    return cells.select("row_i", "col_i").join(won, ["row_i", "col_i"], "left").select("row_i", "col_i", F.coalesce("stream_order", F.lit(0)).alias("stream_order"))


@query("SELECT b.row_i, b.col_i, b.elev_m, x.cell_id AS seen FROM fx_cell b JOIN (SELECT cell_id, easting, northing FROM fx_cell) x ON b.row_i = floor((4000010 - x.northing) / 10) AND b.col_i = floor((x.easting - 500000) / 10)")
def sample_raster(spark, sf_dir):
    """Value of the cell under each of a set of points: an equi-join on cell indices."""
    cells = fixtures.cells(spark, sf_dir)
    points = cells.select(F.col("cell_id").alias("seen"), F.floor((4000010.0 - F.col("northing")) / 10.0).cast("int").alias("row_i"), F.floor((F.col("easting") - 500000.0) / 10.0).cast("int").alias("col_i"))
    return cells.select("row_i", "col_i", "elev_m").join(points, ["row_i", "col_i"])


