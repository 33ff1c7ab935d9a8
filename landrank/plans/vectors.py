"""Lines, sites and areas: distances, crossings, label joins, rules between sites, and survey plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from ..functions.geometry import boxes_overlap
from ..operators import detection, ranking, spatial
from ..sources import fixtures
from ..storage import durable
from . import ORACLE_SQL, query
from .scoring import SCORED, scored

SEG = """, sd AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM {points} p, fx_line),
dd AS (SELECT *, sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1)))) AS far FROM sd),
nn AS (SELECT {key}, min(round(far, 6)) AS dist, (min_by(stream_order, (round(far, 6), id))) AS stream_order FROM dd GROUP BY {key})"""
CELL_POINTS = "(SELECT cell_id, easting AS x, northing AS y FROM fx_cell)"


def _cells(spark, sf_dir) -> DataFrame:
    return fixtures.cells(spark, sf_dir).select("cell_id", F.col("easting").alias("x"), F.col("northing").alias("y"))


@query(SEG.format(points=CELL_POINTS, key="cell_id") + " SELECT cell_id, dist, stream_order FROM fx_cell LEFT JOIN nn USING (cell_id)")
def dist_to_stream(spark, sf_dir):
    """Distance and order of the nearest line of every cell, however far."""
    return spatial.nearest_segment(_cells(spark, sf_dir), fixtures.flowlines(spark, sf_dir), "cell_id", None, "stream_order").select("cell_id", "dist", "stream_order")


@query("SELECT id, stream_order, x1, y1, x2, y2 FROM fx_line WHERE least(x1, x2) <= 500600 AND greatest(x1, x2) >= 500200 AND least(y1, y2) <= 3999900 AND greatest(y1, y2) >= 3999400")
def bbox_scan_flowlines(spark, sf_dir):
    lines = fixtures.flowlines(spark, sf_dir)
    box = {"xmin": F.least("x1", "x2"), "xmax": F.greatest("x1", "x2"), "ymin": F.least("y1", "y2"), "ymax": F.greatest("y1", "y2")}
    frame = {"xmin": F.lit(500200.0), "xmax": F.lit(500600.0), "ymin": F.lit(3999400.0), "ymax": F.lit(3999900.0)}
    return lines.filter(boxes_overlap(box, frame))


CROSS = """, cx AS (SELECT a.id AS id_a, b.id AS id_b, a.stream_order AS order_a, b.stream_order AS order_b,
sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) AS d1, sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) AS d2,
sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) AS d3, sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) AS d4
FROM fx_line a JOIN fx_line b ON a.id < b.id AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2))"""


@query(CROSS + " SELECT id_a, id_b, least(order_a, order_b) AS order_minor, greatest(order_a, order_b) AS order_major FROM cx WHERE d1 * d2 <= 0 AND d3 * d4 <= 0 AND NOT (d1 = 0 AND d2 = 0) AND least(order_a, order_b) >= 2 AND order_a <> order_b")
def confluences(spark, sf_dir):
    """Junctions of streams of different order, the smaller at least 2."""
    pairs = spatial.crossings(fixtures.flowlines(spark, sf_dir), lambda a, b: (F.least(a, b) >= 2) & (a != b))
    minor, major = F.least("stream_order_a", "stream_order_b"), F.greatest("stream_order_a", "stream_order_b")
    return pairs.select("id_a", "id_b", minor.alias("order_minor"), major.alias("order_major"))


@query("SELECT aoi_id, site_id, class_id FROM fx_site JOIN fx_aoi ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax")
def labels_within_aoi(spark, sf_dir):
    return spatial.points_in_boxes(fixtures.sites(spark, sf_dir), fixtures.areas(spark, sf_dir)).select("aoi_id", "site_id", "class_id")


@query("SELECT class_id, review_status, count(*) AS n, max(positional_confidence_m) AS worst_m FROM fx_site WHERE review_status <> 'rejected' GROUP BY class_id, review_status")
def label_counts(spark, sf_dir):
    return fixtures.sites(spark, sf_dir).filter("review_status <> 'rejected'").groupBy("class_id", "review_status").agg(F.count(F.lit(1)).alias("n"), F.max("positional_confidence_m").alias("worst_m"))


@query("SELECT aoi_id, slug, count(site_id) AS n FROM fx_aoi LEFT JOIN fx_site ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax AND review_status = 'confirmed' GROUP BY aoi_id, slug")
def sheets_left_join_counts(spark, sf_dir):
    """Areas with their number of confirmed sites, none included."""
    areas = fixtures.areas(spark, sf_dir)
    inside = spatial.points_in_boxes(fixtures.sites(spark, sf_dir).filter("review_status = 'confirmed'"), areas).select("aoi_id", "site_id")
    return areas.join(inside, "aoi_id", "left").groupBy("aoi_id", "slug").agg(F.count("site_id").alias("n"))


@query("SELECT site_id FROM fx_site WHERE NOT EXISTS (SELECT 1 FROM fx_aoi WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)")
def sites_outside_footprints(spark, sf_dir):
    sites = fixtures.sites(spark, sf_dir)
    return sites.select("site_id").join(spatial.points_in_boxes(sites, fixtures.areas(spark, sf_dir)).select("site_id"), "site_id", "left_anti")


RING = [(500050.0, 3999950.0), (500600.0, 3999980.0), (500900.0, 3999700.0), (500500.0, 3999760.0), (500850.0, 3999300.0), (500400.0, 3999450.0), (500120.0, 3999250.0), (500250.0, 3999650.0)]
EDGES = [(*a, *b) for a, b in zip(RING, RING[1:] + RING[:1])]


@query(", e AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in EDGES) + ") v(x1, y1, x2, y2)) SELECT cell_id FROM fx_cell, e WHERE (y1 > northing) <> (y2 > northing) AND easting < (x2 - x1) * (northing - y1) / (y2 - y1) + x1 GROUP BY cell_id HAVING count(*) % 2 = 1")
def cells_in_polygon(spark, sf_dir):
    """Cells inside a ring by the parity of edges to their right; the box of the ring comes first."""
    xs, ys = [p[0] for p in RING], [p[1] for p in RING]
    x, y = F.col("easting"), F.col("northing")
    from ..functions.geometry import edge_crosses

    near = fixtures.cells(spark, sf_dir).filter(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)))
    crossed = sum(F.when(edge_crosses(x, y, *[F.lit(v) for v in e]), 1).otherwise(0) for e in EDGES)
    return near.filter(crossed % 2 == 1).select("cell_id")


@query(SCORED + SEG.format(points="(SELECT cell_id, easting AS x, northing AS y FROM fx_cell)", key="cell_id") + """, b AS (SELECT dist, score_pct, cell_id FROM pct JOIN nn USING (cell_id))
SELECT round(quantile_cont(dist, 0.5) FILTER (score_pct >= 95), 6) AS top_median, round(quantile_cont(dist, 0.25) FILTER (score_pct >= 95), 6) AS top_q1, round(quantile_cont(dist, 0.5), 6) AS background_median,
round((quantile_cont(dist, 0.5) FILTER (score_pct >= 95)) / (quantile_cont(dist, 0.5)), 6) AS ratio FROM b""")
def access_bias(spark, sf_dir):
    """How near the best cells lie to access lines, against all cells."""
    near = spatial.nearest_segment(_cells(spark, sf_dir), fixtures.flowlines(spark, sf_dir), "cell_id", None, "stream_order")
    both = durable(near.join(scored(spark, sf_dir).select("cell_id", "score_pct"), "cell_id").select("dist", "score_pct"))
    top = ranking.quantiles(both.filter("score_pct >= 95"), "dist", {"t": 0.5, "q": 0.25})
    out = top.crossJoin(F.broadcast(ranking.quantiles(both, "dist", {"b": 0.5})))
    return out.select(F.round("t", 6).alias("top_median"), F.round("q", 6).alias("top_q1"), F.round("b", 6).alias("background_median"), F.round(F.try_divide(F.col("t"), F.col("b")), 6).alias("ratio"))


@query("SELECT a.site_id, bool_or(b.site_id IS NOT NULL) AS satisfied FROM (SELECT * FROM fx_site WHERE class_id = 'BUILDING') a LEFT JOIN (SELECT * FROM fx_site WHERE class_id = 'MACHINERY') b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2500 GROUP BY a.site_id")
def sites_paired(spark, sf_dir):
    """Sites of one class with one of another within 50 m: places of sites, each once, meet through tiles of that width."""
    sites, gap = fixtures.sites(spark, sf_dir), 50.0
    from ..functions.geometry import tile

    a = sites.filter("class_id = 'BUILDING'").select("site_id", "x", "y")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.select("x", "y").distinct().select("x", "y", around.alias("o")).select("x", "y", (tile(F.col("x"), gap) + F.col("o.i")).alias("tx"), (tile(F.col("y"), gap) + F.col("o.j")).alias("ty"))
    right = sites.filter("class_id = 'MACHINERY'").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct().withColumns({"tx": tile(F.col("u"), gap), "ty": tile(F.col("v"), gap)})
    near = left.join(right, ["tx", "ty"]).filter((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2 <= gap * gap).select("x", "y").distinct().withColumn("hit", F.lit(True))
    return a.join(near, ["x", "y"], "left").select("site_id", F.coalesce("hit", F.lit(False)).alias("satisfied"))


@query(""", k AS (SELECT aoi_id, site_id, x, y FROM fx_site JOIN fx_aoi ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax WHERE review_status = 'confirmed'),
d AS (SELECT a.aoi_id, a.site_id, min(round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6)) AS near FROM k a JOIN k b ON a.aoi_id = b.aoi_id AND a.site_id <> b.site_id GROUP BY a.aoi_id, a.site_id)
SELECT aoi_id, count(*) AS n, round(avg(near), 6) AS mean_gap, round(stddev_pop(near) / nullif(avg(near), 0), 6) AS cv FROM d GROUP BY aoi_id""")
def sites_regularity(spark, sf_dir):
    """Regularity of the sites of an area: variation of the gap to the nearest other one, found through tiles that widen."""
    inside = spatial.points_in_boxes(fixtures.sites(spark, sf_dir).filter("review_status = 'confirmed'"), fixtures.areas(spark, sf_dir)).select("aoi_id", "site_id", "x", "y")
    near = spatial.nearest_other(inside, "aoi_id", "site_id")
    cv = F.try_divide(F.stddev_pop("near"), F.avg("near"))
    return near.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("near"), 6).alias("mean_gap"), F.round(cv, 6).alias("cv"))


FIELD_HOURS, CONTROL_SHARE = 16.0, 0.15


@query(""", c AS (SELECT n_regionkey AS g, s_suppkey AS id, round(greatest(1.0, round_even((100 + (s_suppkey * 37) % 3000)::DOUBLE / 225.0, 0)) * 20.0 / 60.0 + 0.5, 6)::DOUBLE AS hours,
round(greatest((90 + (s_suppkey * 13) % 100 / 10.0)::DOUBLE - 95.0, 0.1) * (1.0 - (s_suppkey % 4) / 4.0::DOUBLE * 0.75), 6)::DOUBLE AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey),
q AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY -(value / hours), id) AS rn FROM c),
f AS (SELECT g, id, rn, CASE WHEN hours <= 13.6::DOUBLE THEN hours ELSE 0 END AS spent, hours <= 13.6::DOUBLE AS taken FROM q WHERE rn = 1
 UNION ALL SELECT q.g, q.id, q.rn, CASE WHEN f.spent + q.hours <= 13.6::DOUBLE THEN f.spent + q.hours ELSE f.spent END, f.spent + q.hours <= 13.6::DOUBLE FROM f JOIN q ON q.g = f.g AND q.rn = f.rn + 1)
SELECT g AS region, c.id, hours, value, CASE WHEN taken THEN (row_number() OVER (PARTITION BY g, taken ORDER BY rn))::INT END AS stop, 2.4::DOUBLE AS control_hours FROM f JOIN c USING (g, id)""")
def survey_plan(spark, sf_dir):
    """Stops that fit into the hours of a region, by expected value an hour; what does not fit is skipped (no stop), not the end.

    Of 16 hours 15 percent go to control cells of low score, which alone can prove the ranking wrong.
    """
    supplier, nation = fixtures.table(spark, sf_dir, "supplier"), fixtures.table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    sites = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("region"), k.alias("id"), F.round(curves.effort_hours((100.0 + (k * 37) % 3000), F.lit(False)), 6).alias("hours"),
        F.round(curves.expected_value(90.0 + ((k * 13) % 100) / 10.0, (k % 4) / 4.0), 6).alias("value"),
    )
    control = round(FIELD_HOURS * CONTROL_SHARE, 1)
    return ranking.budget_fill(sites, "region", FIELD_HOURS - control).select("region", "id", "hours", "value", "stop", F.lit(control).alias("control_hours"))


@query("SELECT n_nationkey AS sheet_id, round((24000 + 1000 * (n_nationkey % 5))::DOUBLE * (0.0254::DOUBLE / 50) + 20.0, 1) AS sheet_m, greatest(round((24000 + 1000 * (n_nationkey % 5))::DOUBLE * (0.0254::DOUBLE / 50) + 20.0, 1), (35 + n_nationkey)::DOUBLE) AS point_m FROM nation")
def nmas_confidence(spark, sf_dir):
    k = F.col("n_nationkey")
    sheet = curves.map_error_m(24000 + 1000 * (k % 5), 20.0)
    return fixtures.table(spark, sf_dir, "nation").select(k.alias("sheet_id"), sheet.alias("sheet_m"), F.greatest(sheet, (35 + k).cast("double")).alias("point_m"))


DISC_M, RING_M = 40.0, 100.0
FIRE = f""", w AS (SELECT h.id, h.x AS sx, h.y AS sy, row_i, col_i, elev_m, sqrt((easting - h.x) ** 2 + (northing - h.y) ** 2) AS d FROM h JOIN fx_cell ON easting BETWEEN h.x - {RING_M} AND h.x + {RING_M} AND northing BETWEEN h.y - {RING_M} AND h.y + {RING_M}),
t AS (SELECT id, count(*) FILTER (d > {DISC_M} AND d <= {RING_M}) AS n_ring, count(*) FILTER (d <= {DISC_M}) AS n_disc, quantile_cont(elev_m, 0.9) FILTER (d > {DISC_M} AND d <= {RING_M}) AS hi, quantile_cont(elev_m, 0.1) FILTER (d > {DISC_M} AND d <= {RING_M}) AS lo FROM w GROUP BY id),
u AS (SELECT id, tail, row_i::BIGINT * 4294967296 + col_i AS key FROM w JOIN t USING (id), (VALUES (0), (1)) v(tail) WHERE d <= {DISC_M} AND CASE WHEN tail = 0 THEN elev_m >= hi ELSE elev_m <= lo END),
fl(id, tail, seed, key) AS (SELECT id, tail, key, key FROM u UNION SELECT u.id, u.tail, fl.seed, u.key FROM fl JOIN u ON u.id = fl.id AND u.tail = fl.tail AND u.key IN (fl.key + 1, fl.key - 1, fl.key + 4294967296, fl.key - 4294967296) AND u.key > fl.seed),
cl AS (SELECT id, tail, seed, count(*) AS cells FROM (SELECT id, tail, key, min(seed) AS seed FROM fl GROUP BY id, tail, key) GROUP BY id, tail, seed HAVING count(*) >= 4),
mo AS (SELECT id, max(cells) FILTER (tail = 0) AS high, max(cells) FILTER (tail = 1) AS low FROM cl GROUP BY id),
fi AS (SELECT h.id, coalesce(n_ring, 0) AS n_ring, coalesce(n_disc, 0) AS n_disc, coalesce(n_ring, 0) >= 100 AND coalesce(n_disc, 0) >= 4 AS evaluable, high, low FROM h LEFT JOIN t USING (id) LEFT JOIN mo USING (id))"""


def _surface(spark, sf_dir) -> DataFrame:
    return fixtures.cells(spark, sf_dir).select(F.col("easting").alias("x"), F.col("northing").alias("y"), F.col("elev_m").alias("z"))


@query(""", h AS (SELECT site_id AS id, x, y FROM fx_site WHERE review_status = 'confirmed')""" + FIRE + """ SELECT id AS site_id, n_ring, n_disc, evaluable, CASE WHEN evaluable THEN high IS NOT NULL END AS fired_high, CASE WHEN evaluable THEN low IS NOT NULL END AS fired_low,
CASE WHEN evaluable THEN coalesce(high, 0) END AS cluster_high, CASE WHEN evaluable THEN coalesce(low, 0) END AS cluster_low FROM fi""")
def firing_rule_at_sites(spark, sf_dir):
    """Whether a cluster of at least 4 cells of a site's disc lies beyond the upper or lower tenth of its ring; a ring of fewer than
    100 cells is a gap."""
    sites = fixtures.sites(spark, sf_dir).filter("review_status = 'confirmed'").select(F.col("site_id").alias("id"), "x", "y")
    return detection.fire(sites, _surface(spark, sf_dir), 10.0, DISC_M, RING_M).withColumnRenamed("id", "site_id")


TRIES, CLEAR_M, MARGIN_M = 400, 150.0, 100.0
NULLS = f""", f AS (SELECT min(easting) + {MARGIN_M} AS x0, max(easting) - min(easting) - {2 * MARGIN_M} AS w, min(northing) + {MARGIN_M} AS y0, max(northing) - min(northing) - {2 * MARGIN_M} AS hh FROM fx_cell),
tr AS (SELECT range AS id, round(x0 + w * ((range * 7548776662 % 10000000000) / 10000000000.0::DOUBLE), 3) AS x, round(y0 + hh * ((range * 5698402909 % 10000000000) / 10000000000.0::DOUBLE), 3) AS y FROM range(0, {TRIES}), f),
fa AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM tr WHERE NOT EXISTS (SELECT 1 FROM fx_site s WHERE review_status = 'confirmed' AND class_id = 'BUILDING' AND (s.x - tr.x) ** 2 + (s.y - tr.y) ** 2 < {CLEAR_M * CLEAR_M})),
gr(n, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] UNION ALL SELECT fa.n, CASE WHEN len(list_filter(kept, lambda k: (k.x - fa.x) ** 2 + (k.y - fa.y) ** 2 < {4 * DISC_M * DISC_M})) = 0 THEN list_append(kept, {{'id': fa.id, 'x': fa.x, 'y': fa.y}}) ELSE kept END FROM gr JOIN fa ON fa.n = gr.n + 1),
h AS (SELECT unnest(kept, recursive := true) FROM gr WHERE n = (SELECT max(n) FROM gr))"""


def null_discs(spark, sf_dir) -> DataFrame:
    """Discs by a formula of their number all over the frame, away from the sites and from each other."""
    cells = fixtures.cells(spark, sf_dir)
    frame = cells.agg(F.min("easting").alias("xa"), F.max("easting").alias("xb"), F.min("northing").alias("ya"), F.max("northing").alias("yb"))
    place = lambda a, b, step: F.round(F.col(a) + MARGIN_M + (F.col(b) - F.col(a) - 2 * MARGIN_M) * ((F.col("id") * step % 10000000000) / 1e10), 3)
    tries = spark.range(TRIES).crossJoin(F.broadcast(frame)).select("id", place("xa", "xb", 7548776662).alias("x"), place("ya", "yb", 5698402909).alias("y"))
    sites = fixtures.sites(spark, sf_dir).filter("review_status = 'confirmed' and class_id = 'BUILDING'")
    return detection.null_places(tries, sites, CLEAR_M, 2 * DISC_M)


@query(NULLS + " SELECT id, x, y FROM h")
def null_draws(spark, sf_dir):
    return null_discs(spark, sf_dir).select("id", "x", "y")


SITES_H = ", h AS (SELECT site_id AS id, x, y FROM fx_site WHERE review_status = 'confirmed' AND class_id = 'BUILDING')"


@query()
def recall_vs_background(spark, sf_dir):
    """Recall over evaluable sites of a class beside the rate at which null discs fire, (fired + 1) / (draws + 1): a rule that fires
    everywhere has both near 1. Gaps count as neither."""
    sites = fixtures.sites(spark, sf_dir).filter("review_status = 'confirmed' and class_id = 'BUILDING'").select(F.col("site_id").alias("id"), "x", "y")
    surface = _surface(spark, sf_dir)
    count = lambda c: F.count(F.when(c, 1))
    at_sites = detection.fire(sites, surface, 10.0, DISC_M, RING_M).agg(count(F.col("evaluable")).alias("evaluable"), count(~F.col("evaluable")).alias("gaps"), count(F.col("fired_high")).alias("hits"))
    at_null = detection.fire(null_discs(spark, sf_dir), surface, 10.0, DISC_M, RING_M).agg(count(F.col("evaluable")).alias("draws"), count(F.col("fired_high")).alias("fired"))
    return at_sites.crossJoin(F.broadcast(at_null)).select(
        "evaluable", "gaps", "hits", F.round(F.try_divide("hits", "evaluable"), 6).alias("recall"), "draws", "fired", F.round((F.col("fired") + 1.0) / (F.col("draws") + 1.0), 6).alias("null_rate")
    )


_AT_SITES = f"(WITH RECURSIVE {fixtures.SQL}{SITES_H}{FIRE} SELECT count(*) FILTER (evaluable) AS evaluable, count(*) FILTER (NOT evaluable) AS gaps, count(*) FILTER (evaluable AND high IS NOT NULL) AS hits FROM fi)"
_AT_NULL = f"(WITH RECURSIVE {fixtures.SQL}{NULLS}{FIRE} SELECT count(*) FILTER (evaluable) AS draws, count(*) FILTER (evaluable AND high IS NOT NULL) AS fired FROM fi)"
ORACLE_SQL["recall_vs_background"] = f"SELECT evaluable, gaps, hits, round(hits / nullif(evaluable, 0)::DOUBLE, 6) AS recall, draws, fired, round((fired + 1.0::DOUBLE) / (draws + 1.0::DOUBLE), 6) AS null_rate FROM {_AT_SITES}, {_AT_NULL}"
