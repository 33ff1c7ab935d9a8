"""Sinks, grids and checks around the scores: clusters of sites, tiles, merges, hillshade, flow accumulation, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking, raster, spatial
from ..sources import fixtures
from ..sources.fixtures import table
from ..storage import durable
from . import query
from .scoring import BOX, CONTROL, SCORED, in_areas, scored
from .terrain import COLS, DOWN, surface

PAD = 12.0


@query(f""", p AS (SELECT site_id, x, y FROM fx_site WHERE review_status = 'confirmed'), e AS (SELECT a.site_id AS a, b.site_id AS b FROM p a JOIN p b ON a.site_id <> b.site_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {4 * PAD * PAD}),
w(seed, node) AS (SELECT site_id, site_id FROM p UNION SELECT w.seed, e.b FROM w JOIN e ON e.a = w.node AND e.b > w.seed), c AS (SELECT node AS site_id, min(seed) AS cluster FROM w GROUP BY node)
SELECT cluster, count(*) AS sites, min(x) - {PAD} AS xmin, max(x) + {PAD} AS xmax, min(y) - {PAD} AS ymin, max(y) + {PAD} AS ymax FROM c JOIN p USING (site_id) GROUP BY cluster""")
def site_clusters(spark, sf_dir):
    """Sites whose padded discs overlap are one cluster with one frame; near places, each once, meet through tiles."""
    sites = fixtures.sites(spark, sf_dir).filter("review_status = 'confirmed'").select("site_id", "x", "y")
    reach = 2 * PAD
    # Sites at one place are one node, of the smallest id.
    places = durable(sites.groupBy("x", "y").agg(F.min("site_id").alias("site_id"), F.count(F.lit(1)).alias("sites")))
    boxes = places.select(F.col("site_id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v"), (F.col("x") - reach).alias("xmin"), (F.col("x") + reach).alias("xmax"), (F.col("y") - reach).alias("ymin"), (F.col("y") + reach).alias("ymax"))
    pairs = spatial.points_in_boxes(places, boxes, 100.0).filter((F.col("site_id") < F.col("other")) & ((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2 <= reach * reach))
    label = raster.contract(pairs.select(F.col("site_id").alias("a"), F.col("other").alias("b")))
    placed = places.join(label, places.site_id == label.node, "left").withColumn("cluster", F.coalesce("least", "site_id"))
    return placed.groupBy("cluster").agg(F.sum("sites").alias("sites"), (F.min("x") - PAD).alias("xmin"), (F.max("x") + PAD).alias("xmax"), (F.min("y") - PAD).alias("ymin"), (F.max("y") + PAD).alias("ymax"))


@query("SELECT p_partkey AS sheet_id, r.t::INT AS tile_row, c.t::INT AS tile_col, (r.t * 1300)::INT AS top, (c.t * 1300)::INT AS left_, least(1400, p_size * 200 - r.t * 1300)::INT AS height, least(1400, p_size * 150 - c.t * 1300)::INT AS width FROM part, LATERAL (SELECT unnest(range(0, greatest(1, ceil((p_size * 200 - 100) / 1300.0)::BIGINT))) AS t) r, LATERAL (SELECT unnest(range(0, greatest(1, ceil((p_size * 150 - 100) / 1300.0)::BIGINT))) AS t) c")
def sheet_tiles(spark, sf_dir):
    """Tiles of 1400 pixels that overlap by 100, with their offset in the sheet."""
    tile, overlap = 1400, 100
    step = tile - overlap
    h, w = F.col("p_size") * 200, F.col("p_size") * 150
    count = lambda size: F.greatest(F.lit(1), F.ceil((size - overlap) / step).cast("int"))
    sheets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sheet_id"), h.alias("h"), w.alias("w"))
    rows = sheets.withColumn("tile_row", F.explode(F.sequence(F.lit(0), count(F.col("h")) - 1))).withColumn("tile_col", F.explode(F.sequence(F.lit(0), count(F.col("w")) - 1)))
    r, c = F.col("tile_row") * step, F.col("tile_col") * step
    return rows.select("sheet_id", "tile_row", "tile_col", r.alias("top"), c.alias("left_"), F.least(F.lit(tile), F.col("h") - r).alias("height"), F.least(F.lit(tile), F.col("w") - c).alias("width"))


@query("SELECT site_id, class_id, review_status FROM fx_site WHERE review_status <> 'unreviewed' UNION ALL SELECT site_id + 5000000, class_id, 'unreviewed' FROM fx_site s WHERE NOT EXISTS (SELECT 1 FROM fx_site k WHERE k.review_status <> 'unreviewed' AND k.site_id = s.site_id)")
def replace_unreviewed(spark, sf_dir):
    """A new load replaces unreviewed rows; reviewed ones stay and keep their names from coming in again."""
    sites = fixtures.sites(spark, sf_dir).select("site_id", "class_id", "review_status")
    reviewed = sites.filter("review_status <> 'unreviewed'")
    incoming = sites.join(reviewed.select("site_id"), "site_id", "left_anti")
    return reviewed.unionByName(incoming.select((F.col("site_id") + 5000000).alias("site_id"), "class_id", F.lit("unreviewed").alias("review_status")))


@query("SELECT p_partkey, least(p_size, 9) AS size, CASE WHEN p_partkey % 2 = 0 THEN 'override' ELSE p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS kind FROM part")
def registry_param_merge(spark, sf_dir):
    """Shallow merge of two parameter maps: the later one wins by key."""
    base = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.least("p_size", F.lit(9)).cast("string"))
    later = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("brand"), F.lit("override"), F.lit("kind"), F.col("p_type"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = table(spark, sf_dir, "part").withColumn("m", F.map_zip_with(base, later, lambda k, a, b: F.coalesce(b, a)))
    return merged.select("p_partkey", F.col("m")["size"].cast("int").alias("size"), F.col("m")["brand"].alias("brand"), F.col("m")["kind"].alias("kind"))


@query(SCORED + ", g AS (SELECT r.range AS row_i, c.range AS col_i FROM range(0, (SELECT max(row_i) + 2 FROM fx_cell)) r, range(0, 100) c) SELECT g.row_i::INT AS row_i, g.col_i::INT AS col_i, score FROM g LEFT JOIN scr ON scr.row_i = g.row_i AND scr.col_i = g.col_i")
def score_raster(spark, sf_dir):
    """The score on the full grid, one row of it beyond the data: cells without a score are null."""
    rows = surface(spark, sf_dir)[1] + 1
    grid = spark.range(rows * COLS).select(F.expr(f"cast(id div {COLS} as int)").alias("row_i"), (F.col("id") % COLS).cast("int").alias("col_i"))
    return grid.join(scored(spark, sf_dir).select("row_i", "col_i", "score"), ["row_i", "col_i"], "left")


@query(""", n AS (SELECT a.row_i, a.col_i, max(z.elev_m) FILTER (z.col_i = a.col_i + 1) - max(z.elev_m) FILTER (z.col_i = a.col_i - 1) AS dx, max(z.elev_m) FILTER (z.row_i = a.row_i + 1) - max(z.elev_m) FILTER (z.row_i = a.row_i - 1) AS dy
FROM fx_cell a JOIN fx_cell z ON abs(z.row_i - a.row_i) + abs(z.col_i - a.col_i) = 1 GROUP BY a.row_i, a.col_i), s AS (SELECT row_i, col_i, dx / 20.0::DOUBLE AS p, dy / 20.0::DOUBLE AS q FROM n WHERE dx IS NOT NULL AND dy IS NOT NULL)
SELECT row_i, col_i, round((greatest(0.0::DOUBLE, (1 - p) / sqrt(2.0::DOUBLE * (1 + p * p + q * q))) + greatest(0.0::DOUBLE, (1 + p) / sqrt(2.0::DOUBLE * (1 + p * p + q * q))) + greatest(0.0::DOUBLE, (1 - q) / sqrt(2.0::DOUBLE * (1 + p * p + q * q))) + greatest(0.0::DOUBLE, (1 + q) / sqrt(2.0::DOUBLE * (1 + p * p + q * q)))) / 4.0::DOUBLE, 6) AS shade FROM s""")
def hillshade(spark, sf_dir):
    """Mean shade under suns in four directions at 45 degrees, from central differences; the border has none."""
    cells, _ = surface(spark, sf_dir)
    way = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, r, c in (("e", 0, -1), ("w", 0, 1), ("s", -1, 0), ("n", 1, 0))]))
    # A cell tells its neighbours its height: its value is the east one of the cell to its west.
    told = cells.select("row_i", "col_i", "elev_m", way.alias("o")).select((F.col("row_i") + F.col("o.r")).alias("row_i"), (F.col("col_i") + F.col("o.c")).alias("col_i"), F.col("o.k").alias("k"), "elev_m")
    side = {k: F.max(F.when(F.col("k") == k, F.col("elev_m"))) for k in "ewsn"}
    slope = told.groupBy("row_i", "col_i").agg(((side["e"] - side["w"]) / 20.0).alias("p"), ((side["s"] - side["n"]) / 20.0).alias("q")).filter("p is not null and q is not null").join(cells.select("row_i", "col_i"), ["row_i", "col_i"], "left_semi")
    p, q = F.col("p"), F.col("q")
    norm = F.sqrt(2.0 * (1 + p * p + q * q))
    suns = [F.greatest(F.lit(0.0), x / norm) for x in (1 - p, 1 + p, 1 - q, 1 + q)]
    return slope.select("row_i", "col_i", F.round((suns[0] + suns[1] + suns[2] + suns[3]) / 4.0, 6).alias("shade"))


@query("SELECT row_i, col_i, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (elev_m - lo) / (hi - lo))), 6) AS stretched FROM fx_cell, (SELECT quantile_cont(elev_m, 0.02) AS lo, quantile_cont(elev_m, 0.98) AS hi FROM fx_cell)")
def percentile_stretch(spark, sf_dir):
    cells, _ = surface(spark, sf_dir)
    cut = ranking.quantiles(cells, "elev_m", {"lo": 0.02, "hi": 0.98})
    x = (F.col("elev_m") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return cells.crossJoin(F.broadcast(cut)).select("row_i", "col_i", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6).alias("stretched"))


@query(DOWN + " SELECT row_i, col_i, cells FROM acc")
def flow_accumulation(spark, sf_dir):
    """Cells that drain through each cell."""
    cells, rows = surface(spark, sf_dir)
    return raster.flow_accumulation(cells, "elev_m", rows, COLS)


@query(SCORED + f"SELECT aoi_id, round(max(score_pct), 4) AS best, max(score_pct) >= 95.0::DOUBLE AS passes FROM pct JOIN fx_aoi ON {BOX} WHERE {CONTROL} GROUP BY aoi_id")
def control_gate(spark, sf_dir):
    """Whether each control area reaches the 95th percentile."""
    return in_areas(scored(spark, sf_dir), spark, sf_dir).filter(CONTROL).groupBy("aoi_id").agg(F.round(F.max("score_pct"), 4).alias("best"), (F.max("score_pct") >= 95.0).alias("passes"))


@query(SCORED + """SELECT 'contributions sum to score' AS check_, (count(*) FILTER (abs(score - (0.375::DOUBLE * norm_hand + 0.25::DOUBLE * norm_slope + 0.25::DOUBLE * coalesce(norm_drainage, 0) + 0.125::DOUBLE * norm_twi)) > 0.01)) AS failures FROM scr
UNION ALL SELECT 'score in range', count(*) FILTER (score < 0 OR score > 1) FROM scr UNION ALL SELECT 'percentile in range', count(*) FILTER (score_pct <= 0 OR score_pct > 100) FROM pct""")
def mechanical_checks(spark, sf_dir):
    """Invariants of a scored table as rows: name and number of failures, in one pass."""
    s = scored(spark, sf_dir)
    parts = sum((F.lit(w) * F.coalesce(F.col(f"norm_{n}"), F.lit(0.0)) for n, w in (("hand", 0.375), ("slope", 0.25), ("drainage", 0.25), ("twi", 0.125))), F.lit(0.0))
    count = lambda c: F.count(F.when(c, 1))
    found = s.agg(count(F.abs(F.col("score") - parts) > 0.01).alias("a"), count(~F.col("score").between(0, 1)).alias("b"), count((F.col("score_pct") <= 0) | (F.col("score_pct") > 100)).alias("c"))
    named = (("contributions sum to score", "a"), ("score in range", "b"), ("percentile in range", "c"))
    return found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_"), F.col(c).alias("failures")) for k, c in named])).alias("r")).select("r.*")


def sweep(spark, sf_dir, radii: tuple[int, ...]) -> DataFrame:
    cells, rows = surface(spark, sf_dir)
    out = None
    for r in radii:
        one = raster.local_relief(cells, "elev_m", rows, COLS, r).agg(F.round(F.stddev_pop("relief"), 4).alias("sd"), F.round(F.max("relief"), 4).alias("highest")).select(F.lit(f"radius={r}").alias("variant"), "sd", "highest")
        out = one if out is None else out.unionByName(one)
    return out


def _sweep_sql(radius: int) -> str:
    sigma = radius / 2
    return f"""(SELECT 'radius={radius}' AS variant, round(stddev_pop(relief), 4) AS sd, round(max(relief), 4) AS highest FROM (SELECT b.row_i, b.col_i, round(any_value(b.elev_m) - sum(z.elev_m * w) / sum(w), 6) AS relief FROM (SELECT *,
CASE WHEN r < 0 THEN -r - 1 WHEN r > last THEN 2 * last + 1 - r ELSE r END AS rr, CASE WHEN c < 0 THEN -c - 1 WHEN c > 99 THEN 199 - c ELSE c END AS cc FROM (SELECT row_i, col_i, elev_m, exp(-(x.range * x.range + y.range * y.range) / {2 * sigma * sigma}::DOUBLE) AS w,
row_i + x.range AS r, col_i + y.range AS c, (SELECT max(row_i) FROM fx_cell) AS last FROM fx_cell, range({-radius}, {radius + 1}) x, range({-radius}, {radius + 1}) y)) b JOIN fx_cell z ON z.row_i = rr AND z.col_i = cc GROUP BY b.row_i, b.col_i))"""


@query(" UNION ALL ".join(f"SELECT * FROM {_sweep_sql(r)}" for r in (1, 2, 4)))
def relief_sweep(spark, sf_dir):
    """One variant of the local relief a radius; each is the checked local_relief with another parameter."""
    return sweep(spark, sf_dir, (1, 2, 4))
