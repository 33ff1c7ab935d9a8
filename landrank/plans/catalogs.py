"""Catalog tables and the small questions asked of them: merges, filters, orders, digests, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import params
from ..operators import ranking
from ..sources import catalogs, fixtures
from ..sources.fixtures import table
from . import query
from .scoring import BOX, CONTROL, SCORED, in_areas, scored

ASSETS = "SELECT user_id AS aoi_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'model' ELSE 'detection' END AS grid, CAST(event_id % 3 AS VARCHAR) AS variant, max(event_id) AS asset_id FROM events WHERE {} GROUP BY 1, 2, 3, 4"
KEY = ["aoi_id", "kind", "grid", "variant"]


def assets(spark, sf_dir, only: str = "true"):
    e = table(spark, sf_dir, "events").filter(only)
    named = e.select(F.col("user_id").alias("aoi_id"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, "model").otherwise("detection").alias("grid"), (F.col("event_id") % 3).cast("string").alias("variant"), "event_id")
    return named.groupBy(*KEY).agg(F.max("event_id").alias("asset_id"))


@query(f", o AS ({ASSETS.format('event_id % 7 < 4')}), n AS ({ASSETS.format('event_id % 7 >= 3')}) SELECT aoi_id, kind, grid, variant, coalesce(n.asset_id, o.asset_id) AS asset_id FROM o FULL JOIN n USING (aoi_id, kind, grid, variant)")
def asset_upsert(spark, sf_dir):
    """A raster catalog on its four-column key: assets registered again take the new path."""
    return catalogs.merge(assets(spark, sf_dir, "event_id % 7 < 4"), assets(spark, sf_dir, "event_id % 7 >= 3"), KEY)


@query(""", o AS (SELECT p_partkey AS sheet_id, p_name AS title, p_brand AS series, p_size AS year, p_retailprice AS error_m FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey AS sheet_id, 'new ' || p_name AS title, p_type AS series, p_size + 100 AS year, p_retailprice / 2 AS error_m FROM part WHERE p_partkey % 2 = 0)
SELECT sheet_id, CASE WHEN o.sheet_id IS NOT NULL THEN o.title ELSE n.title END AS title, CASE WHEN o.sheet_id IS NOT NULL THEN o.series ELSE n.series END AS series, coalesce(n.year, o.year) AS year, coalesce(n.error_m, o.error_m) AS error_m FROM o FULL JOIN n USING (sheet_id)""")
def sheet_partial_upsert(spark, sf_dir):
    """Sheets known already take the year and error of a new load, and keep their title and series."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("sheet_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("series"), F.col("p_size").alias("year"), F.col("p_retailprice").alias("error_m"))
    new = part.filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("sheet_id"), F.concat(F.lit("new "), "p_name").alias("title"), F.col("p_type").alias("series"), (F.col("p_size") + 100).alias("year"), (F.col("p_retailprice") / 2).alias("error_m")
    )
    return catalogs.merge(old, new, ["sheet_id"], ["year", "error_m"])


@query(""", n AS (SELECT aoi_id, class_id, site_id + 1000000 AS zone FROM fx_site JOIN fx_aoi ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax WHERE review_status = 'confirmed' AND aoi_id % 3 = 0),
o AS (SELECT aoi_id, class_id, site_id AS zone FROM fx_site JOIN fx_aoi ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax WHERE review_status <> 'confirmed')
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.aoi_id = o.aoi_id AND n.class_id = o.class_id) UNION ALL SELECT * FROM n""")
def zones_partition_replace(spark, sf_dir):
    """A new run's zones take the place of all zones of their area and class."""
    from ..operators import spatial

    inside = spatial.points_in_boxes(fixtures.sites(spark, sf_dir), fixtures.areas(spark, sf_dir)).select("aoi_id", "class_id", "site_id", "review_status")
    old = inside.filter("review_status <> 'confirmed'").select("aoi_id", "class_id", F.col("site_id").alias("zone"))
    new = inside.filter("review_status = 'confirmed' and aoi_id % 3 = 0").select("aoi_id", "class_id", (F.col("site_id") + 1000000).alias("zone"))
    return catalogs.replace_partitions(old, new, ["aoi_id", "class_id"])


@query("SELECT row_i // 50 AS stack, count(*) AS cells, min(easting) - 5.0 AS xmin, min(northing) - 5.0 AS ymin, max(easting) + 5.0 AS xmax, max(northing) + 5.0 AS ymax FROM fx_cell GROUP BY 1")
def stack_footprint(spark, sf_dir):
    """Footprint of each feature stack: the extent of its cells and half a cell around it."""
    cells = fixtures.cells(spark, sf_dir).select(F.expr("row_i div 50").cast("int").alias("stack"), "easting", "northing")
    return catalogs.footprint(cells, ["stack"], 10.0)


@query(SCORED + f""", n AS (SELECT aoi_id, round(avg(score), 6) AS mean FROM pct JOIN fx_aoi ON {BOX} GROUP BY aoi_id),
o AS (SELECT aoi_id, v AS variant, 0.0::DOUBLE AS mean FROM fx_aoi, (VALUES ('civic'), ('plain')) t(v) WHERE aoi_id % 2 = 0)
SELECT coalesce(o.aoi_id, n.aoi_id) AS aoi_id, 'score' AS kind, coalesce(variant, 'civic') AS variant, CASE WHEN n.aoi_id IS NULL THEN o.mean ELSE n.mean END AS mean FROM o FULL JOIN n ON o.aoi_id = n.aoi_id AND o.variant = 'civic'""")
def publish_score_variant(spark, sf_dir):
    """A score published under its class as variant: other variants of the area stay as they are."""
    key = ["aoi_id", "kind", "variant"]
    old = fixtures.areas(spark, sf_dir).filter("aoi_id % 2 = 0").select("aoi_id", F.lit("score").alias("kind"), F.explode(F.array(F.lit("civic"), F.lit("plain"))).alias("variant"), F.lit(0.0).alias("mean"))
    new = in_areas(scored(spark, sf_dir), spark, sf_dir).groupBy("aoi_id").agg(F.round(F.avg("score"), 6).alias("mean")).select("aoi_id", F.lit("score").alias("kind"), F.lit("civic").alias("variant"), "mean")
    return catalogs.merge(old, new, key)


@query("SELECT aoi_id, slug FROM fx_aoi WHERE role = 'prospect'")
def areas_by_role(spark, sf_dir):
    return ranking.where_equal(fixtures.areas(spark, sf_dir), role="prospect", slug=None).select("aoi_id", "slug")


@query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'p%'")
def operations_like(spark, sf_dir):
    """Operations of a family by the start of their name; the prefix reaches the scan."""
    return table(spark, sf_dir, "events").filter(F.col("event_type").startswith("p")).select("event_id", "event_type")


@query("SELECT p_partkey, p_type FROM part WHERE (upper(p_type) LIKE 'ECO%' OR upper(p_type) LIKE '%MALL' OR upper(p_name) LIKE '%RING%') AND p_size IN (" + ", ".join(map(str, range(3, 36))) + ")")
def name_filter_list(spark, sf_dir):
    """Any of some name patterns, within a list of counties."""
    patterns = (("p_type", "ECO%"), ("p_type", "%MALL"), ("p_name", "%RING%"))
    named = F.lit(False)
    for column, pattern in patterns:
        named = named | F.upper(column).like(pattern)
    return table(spark, sf_dir, "part").filter(named & F.col("p_size").isin(*range(3, 36))).select("p_partkey", "p_type")


@query("SELECT f_table_name, f_geometry_column, srid FROM (SELECT n_name AS f_table_name, CASE WHEN n_nationkey % 2 = 0 THEN 'geom' ELSE 'geom_wgs84' END AS f_geometry_column, CASE WHEN n_nationkey % 3 = 0 THEN 26916 ELSE 4326 END AS srid FROM nation) WHERE srid <> 26916 AND NOT ends_with(f_geometry_column, '_wgs84')")
def crs_violations(spark, sf_dir):
    """Geometry columns outside the project's reference system, but for those whose name says so."""
    k = F.col("n_nationkey")
    columns = table(spark, sf_dir, "nation").select(F.col("n_name").alias("f_table_name"), F.when(k % 2 == 0, "geom").otherwise("geom_wgs84").alias("f_geometry_column"), F.when(k % 3 == 0, 26916).otherwise(4326).alias("srid"))
    return columns.filter((F.col("srid") != 26916) & ~F.col("f_geometry_column").endswith("_wgs84"))


@query(f", a AS ({ASSETS.format('event_id % 5 = 0')}) SELECT aoi_id, kind, count(DISTINCT variant) AS variants, max(variant) AS last FROM a GROUP BY aoi_id, kind HAVING count(DISTINCT variant) > 1")
def ambiguous_variants(spark, sf_dir):
    """Kinds of an area that can't be asked for without naming a variant."""
    a = assets(spark, sf_dir, "event_id % 5 = 0")
    return a.groupBy("aoi_id", "kind").agg(F.countDistinct("variant").alias("variants"), F.max("variant").alias("last")).filter("variants > 1")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey AND l_returnflag = 'N' AND p_size > 10")
def indicator_join(spark, sf_dir):
    """Components joined to their groups, the indicator being part of the join: rows without it have no partner."""
    both = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").join(table(spark, sf_dir, "part"), (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_returnflag") == "N") & (F.col("p_size") > 10))
    return both.select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 5")
def last_runs(spark, sf_dir):
    """The five newest runs."""
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(5).select("event_id", "event_type")


@query("SELECT aoi_id, role, (row_number() OVER (PARTITION BY role ORDER BY (xmax - xmin) * (ymax - ymin) * (1 + aoi_id % 3) DESC, aoi_id))::INT AS place FROM fx_aoi")
def areas_ranked_by_size(spark, sf_dir):
    from pyspark.sql import Window

    size = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) * (1 + F.col("aoi_id") % 3)
    return fixtures.areas(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy(size.desc(), "aoi_id"))).select("aoi_id", "role", "place")


@query("SELECT site_id, (row_number() OVER (ORDER BY positional_confidence_m DESC, site_id)) AS place FROM fx_site")
def sites_by_confidence(spark, sf_dir):
    """A whole table in order, largest first, with its places."""
    return ranking.numbered(fixtures.sites(spark, sf_dir).select("site_id", "positional_confidence_m"), [F.desc("positional_confidence_m"), F.asc("site_id")], "place").select("site_id", "place")


@query(f", a AS ({ASSETS.format('TRUE')}) SELECT aoi_id, kind, grid, variant, (row_number() OVER (ORDER BY kind, grid, variant, aoi_id)) AS place FROM a")
def catalog_order(spark, sf_dir):
    """The raster catalog in its listing order, by several keys."""
    return ranking.numbered(assets(spark, sf_dir), [F.asc(c) for c in ("kind", "grid", "variant", "aoi_id")], "place").select(*KEY, "place")


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_size, p_type, p_partkey)) AS place FROM part")
def registry_order(spark, sf_dir):
    """The registry of classes by period and class."""
    return ranking.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"), [F.asc("p_size"), F.asc("p_type"), F.asc("p_partkey")], "place").select("p_partkey", "place")


@query("SELECT p_partkey AS sheet_id, (row_number() OVER (ORDER BY 1900 + p_size % 7, 24000 * (1 + p_partkey % 3), p_partkey)) AS place FROM part")
def sheet_order(spark, sf_dir):
    """Map sheets by year, scale and id."""
    sheets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sheet_id"), (1900 + F.col("p_size") % 7).alias("year"), (24000 * (1 + F.col("p_partkey") % 3)).alias("scale"))
    return ranking.numbered(sheets, [F.asc("year"), F.asc("scale"), F.asc("sheet_id")], "place").select("sheet_id", "place")


@query(SCORED + """, p AS (SELECT cell_id, unnest(['hand', 'slope', 'drainage', 'twi']) AS feature, unnest([0.375::DOUBLE * coalesce(norm_hand, 0), 0.25::DOUBLE * coalesce(norm_slope, 0), 0.25::DOUBLE * coalesce(norm_drainage, 0), 0.125::DOUBLE * coalesce(norm_twi, 0)]) AS part FROM nrm)
SELECT cell_id, feature, (row_number() OVER (PARTITION BY cell_id ORDER BY round(part, 9) DESC, feature))::INT AS place FROM p""")
def contributions_ranked(spark, sf_dir):
    """What each feature adds to a cell's score, the most first; the order is made within the row, without a shuffle."""
    share = {"hand": 0.375, "slope": 0.25, "drainage": 0.25, "twi": 0.125}
    parts = F.array(*[F.struct((-F.round(F.lit(w) * F.coalesce(f"norm_{n}", F.lit(0.0)), 9)).alias("less"), F.lit(n).alias("feature")) for n, w in share.items()])
    return scored(spark, sf_dir).select("cell_id", F.posexplode(F.array_sort(parts)).alias("at", "p")).select("cell_id", "p.feature", (F.col("at") + 1).alias("place"))


#: Fixed value: how the publisher of the sheets titles them (scale, name, year).
TITLE = r"USGS 1:(\d+)-scale Quadrangle for (.+?),? (\d{4})$"
NAMED = """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'Index map ' || p_name ELSE 'USGS 1:' || (24000 + 1000 * (p_size % 3)) || '-scale Quadrangle for ' || p_name || ', TN ' || (1900 + p_size) END AS title,
'https://example.org/maps/TN_' || replace(p_name, ' ', '%20') || '_' || p_partkey || '_geo.tif' AS url FROM part"""


@query(f"""SELECT id, CAST(regexp_extract(title, '{TITLE}', 1) AS INT) AS scale, regexp_replace(regexp_extract(title, '{TITLE}', 2), ', TN$', '') AS cell, CAST(regexp_extract(title, '{TITLE}', 3) AS INT) AS year,
regexp_replace(regexp_replace(url_decode(regexp_extract(url, '([^/]+)$', 1)), '\\.[^.]*$', ''), '_geo$', '') AS sheet_id FROM ({NAMED}) WHERE regexp_matches(title, '{TITLE}')""")
def sheet_titles(spark, sf_dir):
    """Scale, quadrangle and year from a product's title, its id from the file name of its address; other products are dropped."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    title = F.when(k % 5 == 0, F.concat(F.lit("Index map "), name)).otherwise(F.concat(F.lit("USGS 1:"), (24000 + 1000 * (size % 3)).cast("string"), F.lit("-scale Quadrangle for "), name, F.lit(", TN "), (1900 + size).cast("string")))
    url = F.concat(F.lit("https://example.org/maps/TN_"), F.replace(name, F.lit(" "), F.lit("%20")), F.lit("_"), k.cast("string"), F.lit("_geo.tif"))
    items = table(spark, sf_dir, "part").select(k.alias("id"), title.alias("title"), url.alias("url")).filter(F.col("title").rlike(TITLE))
    stem = F.regexp_replace(F.url_decode(F.regexp_extract("url", r"([^/]+)$", 1)), r"\.[^.]*$", "")
    pick = lambda n: F.regexp_extract("title", TITLE, n)
    return items.select("id", pick(1).cast("int").alias("scale"), F.regexp_replace(pick(2), ", TN$", "").alias("cell"), pick(3).cast("int").alias("year"), F.regexp_replace(stem, "_geo$", "").alias("sheet_id"))


@query("SELECT p_partkey, sha256('wfs' || json_object('brand', p_brand, 'size', p_size)::VARCHAR) AS key, left(sha256(json_object('brand', p_brand, 'size', p_size)::VARCHAR), 10) AS variant FROM part")
def param_digest(spark, sf_dir):
    """Digest of a fetch and short digest of a parameter set, over JSON without blanks and with keys in order."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return part.select("p_partkey", F.sha2(F.concat(F.lit("wfs"), params.canonical(["size", "brand"])), 256).alias("key"), params.variant(["brand", "size"]).alias("variant"))


@query("SELECT p_partkey, greatest(400, least(p_size * 100, trunc(sqrt(8388608.0::DOUBLE / (1 + p_partkey % 40) / 1300000.0::DOUBLE) * 1500)::INT)) AS pixels FROM part")
def layer_pixels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", params.layer_pixels((1 + F.col("p_partkey") % 40), F.col("p_size") * 100, 8388608.0).alias("pixels"))


@query("SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(value, 1) AS value FROM events")
def run_days(spark, sf_dir):
    """Runs by day, values to one decimal."""
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").cast("string").alias("day"), F.round("value", 1).alias("value"))


@query("SELECT aoi_id, grid, xmin - b AS xmin, ymin - b AS ymin, xmax + b AS xmax, ymax + b AS ymax FROM fx_aoi, (VALUES ('model', 2000.0::DOUBLE), ('detection', 80.0::DOUBLE)) g(grid, b)")
def grid_bounds(spark, sf_dir):
    """Bounds that each grid of an area is computed over, with a search radius of 40 m in detection."""
    grids = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.lit(params.buffer_m(g, 40.0)).alias("b")) for g in ("model", "detection")]))
    a = fixtures.areas(spark, sf_dir).withColumn("g", grids)
    return a.select("aoi_id", "g.grid", *[(F.col(c) + s * F.col("g.b")).alias(c) for c, s in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))])


@query("SELECT aoi_id, round(km2, 6) AS km2, CAST(km2 * 4000000 AS BIGINT) AS cells, km2 <= 25 AS allowed FROM (SELECT aoi_id, (xmax - xmin + 2000 * (aoi_id % 4)) * (ymax - ymin + 2000 * (aoi_id % 4)) / 1000000.0 AS km2 FROM fx_aoi)")
def detection_guard(spark, sf_dir):
    """Size and cells of a detection grid, and whether it is small enough for one run."""
    grown = 2000.0 * (F.col("aoi_id") % 4)
    km2 = (F.col("xmax") - F.col("xmin") + grown) * (F.col("ymax") - F.col("ymin") + grown) / 1e6
    return fixtures.areas(spark, sf_dir).select("aoi_id", F.round(km2, 6).alias("km2"), (km2 / params.DETECTION_CELL_M**2 * 1e6).cast("decimal(20,0)").cast("long").alias("cells"), (km2 <= params.MOST_KM2).alias("allowed"))


@query("""SELECT class_id, count(*) FILTER (review_status = 'confirmed') AS confirmed, count(*) FILTER (review_status = 'rejected') AS rejected, round(max(positional_confidence_m), 1) AS worst_m,
array_to_string((list(site_id ORDER BY site_id DESC) FILTER (review_status = 'confirmed'))[1:5], ',') AS newest FROM fx_site GROUP BY class_id""")
def class_brief(spark, sf_dir):
    """What is known of each class: counts by state, the worst position, and the five newest confirmed sites."""
    sites = fixtures.sites(spark, sf_dir)
    facts = sites.groupBy("class_id").agg(F.count(F.when(F.col("review_status") == "confirmed", 1)).alias("confirmed"), F.count(F.when(F.col("review_status") == "rejected", 1)).alias("rejected"), F.round(F.max("positional_confidence_m"), 1).alias("worst_m"))
    new = ranking.first_of_each(sites.filter("review_status = 'confirmed'").select("class_id", "site_id"), ["class_id"], [F.desc("site_id")], 5)
    named = new.groupBy("class_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("site_id"), asc=False), lambda i: i.cast("string")), ",").alias("newest"))
    return facts.join(named, "class_id", "left")


@query(SCORED + f"SELECT aoi_id, round(quantile_cont(elev_m, 0.5), 6) AS elev_median, round(quantile_cont(hand_m, 0.9), 6) AS hand_p90, count(*) AS cells FROM pct JOIN fx_aoi ON {BOX} WHERE NOT ({CONTROL}) GROUP BY aoi_id")
def area_context(spark, sf_dir):
    """Median height and 90th percentile of height above drainage of each area."""
    from ..functions import stats

    inside = in_areas(fixtures.cells(spark, sf_dir), spark, sf_dir).filter(f"not ({CONTROL})")
    return inside.groupBy("aoi_id").agg(F.round(stats.quantile("elev_m", 0.5), 6).alias("elev_median"), F.round(stats.quantile("hand_m", 0.9), 6).alias("hand_p90"), F.count(F.lit(1)).alias("cells"))
