"""Response curves, overlay scores, ranks and the statistics that test them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import curves, stats
from ..operators import ranking, spatial
from ..sources import fixtures
from ..storage import durable
from . import query

DRAINAGE = {"well_drained": 1.0, "moderately_well_drained": 0.7, "somewhat_poorly_drained": 0.3}
FLOOD = {"none": 0.0, "occasional": 0.5, "frequent": 1.0}
WEIGHTS = {
    "hand": {"column": "hand_m", "weight": 3.0, "method": "inverse_linear", "params": {"optimum": 2.0, "falloff": 30.0}},
    "slope": {"column": "slope_deg", "weight": 2.0, "method": "threshold_decay", "params": {"full_below": 4.0, "zero_above": 18.0}},
    "drainage": {"column": "drainage_class", "weight": 2.0, "method": "categorical", "params": {"scores": DRAINAGE}},
    "twi": {"column": "twi", "weight": 1.0, "method": "band", "params": {"low": 5.0, "high": 8.0, "falloff": 2.0}},
}
NAMES = tuple(WEIGHTS)
N_HAND = "greatest(0.0, least(1.0, (30.0::DOUBLE - hand_m) / 28.0::DOUBLE))"
N_SLOPE = "greatest(0.0, least(1.0, (18.0::DOUBLE - slope_deg) / 14.0::DOUBLE))"
N_DRAIN = "CASE WHEN drainage_class IS NULL THEN NULL WHEN drainage_class = 'Well drained' THEN 1.0::DOUBLE WHEN drainage_class = 'Moderately well drained' THEN 0.7::DOUBLE WHEN drainage_class = 'Somewhat poorly drained' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"
N_TWI = "greatest(0.0::DOUBLE, 1.0::DOUBLE - greatest(5.0::DOUBLE - twi, twi - 8.0::DOUBLE, 0.0::DOUBLE) / 2.0::DOUBLE)"
SCORED = f""",
nrm AS (SELECT *, ({N_HAND})::DOUBLE AS norm_hand, ({N_SLOPE})::DOUBLE AS norm_slope, {N_DRAIN} AS norm_drainage, {N_TWI} AS norm_twi FROM fx_cell),
scr AS (SELECT *, round(0.0::DOUBLE + 0.375::DOUBLE * coalesce(norm_hand, 0) + 0.25::DOUBLE * coalesce(norm_slope, 0) + 0.25::DOUBLE * coalesce(norm_drainage, 0) + 0.125::DOUBLE * coalesce(norm_twi, 0), 9) AS score FROM nrm),
pct AS (SELECT *, (rank() OVER (ORDER BY score::FLOAT) + (count(*) OVER (PARTITION BY score::FLOAT) - 1) / 2.0::DOUBLE) * 100.0::DOUBLE / count(*) OVER () AS score_pct FROM scr)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.weighted_overlay(fixtures.cells(spark, sf_dir), WEIGHTS)


@query(SCORED + "SELECT cell_id, row_i, col_i, norm_hand, norm_slope, norm_drainage, norm_twi, score, round(score_pct, 6) AS score_pct FROM pct")
def score_overlay(spark, sf_dir):
    return scored(spark, sf_dir).select("cell_id", "row_i", "col_i", *[f"norm_{n}" for n in NAMES], "score", F.round("score_pct", 6).alias("score_pct"))


@query(SCORED + "SELECT round(avg(norm_hand) * 0.375, 9) AS hand, round(avg(norm_slope) * 0.25, 9) AS slope, round(avg(norm_drainage) * 0.25, 9) AS drainage, round(avg(norm_twi) * 0.125, 9) AS twi, count(*) AS n FROM nrm")
def score_contributions(spark, sf_dir):
    total = sum(w["weight"] for w in WEIGHTS.values())
    return scored(spark, sf_dir).agg(*[F.round(F.avg(f"norm_{n}") * F.lit(WEIGHTS[n]["weight"] / total), 9).alias(n) for n in NAMES], F.count(F.lit(1)).alias("n"))


@query(f"SELECT cell_id, {N_DRAIN} AS norm FROM fx_cell")
def norm_categorical(spark, sf_dir):
    return fixtures.cells(spark, sf_dir).select("cell_id", curves.categorical(F.col("drainage_class"), DRAINAGE).alias("norm"))


@query(f"SELECT cell_id, round({N_HAND}, 9)::DOUBLE AS norm FROM fx_cell")
def norm_inverse_linear(spark, sf_dir):
    return fixtures.cells(spark, sf_dir).select("cell_id", F.round(curves.inverse_linear(F.col("hand_m"), 2.0, 30.0), 9).alias("norm"))


@query(f"SELECT cell_id, round({N_SLOPE}, 9)::DOUBLE AS norm FROM fx_cell")
def norm_threshold_decay(spark, sf_dir):
    return fixtures.cells(spark, sf_dir).select("cell_id", F.round(curves.threshold_decay(F.col("slope_deg"), 4.0, 18.0), 9).alias("norm"))


@query(f"SELECT cell_id, round({N_TWI}, 9) AS norm FROM fx_cell")
def norm_band(spark, sf_dir):
    return fixtures.cells(spark, sf_dir).select("cell_id", F.round(curves.band(F.col("twi"), 5.0, 8.0, 2.0), 9).alias("norm"))


@query("SELECT cell_id, round((rank() OVER (ORDER BY hand_m) + (count(*) OVER (PARTITION BY hand_m) - 1) / 2.0::DOUBLE) * 100.0::DOUBLE / count(*) OVER (), 6) AS pct FROM fx_cell")
def pct_rank_avg_ties(spark, sf_dir):
    return ranking.percentile_rank(fixtures.cells(spark, sf_dir), "hand_m", "pct", 0.0, 50.0).select("cell_id", F.round("pct", 6).alias("pct"))


@query(SCORED + "SELECT cell_id, score, round(score_pct, 6) AS score_pct FROM pct WHERE score_pct >= 95.0::DOUBLE")
def top_percent_cells(spark, sf_dir):
    return scored(spark, sf_dir).filter(F.col("score_pct") >= 100.0 - 5.0).select("cell_id", "score", F.round("score_pct", 6).alias("score_pct"))


BOX = "easting BETWEEN xmin AND xmax AND northing BETWEEN ymin AND ymax"


def in_areas(cells: DataFrame, spark, sf_dir, *columns: str) -> DataFrame:
    points = cells.withColumn("x", F.col("easting")).withColumn("y", F.col("northing"))
    return spatial.points_in_boxes(points, fixtures.areas(spark, sf_dir))


@query(SCORED + f""", m AS (SELECT avg(CASE WHEN score >= p95 THEN 1.0 ELSE 0.0 END) AS g, any_value(p95) AS p95 FROM scr, (SELECT quantile_cont(score, 0.95) AS p95 FROM scr))
SELECT aoi_id, count(*) AS n, round(avg(score_pct) + 1e-9::DOUBLE, 6) AS pct_mean, round(avg(CASE WHEN score >= (SELECT p95 FROM m) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 0.05::DOUBLE, 6) AS enrichment,
round(avg(CASE WHEN hand_m < 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS lowland FROM pct JOIN fx_aoi ON {BOX} GROUP BY aoi_id""")
def cells_in_footprint(spark, sf_dir):
    cells = scored(spark, sf_dir)
    cut = ranking.quantiles(cells, "score", {"p95": 0.95})
    return (
        in_areas(cells, spark, sf_dir).crossJoin(F.broadcast(cut)).groupBy("aoi_id")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score_pct") + 1e-9, 6).alias("pct_mean"), F.round(stats.share(F.col("score") >= F.col("p95")) / 0.05, 6).alias("enrichment"), F.round(stats.share(F.col("hand_m") < 15.0), 6).alias("lowland"))
    )


@query(f"""SELECT aoi_id, slug, count(elev_m) AS n, round(min(elev_m), 6) AS lo, round(max(elev_m), 6) AS hi, round(avg(elev_m), 6) AS mean, round(stddev_pop(elev_m), 6) AS sd,
round(quantile_cont(elev_m, 0.02), 6) AS p2, round(quantile_cont(elev_m, 0.25), 6) AS p25, round(quantile_cont(elev_m, 0.5), 6) AS p50, round(quantile_cont(elev_m, 0.75), 6) AS p75, round(quantile_cont(elev_m, 0.98), 6) AS p98,
round(avg(CASE WHEN elev_m IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS nodata FROM fx_cell JOIN fx_aoi ON {BOX} GROUP BY aoi_id, slug""")
def zonal_stats_by_aoi(spark, sf_dir):
    q = {"p2": 0.02, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p98": 0.98}
    e = "elev_m"
    return in_areas(fixtures.cells(spark, sf_dir), spark, sf_dir).groupBy("aoi_id", "slug").agg(
        F.count(e).alias("n"), F.round(F.min(e), 6).alias("lo"), F.round(F.max(e), 6).alias("hi"), F.round(F.avg(e), 6).alias("mean"), F.round(F.stddev_pop(e), 6).alias("sd"),
        *[F.round(stats.quantile(e, p), 6).alias(n) for n, p in q.items()], F.round(stats.share(F.col(e).isNull()), 6).alias("nodata"),
    )


PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]


def _correlations(df: DataFrame) -> list:
    return [F.round(stats.correlation(f"norm_{a}", f"norm_{b}"), 6).alias(f"{a}_{b}") for a, b in PAIRS]


def _corr_sql(a: str, b: str) -> str:
    return f"round(covar_pop(norm_{a}, norm_{b}) / nullif(stddev_pop(CASE WHEN TRUE THEN norm_{a} END) * stddev_pop(norm_{b}), 0), 6)"


@query(SCORED + "SELECT " + ", ".join(f"{_corr_sql(a, b)} AS {a}_{b}" for a, b in PAIRS) + " FROM nrm")
def norm_correlations(spark, sf_dir):
    df = scored(spark, sf_dir)
    return df.agg(*_correlations(df))


LAYERS = ("hand", "slope", "twi")
E_SQL = SCORED + ", r AS (SELECT " + ", ".join(f"abs(coalesce({_corr_sql(a, b)}, 0)) AS {a}_{b}" for a, b in (("hand", "slope"), ("hand", "twi"), ("slope", "twi"))) + " FROM nrm)"


@query(E_SQL + """ SELECT 3::INT AS layers, round(least(3.0::DOUBLE, 9.0::DOUBLE / (3.0::DOUBLE + 2 * hand_slope + 2 * hand_twi + 2 * slope_twi)), 4) AS effective,
(SELECT round(avg(CASE WHEN norm_hand > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM nrm) AS cover_hand, (SELECT round(avg(CASE WHEN norm_slope > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM nrm) AS cover_slope,
(SELECT round(avg(CASE WHEN norm_twi > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM nrm) AS cover_twi FROM r""")
def evidence_stack(spark, sf_dir):
    pairs = {(a, b): stats.correlation(f"norm_{a}", f"norm_{b}") for i, a in enumerate(LAYERS) for b in LAYERS[i + 1 :]}
    return scored(spark, sf_dir).agg(
        F.lit(len(LAYERS)).alias("layers"), F.round(stats.effective_count(LAYERS, pairs), 4).alias("effective"),
        *[F.round(stats.share(F.col(f"norm_{n}") > 0), 6).alias(f"cover_{n}") for n in LAYERS],
    )


CONTROL = "role = 'control_positive'"


@query(SCORED + f""", c AS (SELECT DISTINCT cell_id FROM nrm JOIN fx_aoi ON {BOX} WHERE {CONTROL}), e AS (SELECT nrm.*, c.cell_id IS NOT NULL AS control FROM nrm LEFT JOIN c USING (cell_id)),
v AS (SELECT control, (norm_hand + norm_slope + norm_twi) / 3.0::DOUBLE AS full_, (norm_slope + norm_twi) / 2.0::DOUBLE AS hand, (norm_hand + norm_twi) / 2.0::DOUBLE AS slope, (norm_hand + norm_slope) / 2.0::DOUBLE AS twi FROM e),
s AS (SELECT avg(full_) FILTER (control) - avg(full_) AS f, avg(hand) FILTER (control) - avg(hand) AS h, avg(slope) FILTER (control) - avg(slope) AS s, avg(twi) FILTER (control) - avg(twi) AS t FROM v)
SELECT round(f, 6) AS separation, round(f - h, 6) AS marginal_hand, round(f - s, 6) AS marginal_slope, round(f - t, 6) AS marginal_twi FROM s""")
def evidence_marginals(spark, sf_dir):
    """Separation of control cells from the frame, and what each layer adds: all leave-one-out sets in one pass."""
    cells = scored(spark, sf_dir)
    control = in_areas(cells, spark, sf_dir).filter(CONTROL).select("cell_id", F.lit(True).alias("control")).distinct()
    marked = cells.join(control, "cell_id", "left")
    mean = lambda names: sum(F.col(f"norm_{n}") for n in names) / float(len(names))
    sep = lambda names: F.avg(F.when(F.col("control"), mean(names))) - F.avg(mean(names))
    full = sep(LAYERS)
    return marked.agg(F.round(full, 6).alias("separation"), *[F.round(full - sep([x for x in LAYERS if x != n]), 6).alias(f"marginal_{n}") for n in LAYERS])


DRAWS = 199
WIDTH_X, WIDTH_Y = 150.0, 200.0
DRAW_SQL = SCORED + f""", d AS (SELECT range AS draw, 500000.0::DOUBLE + (range * 7919 + 104729) % 850 AS xmin, (SELECT min(northing) FROM fx_cell) + (range * 6151 + 7) % 1200 AS ymin FROM range(0, {DRAWS})),
x AS (SELECT draw, count(*) AS n, avg(score_pct) AS pct_mean, avg(CASE WHEN hand_m < 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS lowland FROM pct JOIN d ON easting BETWEEN xmin AND xmin + {WIDTH_X} AND northing BETWEEN ymin AND ymin + {WIDTH_Y} GROUP BY draw)"""


def draws(spark, sf_dir, cells: DataFrame) -> DataFrame:
    """Statistics of footprints moved by a formula of the draw number, all draws in one tile join; they lie in the lowest 1400 m, see matched_draws for the whole frame."""
    floor = fixtures.cells(spark, sf_dir).agg(F.min("northing").alias("low"))
    k = F.col("id")
    boxes = spark.range(DRAWS).crossJoin(F.broadcast(floor)).select(k.alias("draw"), (500000.0 + (k * 7919 + 104729) % 850).alias("xmin"), (F.col("low") + (k * 6151 + 7) % 1200).alias("ymin"))
    boxes = boxes.withColumn("xmax", F.col("xmin") + WIDTH_X).withColumn("ymax", F.col("ymin") + WIDTH_Y)
    points = cells.select("score_pct", "hand_m", F.col("easting").alias("x"), F.col("northing").alias("y"))
    return spatial.points_in_boxes(points, boxes).groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.avg("score_pct").alias("pct_mean"), stats.share(F.col("hand_m") < 15.0).alias("lowland"))


@query(DRAW_SQL + " SELECT draw, n, round(pct_mean + 1e-9::DOUBLE, 6) AS pct_mean, round(lowland, 6) AS lowland FROM x")
def permutation_null(spark, sf_dir):
    return draws(spark, sf_dir, scored(spark, sf_dir)).select("draw", "n", F.round(F.col("pct_mean") + 1e-9, 6).alias("pct_mean"), F.round("lowland", 6).alias("lowland"))


@query(DRAW_SQL + f""", o AS (SELECT avg(score_pct) AS observed FROM pct JOIN fx_aoi ON {BOX} WHERE aoi_id = 0),
k AS (SELECT round(pct_mean, 9) AS s FROM x WHERE n >= 10) SELECT round(any_value(observed), 6) AS observed, count(*) AS draws, round(avg(s), 6) AS null_mean, round(stddev_pop(s), 6) AS null_sd,
round(quantile_cont(s, 0.05), 6) AS q05, round(quantile_cont(s, 0.95), 6) AS q95, round((sum(CASE WHEN s >= observed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 1) / (count(*) + 1), 6) AS p FROM k, o""")
def permutation_summary(spark, sf_dir):
    cells = scored(spark, sf_dir)
    observed = in_areas(cells, spark, sf_dir).filter("aoi_id = 0").agg(F.avg("score_pct").alias("observed"))
    null = draws(spark, sf_dir, cells).filter("n >= 10").select(F.round("pct_mean", 9).alias("s"))
    return null.crossJoin(F.broadcast(observed)).agg(
        F.round(F.first("observed"), 6).alias("observed"), F.count(F.lit(1)).alias("draws"), F.round(F.avg("s"), 6).alias("null_mean"), F.round(F.stddev_pop("s"), 6).alias("null_sd"),
        F.round(stats.quantile("s", 0.05), 6).alias("q05"), F.round(stats.quantile("s", 0.95), 6).alias("q95"), F.round(stats.empirical_p(F.col("s"), F.col("observed")), 6).alias("p"),
    )


LOWLAND_TOL, TRIES = 0.15, 60


def _uniform(salt: int):
    """A number in [0, 1) by area and try."""
    return F.pmod(F.xxhash64(F.lit(salt), "aoi_id", "try"), F.lit(1 << 53)) / float(1 << 53)


def matched_draws(cells: DataFrame, areas: DataFrame, keep: int = DRAWS) -> DataFrame:
    """(aoi_id, observed columns, try, n, pct_mean, lowland): the first `keep` null footprints of each area, of at most 60 times as many tries.

    A footprint is the area's own, turned by right angles, anywhere in the frame of all cells; it counts with 0.9 of the area's
    cells, 10 at least, and a lowland share within LOWLAND_TOL of the area's. Tries go on in rounds for areas that lack some.
    """
    points = cells.select("score_pct", "hand_m", F.col("easting").alias("x"), F.col("northing").alias("y"))
    measured = lambda boxes, *key: spatial.points_in_boxes(points, boxes).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("score_pct").alias("pct_mean"), stats.share(F.col("hand_m") < 15.0).alias("lowland"))
    own = measured(areas, "aoi_id", "xmin", "ymin", "xmax", "ymax").select(
        "aoi_id", F.col("n").alias("own_n"), F.col("pct_mean").alias("observed"), F.col("lowland").alias("own_lowland"), (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h")
    )
    frame = points.agg(F.min("x").alias("x0"), F.max("x").alias("x9"), F.min("y").alias("y0"), F.max("y").alias("y9"))
    own = durable(own.crossJoin(F.broadcast(frame)))
    kept, lacking, seen, step = None, own, 0, 2 * keep
    while seen < TRIES * keep:
        upto = min(seen + step, TRIES * keep)
        turned = _uniform(0) < 0.5
        boxes = lacking.crossJoin(own.sparkSession.range(seen, upto).withColumnRenamed("id", "try"))
        boxes = boxes.select("aoi_id", "try", F.when(turned, F.col("h")).otherwise(F.col("w")).alias("bw"), F.when(turned, F.col("w")).otherwise(F.col("h")).alias("bh"), "x0", "x9", "y0", "y9")
        boxes = boxes.filter((F.col("x9") - F.col("x0") > F.col("bw")) & (F.col("y9") - F.col("y0") > F.col("bh")))
        boxes = boxes.withColumn("xmin", F.col("x0") + _uniform(1) * (F.col("x9") - F.col("x0") - F.col("bw"))).withColumn("ymin", F.col("y0") + _uniform(2) * (F.col("y9") - F.col("y0") - F.col("bh")))
        boxes = boxes.select("aoi_id", "try", "xmin", "ymin", (F.col("xmin") + F.col("bw")).alias("xmax"), (F.col("ymin") + F.col("bh")).alias("ymax"))
        alike = F.coalesce(F.abs(F.col("lowland") - F.col("own_lowland")) <= LOWLAND_TOL, F.lit(True))
        good = measured(boxes, "aoi_id", "try", "xmin", "ymin", "xmax", "ymax").join(own, "aoi_id").filter((F.col("n") >= F.greatest(F.lit(10), F.floor(F.col("own_n") * 0.9))) & alike)
        good = good.select("aoi_id", "own_n", "observed", "own_lowland", "try", "xmin", "ymin", "xmax", "ymax", "n", "pct_mean", "lowland")
        kept = durable(good if kept is None else kept.unionByName(good))
        done = kept.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") >= keep)
        lacking = durable(own.join(done.select("aoi_id"), "aoi_id", "left_anti"))
        if lacking.isEmpty():
            break
        seen, step = upto, 2 * step
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("aoi_id").orderBy("try"))).filter(F.col("rank") <= keep).drop("rank")


@query()
def permutation_matched(spark, sf_dir):
    """Each positive control against null footprints of its own size and lowland share from the whole frame; no row for an area without cells."""
    areas = fixtures.areas(spark, sf_dir).filter(CONTROL)
    cells = scored(spark, sf_dir)
    null = matched_draws(cells, areas)
    own = in_areas(cells, spark, sf_dir).filter(CONTROL).groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score_pct").alias("observed"))
    by = null.withColumn("s", F.round("pct_mean", 9)).groupBy("aoi_id").agg(
        F.count(F.lit(1)).alias("draws"), F.round(F.avg("s"), 6).alias("null_mean"), F.round(F.stddev_pop("s"), 6).alias("null_sd"), F.round(stats.quantile("s", 0.05), 6).alias("q05"),
        F.round(stats.quantile("s", 0.95), 6).alias("q95"), F.round(stats.empirical_p(F.col("s"), F.round("observed", 9)), 6).alias("p"),
    )
    return own.join(by, "aoi_id", "left").select("aoi_id", "n", F.round("observed", 6).alias("observed"), F.coalesce("draws", F.lit(0)).alias("draws"), "null_mean", "null_sd", "q05", "q95", "p")


def _without(name: str) -> str:
    rest = {"hand": 3.0, "slope": 2.0, "drainage": 2.0, "twi": 1.0}
    rest.pop(name, None)
    return " + ".join(f"{w / sum(rest.values())!r}::DOUBLE * coalesce(norm_{n}, 0)" for n, w in rest.items())


@query(SCORED + ", a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, cell_id, easting, northing, round(0.0::DOUBLE + {_without(n)}, 9) AS s FROM nrm" for n in (*NAMES, "none")) + f"""),
k AS (SELECT *, (rank() OVER (PARTITION BY feature ORDER BY s::FLOAT) + (count(*) OVER (PARTITION BY feature, s::FLOAT) - 1) / 2.0::DOUBLE) * 100.0::DOUBLE / count(*) OVER (PARTITION BY feature) AS pct FROM a)
SELECT feature, round(avg(pct) + 1e-9::DOUBLE, 4) AS control_pct FROM k JOIN fx_aoi ON {BOX} WHERE {CONTROL} GROUP BY feature""")
def ablation(spark, sf_dir):
    """Mean control percentile with each feature held out: one scan, all sets ranked side by side."""
    cells = fixtures.cells(spark, sf_dir).select("cell_id", "easting", "northing", *[curves.normalise(w["method"], F.col(w["column"]), **w["params"]).alias(f"norm_{n}") for n, w in WEIGHTS.items()])
    sets = []
    for held in (*NAMES, "none"):
        rest = {n: w["weight"] for n, w in WEIGHTS.items() if n != held}
        score = sum((F.lit(w / sum(rest.values())) * F.coalesce(F.col(f"norm_{n}"), F.lit(0.0)) for n, w in rest.items()), F.lit(0.0))
        sets.append(F.struct(F.lit(held).alias("feature"), F.round(score, 9).cast("float").alias("s")))
    long = cells.select("cell_id", F.explode(F.array(*sets)).alias("a")).select("cell_id", "a.feature", "a.s")
    control = in_areas(cells, spark, sf_dir).filter(CONTROL).select("cell_id")
    ranked = ranking.percentile_rank(long, "s", "pct", by=("feature",))
    return ranked.join(control, "cell_id").groupBy("feature").agg(F.round(F.avg("pct") + 1e-9, 4).alias("control_pct"))


@query(SCORED + "SELECT feature, norm, share, round(share * coalesce(norm, 0), 9) AS contribution FROM (SELECT cell_id, unnest(['hand', 'slope', 'drainage', 'twi']) AS feature, unnest([norm_hand, norm_slope, norm_drainage, norm_twi]) AS norm, unnest([0.375::DOUBLE, 0.25, 0.25, 0.125]) AS share FROM nrm WHERE cell_id = (SELECT cell_id FROM nrm ORDER BY (easting - 500423.0) ** 2 + (northing - 3999900.0) ** 2, cell_id LIMIT 1))")
def explain_cell(spark, sf_dir):
    """What each feature adds to the score of the cell nearest to a point."""
    total = sum(w["weight"] for w in WEIGHTS.values())
    near = scored(spark, sf_dir).orderBy((F.col("easting") - 500423.0) ** 2 + (F.col("northing") - 3999900.0) ** 2, "cell_id").limit(1)
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"norm_{n}").alias("norm"), F.lit(WEIGHTS[n]["weight"] / total).alias("share")) for n in NAMES])
    return near.select(F.explode(parts).alias("p")).select("p.*").withColumn("contribution", F.round(F.col("share") * F.coalesce("norm", F.lit(0.0)), 9))


@query(SCORED + "SELECT feature, round(a, 9) AS norm_a, round(b, 9) AS norm_b, round(a - b, 9) AS difference FROM (SELECT unnest(['hand', 'slope', 'drainage', 'twi']) AS feature, unnest([x.norm_hand, x.norm_slope, x.norm_drainage, x.norm_twi]) AS a, unnest([y.norm_hand, y.norm_slope, y.norm_drainage, y.norm_twi]) AS b FROM nrm x, nrm y WHERE x.cell_id = 7 AND y.cell_id = 1207)")
def compare_cells(spark, sf_dir):
    def long(cell: int, name: str) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"norm_{n}").alias(name)) for n in NAMES])
        return scored(spark, sf_dir).filter(F.col("cell_id") == cell).select(F.explode(parts).alias("p")).select("p.*")

    both = long(7, "a").join(long(1207, "b"), "feature", "full")
    return both.select("feature", F.round("a", 9).alias("norm_a"), F.round("b", 9).alias("norm_b"), F.round(F.col("a") - F.col("b"), 9).alias("difference"))


@query("SELECT cell_id, CASE WHEN drainage_class = 'Well drained' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * CASE flood_freq WHEN 'Occasional' THEN 0.5::DOUBLE WHEN 'Frequent' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS burial_risk FROM fx_cell")
def burial_risk(spark, sf_dir):
    material = F.when(F.col("drainage_class") == "Well drained", "Loamy alluvium").otherwise("Residuum")
    return fixtures.cells(spark, sf_dir).select("cell_id", curves.burial_risk(material, F.col("flood_freq"), FLOOD).alias("burial_risk"))
