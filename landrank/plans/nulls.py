"""Controls against matched null footprints, on the full score and with each feature held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves, stats
from ..operators import permutation, ranking
from ..operators.permutation import ACROSS, LOWLAND_TOL, SHIFT, UP, WHOLE
from ..sources import fixtures
from ..storage import durable
from . import query
from .scoring import CONTROL, NAMES, SCORED, WEIGHTS, _without

#: Draws kept for an area, and tries at most; production takes 199 and 60 times as many.
KEEP, MOST = 49, 392
SETS = ("none", *NAMES)

SURFACES = SCORED + ", a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, cell_id, easting, northing, hand_m, round(0.0::DOUBLE + {_without(n)}, 9) AS s FROM nrm" for n in SETS) + f"""),
cu AS (SELECT feature, quantile_cont(s, 0.95) AS cut FROM a GROUP BY feature),
sf AS MATERIALIZED (SELECT a.*, (rank() OVER (PARTITION BY feature ORDER BY s::FLOAT) + (count(*) OVER (PARTITION BY feature, s::FLOAT) - 1) / 2.0::DOUBLE) * 100.0::DOUBLE / count(*) OVER (PARTITION BY feature) AS pct, CASE WHEN s >= cut THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS top FROM a JOIN cu USING (feature)),
fr AS (SELECT min(easting) AS x0, max(easting) AS x9, min(northing) AS y0, max(northing) AS y9 FROM fx_cell),
ow AS (SELECT aoi_id AS id, feature, any_value(xmax - xmin) AS w, any_value(ymax - ymin) AS h, count(*) AS n, avg(CASE WHEN hand_m < 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS lowland, avg(pct) AS pct, avg(top) AS enrich FROM sf JOIN fx_aoi ON easting BETWEEN xmin AND xmax AND northing BETWEEN ymin AND ymax WHERE {CONTROL} GROUP BY aoi_id, feature),
sz AS (SELECT id, n AS own_n, lowland AS own_lowland, range AS t, CASE WHEN range % 2 = 1 THEN h ELSE w END AS bw, CASE WHEN range % 2 = 1 THEN w ELSE h END AS bh FROM ow, range(0, {MOST}) WHERE feature = 'none'),
bx AS (SELECT *, x0 + (t * {ACROSS} + id * {SHIFT}) % {WHOLE} / {WHOLE}.0::DOUBLE * (x9 - x0 - bw) AS xa, y0 + (t * {UP} + id * {SHIFT}) % {WHOLE} / {WHOLE}.0::DOUBLE * (y9 - y0 - bh) AS ya FROM sz, fr WHERE x9 - x0 > bw AND y9 - y0 > bh),
dr AS MATERIALIZED (SELECT id, t, own_n, own_lowland, cell_id, hand_m FROM fx_cell JOIN bx ON easting BETWEEN xa AND xa + bw AND northing BETWEEN ya AND ya + bh),
ok AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY t) AS k FROM dr GROUP BY id, t HAVING count(*) >= greatest(10, floor(any_value(own_n) * 0.9)) AND abs(avg(CASE WHEN hand_m < 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - any_value(own_lowland)) <= {LOWLAND_TOL}),
nu AS (SELECT id, feature, t, round(avg(pct), 9) AS pct, round(avg(top), 9) AS enrich FROM dr JOIN ok USING (id, t) JOIN sf USING (cell_id) WHERE k <= {KEEP} GROUP BY id, feature, t),
su AS (SELECT ow.id, ow.feature, any_value(ow.n) AS n, any_value(round(ow.pct, 9)) AS pct, any_value(round(ow.enrich, 9)) AS enrich, count(nu.t) AS draws, avg(nu.pct) AS pct_mean, stddev_pop(nu.pct) AS pct_sd, quantile_cont(nu.pct, 0.05) AS pct_q05, quantile_cont(nu.pct, 0.95) AS pct_q95, avg(nu.enrich) AS enrich_mean, stddev_pop(nu.enrich) AS enrich_sd, quantile_cont(nu.enrich, 0.95) AS enrich_q95,
CASE WHEN count(nu.t) > 0 THEN (count(*) FILTER (nu.pct >= round(ow.pct, 9)) + 1.0::DOUBLE) / (count(nu.t) + 1) END AS p_pct, CASE WHEN count(nu.t) > 0 THEN (count(*) FILTER (nu.enrich >= round(ow.enrich, 9)) + 1.0::DOUBLE) / (count(nu.t) + 1) END AS p_enrich FROM ow LEFT JOIN nu USING (id, feature) GROUP BY ow.id, ow.feature)"""


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, hand_m, pct_<set>, top_<set>) of every cell: percentile of the score, and 20 for the cells of its top twentieth, on the full
    set of features ('none' held out) and without each of them; all sets are scored and ranked in one pass."""
    cells = fixtures.cells(spark, sf_dir).select("cell_id", "easting", "northing", "hand_m", *[curves.normalise(w["method"], F.col(w["column"]), **w["params"]).alias(f"norm_{n}") for n, w in WEIGHTS.items()])
    sets = []
    for held in SETS:
        rest = {n: w["weight"] for n, w in WEIGHTS.items() if n != held}
        score = sum((F.lit(w / sum(rest.values())) * F.coalesce(F.col(f"norm_{n}"), F.lit(0.0)) for n, w in rest.items()), F.lit(0.0))
        sets.append(F.struct(F.lit(held).alias("feature"), F.round(score, 9).alias("s")))
    long = durable(cells.select("cell_id", F.explode(F.array(*sets)).alias("a")).select("cell_id", "a.feature", "a.s", F.col("a.s").cast("float").alias("f")))
    cut = ranking.quantiles(long, "s", {"cut": 0.95}, by=("feature",))
    ranked = ranking.percentile_rank(long, "f", "pct", by=("feature",)).join(F.broadcast(cut), "feature")
    of = lambda n, c: F.max(F.when(F.col("feature") == n, c))
    wide = ranked.groupBy("cell_id").agg(*[of(n, F.col("pct")).alias(f"pct_{n}") for n in SETS], *[of(n, F.when(F.col("s") >= F.col("cut"), 20.0).otherwise(0.0)).alias(f"top_{n}") for n in SETS])
    return durable(cells.select("cell_id", "hand_m", F.col("easting").alias("x"), F.col("northing").alias("y")).join(wide, "cell_id").drop("cell_id"))


def controls_against_null(spark: SparkSession, sf_dir: str, sets: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    areas = fixtures.areas(spark, sf_dir).filter(CONTROL).select(F.col("aoi_id").cast("long").alias("id"), "xmin", "ymin", "xmax", "ymax")
    measures = {f"{kind}_{n}": F.avg(f"{kind}_{n}") for n in sets for kind in ("pct", "top")}
    own, null = permutation.matched(surfaces(spark, sf_dir), areas, measures, stats.share(F.col("hand_m") < 15.0), KEEP, MOST)
    return own, durable(null)


@query(SURFACES + """ SELECT id AS aoi_id, n, draws, round(pct, 6) AS observed_pct, round(pct_mean, 6) AS pct_mean, round(pct_sd, 6) AS pct_sd, round(pct_q05, 6) AS pct_q05, round(pct_q95, 6) AS pct_q95, round(p_pct, 6) AS p_pct,
round(enrich, 6) AS observed_enrich, round(enrich_mean, 6) AS enrich_mean, round(enrich_sd, 6) AS enrich_sd, round(enrich_q95, 6) AS enrich_q95, round(p_enrich, 6) AS p_enrich FROM su WHERE feature = 'none'""")
def permutation_both(spark, sf_dir):
    """Mean percentile and top-5-percent enrichment of each positive control against its matched null, with both p."""
    own, null = controls_against_null(spark, sf_dir, ("none",))
    r = lambda c, n: F.round(c, 6).alias(n)
    pct = permutation.summary(own, null, "pct_none").select("id", "draws", r("observed", "observed_pct"), r("mean", "pct_mean"), r("sd", "pct_sd"), r("q05", "pct_q05"), r("q95", "pct_q95"), r("p", "p_pct"))
    top = permutation.summary(own, null, "top_none").select("id", r("observed", "observed_enrich"), r("mean", "enrich_mean"), r("sd", "enrich_sd"), r("q95", "enrich_q95"), r("p", "p_enrich"))
    return own.select("id", "n").join(pct, "id").join(top, "id").withColumnRenamed("id", "aoi_id")


@query(SURFACES + " SELECT h.id AS aoi_id, h.feature, round(h.pct, 6) AS pct_mean, round(h.pct - b.pct, 6) AS delta_pct_mean, round(h.enrich, 6) AS top5_enrich, round(h.enrich - b.enrich, 6) AS delta_top5_enrich, round(h.p_pct, 6) AS p_pct_mean FROM su h JOIN su b ON b.id = h.id AND b.feature = 'none' WHERE h.feature <> 'none'")
def ablation_controls(spark, sf_dir):
    """Each positive control with each feature held out: its statistics, what they lose against the full set, and their own null's p."""
    own, null = controls_against_null(spark, sf_dir, SETS)
    out = None
    for n in NAMES:
        p = permutation.summary(own, null, f"pct_{n}").select("id", F.round("p", 6).alias("p_pct_mean"))
        pct, top, pct0, top0 = (F.round(F.col(c), 9) for c in (f"pct_{n}", f"top_{n}", "pct_none", "top_none"))
        one = own.select("id", F.lit(n).alias("feature"), F.round(pct, 6).alias("pct_mean"), F.round(pct - pct0, 6).alias("delta_pct_mean"), F.round(top, 6).alias("top5_enrich"), F.round(top - top0, 6).alias("delta_top5_enrich")).join(p, "id")
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", "aoi_id")
