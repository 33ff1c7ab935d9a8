"""Spatial views over the star-schema tables: a raster of cells, flow lines, sites and areas, all planar metres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cell, 100 columns wide, from orders."""
    k = F.col("o_orderkey")
    row, col = F.floor(k / COLS).cast("int"), (k % COLS).cast("int")
    drainage = {"1": "Well drained", "2": "Moderately well drained", "3": "Somewhat poorly drained", "4": "Unmapped class"}
    pick = F.substring("o_orderpriority", 1, 1)
    phrase = F.when(pick == "1", drainage["1"]).when(pick == "2", drainage["2"]).when(pick == "3", drainage["3"]).when(pick == "4", drainage["4"])
    return table(spark, sf_dir, "orders").select(
        k.alias("cell_id"), row.alias("row_i"), col.alias("col_i"),
        (F.lit(500005.0) + 10.0 * col).alias("easting"), (F.lit(4000005.0) - 10.0 * row).alias("northing"),
        F.round(150.0 + 20.0 * F.sin(col / 9.0) + 15.0 * F.cos(row / 11.0) + F.col("o_totalprice") / 500000.0, 6).alias("elev_m"),
        ((F.col("o_custkey") % 40) + 0.5).cast("double").alias("hand_m"), ((k * 7) % 23 + 0.25).cast("double").alias("slope_deg"),
        (2.0 + ((k * 13) % 90) / 10.0).alias("twi"), phrase.alias("drainage_class"),
        F.when(F.col("o_orderstatus") == "F", "None").when(F.col("o_orderstatus") == "O", "Occasional").otherwise("Frequent").alias("flood_freq"),
    )


def flowlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select(k.alias("id"), (1 + k % 6).cast("int").alias("stream_order"), (500000.0 + (k * 37) % 1000).alias("x1"), (4000000.0 - (k * 91) % 1500).alias("y1"))
    return lines.select("id", "stream_order", "x1", "y1", (F.col("x1") + 120.0 * (F.col("id") % 3 - 1)).alias("x2"), (F.col("y1") - 150.0).alias("y2"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "rejected").when(k % 5 == 1, "confirmed").otherwise("unreviewed")
    return table(spark, sf_dir, "customer").select(
        k.alias("site_id"), (500000.0 + (k * 53) % 1000).alias("x"), (4000000.0 - (k * 101) % 1500).alias("y"), F.col("c_mktsegment").alias("class_id"),
        (35.0 + k % 60).alias("positional_confidence_m"), status.alias("review_status"),
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    role = F.element_at(F.array(*[F.lit(r) for r in ("control_positive", "control_detection", "prospect", "shakeout")]), (k % 4 + 1).cast("int"))
    out = table(spark, sf_dir, "nation").select(k.alias("aoi_id"), F.col("n_name").alias("slug"), role.alias("role"), (500000.0 + 200.0 * (k % 5)).alias("xmin"), (4000000.0 - 300.0 * F.floor(k / 5)).alias("top"))
    return out.select("aoi_id", "slug", "role", "xmin", (F.col("top") - 300.0).alias("ymin"), (F.col("xmin") + 180.0).alias("xmax"), (F.col("top") - 20.0).alias("ymax"))


#: The same views for a check in SQL.
SQL = """
fx_cell AS (SELECT o_orderkey AS cell_id, (o_orderkey // 100)::INT AS row_i, (o_orderkey % 100)::INT AS col_i,
  500005.0::DOUBLE + 10.0::DOUBLE * (o_orderkey % 100) AS easting, 4000005.0::DOUBLE - 10.0::DOUBLE * (o_orderkey // 100) AS northing,
  round(150.0::DOUBLE + 20.0::DOUBLE * sin((o_orderkey % 100) / 9.0::DOUBLE) + 15.0::DOUBLE * cos((o_orderkey // 100) / 11.0::DOUBLE) + o_totalprice / 500000.0::DOUBLE, 6) AS elev_m,
  ((o_custkey % 40) + 0.5)::DOUBLE AS hand_m, ((o_orderkey * 7) % 23 + 0.25)::DOUBLE AS slope_deg, 2.0::DOUBLE + ((o_orderkey * 13) % 90) / 10.0::DOUBLE AS twi,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'Well drained' WHEN '2' THEN 'Moderately well drained' WHEN '3' THEN 'Somewhat poorly drained' WHEN '4' THEN 'Unmapped class' END AS drainage_class,
  CASE o_orderstatus WHEN 'F' THEN 'None' WHEN 'O' THEN 'Occasional' ELSE 'Frequent' END AS flood_freq FROM orders),
fx_line AS (SELECT *, x1 + 120.0::DOUBLE * (id % 3 - 1) AS x2, y1 - 150.0::DOUBLE AS y2 FROM (SELECT s_suppkey AS id, (1 + s_suppkey % 6)::INT AS stream_order,
  500000.0::DOUBLE + (s_suppkey * 37) % 1000 AS x1, 4000000.0::DOUBLE - (s_suppkey * 91) % 1500 AS y1 FROM supplier)),
fx_site AS (SELECT c_custkey AS site_id, 500000.0::DOUBLE + (c_custkey * 53) % 1000 AS x, 4000000.0::DOUBLE - (c_custkey * 101) % 1500 AS y, c_mktsegment AS class_id,
  (35 + c_custkey % 60)::DOUBLE AS positional_confidence_m, CASE c_custkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'unreviewed' END AS review_status FROM customer),
fx_aoi AS (SELECT n_nationkey AS aoi_id, n_name AS slug, (['control_positive', 'control_detection', 'prospect', 'shakeout'])[n_nationkey % 4 + 1] AS role,
  500000.0::DOUBLE + 200.0::DOUBLE * (n_nationkey % 5) AS xmin, 4000000.0::DOUBLE - 300.0::DOUBLE * (n_nationkey // 5) - 300.0::DOUBLE AS ymin,
  500000.0::DOUBLE + 200.0::DOUBLE * (n_nationkey % 5) + 180.0::DOUBLE AS xmax, 4000000.0::DOUBLE - 300.0::DOUBLE * (n_nationkey // 5) - 20.0::DOUBLE AS ymax FROM nation)
"""
