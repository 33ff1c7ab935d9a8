"""Label points from GeoJSON collections, with the checks that a load must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """features array<struct<geometry: struct<type: string, coordinates: array<double>>,
properties: struct<class_id: string, name: string, positional_confidence_m: double, note: string>>>"""


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name, positional_confidence_m, note, x, y), one row a feature."""
    feature = F.explode("features").alias("f")
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(feature)
    return rows.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"))


def problems(points: DataFrame, classes: DataFrame, footprint: dict[str, float]) -> DataFrame:
    """(name, problem) of points that look like degrees, lie outside the footprint, or name an unknown class."""
    x, y = F.col("x"), F.col("y")
    outside = ~(x.between(footprint["xmin"], footprint["xmax"]) & y.between(footprint["ymin"], footprint["ymax"]))
    known = classes.select("class_id", F.lit(True).alias("known"))
    found = points.join(known, "class_id", "left").select(
        "name",
        F.explode(F.array_compact(F.array(F.when((F.abs(x) <= 360) & (F.abs(y) <= 90), "degrees"), F.when(outside, "outside footprint"), F.when(F.col("known").isNull(), "unknown class")))).alias("problem"),
    )
    return found


def confidence(points: DataFrame, sheet_m: float) -> DataFrame:
    """The worse of a point's own error and its sheet's."""
    return points.withColumn("positional_confidence_m", F.greatest(F.coalesce("positional_confidence_m", F.lit(0.0)), F.lit(float(sheet_m))))


def write_geojson(points: DataFrame, path: str) -> None:
    """One feature a line, with all other columns as properties."""
    others = [c for c in points.columns if c not in ("x", "y")]
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*others).alias("properties"))
    points.select(F.to_json(feature).alias("value")).write.text(path)
