"""Null footprints for areas: the area's own box, turned and moved all over the frame, alike in size and lowland."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from . import spatial

#: Fixed multipliers of the stream of draws, per ten thousand million: across, up, and the area's own shift.
ACROSS, UP, SHIFT, WHOLE = 7548776662, 5698402909, 3628273133, 10_000_000_000
LOWLAND_TOL = 0.15


def draw_boxes(areas: DataFrame, tries: DataFrame) -> DataFrame:
    """(id, try, xmin, ymin, xmax, ymax): three of four tries turn the area's box by right angles; none where it is not smaller than the
    frame. areas: (id, w, h, x0, x9, y0, y9); tries: (try). A number's place follows from it alone, so SQL can repeat it."""
    part = lambda step: F.pmod(F.col("try") * step + F.col("id") * SHIFT, F.lit(WHOLE)) / float(WHOLE)
    odd = F.col("try") % 4 % 2 == 1
    sized = areas.crossJoin(F.broadcast(tries)).withColumn("bw", F.when(odd, F.col("h")).otherwise(F.col("w"))).withColumn("bh", F.when(odd, F.col("w")).otherwise(F.col("h")))
    room = sized.filter((F.col("x9") - F.col("x0") > F.col("bw")) & (F.col("y9") - F.col("y0") > F.col("bh")))
    placed = room.withColumn("xmin", F.col("x0") + part(ACROSS) * (F.col("x9") - F.col("x0") - F.col("bw"))).withColumn("ymin", F.col("y0") + part(UP) * (F.col("y9") - F.col("y0") - F.col("bh")))
    return placed.select("id", "try", "xmin", "ymin", (F.col("xmin") + F.col("bw")).alias("xmax"), (F.col("ymin") + F.col("bh")).alias("ymax"))


def matched(cells: DataFrame, areas: DataFrame, measures: Mapping[str, Column], lowland: Column, keep: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(own, null) of areas (id long, xmin, ymin, xmax, ymax): what each measures, and the same of its first `keep` matching footprints.

    cells: (x, y, columns that the aggregates `measures` and `lowland` read). A footprint matches with 0.9 of the area's cells, 10 at
    least, and a lowland share within LOWLAND_TOL of the area's, if that has one. At most `most` tries an area, in growing rounds for
    areas that lack some; all tries of a round meet the cells in one tile join. own: (id, n, lowland, measures), areas without
    cells left out; null: (id, try, n, measures).
    """
    names = list(measures)
    measured = lambda boxes, *key: spatial.points_in_boxes(cells, boxes).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), lowland.alias("lowland"), *[m.alias(k) for k, m in measures.items()])
    own = durable(measured(areas.select("id", "xmin", "ymin", "xmax", "ymax"), "id"))
    frame = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x9"), F.min("y").alias("y0"), F.max("y").alias("y9"))
    shape = durable(own.select("id", F.col("n").alias("own_n"), F.col("lowland").alias("own_lowland")).join(areas.select("id", (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h")), "id").crossJoin(F.broadcast(frame)))
    lacking, kept, seen, step = shape, None, 0, 2 * keep
    while seen < most:
        upto = min(seen + step, most)
        boxes = draw_boxes(lacking, cells.sparkSession.range(seen, upto).withColumnRenamed("id", "try"))
        alike = F.col("own_lowland").isNull() | F.coalesce(F.abs(F.col("lowland") - F.col("own_lowland")) <= LOWLAND_TOL, F.lit(False))
        good = measured(boxes, "id", "try").join(shape.select("id", "own_n", "own_lowland"), "id").filter((F.col("n") >= F.greatest(F.lit(10), F.floor(F.col("own_n") * 0.9))) & alike).select("id", "try", "n", *names)
        kept = durable(good if kept is None else kept.unionByName(good))
        done = kept.groupBy("id").agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") >= keep)
        lacking = durable(shape.join(done.select("id"), "id", "left_anti"))
        if lacking.isEmpty():
            break
        seen, step = upto, 2 * step
    order = Window.partitionBy("id").orderBy("try")
    return own, kept.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= keep).drop("k")


def summary(own: DataFrame, null: DataFrame, name: str, digits: int = 9) -> DataFrame:
    """(id, observed, draws, mean, sd, q05, q95, p) of one measure: its null and how often the null is as large, (r + 1) / (k + 1)."""
    s = F.round(F.col(name), digits)
    both = null.select("id", s.alias("s")).join(own.select("id", s.alias("o")), "id")
    least = lambda p: F.percentile("s", F.lit(p))  # noqa: E731  at most `keep` values an area
    found = both.groupBy("id").agg(F.count(F.lit(1)).alias("draws"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"), least(0.05).alias("q05"), least(0.95).alias("q95"), ((F.sum(F.when(F.col("s") >= F.col("o"), 1.0).otherwise(0.0)) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("p"))
    return own.select("id", s.alias("observed")).join(found, "id", "left").withColumn("draws", F.coalesce("draws", F.lit(0).cast("long")))
