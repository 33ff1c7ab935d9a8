import glob
import itertools
import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from landrank.sources import layout


def test_numbers_and_ranges(spark):
    rng = np.random.default_rng(1)
    pairs = [(0, 0), (5, 3), ((1 << 24) - 1, (1 << 24) - 1), *[tuple(map(int, rng.integers(0, 1 << 24, 2))) for _ in range(20)]]
    got = spark.createDataFrame(pairs, "c long, r long").select("c", "r", layout.z_order(F.col("c"), F.col("r")).alias("z")).collect()
    assert all(g.z == layout.z_number(g.c, g.r) for g in got)
    for most in (48, 3):
        for _ in range(30):
            c0, r0, w, h = (int(v) for v in rng.integers(0, 40, 4))
            found = layout.z_ranges(c0, r0, c0 + w, r0 + h, most)
            assert len(found) <= most and all(a <= b for a, b in found) and all(x[1] < y[0] for x, y in zip(found, found[1:]))
            inside = {layout.z_number(c, r) for c, r in itertools.product(range(c0, c0 + w + 1), range(r0, r0 + h + 1))}
            assert all(any(a <= z <= b for a, b in found) for z in inside)
            if most == 48 and max(w, h) < 8:
                assert sum(b - a + 1 for a, b in found) == len(inside)


@pytest.mark.parametrize("size", [0.0, 35.0])
def test_a_box_reads_few_row_groups(spark, tmp_path, size):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 4000, 20000), rng.uniform(-100, 3900, 20000)
    w, h = rng.uniform(0, size, (2, 20000))
    rows = [(k, float(a), float(b), float(a + c), float(b + d)) for k, (a, b, c, d) in enumerate(zip(x, y, w, h))]
    table = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double")
    path = str(tmp_path / "t")
    layout.write(table, path, tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), 50.0, files=4, group_rows=250)
    box = (1000.0, 1000.0, 1300.0, 1200.0)
    got = layout.read(spark, path, *box)
    assert got.columns == table.columns
    assert {r.k for r in got.collect()} == {k for k, a, b, c, d in rows if a <= box[2] and c >= box[0] and b <= box[3] and d >= box[1]}
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    plan = layout.read(spark, path, *box)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "tile_z" in pushed and "box_xmin" in pushed
    about = spark.read.parquet(path).schema["tile_z"].metadata["layout"]
    ranges = layout.ranges_of(json.loads(about), *box)
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in glob.glob(f"{path}/*.parquet") for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    stats = [next(g.column(i).statistics for i in range(g.num_columns) if g.column(i).path_in_schema == "tile_z") for g in groups]
    needed = sum(any(a <= s.max and s.min <= b for a, b in ranges) for s in stats)
    assert len(groups) >= 60 and needed <= len(groups) / 8


def test_nothing_there_and_too_small_tiles(spark, tmp_path):
    table = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    box = (F.col("x"), F.col("y"), F.col("x"), F.col("y"))
    layout.write(table, str(tmp_path / "a"), box, 10.0)
    assert layout.read(spark, str(tmp_path / "a"), -9.0, -9.0, -5.0, -5.0).count() == 0
    assert layout.read(spark, str(tmp_path / "a"), 1.0, 2.0, 1.0, 2.0).count() == 1
    layout.write(table.filter("false"), str(tmp_path / "b"), box, 10.0)
    assert layout.read(spark, str(tmp_path / "b"), 0.0, 0.0, 5.0, 5.0).count() == 0
    with pytest.raises(ValueError, match="too small"):
        layout.write(table.union(spark.createDataFrame([(1e12, 0.0)], table.schema)), str(tmp_path / "c"), box, 1.0)
