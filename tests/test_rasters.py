import numpy as np
import pytest

from landrank.operators.resample import Grid
from landrank.sources import rasters

GRID = Grid(500000.0, 4000010.0, 10.0, 75, 90)


def cells(spark, seed=1, whole=False):
    rng = np.random.default_rng(seed)
    rows = [(r, c, float(np.float32(rng.uniform(80, 450)))) for r in range(75) for c in range(90) if rng.random() < 0.9]
    if whole:
        rows = [(r, c, float(round(v))) for r, c, v in rows]
    return spark.createDataFrame(rows, "row_i int, col_i int, z double"), {(r, c): v for r, c, v in rows}


@pytest.fixture
def read(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(rasters.TiledRaster)
    return lambda folder, **o: spark.read.format("tiled_raster").options(**o).load(str(folder))


@pytest.mark.parametrize("dtype,nodata,compression", [("float32", -9999.0, rasters.DEFLATE), ("float64", -1.0, rasters.PLAIN), ("int16", -32768.0, rasters.DEFLATE), ("int32", 0.0, rasters.PLAIN)])
def test_round_trip(spark, tmp_path, read, dtype, nodata, compression):
    table, want = cells(spark, whole=dtype.startswith("int"))
    n = rasters.write(table.unionByName(spark.createDataFrame([(0, 0, float("nan"))], "row_i int, col_i int, z double").filter("false")), str(tmp_path / "r"), GRID, "z", dtype, nodata, tile=16, block=2, compression=compression)
    assert n == 9 and len(rasters.files(str(tmp_path / "r"))) == 9
    got = read(tmp_path / "r", run=3).collect()
    assert {(r["row_i"], r["col_i"]): r["value"] for r in got} == want
    assert all(r["x"] == 500005.0 + 10 * r["col_i"] and r["y"] == 4000005.0 - 10 * r["row_i"] for r in got)


def test_a_disc_reads_only_its_tiles(spark, tmp_path, read):
    table, want = cells(spark)
    rasters.write(table, str(tmp_path / "r"), GRID, "z", tile=16, block=2)
    disc = "x between 500200 and 500300 and y between 3999700 and 3999790"
    got = read(tmp_path / "r").filter(disc).filter("(x - 500250) * (x - 500250) + (y - 3999745) * (y - 3999745) <= 1600").collect()
    inside = lambda r, c: (500005 + 10 * c - 500250) ** 2 + (4000005 - 10 * r - 3999745) ** 2 <= 1600
    assert {(r["row_i"], r["col_i"]): r["value"] for r in got} == {k: v for k, v in want.items() if inside(*k)}
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

    reader = rasters._Reader({"path": str(tmp_path / "r")})
    list(reader.pushFilters([GreaterThanOrEqual(("x",), 500200), LessThanOrEqual(("x",), 500300), GreaterThanOrEqual(("y",), 3999700), LessThanOrEqual(("y",), 3999790)]))
    assert sum(len(p.tiles) for p in reader.partitions()) == 1
    assert sum(len(p.tiles) for p in rasters._Reader({"path": str(tmp_path / "r")}).partitions()) == 30
    assert read(tmp_path / "r").filter("row_i = 40 and col_i >= 88").count() == sum(k[0] == 40 and k[1] >= 88 for k in want)
    assert read(tmp_path / "r").filter("x > 900000").count() == 0


def test_metadata(spark, tmp_path):
    table, want = cells(spark)
    rasters.write(table, str(tmp_path / "r"), GRID, "z", tile=32, block=9)
    (head,) = rasters.heads(str(tmp_path / "r"))
    assert (head.epsg, head.metres, head.resolution, head.left, head.top, head.nodata, head.rows, head.cols) == (26916, True, 10.0, 500000.0, 4000010.0, -9999.0, 75, 90)
    assert all(80 <= v <= 450 for v in want.values())


def test_what_can_not_be_written(spark, tmp_path):
    one = lambda *rows: spark.createDataFrame(rows, "row_i int, col_i int, z double")
    for bad, dtype, nodata, said in ((one((0, 0, -9999.0)), "float32", -9999.0, "no-data value"), (one((0, 0, 1.5)), "int16", -1.0, "can't hold"), (one((0, 0, 70000.0)), "int16", -1.0, "can't hold"), (one((0, 99, 1.0)), "float32", -1.0, "not on the grid"), (one((0, 0, 1.0)), "float32", None, "no value for them")):
        with pytest.raises(Exception, match=said):
            rasters.write(bad, str(tmp_path / "bad"), GRID, "z", dtype, nodata)
    (tmp_path / "odd.tif").write_bytes(b"MM\0*" + b"\0" * 40)
    with pytest.raises(ValueError, match="little-endian"):
        rasters.heads(str(tmp_path / "odd.tif"))
