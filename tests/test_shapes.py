import numpy as np
import pytest
from pyspark.sql import functions as F

from landrank.functions import geometry
from landrank.operators import detection, ranking, resample, spatial, stack


def test_quantiles_by_group_equal_numpy(spark):
    rng = np.random.default_rng(1)
    values = {g: np.round(rng.normal(size=n) * 10, 1) for g, n in (("a", 301), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(g, float(v)) for g, x in values.items() for v in x] + [("a", None), ("d", None)], "g string, v double")
    got = {r.g: r for r in ranking.quantiles(df, "v", {"p10": 0.1, "p50": 0.5, "p98": 0.98}, by=("g",)).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, x in values.items():
        assert [got[g].p10, got[g].p50, got[g].p98] == pytest.approx(np.quantile(x, [0.1, 0.5, 0.98]).tolist())
    whole = ranking.quantiles(df, "v", {"p": 0.25}).first().p
    assert whole == pytest.approx(np.quantile(np.concatenate(list(values.values())), 0.25))
    assert ranking.quantiles(df.limit(0), "v", {"p": 0.25}).first().p is None


def test_places_in_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"))
    got = {r.k: r.place for r in ranking.numbered(df, [F.desc("k")], "place").collect()}
    assert got == {k: 1000 - k for k in range(1000)}


def test_no_single_partition_of_all_rows(spark):
    """Ranks, quantiles and places never sort all rows in one task: single partitions hold one row a bucket or range."""
    df = spark.range(100_000).select((F.col("id") % 997).cast("double").alias("v"))
    plan = ranking.percentile_rank(df, "v", "p", 0.0, 997.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1 and "Window [row_number" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_segments_and_boxes(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [tuple(map(float, rng.integers(-5, 6, 4))) + tuple(map(float, (x, y, x + w, y + h))) for x, y, w, h in zip(rng.integers(-5, 3, 200), rng.integers(-5, 3, 200), rng.integers(0, 4, 200), rng.integers(0, 4, 200))]
    names = ["x1", "y1", "x2", "y2", "xmin", "ymin", "xmax", "ymax"]
    got = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(*names, geometry.segment_meets_box(*[F.col(n) for n in names]).alias("meets")).collect()
    for r in got:
        # Clip by halving: the segment's points at all crossings with the sides, and its ends.
        ts = [0.0, 1.0]
        for a, b, sides in ((r.x1, r.x2, (r.xmin, r.xmax)), (r.y1, r.y2, (r.ymin, r.ymax))):
            ts += [(s - a) / (b - a) for s in sides if a != b]
        inside = lambda t: r.xmin - 1e-9 <= r.x1 + t * (r.x2 - r.x1) <= r.xmax + 1e-9 and r.ymin - 1e-9 <= r.y1 + t * (r.y2 - r.y1) <= r.ymax + 1e-9
        assert r.meets == any(inside(t) for t in ts if 0 <= t <= 1)


def test_burnt_cells(spark):
    rng = np.random.default_rng(4)
    lines = [(i, *map(float, rng.uniform(-20, 120, 4).round(2))) for i in range(30)] + [(90, 5.0, 55.0, 95.0, 55.0), (91, 33.0, 3.0, 33.0, 3.0)]
    got = {}
    for r in spatial.burn(spark.createDataFrame(lines, "id int, x1 double, y1 double, x2 double, y2 double"), 0.0, 100.0, 10.0, 10, 10).collect():
        got.setdefault(r.id, set()).add((r.row_i, r.col_i))
    for i, x1, y1, x2, y2 in lines:
        t = np.linspace(0, 1, 20_001)
        x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        touched = {(int((100 - b) // 10), int(a // 10)) for a, b in zip(x, y) if 0 <= a < 100 and 0 < 100 - b < 100}
        assert touched <= got.get(i, set()) and len(got.get(i, set()) - touched) <= 2


def test_boxes_meet_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 500.0, 500.0), (2, 900.0, 900.0, 950.0, 950.0)], "k int, xmin double, ymin double, xmax double, ymax double")
    b = spark.createDataFrame([(7, 100.0, 100.0, 700.0, 700.0), (8, 500.0, 500.0, 501.0, 501.0)], "m int, uxmin double, uymin double, uxmax double, uymax double")
    assert sorted((r.k, r.m) for r in spatial.boxes_meet(a, b, 100.0).collect()) == [(1, 7), (1, 8)]


def test_stack_errors_and_mask(spark):
    grid = resample.Grid(0.0, 20.0, 10.0, 2, 2)
    layer = lambda rows: spark.createDataFrame(rows, "row_i int, col_i int, value double")
    a, b = layer([(0, 0, 1.0), (0, 1, float("nan")), (1, 1, 3.0)]), layer([(0, 0, 5.0), (0, 1, 6.0)])
    got = stack.build(grid, {"a": a, "b": b}, core=("a",)).collect()
    assert sorted((r.row_i, r.col_i, r.easting, r.northing, r.a, r.b) for r in got) == [(0, 0, 5.0, 15.0, 1.0, 5.0), (1, 1, 15.0, 5.0, 3.0, None)]
    with pytest.raises(ValueError, match="no layer c"):
        stack.build(grid, {"a": a}, core=("c",))
    with pytest.raises(Exception, match="not on the grid"):
        stack.build(grid, {"a": layer([(2, 0, 1.0)])}, core=("a",)).collect()
    with pytest.raises(Exception, match="two values"):
        stack.build(grid, {"a": layer([(0, 0, 1.0), (0, 0, 2.0)])}, core=("a",)).collect()


def test_null_places_are_thinned_in_order(spark):
    rng = np.random.default_rng(9)
    tries = [(i, *map(float, rng.uniform(0, 1000, 2))) for i in range(300)]
    sites = [tuple(map(float, rng.uniform(0, 1000, 2))) for _ in range(5)]
    kept = []
    for i, x, y in tries:
        if all((x - a) ** 2 + (y - b) ** 2 >= 100**2 for a, b in sites) and all((x - a) ** 2 + (y - b) ** 2 >= 60**2 for _, a, b in kept):
            kept.append((i, x, y))
    got = detection.null_places(spark.createDataFrame(tries, "id long, x double, y double"), spark.createDataFrame(sites, "x double, y double"), 100.0, 60.0)
    assert sorted(map(tuple, got.collect())) == kept


def test_gates_of_a_firing_place(spark):
    n = 30
    z = np.random.default_rng(3).normal(size=(n, n))
    z[14:16, 12:18] = 50.0
    cells = spark.createDataFrame([(c * 1.0, r * 1.0, float(z[r, c])) for r in range(n) for c in range(n)], "x double, y double, z double")
    places = spark.createDataFrame([(1, 15.0, 15.0), (2, 500.0, 500.0)], "id long, x double, y double")
    got = {r.id: r for r in detection.fire(places, cells, 1.0, 4.0, 10.0).collect()}
    assert got[1].evaluable and got[1].fired_high and got[1].cluster_high >= 12 and not got[2].evaluable and got[2].fired_high is None
    assert not {r.id: r for r in detection.fire(places, cells, 1.0, 4.0, 10.0, gate=F.col("elongation") > 50).collect()}[1].fired_high


def test_nearest_other(spark):
    rng = np.random.default_rng(12)
    rows = [("a", i, *map(float, rng.uniform(0, 5000, 2))) for i in range(80)] + [("b", i, *map(float, rng.uniform(0, 30, 2))) for i in range(60)] + [("c", 1, 0.0, 0.0), ("d", 1, 7.0, 7.0), ("d", 2, 7.0, 7.0)]
    got = {(r.g, r.k): r.near for r in spatial.nearest_other(spark.createDataFrame(rows, "g string, k int, x double, y double"), "g", "k", 10.0).collect()}
    for g, k, x, y in rows:
        far = [np.hypot(x - a, y - b) for h, m, a, b in rows if h == g and m != k]
        assert (g, k) not in got if not far else got[g, k] == pytest.approx(min(far), abs=1e-5)
