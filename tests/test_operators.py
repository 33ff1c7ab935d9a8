import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landrank import streaming
from landrank.functions import curves
from landrank.operators import ranking, raster, spatial
from landrank.sources import intake, ledger, semantic


def one(spark, column, value, kind="double"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first().o


@settings(max_examples=8, deadline=None)
@given(st.floats(-100, 100, allow_nan=False))
def test_curves_stay_in_range(spark, x):
    for build in (lambda c: curves.inverse_linear(c, 2, 30), lambda c: curves.threshold_decay(c, 4, 18), lambda c: curves.band(c, 5, 8, 2), lambda c: curves.taper(c, 10)):
        assert 0 <= one(spark, build, x) <= 1


def test_missing_values_stay_missing(spark):
    for build in (lambda c: curves.inverse_linear(c, 2, 30), lambda c: curves.threshold_decay(c, 4, 18), lambda c: curves.band(c, 5, 8, 2)):
        assert one(spark, build, None) is None and one(spark, build, float("nan")) is None
    scores = {"well_drained": 1.0}
    assert [one(spark, lambda c: curves.categorical(c, scores), v, "string") for v in (" Well-Drained", "other", None)] == [1.0, 0.0, None]


def test_curve_errors():
    for call in (lambda: curves.inverse_linear(F.lit(1.0), 3, 3), lambda: curves.band(F.lit(1.0), 3, 2, 1), lambda: curves.normalise("none", F.lit(1.0)), lambda: curves.cells_from_metres(F.lit(1.0), 0)):
        with pytest.raises(ValueError):
            call()


def test_small_formulas(spark):
    row = spark.range(1).select(
        curves.cells_from_metres(F.lit(25.0), 10.0).alias("cells"), curves.effort_hours(F.lit(50.0), F.lit(False)).alias("probe"), curves.effort_hours(F.lit(50.0), F.lit(True)).alias("direct"),
        curves.expected_value(F.lit(90.0), F.lit(1.0)).alias("ev"), curves.newest_year(F.lit("x_1985_2011_2100")).alias("year"), curves.map_error_m(F.lit(24000), 20.0).alias("map"),
    ).first()
    assert (row.cells, row.direct, row.year, row.map) == (2, 1.25, 2011, 32.2)
    assert row.probe == pytest.approx(1 / 3 + 0.5) and row.ev == pytest.approx(0.025)


def test_percentile_rank_equals_pandas(spark):
    rng = np.random.default_rng(1)
    values = [None if rng.random() < 0.1 else float(round(rng.normal(), 1)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = ranking.percentile_rank(df, "v", "p").toPandas().sort_values("id")
    want = got.v.rank(pct=True) * 100
    assert np.allclose(got.p.fillna(-1), want.fillna(-1))


def test_overlay_rejects(spark):
    df = spark.createDataFrame([(1, 2.0)], "cell_id int, burial_risk double")
    rule = {"column": "burial_risk", "weight": 1.0, "method": "threshold_decay", "params": {"full_below": 0, "zero_above": 1}}
    with pytest.raises(ValueError):
        ranking.weighted_overlay(df, {"burial": rule})
    with pytest.raises(ValueError):
        ranking.weighted_overlay(df, {"x": rule | {"column": "absent"}})


def grid(spark, z):
    return spark.createDataFrame([(r, c, None if math.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "row_i int, col_i int, z double")


def test_openness_of_plane_and_numpy(spark):
    flat = raster.openness(grid(spark, np.full((6, 7), 3.0)), "z", 6, 7, 10.0, 20.0).toPandas()
    assert (flat.openness == 90).all()
    z = np.random.default_rng(2).normal(size=(8, 9)).round(3)
    z[3, 4] = z[0, 0] = np.nan
    padded = np.pad(z, 3, mode="reflect")
    for negative, tile in ((True, 512), (False, 4)):
        got = raster.openness(grid(spark, z), "z", 8, 9, 10.0, 30.0, 16, negative, tile).toPandas().set_index(["row_i", "col_i"]).openness
        sign = -1 if negative else 1
        for r in range(8):
            for c in range(9):
                # Places by the definition: rounded thirds of a cell along each of 16 directions.
                rises = []
                for k in range(16):
                    places = {(round(np.cos(k * np.pi / 8) * d / 3), round(np.sin(k * np.pi / 8) * d / 3)) for d in range(3, 10)}
                    found = [sign * (padded[r + 3 + i, c + 3 + j] - z[r, c]) / (10 * math.hypot(i, j)) for i, j in places]
                    rises.append(max([-1000.0, *(x for x in found if not math.isnan(x))]))
                want = 90 - np.mean(np.degrees(np.arctan(rises)))
                assert np.isnan(got[r, c]) if np.isnan(z[r, c]) else got[r, c] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("tile", [3, 4, 512])
def test_stencils_do_not_see_tiles(spark, tile):
    z = np.random.default_rng(6).normal(size=(9, 11)).round(2)
    cells = grid(spark, z)
    got = raster.slope(cells, "z", 9, 11, 2.0, tile).toPandas().set_index(["row_i", "col_i"]).slope_deg
    for r in range(9):
        for c in range(11):
            if 0 < r < 8 and 0 < c < 10:
                n = z[r - 1 : r + 2, c - 1 : c + 2]
                dx, dy = ((n[:, 2] - n[:, 0]) @ [1, 2, 1]) / 16, ((n[2] - n[0]) @ [1, 2, 1]) / 16
                assert got[r, c] == pytest.approx(math.degrees(math.atan(math.hypot(dx, dy))), abs=1e-5)
            else:
                assert np.isnan(got[r, c])
    assert sorted(map(tuple, raster.local_relief(cells, "z", 9, 11, 2, tile).collect())) == sorted(map(tuple, raster.local_relief(cells, "z", 9, 11, 2).collect()))


@pytest.mark.parametrize("lines", [[(0, 0.0, 0.0, 120.0, -150.0), (1, 40.0, 10.0, 40.0, 10.0), (2, 0.0, 0.0, 120.0, -150.0)], None])
def test_nearest_segment_has_no_reach(spark, lines):
    rng = np.random.default_rng(8)
    lines = lines or [(i, *map(float, rng.uniform(-500, 500, 2)), *map(float, rng.uniform(-500, 500, 2))) for i in range(25)]
    xy = np.concatenate([rng.uniform(-700, 700, (60, 2)), rng.uniform(-30000, 30000, (60, 2))]).round(3).tolist()
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(xy)] + [(999, None, 1.0)], "k int, x double, y double")
    segments = spark.createDataFrame([(*s, 10 * s[0]) for s in lines], "id int, x1 double, y1 double, x2 double, y2 double, o int")

    def far(p, s):
        _, x1, y1, x2, y2 = s
        squared = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / squared)) if squared else 0.0
        return math.hypot(p[0] - x1 - t * (x2 - x1), p[1] - y1 - t * (y2 - y1))

    got = {r.k: (r.dist, r.o) for r in spatial.nearest_segment(points, segments, "k", None, "o").collect()}
    assert got.pop(999) == (None, None) and len(got) == len(xy)
    for i, p in enumerate(xy):
        d, name = min((round(far(p, s), 6), s[0]) for s in lines)
        assert got[i] == (pytest.approx(d, abs=2e-6), 10 * name)
    nothing = spatial.nearest_segment(points, segments.limit(0), "k", None, "o").collect()
    assert len(nothing) == len(xy) + 1 and all(r.dist is None and r.o is None for r in nothing)


@pytest.mark.parametrize("tile", [2, 3, 512])
def test_flow_accumulation(spark, tile):
    z = np.random.default_rng(5).permutation(56).reshape(7, 8).astype(float)
    got = {(r.row_i, r.col_i): r.cells for r in raster.flow_accumulation(grid(spark, z), "z", 7, 8, tile).collect()}
    ways = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    want = {}
    for start in np.ndindex(7, 8):
        at = start
        while at is not None:
            want[at] = want.get(at, 0) + 1
            best, to = 0.0, None
            for dr, dc in ways:
                r, c = at[0] + dr, at[1] + dc
                if 0 <= r < 7 and 0 <= c < 8 and round((z[at] - z[r, c]) / math.hypot(dr, dc), 6) > best:
                    best, to = round((z[at] - z[r, c]) / math.hypot(dr, dc), 6), (r, c)
            at = to
    assert got == want


def test_height_above_streams(spark):
    z = np.add.outer(np.arange(6) * 3.0, np.abs(np.arange(7) - 3.0))
    got = {(r.row_i, r.col_i): r.hand for r in raster.hand(grid(spark, z), "z", 6, 7, 7, 4).collect()}
    flow = {(r.row_i, r.col_i): r.cells for r in raster.flow_accumulation(grid(spark, z), "z", 6, 7).collect()}
    ways = {(r.row_i, r.col_i): r.dir for r in raster.flow_direction(grid(spark, z), "z", 6, 7).collect()}
    for at in np.ndindex(6, 7):
        here = at
        while flow[here] < 7 and ways[here] is not None:
            here = (here[0] + raster.WAYS[ways[here]][0], here[1] + raster.WAYS[ways[here]][1])
        assert got[at] == (pytest.approx(z[at] - z[here]) if flow[here] >= 7 else None)


def flood(mask):
    label = {}
    for start in sorted(zip(*np.nonzero(mask))):
        start = tuple(map(int, start))
        if start in label:
            continue
        stack, name = [start], (start[0] << 32) | start[1]
        label[start] = name
        while stack:
            r, c = stack.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in label:
                    label[p] = name
                    stack.append(p)
    return label


def test_components_over_tile_borders(spark):
    mask = np.random.default_rng(3).random((30, 30)) < 0.58
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "row_i int, col_i int")
    got = {(r.row_i, r.col_i): r.zone for r in raster.components(cells, 7).collect()}
    assert got == flood(mask)


def test_enclosure_and_boxes(spark):
    ring = [(r, c, 1) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)] + [(10, c, 2) for c in range(6)]
    zones = spark.createDataFrame(ring, "row_i int, col_i int, zone long")
    assert {r.zone: (r.holes, r.enclosed) for r in raster.enclosure(zones).collect()} == {1: (9, 0.36), 2: (0, 0.0)}
    shape = {r.zone: r for r in raster.morphometry(zones).collect()}
    assert shape[2].span == 6.0 and shape[2].fill == 1.0 and shape[1].elongation == 1.0


@pytest.mark.parametrize("width", [3, 256])
def test_enclosure_by_flooding_the_boxes(spark, width):
    mask = np.random.default_rng(11).random((24, 31)) < 0.7
    zone = {at: z % 5 for at, z in flood(mask).items()}
    want = {}
    for z in set(zone.values()):
        own = {at for at, other in zone.items() if other == z}
        r0, r1, c0, c1 = min(r for r, _ in own) - 1, max(r for r, _ in own) + 1, min(c for _, c in own) - 1, max(c for _, c in own) + 1
        seen, stack = {(r0, c0)}, [(r0, c0)]
        while stack:
            r, c = stack.pop()
            more = {(r + dr, c + dc) for dr, dc in ((1, 0), (-1, 0), (0, 1), (0, -1)) if r0 <= r + dr <= r1 and c0 <= c + dc <= c1} - seen - own
            seen |= more
            stack += more
        want[z] = (r1 - r0 + 1) * (c1 - c0 + 1) - len(seen) - len(own)
    zones = spark.createDataFrame([(z, r, c) for (r, c), z in zone.items()], "zone long, row_i int, col_i int")
    assert {r.zone: r.holes for r in raster.enclosure(zones, width).collect()} == want and sum(want.values()) > 20
    assert raster.enclosure(zones.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1, 3, 512])
def test_budget_fill_by_a_plain_fold(spark, block):
    rng = np.random.default_rng(5)
    rows = [(int(g), i, float(rng.integers(1, 40)) / 4, float(rng.integers(0, 12))) for i, g in enumerate(rng.choice([1, 2, 3], 120, p=[0.8, 0.1, 0.1]))]
    odd = [(1, 900, None, 3.0), (1, 901, 0.0, 3.0), (2, 902, 1.0, None), (None, 903, 1.0, 9.0), (4, 904, 99.0, 1e6)]
    want = {}
    for g in (1, 2, 3):
        spent = stop = 0
        for _, i, h in sorted((-(v / h), i, h) for k, i, h, v in rows if k == g):
            if spent + h <= 20.0:
                spent, stop = spent + h, stop + 1
                want[i] = stop
    df = spark.createDataFrame(rows + odd, "g int, id long, hours double, value double")
    got = ranking.budget_fill(df, "g", 20.0, block).collect()
    assert len(got) == len(rows + odd) and {r.id: r.stop for r in got if r.stop} == want
    assert ranking.budget_fill(df.limit(0), "g", 20.0).collect() == []


def test_far_tiles_keep_few_segments(spark):
    """Tiles far from all lines keep the few that can be nearest there, not a band of them."""
    rng = np.random.default_rng(4)
    lines = [(i, *map(float, xy), float(xy[0] + 120), float(xy[1] - 150)) for i, xy in enumerate(rng.uniform(0, 1000, (400, 2)))]
    segments = spark.createDataFrame([(*s, s[0]) for s in lines], "id int, x1 double, y1 double, x2 double, y2 double, o int")
    points = spark.createDataFrame([(i, float(x), -20000.0 - 500.0 * i) for i, x in enumerate(rng.uniform(0, 1000, 60))], "k int, x double, y double")
    _, kept = spatial.nearest_candidates(points, segments, "k", "o")
    each = [r["count"] for r in kept.groupBy("px", "py").count().collect()]
    assert len(each) == 60 and sum(each) <= 3 * 60


def test_nearest_is_null_beyond_reach(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0)], "k int, x double, y double")
    lines = spark.createDataFrame([(7, 3, 10.0, -5.0, 10.0, 5.0), (6, 2, -10.0, -5.0, -10.0, 5.0)], "id int, o int, x1 double, y1 double, x2 double, y2 double")
    got = {r.k: (r.dist, r.o) for r in spatial.nearest_segment(points, lines, "k", 100.0, "o").collect()}
    assert got == {1: (10.0, 2), 2: (None, None)}


SPEC = {"name": "parts", "driver": "parquet", "params": {"path": "x"}, "transform": [{"filter": "a > 0"}], "load": {"target": "t", "mode": "upsert", "upsert_key": ["a"]}}


def test_intake_specs(spark, tmp_path):
    source = intake.Source.parse(SPEC)
    assert intake.Source.parse(source.dump()) == source
    assert source.cache_key("aoi") == intake.Source.parse(SPEC | {"transform": []}).cache_key("aoi") != source.cache_key("other")
    for bad in (SPEC | {"extra": 1}, SPEC | {"load": {"target": "t", "mode": "upsert"}}, SPEC | {"transform": [{"buffer": 1}]}):
        with pytest.raises(ValueError):
            intake.Source.parse(bad)
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    with pytest.raises(ValueError, match="there are: a, b"):
        intake.apply(df, [{"select": ["z"]}])
    with pytest.raises(ValueError, match="every row"):
        intake.apply(df, [{"filter": "a > 9"}], check_rows=True)
    df.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(2, "old"), (3, "old")], "a int, b string").write.parquet(str(tmp_path / "out"))
    run = intake.Source.parse(SPEC | {"params": {"path": str(tmp_path / "in")}})
    assert sorted(map(tuple, intake.run(spark, run, str(tmp_path / "out")).collect())) == [(1, "x"), (2, "y"), (3, "old")]


def test_semantic_layer(spark):
    model = semantic.Model("m", {"k": "k", "v": "v"}, {"n": ("count", "*")})
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    assert semantic.ask(model, df, ["k"], filters=["v >= 2", "k != 'b'"]).collect() == [("a", 1)]
    for call in (lambda: semantic.ask(model, df, ["x"]), lambda: semantic.ask(model, df, limit=9000), lambda: semantic.parse_filter("nonsense")):
        with pytest.raises(ValueError):
            call()


def test_ledger_and_stream(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with ledger.operation(spark, path, "score", "spark", {"a": 1}) as patch:
        patch["rows"] = 5
    with pytest.raises(KeyError), ledger.operation(spark, path, "zones", "spark", {}):
        raise KeyError("x" * 9000)
    last = {r.operation: r for r in ledger.latest(spark.read.parquet(path)).collect()}
    assert last["score"].status == "ok" and '"rows": 5' in last["score"].params
    assert last["zones"].status == "failed" and len(last["zones"].error) == ledger.ERROR_CHARS
    q = streaming.operations_per_window(spark, path).writeStream.outputMode("complete").format("memory").queryName("ops").start()
    try:
        q.processAllAvailable()
        assert spark.table("ops").agg(F.sum("n")).first()[0] == 4
    finally:
        q.stop()


def test_copies_of_segments_pair_all_their_ids(spark, monkeypatch):
    """Segments at one place meet others once, yet every pair of ids comes out, in blocks of any size."""
    monkeypatch.setattr(spatial, "BLOCK", 3)
    places = [(0.0, 0.0, 100.0, 100.0), (0.0, 100.0, 100.0, 0.0), (50.0, 50.0, 50.0, 50.0), (300.0, 0.0, 310.0, 0.0)]
    rows = [(i, 1 + i % 2, *places[i % 4]) for i in range(30)]
    lines = spark.createDataFrame(rows, "id long, stream_order int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.id_a, r.id_b) for r in spatial.crossings(lines).collect())
    # The point lies on both lines: a line that crosses it as the later one counts, as the rule of SQL has it.
    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    ends = lambda s, o: (side(s, *o[:2]), side(s, *o[2:]))
    meets = lambda a, b: ends(b, a)[0] * ends(b, a)[1] <= 0 and ends(a, b)[0] * ends(a, b)[1] <= 0 and ends(b, a) != (0, 0)
    near = lambda a, b: min(a[0], a[2]) <= max(b[0], b[2]) and max(a[0], a[2]) >= min(b[0], b[2])
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a[2:], b[2:]) and meets(a[2:], b[2:])) and len(got) > 40
    assert spatial.crossings(lines, lambda a, b: a > b + 5).isEmpty()
