import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from landrank import catalog
from landrank.operators import discs, gridding
from landrank.operators.resample import Grid

from .test_hydrology import shuffled


def flood(on):
    """Components of a set of cells, by their first cells."""
    left, out = set(on), []
    for cell in sorted(on):
        if cell in left:
            part, start = [], [cell]
            left.discard(cell)
            while start:
                r, c = start.pop()
                part.append((r, c))
                for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if n in left:
                        left.discard(n)
                        start.append(n)
            out.append(sorted(part))
    return out


def test_labels_of_random_masks():
    rng = np.random.default_rng(1)
    for _ in range(100):
        on = rng.random((9, 11)) < rng.choice([0.2, 0.5, 0.8])
        got = discs.labelled(on)
        want = flood([tuple(map(int, c)) for c in np.argwhere(on)])
        assert got.max(initial=0) == len(want) and (got > 0).sum() == on.sum()
        for k, part in enumerate(want, 1):
            assert all(got[c] == k for c in part)


def test_shapes_of_clusters():
    """As the shapes of zones have them; a frame encloses its inside."""
    line = np.array([(2, c) for c in range(9)])
    assert discs.shape(line[:, 0], line[:, 1]) == (9.0, 9.0, 1.0) and discs.enclosed(line[:, 0], line[:, 1]) == 0.0
    frame = np.array([(r, c) for r in range(5) for c in range(4) if r in (0, 4) or c in (0, 3)])
    assert discs.enclosed(frame[:, 0], frame[:, 1]) == round(6 / 20, 2) and discs.shape(frame[:, 0], frame[:, 1])[1:] == (5.0, 0.7)
    gap = frame[1:]
    assert discs.enclosed(gap[:, 0], gap[:, 1]) == round(6 / 19, 2)
    open_ = np.array([c for c in frame.tolist() if c != [2, 0]])
    assert discs.enclosed(open_[:, 0], open_[:, 1]) == 0.0
    assert discs.shape(frame[:3, 0], frame[:3, 1]) == (1.0, 0.0, 1.0)


def test_clusters_against_plain_python(spark):
    rng = np.random.default_rng(2)
    z = {n: rng.normal(size=(40, 40)) for n in ("a", "b")}
    z["a"][rng.random((40, 40)) < 0.05] = np.nan
    cells = [(10.0 * c + 5, 395.0 - 10 * r, float(z["a"][r, c]), float(z["b"][r, c])) for r in range(40) for c in range(40)]
    places = [(1, 203.0, 188.0), (2, 150.0, 260.0), (3, 5.0, 5.0), (4, 9000.0, 9000.0)]
    found = discs.clusters(spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(cells, "x double, y double, a double, b double"), {"a": "high", "b": "low"}, 10.0, 60.0, 120.0, 0.8, 3)
    rows = {}
    for r in found.collect():
        rows.setdefault((r["id"], r["surface"]), []).append(r)
    assert set(rows) == {(p, s) for p in (1, 2, 3, 4) for s in "ab"}
    for (p, s), mine in rows.items():
        _, px, py = places[p - 1]
        values = {(r, c): (math.hypot(10 * c + 5 - px, 395 - 10 * r - py), z[s][r, c]) for r in range(40) for c in range(40) if not math.isnan(z[s][r, c])}
        ring, disc = [v for d, v in values.values() if 60 < d <= 120], {k: v for k, (d, v) in values.items() if d <= 60}
        if p in (3, 4):
            assert len(mine) == 1 and not mine[0]["valid"] and mine[0]["cluster"] is None
            continue
        cut = np.quantile(ring, 0.8 if s == "a" else 0.2)
        want = flood([k for k, v in disc.items() if (v >= cut if s == "a" else v <= cut)])
        assert (mine[0]["n_ring"], mine[0]["n_disc"]) == (len(ring), len(disc))
        got = sorted(mine, key=lambda r: r["cluster"])
        assert [r["cells"] for r in got] == [len(w) for w in want]
        r0, c0 = min(k[0] for k in disc), min(k[1] for k in disc)
        shift = (got[0]["row_c"] - np.mean([k[0] for k in want[0]]), got[0]["col_c"] - np.mean([k[1] for k in want[0]]))
        assert all(r["row_c"] - shift[0] == pytest.approx(np.mean([k[0] for k in w])) and r["col_c"] - shift[1] == pytest.approx(np.mean([k[1] for k in w])) for r, w in zip(got, want)) and r0 >= 0 and c0 >= 0
    with pytest.raises(ValueError, match="high or low"):
        discs.clusters(None, None, {"a": "up"}, 1.0, 1.0, 2.0)


FOUND = "id long, surface string, valid boolean, cluster int, cells long, row_c double, col_c double, elongation double"


def test_pairs_are_between_clusters_of_one_place(spark):
    rows = [
        (1, "a", True, 1, 5, 3.0, 3.0, 1.0), (1, "b", True, 1, 5, 3.0, 6.0, 1.0),  # 3 cells apart
        (2, "a", True, 1, 5, 3.0, 3.0, 1.0), (2, "b", True, 1, 5, 3.0, 6.1, 1.0),  # just too far
        (3, "a", True, 1, 5, 3.0, 3.0, 9.0), (3, "b", True, 1, 5, 3.0, 4.0, 1.0),  # the first fails the gate
        (4, "a", True, None, None, None, None, None), (4, "b", False, None, None, None, None, None),
        *[(5, "a", True, k, 5, 50.0 * k, 0.0, 1.0) for k in range(1, 6)], (5, "a", True, 6, 5, 3.0, 3.0, 1.0), (5, "b", True, 1, 5, 3.0, 3.0, 1.0),  # only the sixth is near
    ]
    table, gate = spark.createDataFrame(rows, FOUND), F.col("elongation") <= 4
    got = {r["id"]: (r["fired_a"], r["fired_b"], r["paired"], r["hit"]) for r in discs.paired(table, "a", "b", 30.0, 10.0, gate).collect()}
    assert got == {1: (True, True, True, True), 2: (True, True, False, False), 3: (False, True, False, False), 4: (False, False, False, False), 5: (True, True, False, False)}
    assert {r["id"] for r in discs.paired(table, "a", "b", 30.0, 10.0, gate, most=None).filter("hit").collect()} == {1, 5}


def test_several_small_regular_clusters(spark):
    line = lambda p, places: [(p, "a", True, k, 3, 0.0, float(c), 1.0) for k, c in enumerate(places)]
    rows = line(1, [0, 2, 4, 6]) + line(2, [0, 1, 6, 7.5, 20]) + line(3, [0, 2]) + [(4, "a", True, 0, 90, 0.0, 0.0, 1.0), (4, "a", True, 1, 3, 0.0, 2.0, 1.0), (5, "a", False, None, None, None, None, None)]
    got = {r["id"]: r for r in discs.several(spark.createDataFrame(rows, FOUND), "a", 3, 25.0, 0.3, 10.0, F.col("cells") <= 6).collect()}
    assert (got[1]["elements"], got[1]["nn_mean_m"], got[1]["nn_cv"], got[1]["satisfied"]) == (4, 20.0, 0.0, True)
    near = np.array([1, 1, 1.5, 1.5, 12.5]) * 10
    assert (got[2]["nn_mean_m"], got[2]["nn_cv"], got[2]["satisfied"]) == (round(near.mean(), 1), round(near.std() / near.mean(), 2), False)
    assert [(got[k]["elements"], got[k]["nn_mean_m"], got[k]["satisfied"]) for k in (3, 4, 5)] == [(2, None, False), (1, None, False), (0, None, False)]


def test_gridding_by_inverse_distance(spark):
    rng = np.random.default_rng(3)
    points = [(float(x), float(y), float(v)) for x, y, v in zip(rng.uniform(-20, 120, 300), rng.uniform(-20, 90, 300), rng.normal(size=300))]
    points += [(5.0, 75.0, 7.0), (5.0, 75.0, 9.0), (50.0, 40.0, float("nan"))]
    grid = Grid(0.0, 80.0, 10.0, 8, 10)
    table = spark.createDataFrame([*points, (50.0, 40.0, None)], "x double, y double, z double")
    for radius, power in ((None, 1.0), (23.0, 2.0), (3.0, 1.0)):
        got = {(r["row_i"], r["col_i"]): (r["points"], r["value"]) for r in gridding.inverse_distance(table, grid, radius, power).collect()}
        assert len(got) == 80
        for (r, c), (n, value) in got.items():
            near = [(math.hypot(x - 10 * c - 5, y - 75 + 10 * r), v) for x, y, v in points if v == v]
            near = [(d, v) for d, v in near if d <= (radius or 10 * math.sqrt(2))]
            assert n == len(near)
            exact = [v for d, v in near if d == 0]
            want = np.mean(exact) if exact else sum(v / d**power for d, v in near) / sum(d**-power for d, _ in near) if near else None
            assert value == (pytest.approx(want) if near else None)


def test_gridding_sums_cells_in_one_part(spark):
    """Points in any order: what leaves the sums is a row a cell, not one for every task that saw it."""
    grid = Grid(0.0, 1280.0, 10.0, 128, 128)
    table = spark.range(0, 60000, 1, 16).select((F.rand(1) * 1280).alias("x"), (F.rand(2) * 1280).alias("y"), F.col("id").cast("double").alias("z"))
    rows = shuffled(spark, lambda: gridding.inverse_distance(table, grid).write.format("noop").mode("overwrite").save())
    assert 60000 < rows < 60000 + 4 * 128 * 128


def test_places_with_the_same_coordinates_are_looked_at_once(spark):
    places = spark.createDataFrame([(5, 1.0, 2.0), (3, 1.0, 2.0), (4, 1.0, 2.0), (9, 0.0, 0.0), (7, None, 1.0)], "id long, x double, y double")
    asked = []

    def rule(one):
        asked.append(one.count())
        return one.select("id", F.col("x").alias("seen"))

    got = discs.each_place(places, rule)
    assert asked == [3] and sorted(map(tuple, got.collect())) == [(3, 1.0), (4, 1.0), (5, 1.0), (7, None), (9, 0.0)]


def test_pair_rule_compares_all_clusters(spark, tmp_path):
    """A disc with six high clusters, of which only the last is near the low one; SQL says the same, and of another site at its place."""
    high, low = [(7, 4), (9, 2), (9, 6), (11, 1), (11, 5), (13, 3)], (14, 3)  # first cells of runs of three
    rows = []
    for key in range(3000):
        row, col = divmod(key, 100)
        disc = math.hypot(500005.0 + 10 * col - 500053.0, 4000005.0 - 10 * row - 3999899.0) <= 40
        run = lambda r, c: row == r and c <= col < c + 3
        elev = 220.0 if not disc else 230.0 if any(run(*h) for h in high) else 210.0
        price = (elev - (150.0 + 20.0 * math.sin(col / 9.0) + 15.0 * math.cos(row / 11.0))) * 500000.0
        rows.append((key, 20 if not disc else 0 if run(*low) else 30, price, "O", "1-URGENT"))
    tables = {
        "orders": spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string"),
        "customer": spark.createDataFrame([(1, "BUILDING"), (3001, "BUILDING"), (2, "BUILDING")], "c_custkey long, c_mktsegment string"),
    }
    con = duckdb.connect()
    for name, table in tables.items():
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["site_id", "valid", "fired_high", "fired_low", "paired", "hit"]
    want = [(1, True, True, True, True, True), (3001, True, True, True, True, True)]
    assert sorted(map(tuple, catalog.QUERIES["pair_rule"](spark, str(tmp_path)).select(columns).collect())) == want
    assert sorted(con.sql(catalog.ORACLE_SQL["pair_rule"]).select(*columns).fetchall()) == want
