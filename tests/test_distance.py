import numpy as np
import pytest

from landrank.operators import distance


def brute(marked, rows, cols):
    out = {}
    for r in range(rows):
        for c in range(cols):
            near = min((((a - r) ** 2 + (b - c) ** 2, a, b, v) for a, b, v in marked), default=None)
            out[r, c] = (None, None) if near is None else (round(10.0 * near[0] ** 0.5, 6), near[3])
    return out


@pytest.mark.parametrize("cells,share", [(1 << 22, 0.1), (40, 0.1), (40, 0.01), (16, 0.5), (90, 0.0), (1, 0.05)])
def test_distance_and_value_of_the_nearest(spark, monkeypatch, cells, share):
    monkeypatch.setattr(distance, "TASK_CELLS", cells)
    rng = np.random.default_rng(cells)
    rows, cols = 17, 13
    marked = [(int(r), int(c), float(r * 100 + c)) for r, c in np.argwhere(rng.random((rows, cols)) < share)]
    table = spark.createDataFrame([*marked, (-1, 3, 5.0), (3, cols, 5.0)], "row_i int, col_i int, v double")
    got = {(r["row_i"], r["col_i"]): (None if r["dist"] is None else round(r["dist"], 6), r["v"]) for r in distance.distance_to_marked(table, rows, cols, 10.0, "v").collect()}
    assert got == brute(marked, rows, cols)


def test_ties_go_to_the_smaller_row_and_column():
    rng = np.random.default_rng(2)
    for _ in range(200):
        w = int(rng.integers(1, 12))
        drow, row = rng.integers(0, 9, (3, w)) ** 2, rng.integers(0, 4, (3, w))
        drow[rng.random((3, w)) < 0.3] = distance._FAR
        got = distance._envelope(drow, row)
        for i in range(3):
            for c in range(w):
                near = min(((drow[i, q] + (q - c) ** 2, row[i, q], q) for q in range(w) if drow[i, q] < distance._FAR), default=(0, 0, -1))
                assert got[i, c] == near[2]


def test_two_shuffles_of_rows(spark):
    table = spark.createDataFrame([(1, 2, 1.0)], "row_i int, col_i int, v double")
    plan = distance.distance_to_marked(table, 1000, 1000, 1.0, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("FlatMapCoGroupsInArrow") == 1
