import math

import numpy as np
import pytest

from landrank.operators import detection, spatial
from landrank.operators.resample import Grid


def gap(line, x0, y0, x9, y9):
    """Distance of a segment to a box, from many points of the segment."""
    x1, y1, x2, y2 = line
    return min(math.hypot(max(x0 - x, x - x9, 0), max(y0 - y, y - y9, 0)) for k in range(4001) for x, y in [(x1 + (x2 - x1) * k / 4000, y1 + (y2 - y1) * k / 4000)])


def test_cells_that_a_buffer_touches(spark):
    rng = np.random.default_rng(4)
    lines = [tuple(map(float, rng.uniform(-50, 350, 4))) for _ in range(6)] + [(120.0, 80.0, 120.0, 80.0), (30.0, 0.0, 30.0, 300.0)]
    cells = [(r, c) for r in range(30) for c in range(30)]
    segments = spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double")
    for d in (0.0, 17.0):
        got = {tuple(r) for r in spatial.cells_near(spark.createDataFrame(cells, "row_i int, col_i int"), segments, d, 0.0, 300.0, 10.0, 64.0).collect()}
        for r, c in cells:
            near = min(gap(line, 10 * c, 290 - 10 * r, 10 * c + 10, 300 - 10 * r) for line in lines)
            if abs(near - d) > 0.3:
                assert ((r, c) in got) == (near <= d)


def test_a_slanting_line_takes_no_rectangle(spark):
    """Two zones beside a diagonal: one under its buffer, one in the corner of its box."""
    zones = [(1, k, k) for k in range(5, 15)] + [(2, r, c) for r in range(15, 19) for c in range(1, 5)]
    lines = spark.createDataFrame([(0.0, 200.0, 200.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    table, grid = spark.createDataFrame(zones, "zone long, row_i int, col_i int"), Grid(0.0, 200.0, 10.0, 20, 20)
    assert [tuple(r) for r in detection.exclude_near(table, lines, 20.0, grid).collect()] == [(2, 16, 0.0)]
    for empty in (lines.filter("false"), lines.selectExpr("x1 + 900 AS x1", "y1", "x2 + 900 AS x2", "y2")):
        with pytest.raises(ValueError, match="nothing in this frame"):
            detection.exclude_near(table, empty, 20.0, grid)
