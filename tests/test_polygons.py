import math

import numpy as np
import pytest

from landrank.operators import polygons

EDGES = "poly long, x1 double, y1 double, x2 double, y2 double"


def ring(poly, points):
    return [(poly, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1])]


def star(rng, cx, cy, size, n):
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    far = rng.uniform(0.4, 1.0, n) * size
    return [(round(cx + f * math.cos(t), 3), round(cy + f * math.sin(t), 3)) for f, t in zip(far, angle)]


def inside(edges, x, y):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for _, x1, y1, x2, y2 in edges) % 2 == 1


@pytest.fixture(scope="module")
def shapes():
    """A star with a hole and a second part, a box of whole numbers, a sliver and a large one over all."""
    rng = np.random.default_rng(6)
    return {
        1: ring(1, star(rng, 300, 300, 200, 17)) + ring(1, star(rng, 300, 300, 60, 7)) + ring(1, star(rng, 700, 650, 90, 5)),
        2: ring(2, [(100, 100), (740, 100), (740, 420), (100, 420)]),
        3: ring(3, [(0, 0), (900, 1), (900, 2)]),
        4: ring(4, star(rng, 450, 450, 900, 40)),
    }


def test_points_inside_and_few_tests(spark, shapes):
    edges = spark.createDataFrame([e for s in shapes.values() for e in s], EDGES)
    points = [(k, 10.0 * (k % 90) + 5, 10.0 * (k // 90) + 5) for k in range(8100)]
    table = spark.createDataFrame(points, "k long, x double, y double")
    got = {(r["k"], r["poly"]) for r in polygons.points_inside(table, edges, 20.0).collect()}
    assert got == {(k, p) for k, x, y in points for p, e in shapes.items() if inside(e, x, y)}
    assert polygons.tested_share(table, edges.filter("poly in (2, 4)"), 20.0) < 0.15


def test_segments_meeting_polygons(spark, shapes):
    rng = np.random.default_rng(9)
    lines = [(k, *map(float, np.round(rng.uniform(0, 900, 2), 2)), *map(float, np.round(rng.uniform(0, 900, 2), 2))) for k in range(60)] + [(60, 310.0, 320.0, 311.0, 321.0)]
    got = {(r["k"], r["poly"]) for r in polygons.segments_meeting(spark.createDataFrame(lines, "k long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame([e for s in shapes.values() for e in s], EDGES), "k", 40.0).collect()}
    steps = np.linspace(0, 1, 3000)
    for k, x1, y1, x2, y2 in lines:
        for p, e in shapes.items():
            if p != 3:
                touched = any(inside(e, x1 + t * (x2 - x1), y1 + t * (y2 - y1)) for t in steps[:: 1 if (k, p) in got else 7])
                assert touched == ((k, p) in got)


def even_odd_area(edges):
    """Area between neighbouring corners and crossings, slab by slab."""
    ys = {e[k] for e in edges for k in (2, 4)}
    for i, (_, ax, ay, bx, by) in enumerate(edges):
        for _, cx, cy, dx, dy in edges[i + 1 :]:
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if turn:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / turn
                if 0 <= t <= 1 and 0 <= u <= 1:
                    ys.add(ay + t * (by - ay))
    ys, total = sorted(ys), 0.0
    for lo, hi in zip(ys, ys[1:]):
        mid = (lo + hi) / 2
        xs = sorted(x1 + (mid - y1) * (x2 - x1) / (y2 - y1) for _, x1, y1, x2, y2 in edges if (y1 > mid) != (y2 > mid))
        total += (hi - lo) * sum(b - a for a, b in zip(xs[::2], xs[1::2]))
    return total


def test_repair_keeps_the_even_odd_area(spark, shapes):
    rng = np.random.default_rng(3)
    tangle = [tuple(map(float, np.round(rng.uniform(0, 100, 2), 2))) for _ in range(9)]
    broken = {
        10: ring(10, [(0, 0), (10, 10), (10, 0), (0, 10)]),  # bow-tie
        11: ring(11, [(0, 0), (10, 0), (10, 10), (5, 10), (5, 15), (5, 10), (0, 10)]),  # a spike
        12: ring(12, [(0, 0), (5, 0), (9, 0), (5, 0)]),  # no area
        13: ring(13, tangle),
        14: ring(14, [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring(14, [(5, 0), (15, 0), (15, 10), (5, 10)]),  # overlap along a line
        15: ring(15, [(0, 0), (4, 0), (4, 4), (8, 4), (8, 8), (4, 8), (4, 4), (0, 4)]),  # touches itself in a point
    } | {1: shapes[1]}
    corners, _ = polygons.repaired(spark.createDataFrame([e for s in broken.values() for e in s], EDGES), 30.0)
    rows = corners.collect()
    areas = {(r["poly"], r["ring"]): r["area"] for r in polygons.ring_areas(corners).collect()}
    for p, e in broken.items():
        assert sum(v for k, v in areas.items() if k[0] == p) == pytest.approx(even_odd_area(e), abs=1e-3)
    rings_of = lambda p: sorted(round(v, 3) for k, v in areas.items() if k[0] == p)
    assert rings_of(10) == [25.0, 25.0] and rings_of(12) == [] and rings_of(15) == [16.0, 16.0] and rings_of(14) == [50.0, 50.0]
    for key in areas:
        seq = sorted(r["seq"] for r in rows if (r["poly"], r["ring"]) == key)
        assert seq == list(range(len(seq)))
        places = [(r["x"], r["y"]) for r in rows if (r["poly"], r["ring"]) == key]
        assert len(set(places)) == len(places)


def test_no_polygons(spark):
    none = spark.createDataFrame([], EDGES)
    assert polygons.points_inside(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), none).count() == 0
    assert polygons.repaired(none)[0].count() == 0
