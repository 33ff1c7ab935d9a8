import numpy as np
import pytest

from landrank.operators import outlines

SIDES = [(-1, 0), (0, 1), (1, 0), (0, -1)]


def frame(spark, grid):
    return spark.createDataFrame([(int(grid[r, c]), int(r), int(c)) for r, c in np.argwhere(grid >= 0)], "zone long, row_i int, col_i int")


def shoelace(points):
    """Twice the area on the map (rows down), clockwise positive."""
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]))


def got_rings(spark, grid, tile):
    corners, rounds = outlines.rings(frame(spark, grid), *grid.shape, tile)
    found = {}
    for r in sorted(corners.collect(), key=lambda r: r["seq"]):
        ring = found.setdefault((r["zone"], r["ring"]), {"points": [], "area2": r["area2"], "edges": r["n_edges"]})
        assert r["seq"] == len(ring["points"])
        ring["points"].append((r["x"], r["y"]))
    return found, rounds


def check(grid, found):
    """Rings enclose exactly the zone's cells, hold all its edges, and turn at every corner."""
    for z in np.unique(grid[grid >= 0]).tolist():
        mine = {k: v for k, v in found.items() if k[0] == z}
        assert sum(v["area2"] for v in mine.values()) == 2 * int((grid == z).sum())
        free = sum(not (0 <= r + dr < grid.shape[0] and 0 <= c + dc < grid.shape[1] and grid[r + dr, c + dc] == z) for r, c in np.argwhere(grid == z) for dr, dc in SIDES)
        assert sum(v["edges"] for v in mine.values()) == free
        for v in mine.values():
            p = v["points"]
            assert shoelace(p) == v["area2"]
            assert sum(abs(a - c) + abs(b - d) for (a, b), (c, d) in zip(p, p[1:] + p[:1])) == v["edges"]
            for (ax, ay), (bx, by), (cx, cy) in zip(p, p[1:] + p[:1], p[2:] + p[:2]):
                assert (ax == bx) != (ay == by) and (ax == bx) == (by == cy) and (ay == by) == (bx == cx)


@pytest.mark.parametrize("tile", [64, 5, 3])
def test_rings_of_random_zones_whatever_the_tile(spark, tile):
    rng = np.random.default_rng(7)
    grid = np.kron(rng.integers(-1, 3, (9, 8)), np.ones((2, 2), int))
    grid[rng.random(grid.shape) < 0.2] = -1
    found, _ = got_rings(spark, grid, tile)
    check(grid, found)
    if tile != 64:
        whole, _ = got_rings(spark, grid, 64)
        turned = lambda v: min(v["points"][k:] + v["points"][:k] for k in range(len(v["points"])))
        assert {k: turned(v) for k, v in found.items()} == {k: turned(v) for k, v in whole.items()}


def test_holes_and_point_contacts(spark):
    grid = np.full((7, 9), -1)
    grid[1:6, 1:6] = 1
    grid[2:4, 2:4] = -1
    grid[4, 4] = -1
    grid[0, 0] = 1
    grid[6, 6] = 1
    found, _ = got_rings(spark, grid, 4)
    check(grid, found)
    outer = [v["area2"] for v in found.values() if v["area2"] > 0]
    assert sorted(outer) == [2, 2, 50] and sum(v["area2"] < 0 for v in found.values()) == 1
    text = {r["zone"]: r["wkt"] for r in outlines.polygons(outlines.rings(frame(spark, np.where(grid >= 0, -1, 3)[2:4, 2:4]), 2, 2)[0], 0.0, 20.0, 10.0).collect()}
    assert text == {3: "POLYGON ((0 20, 20 20, 20 0, 0 0, 0 20))"}


def test_long_ring_takes_few_rounds(spark):
    """A frame of 60 x 60 through tiles of 4: some 118 chains in a ring."""
    grid = np.full((60, 60), -1)
    grid[[0, -1], :] = grid[:, [0, -1]] = 5
    found, rounds = got_rings(spark, grid, 4)
    check(grid, found)
    assert len(found) == 2 and rounds <= 2 * 8


def test_no_zones(spark):
    assert outlines.rings(frame(spark, np.full((3, 3), -1)), 3, 3)[0].count() == 0
