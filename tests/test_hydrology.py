import heapq
import math

import numpy as np
import pytest

from landrank import catalog
from landrank.operators import hydrology as hy
from landrank.operators.raster import WAYS


def plain(z):
    """(way, breached height) by Prim over whole basins; way is 8 where a cell leaves."""
    h, w = z.shape
    there = {(r, c): float(z[r, c]) for r in range(h) for c in range(w) if not math.isnan(z[r, c])}
    way = {}
    for (r, c), x in there.items():
        drops = [(round((x - there[r + dr, c + dc]) / math.hypot(dr, dc) * 1e6), -k) for k, (dr, dc) in enumerate(WAYS) if (r + dr, c + dc) in there]
        best = max(drops, default=(0, 0))
        way[r, c] = -best[1] if best[0] > 0 else 8
    step = lambda p: (p[0] + WAYS[way[p]][0], p[1] + WAYS[way[p]][1])
    pit = {}
    for p in there:
        q = p
        while way[q] < 8:
            q = step(q)
        pit[p] = q
    key = lambda p: -1 if p is None else p[0] * w + p[1]
    steps = {}
    for p in there:
        for dr, dc in WAYS:
            q = (p[0] + dr, p[1] + dc)
            if q not in there:
                steps.setdefault(None, []).append((there[p], -1, key(p), p, None))
            elif pit[p] != pit[q]:
                steps.setdefault(pit[q], []).append((max(there[p], there[q]), min(key(p), key(q)), max(key(p), key(q)), p, q))
    seen, leave, heap = {None}, {}, []
    for s in steps.get(None, ()):
        heapq.heappush(heap, s)
    while heap:
        *_, a, b = heapq.heappop(heap)
        if pit[a] in seen:
            continue
        seen.add(pit[a])
        leave[pit[a]] = (a, b)
        for s in steps.get(pit[a], ()):
            heapq.heappush(heap, s)
    new = dict(way)
    for p, (a, b) in leave.items():
        path = [a]
        while path[-1] != p:
            path.append(step(path[-1]))
        for x, y in zip(path, path[1:]):
            new[y] = (way[x] + 4) % 8
        new[a] = 8 if b is None else WAYS.index((b[0] - a[0], b[1] - a[1]))
    low = dict(there)
    for p, x in there.items():
        q = p
        while True:
            low[q] = min(low[q], x)
            if new[q] == 8:
                break
            q = (q[0] + WAYS[new[q]][0], q[1] + WAYS[new[q]][1])
    return new, low


def frame(spark, z):
    return spark.createDataFrame([(int(r), int(c), float(z[r, c])) for r, c in np.argwhere(~np.isnan(z))], "row_i int, col_i int, z double")


def raster(seed, h, w, kind):
    rng = np.random.default_rng(seed)
    z = rng.random((h, w)) * 10 if kind != "flat" else rng.integers(0, 4, (h, w)).astype(float)
    if kind == "holes":
        z[rng.random((h, w)) < 0.1] = np.nan
    if kind == "bowl":
        r, c = np.mgrid[:h, :w]
        z = (r - h / 2) ** 2 + (c - w / 2) ** 2 + rng.random((h, w)) * 30
    return z


@pytest.mark.parametrize("kind,tile,fan", [("noise", 64, 8), ("noise", 5, 2), ("flat", 5, 8), ("flat", 4, 2), ("holes", 5, 2), ("bowl", 7, 2)])
def test_breached_ways_whatever_the_tile(spark, monkeypatch, kind, tile, fan):
    monkeypatch.setattr(hy.set_exits, "__defaults__", (hy.TILE, fan))
    z = raster(3, 19, 17, kind)
    way, low = plain(z)
    got = hy.breached(frame(spark, z), "z", 19, 17, tile).collect()
    assert {(r["row_i"], r["col_i"]): (8 if r["dir"] is None else r["dir"], r["breached"]) for r in got} == {p: (way[p], low[p]) for p in way}


def test_no_pit_is_left_inside(spark):
    z = raster(8, 30, 23, "noise")
    got = {(r["row_i"], r["col_i"]): r for r in hy.breached(frame(spark, z), "z", 30, 23, 8).collect()}
    for (r, c), row in got.items():
        if row["dir"] is None:
            assert r in (0, 29) or c in (0, 22)
        else:
            dr, dc = WAYS[row["dir"]]
            assert got[r + dr, c + dc]["breached"] <= row["breached"]


def test_rounds_grow_with_the_logarithm(spark):
    """A way through 64 tiles in a row takes some six rounds."""
    n = 256
    ways = spark.createDataFrame([(0, c, 2 if c < n - 1 else None) for c in range(n)], "row_i int, col_i int, dir int").withColumn("one", hy.F.lit(1))
    out, rounds = hy.accumulate(ways, "one", "sum", n, 4)
    assert {r["col_i"]: r["one"] for r in out.collect()} == {c: c + 1.0 for c in range(n)} and rounds <= 7
    ends, rounds = hy.way_ends(ways, n, 4)
    assert {(r["end_r"], r["end_c"]) for r in ends.collect()} == {(0, n - 1)} and rounds <= 7


def test_height_above_stream_by_tiles(spark):
    z = raster(5, 24, 20, "noise")
    way, low = plain(z)
    count = dict.fromkeys(way, 0)
    for p in way:
        q = p
        while True:
            count[q] += 1
            if way[q] == 8:
                break
            q = (q[0] + WAYS[way[q]][0], q[1] + WAYS[way[q]][1])
    want = {}
    for p in way:
        q = p
        while count[q] < 9 and way[q] < 8:
            q = (q[0] + WAYS[way[q]][0], q[1] + WAYS[way[q]][1])
        want[p] = round(float(z[p] - z[q]), 6) if count[q] >= 9 else None
    cells = frame(spark, z)
    ways = hy.breached(cells, "z", 24, 20, 6)
    got = hy.height_above_stream(ways, cells, "z", 20, 9, 6).collect()
    assert {(r["row_i"], r["col_i"]): r["hand"] for r in got} == want


def test_one_cell_and_no_cells(spark):
    one = frame(spark, np.array([[4.0]]))
    assert [tuple(r) for r in hy.breached(one, "z", 1, 1).collect()] == [(0, 0, None, 4.0)]
    assert hy.breached(one.filter("false"), "z", 1, 1).count() == 0


def shuffled(spark, job):
    """Rows that a job writes to shuffles."""
    context = spark.sparkContext._jsc.sc()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, quantiles, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = written()
    job()
    return sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize("name", ["height_above_stream_breached", "flow_accumulation_breached", "flow_breached"])
def test_cells_are_shuffled_once(spark, name):
    """Between the deal to tiles and the result only what lies on borders travels."""
    cells = 15000
    job = lambda: catalog.QUERIES[name](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    assert cells <= shuffled(spark, job) < 2 * cells
