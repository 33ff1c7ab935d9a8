import hashlib
import itertools
import math

import numpy as np
import pytest

from landrank.llm import zone_clusters as zc

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    """The contract in Python's integers, vector by vector."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in hashed[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in found if c == n) for n in range(len(centroids))]
    fit = lambda x: x if x < 2**63 else None
    return sorted(((i, c, fit(d), fit(inertia[c]), fit(sum(inertia)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found), key=str)


def _rows(n, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, 64)) / 8
    x = (centre[rng.integers(0, 9, n)] + spread * rng.normal(size=(n, 64)) / 8).astype(np.float32)
    return [(i, v, "x", 1) for i, v in enumerate(x.tolist())]


ODD = [
    (None, [0.5] * 64, "c", 1), (None, [-0.25] * 64, "c", None), (7, None, "c", 1), (8, [], "c", 1), (9, [0.1] * 63, "c", 1), (10, [0.1] * 63 + [None], "c", 1),
    (11, [0.1] * 63 + [math.nan], "c", 1), (12, [0.1] * 63 + [math.inf], "c", 1), (900, [0.0] * 64, "c", 1), (900, [0.0] * 64, "c", 1), (901, [0.0] * 64, None, 1),
]


def got(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("bits,axes", [(3, 2), (2, 3), (1, 4), (4, 1)])
def test_hilbert_order_steps_to_neighbours(bits, axes):
    points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    key = zc.hilbert_key(points, bits)
    assert sorted(key.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_candidates_hold_the_nearest_of_every_point():
    rng = np.random.default_rng(4)
    for _ in range(200):
        centre = rng.integers(-9, 9, (6, 3)).astype(float)
        x = rng.integers(-9, 9, (4, 3)).astype(float)
        able = set(zc.candidates(x.min(0), x.max(0), centre).tolist())
        far = ((x[:, None] - centre) ** 2).sum(2)
        assert set(np.flatnonzero((far == far.min(1, keepdims=True)).any(0)).tolist()) <= able


@pytest.mark.parametrize("block", [1024, 7])
def test_clusters_against_brute_force(spark, block):
    rows = _rows(300, 1) + ODD
    out, _ = zc.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block)
    assert got(out) == brute(rows)


def test_huge_components_stay_exact(spark):
    rows = _rows(40, 2) + [(1000, [3e38] * 64, "c", 1), (1001, [-3e38] + [1e20] * 63, "c", 1), (1002, [1e6] * 64, "c", 1)] + ODD
    assert got(zc.cluster_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_few_equal_and_no_vectors(spark):
    few = _rows(5, 3) + [(50, [0.25] * 64, "c", 1)] * 9
    assert got(zc.cluster_vectors(spark.createDataFrame(few, SCHEMA))) == brute(few)
    none = zc.cluster_vectors(spark.createDataFrame(ODD[2:5], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_blocks_spare_comparisons(spark):
    rows = _rows(4000, 5, 0.02)
    good = zc.good_vectors(spark.createDataFrame(rows, SCHEMA), 64)
    zones = zc.zone_table(good, 64, 64, block=64)
    centroids = zc.Centroids(zc.first_centroids(good, 16, 64))
    count, _, work = zc.totals(zones, centroids, 64)
    assert sum(count.values()) == 4000 and work < 0.4 * 16 * 4000
