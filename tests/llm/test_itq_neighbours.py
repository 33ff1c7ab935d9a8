import numpy as np
import pytest

from landrank.llm import itq_neighbours as itq


def brute(rows, threshold=0.98):
    """Links and components of all rows, every pair compared."""
    unit = {}
    for i, (vec, v, label) in enumerate(rows):
        if vec is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            unit[i] = x / np.linalg.norm(x)
    parent = {vec: vec for vec, _, _ in rows if vec is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    return [(vec, links[i], None if vec is None else find(vec)) for i, (vec, _, _) in enumerate(rows)]


def corpus():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist(), int(i % 4)) for i in range(500)]
    for c in range(6):
        centre = rng.normal(size=32)
        rows += [(1000 + 100 * c + k, (centre + 0.1 * rng.normal(size=32)).astype(np.float32).tolist(), c % 4) for k in range(60 if c else 90)]
    rows += [(5000 + k, rows[3][1], 3) for k in range(4)] + [(5010, rows[3][1], 2), (5011, rows[3][1], None), (None, rows[3][1], 3)]
    rows += [(6000, None, 1), (6001, [0.0] * 32, 1), (6002, [None] + [1.0] * 31, 1), (6003, [float("nan")] * 32, 1), (6004, [float("inf")] + [0.0] * 31, 1), (6005, [], 1), (6006, [1e30] * 32, 1), (6007, [1e-30] * 32, 1)]
    rows += [(6010, [1.0, 2.0], 1), (6011, [2.0, 4.0], 1)]
    return rows


@pytest.mark.parametrize("part", [None, 25])
def test_recall_against_brute_force(spark, monkeypatch, part):
    if part:
        monkeypatch.setattr(itq.link, "__defaults__", (itq.THRESHOLD, itq.SAMPLE, part))
        monkeypatch.setattr(itq, "_BLOCK", 16)
    rows = corpus()
    docs = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, n int")
    want = sorted(brute(rows), key=str)
    found = itq.embedding_dedup(docs).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
    assert np.mean([g[2] == w[2] for g, w in zip(got, want)]) >= 0.99


def test_all_unusable_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert itq.embedding_dedup(spark.createDataFrame([], schema)).count() == 0
    row = itq.embedding_dedup(spark.createDataFrame([(4, None, 1)], schema)).first()
    assert (row.n_links, row.component_id, row.kept) == (0, 4, True)


def test_codes_are_balanced():
    x = np.random.default_rng(1).normal(size=(2000, 16)) * np.arange(1, 17)
    mean, projection = itq.learn(x, 2)
    assert projection.shape == (16, 32)
    share = ((x - mean) @ projection >= 0).mean(0)
    assert (np.abs(share - 0.5) < 0.1).all()


@pytest.mark.parametrize("offset", [0, 1, 2, 4, 8])
def test_recall_with_a_common_direction(offset):
    # Codes as a table of 200,000 rows would have them; pairs just above the threshold.
    rng = np.random.default_rng(offset)
    x = rng.normal(size=(4000, 64)) + offset
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits, tables, mean, projection = itq.plan(x[:2000], 200_000)
    y = itq.moved(x, 0.981, seed=9)
    keys = [itq._chunks(z, mean, projection, bits, tables) for z in (x, y)]
    assert (keys[0] == keys[1]).any(1).mean() >= 0.99


def test_recall_of_tight_clusters():
    rng = np.random.default_rng(1)
    centres = np.repeat(rng.normal(size=(20, 48)) + 1.5, 100, 0)
    x = centres + 0.2 * rng.normal(size=centres.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits, tables, mean, projection = itq.plan(x, 1_000_000)
    keys = itq._chunks(x, mean, projection, bits, tables)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert len(a) > 1000
    assert (keys[a] == keys[b]).any(1).mean() >= 0.99


def test_components_of_links():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    comp = itq._join(np.arange(300), a, b)
    assert (comp[a] == comp[b]).all()
    reach = np.eye(300, dtype=bool)
    reach[a, b] = reach[b, a] = True
    for _ in range(9):
        reach = reach @ reach
    assert (comp == reach.argmax(1)).all()


def test_vectors_around_their_mean_keep_their_links():
    x = np.random.default_rng(0).normal(size=(2000, 64)) * 0.0125 + np.eye(64)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits, tables, mean, projection = itq.plan(x, 2000)
    assert itq._own_recall(x, itq._chunks(x, mean, projection, bits, tables), 0.98) >= 0.97
    assert itq._own_recall(x[:1], np.zeros((1, tables), np.int32), 0.98) == 1.0
