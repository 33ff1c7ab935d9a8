import random

import pytest

from landrank.llm import cube_mixing as cm


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_both_totals(seed):
    rng = random.Random(seed)
    size = [float(rng.randint(1, 50)) for _ in range(300)]
    prob = [rng.random() for _ in size]
    out = cm.flight(prob, size, random.Random(1))
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(sum(prob), abs=1e-6)
    assert sum(p * s for p, s in zip(out, size)) == pytest.approx(sum(p * s for p, s in zip(prob, size)), abs=1e-4)
    assert all(p in (0, 1) for p in cm.land(out, size))


@pytest.mark.parametrize("seed", range(6))
def test_landing_with_a_few_large_units(seed):
    """A document of thousands of words in a source of some thousand: words come within a hundredth, documents give way a little."""
    rng = random.Random(seed)
    size = [5184.0, 900.0, 700.0, *[float(int(rng.lognormvariate(4.5, 1.0)) + 1) for _ in range(60)]]
    prob = [rng.uniform(0.2, 0.8)] * len(size)
    out = cm.land(cm.fly(prob, size, random.Random(2)), size)
    want = sum(p * s for p, s in zip(prob, size))
    assert all(p in (0, 1) for p in out) and abs(sum(out) - sum(prob)) <= 10
    reach = max(0.0, prob[0] * 5184 - sum((1 - prob[0]) * s for s in sorted(size[1:])[-12:])) if out[0] == 0 else max(0.0, (1 - prob[0]) * 5184 - sum(prob[0] * s for s in sorted(size[1:])[-12:]))
    assert abs(sum(o * s for o, s in zip(out, size)) - want) <= 0.01 * want + reach


def test_every_source_comes_near_its_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cm.mix_documents(docs).toPandas()
    by = got.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert ((by.taken - by.target).abs() <= 0.01 * by.target).all()


def water_fill(sizes, weights, cap=3.0):
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        over = {i for i in open_ if rest * weights[i] / sum(weights[j] for j in open_) > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in capped else rest * weights[i] / sum(weights[j] for j in open_) for i in range(len(sizes))]
        capped |= over


def test_mix_documents(spark, monkeypatch):
    monkeypatch.setattr(cm, "BLOCK", 64)
    monkeypatch.setattr(cm, "_FAN", 2)
    rng = random.Random(5)
    names = ["a", "b", "c", "Z", "é", "", None]
    rows = []
    for i in range(1500):
        src = "a" if i % 3 == 0 else rng.choice(names)
        words = 0 if i % 50 == 0 else rng.randint(1, 60)
        rows.append((None if i % 97 == 0 else i, " \t".join(["w"] * words) if i % 100 else None, src, 1.5, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, size string")
    got = cm.mix_documents(docs).toPandas()
    again = cm.mix_documents(docs.repartition(7)).toPandas()
    assert sorted(got.fillna(-1).values.tolist()) == sorted(again.fillna(-1).values.tolist())
    order = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s, *_ in rows if s == n) for n in order]
    want = dict(zip(order, water_fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))])))
    assert sorted(got["size"]) == sorted(len((t or "").split()) for _, t, *_ in rows)
    assert (got.taken <= 3 * got["size"]).all()
    for n, size in zip(order, sizes):
        mine = got[((got.target - want[n]).abs() < 1e-6 * max(1, want[n])) & (got.source_size == size)]
        assert abs(mine.taken.sum() - want[n]) <= 60
    assert len(cm.sample(docs).columns) == 5
    assert cm.sample(docs).count() == sum(round(t / s) for t, s in zip(got.taken, got["size"]) if s)


def test_empty_and_single(spark):
    schema = "doc_id long, text string, source string"
    assert cm.mix_documents(spark.createDataFrame([], schema)).count() == 0
    assert cm.mix_documents(spark.createDataFrame([(1, None, None)], schema)).collect()[0].taken == 0
    assert cm.mix_documents(spark.createDataFrame([(1, "a b", "s")], schema)).collect()[0].taken == 2
