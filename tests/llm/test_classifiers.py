import zlib

import numpy as np
import pytest

from landrank.llm import factorisation, pu_toxicity


def test_machine_score_equals_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = factorisation.Machine(0.3, rng.normal(size=factorisation.WIDTH).astype(np.float32), rng.normal(size=(factorisation.WIDTH, 4)).astype(np.float32))
    rows = [rng.choice(factorisation.WIDTH, n, replace=False).astype(np.int32) for n in (9, 15, 40)]
    for row, got in zip(rows, m.raw(rows)):
        x = factorisation._values(len(row))
        want = m.bias + (m.weight[row] * x).sum()
        want += sum(float(m.factor[row[i]] @ m.factor[row[j]]) * x[i] * x[j] for i in range(len(row)) for j in range(i))
        assert got == pytest.approx(want, rel=1e-3, abs=1e-3)


def corpus(spark):
    rng = np.random.default_rng(7)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1200):
        w = rng.choice(vocab, rng.integers(20, 120)).tolist()
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.8)
        if toxic:
            for k in rng.integers(0, len(w), 3):
                w[k] = "vilest" + str(rng.integers(0, 50))
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        docs.append((i, text, "en", "s", 3.0))
        labels.append((i, good, toxic))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0.0), (None, "word1", "en", "s", 0.0), (5, docs[5][1], "en", "s", 0.0)]
    labels += [(None, 1, 1), (7, None, None), (3, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(spark, name):
    docs, labels = corpus(spark)
    run, mod, rest = (factorisation.score_quality, 5, 0) if name == "quality" else (pu_toxicity.score_toxicity, 3, 1)
    got = run(docs, labels).toPandas()
    assert len(got) == 1204 and got.score.between(0, 1).all() and got.score.notna().all()
    truth = dict(zip(*labels.dropna().toPandas()[["doc_id", name]].T.values))
    held = got[got.held_out & got.doc_id.isin(truth)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95
    known = got.dropna(subset=["doc_id"])
    assert all(h == (zlib.crc32(str(int(i)).encode()) % mod == rest) for i, h in zip(known.doc_id, known.held_out))
    assert (got.predicted == (got.score >= (0.3 if name == "quality" else 0.7))).all()


def test_empty_tables(spark):
    docs, labels = corpus(spark)
    for run in (factorisation.score_quality, pu_toxicity.score_toxicity):
        assert run(docs.limit(0), labels).count() == 0
        assert run(docs.limit(3), labels.limit(0)).count() == 3


@pytest.mark.parametrize("shift", [-3.0, 0.0, 3.0])
def test_slopes_are_those_of_the_risk(shift):
    rng = np.random.default_rng(3)
    zp, zu, prior, back, h = rng.normal(size=7) - shift, rng.normal(size=11) + shift, 0.3, 0.05, 1e-5
    positive, negative = pu_toxicity.risks(zp, zu, prior)
    # The published step: down the whole risk, or up the second part alone where that is below 0.
    goal = (lambda p, u: sum(pu_toxicity.risks(p, u, prior))) if negative >= 0 else (lambda p, u: -back * pu_toxicity.risks(p, u, prior)[1])
    gp, gu = pu_toxicity.slopes(zp, zu, prior, back)
    for z, g, at in ((zp, gp, 0), (zu, gu, 1)):
        for i in range(len(z)):
            up, down = ([x.copy() for x in (zp, zu)] for _ in range(2))
            up[at][i] += h
            down[at][i] -= h
            assert g[i] == pytest.approx((goal(*up) - goal(*down)) / (2 * h), abs=1e-7)
    assert {-3.0: True, 3.0: True}.get(shift) is None or (negative < 0) == (shift < 0)


def test_quality_scores_from_the_text():
    """Scores of the machine from words of the text, pair by pair, beside the batch way over hashed bytes."""
    rng = np.random.default_rng(4)
    m = factorisation.Machine(-0.2, rng.normal(0, 0.1, factorisation.WIDTH).astype(np.float32), rng.normal(0, 0.3, (factorisation.WIDTH, 3)).astype(np.float32))
    texts = ["", "One two, TWO three!", "é x1 " * 40, "plain words go here and there\n" * 3]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    where = np.cumsum([0, *[len(t.encode()) for t in texts]])
    rows = factorisation.extract(raw, where)
    for text, row, got in zip(texts, rows, m.raw(rows)):
        one = np.frombuffer(text.encode(), np.uint8)
        words = {w for w in "".join(c.lower() if c.isascii() else c for c in text).translate({ord(c): " " for c in ".,!?\n"}).split()}
        assert len(row) - 9 == len(words)
        assert sorted(row[:9]) == sorted(factorisation.extract(one, np.array([0, len(one)]))[0][:9])
        x = [1.0] * 9 + [1 / np.sqrt(max(1, len(words)))] * len(words)
        want = m.bias + sum(float(m.weight[f]) * v for f, v in zip(row, x))
        want += sum(float(m.factor[row[i]] @ m.factor[row[j]]) * x[i] * x[j] for i in range(len(row)) for j in range(i))
        assert got == pytest.approx(want, rel=1e-3, abs=1e-3)
