import random

import pytest

from landrank.llm import _chunks, prefix_join
from landrank.llm._components import components
from landrank.llm.prefix_join import JoinSpec


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(rows, spec):
    sets = [(i, shingles(t, spec.shingle)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if i is not None and j is not None and a and b and 100 * len(a & b) >= spec.percent * len(a | b):
                u, v = sorted((find(parent, i), find(parent, j)))
                parent[v] = u
    return [(i, len(s), None if i is None else find(parent, i)) for i, s in sets]


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["The", "of", "É", "a", "x"] + [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 80))] for _ in range(8)]
    rows = []
    for i in range(260):
        words = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if words:
                k = rng.randrange(len(words))
                words[k : k + rng.randint(0, 1)] = [rng.choice(vocab)]
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(words)))
    chain = [f"c{i}" for i in range(60)]
    rows += [(2000 + i, " ".join(f"new{j}" if j < i else c for j, c in enumerate(chain))) for i in range(14)]
    rows += [(9000, rows[5][1].upper()), (9001, rows[5][1]), (None, rows[5][1]), (None, None), (9100, None), (9101, ""), (9102, "a"), (9103, "A"), (9104, "a b"), (9105, "word " * 50), (9106, "word " * 20), (15, rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("spec", [JoinSpec(3, 90), JoinSpec()])
def test_against_brute_force(spark, monkeypatch, spec):
    monkeypatch.setattr(prefix_join, "_BUCKET_BYTES", 10_000)
    rows = corpus(spec.percent)
    docs = spark.createDataFrame([(i, t, "g", 4) for i, t in rows], "doc_id long, text string, group string, n int").repartition(3)
    chunks = _chunks.chunk_table(docs, chunk_bytes=4000)
    monkeypatch.setattr(prefix_join, "chunk_table", lambda d, c=None: chunks)
    got = prefix_join.jaccard_components(docs, spec).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, brute(rows, spec)))


def test_drop_near_copies(spark):
    rows = corpus(7)
    docs = spark.createDataFrame([(i, t, "g", 4, [1]) for i, t in rows], "doc_id long, text string, group string, n int, tokens array<int>")
    want = brute(rows, JoinSpec())
    kept = prefix_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == sorted([-1 if i is None else i for i, n, c in want if i is None or n == 0] + sorted({c for i, n, c in want if i is not None and n}))
    assert prefix_join.drop_near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        u, v = sorted((find(parent, a), find(parent, b)))
        parent[v] = u
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(parent, x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
