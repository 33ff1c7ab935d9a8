import hashlib
import random
import tempfile

import numpy as np
import pytest

from landrank.llm import _chunks, _repeats, column_bwt, phrase_automata


def brute(symbols_of, window, docs):
    """Covered positions of each row, judged on the input."""
    first = {}
    for doc_id, text in docs:
        s = symbols_of(text)
        if doc_id is not None:
            for i in range(len(s) - window + 1):
                k = tuple(s[i : i + window])
                first[k] = min(first.get(k, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        s = symbols_of(text)
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if doc_id is not None and first[tuple(s[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        out.append((s, gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "ünd", "a", "loser", "x1", "!!"] + [f"w{i}" for i in range(40)]
    line = lambda n: rng.choice([" ", "  ", "\n", "\t"]).join(rng.choice(vocab) for _ in range(n))
    shared = [line(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.4 else line(rng.randint(0, 30)) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None), (600, None), (601, ""), (602, "Of " * 300), (603, "Of " * 200), (604, "z" * 400), (605, "y" * 30 + "z" * 200), (606, "a" * 49), (607, "a" * 50), (608, "a" * 50), (700, shared[0] * 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy", [1, 10_000])
def test_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(_chunks, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(_repeats, "_BUCKET_BYTES", 4000)
    monkeypatch.setattr(_repeats, "_SHARD_BYTES", 4000)
    rows = corpus(heavy)
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, chunk string").repartition(3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    chunks = _chunks.chunk_table(docs, chunk_bytes=1500)
    assert chunks.count() > 5
    monkeypatch.setattr(column_bwt, "chunk_table", lambda d: chunks)
    monkeypatch.setattr(phrase_automata, "chunk_table", lambda d: chunks)
    want = [(i, len(s), sum(g), sum(a and not b for a, b in zip(g, [False, *g])), hashlib.sha256(bytes(x for x, y in zip(s, g) if not y)).hexdigest()) for (i, _), (s, g) in zip(rows, brute(lambda t: (t or "").encode(), 50, rows))]
    assert sorted(map(key, column_bwt.suffix_dedup(docs, heavy).collect())) == sorted(map(key, want))
    want = [(i, len(s), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(s, g) if not y)).hexdigest()) for (i, _), (s, g) in zip(rows, brute(lambda t: (t or "").encode().split(), 13, rows))]
    assert sorted(map(key, phrase_automata.substring_dedup(docs, heavy).collect())) == sorted(map(key, want))


def test_column_wise_transform_equals_sorted_suffixes():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = column_bwt.build(texts, folder)
    # Equal suffixes stand in the order of what precedes them, recursively; compare what that leaves free.
    suffixes = sorted(t[i:] for t in texts for i in range(len(t) + 1))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(suffixes, suffixes[1:])]
    before = {}
    for t in texts:
        for i in range(len(t) + 1):
            before.setdefault(t[i:], []).append(t[i - 1] if i else 255)
    at = 0
    for s in sorted(before):
        n = len(before[s])
        assert sorted(bwt[at : at + n].tolist()) == sorted(before[s])
        at += n


def test_texts_and_other_columns(spark):
    text = "é" * 60
    docs = spark.createDataFrame([(1, text, "s", 60, 5), (2, "ab " + text, "s", 63, None), (3, "x", None, 1, 7)], "doc_id long, text string, source string, n_chars int, removed int")
    out = {r.doc_id: r for r in column_bwt.cut_repeats(docs).collect()}
    assert out[2].text == "ab " and out[2].n_chars == 3 and out[2].removed is None and out[3].removed == 7
    assert {r.doc_id: r.removed for r in column_bwt.remove_repeats(docs).collect()}[2][0].asDict() == {"start": 3, "end": 123}
    assert phrase_automata.remove_phrases(docs).count() == 3
    empty = docs.limit(0)
    assert column_bwt.suffix_dedup(empty).count() == 0 and phrase_automata.substring_dedup(empty).count() == 0 and column_bwt.cut_repeats(empty).count() == 0


def test_locate_small():
    texts = [b"a b c", b"x a b c", b"b c d"]
    assert phrase_automata.locate(texts, np.array([5, 7, 1]), np.array([5, 7, 1]), 2).tolist() == [2, 6, 0]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_of_the_external_files(monkeypatch, block):
    rng = random.Random(block)
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 24))) for _ in range(40)] + [b"abcabcabc"] * 3
    with tempfile.TemporaryDirectory() as folder:
        whole = column_bwt.build(texts, folder)
    monkeypatch.setattr(column_bwt, "_BLOCK", block)
    with tempfile.TemporaryDirectory() as folder:
        parts = column_bwt.build(texts, folder)
    assert all((a == b).all() for a, b in zip(whole, parts))


@pytest.mark.parametrize("method", ["bwt", "automata"])
def test_batches_lose_nothing(monkeypatch, method):
    rng = random.Random(3)
    vocab = [b"abc", b"de", b"fgh", b"ij"]
    texts = list({b" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 9))) for _ in range(400)})
    low = np.array([rng.randint(0, 50) for _ in texts])
    first = {}
    units = [t.split(b" ") if method == "automata" else t for t in texts]
    window = 5 if method == "automata" else 20
    for u, a in zip(units, low.tolist()):
        for i in range(len(u) - window + 1):
            k = tuple(u[i : i + window])
            first[k] = min(first.get(k, a), a)
    want = [sum(1 << i for i in range(len(u) - window + 1) if first[tuple(u[i : i + window])] < a) for u, a in zip(units, low.tolist())]
    anchors = np.zeros(len(texts), np.uint64)
    if method == "automata":
        assert phrase_automata.locate(texts, low, low, 5, anchors, 3).tolist() == want
    else:
        monkeypatch.setattr(column_bwt, "WINDOW", 20)
        monkeypatch.setattr(column_bwt, "_BATCH", 5)
        monkeypatch.setattr(column_bwt.earliest, "__defaults__", (20,))
        assert column_bwt.solver(texts, low, low, anchors).tolist() == want


def test_many_segments_of_one_anchor_and_many_words():
    # More distinct words than there are code points, and 70,000 segments that one anchor would bring together.
    texts = [b" ".join(b"%d" % (20 * i + k) for k in range(20)) for i in range(69_000)]
    texts += [b" ".join([b"x", *t.split(b" ")[3:18]]) for t in texts[:1000]]
    low = np.arange(len(texts)) + 5
    bits = phrase_automata.locate(texts, low, low)
    assert not bits[:69_000].any() and (bits[69_000:] == 0b1110).all()
