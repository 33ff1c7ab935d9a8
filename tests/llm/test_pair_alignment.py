import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landrank.llm import pair_alignment as pa_

A, B = pa_.default_tokenizers()
TEXTS = [
    None, "", " ", "  ", " \n", "The mit license.", "café é ﬁ İ ſ x's don't 'S A.B a1b2c3 <|endoftext|> </s> <unk> <0x41> x \x1c \x85 a\xa0 b\xa0  c  ß.    x　 y",
    "\x00 a\x00b. naïve!! «quoted».\n\n  two\t\ttabs  ", "the of and " * 300, "日本語 の テキスト。 " * 20, "tail  ", "  head", "has ▁ lower block", "x▁y", "=" * 300, "aaaa" * 90, "🙂🙂 ok 🙂",
    "In eaenat the ouat onenti thheingble. The ouat, the ouat!", "The mit license.", "the quick brown fox; the lazy dog's tail",
]


def _tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _bytes_of(a, b):
    chars = {}
    n = 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x:
            chars[chr(x)] = x
        else:
            chars[chr(256 + n)] = x
            n += 1
    return (lambda i: bytes(chars[c] for c in a.id_to_token(i))), (lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())


def brute_groups(text, a, b, of_a, of_b):
    """Groups of a whole text, token by token."""
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if any(b"".join(map(of, i)) != raw for of, i in zip((of_a, of_b), ids, strict=True)):
        return None
    ends = [np.cumsum([len(of(i)) for i in x]).tolist() for of, x in zip((of_a, of_b), ids, strict=True)]
    groups, k, m = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k2, m2 = ends[0].index(cut, k) + 1, ends[1].index(cut, m) + 1
        groups.append((ids[0][k:k2], ids[1][m:m2]))
        k, m = k2, m2
    return groups


def brute(rows):
    a, b = _tokenizers()
    of = _bytes_of(a, b)
    found = [(i, brute_groups(t, a, b, *of)) for i, t in rows]
    held = Counter()
    for _, groups in found:
        held.update({(x, y) for p, q in groups or () for x in p for y in q})
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, groups in found:
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [held[x, y] == top[x] for p, q in groups for x in p for y in q]
        counts = [held[x, y] for p, q in groups for x in p for y in q]
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((i, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(links), sum(counts), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("abT.,'s \n\t\xa0é\x1c▁=🙂の1") + ["  ", " the", "don't", "<0x41>", "<|endoftext|>"]), max_size=25).map("".join), min_size=1, max_size=6))
def test_parts_give_the_groups_of_whole_texts(texts):
    a, b = _tokenizers()
    of = _bytes_of(a, b)
    found = pa_.Aligned(pa_.aligner(A, B), [t.encode() for t in texts])
    for i, t in enumerate(texts):
        groups = brute_groups(t, a, b, *of)
        assert found.groups(i).decode() == (";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups) if groups else "")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 2**40), st.integers(1, 9), max_size=40), max_size=6), st.integers(1, 7))
def test_heap_merge_counts_and_answers(runs, block):
    old, pa_._RUN_BLOCK = pa_._RUN_BLOCK, block
    try:
        raw = [pa_.write_run(np.array(sorted(r), np.uint64), np.array([r[k] for k in sorted(r)], np.int64)) for r in runs]
        want = Counter()
        for r in runs:
            want.update(r)
        pairs, back = [], [[] for _ in runs]
        for p, t, given_ in pa_.merged(raw):
            pairs += list(zip(p.tolist(), t.tolist(), strict=True))
            for q, counts in given_:
                back[q] += counts.tolist()
        assert pairs == sorted(want.items())
        assert back == [[want[k] for k in sorted(r)] for r in runs]
    finally:
        pa_._RUN_BLOCK = old


@pytest.mark.parametrize("chunk_bytes,fan_in", [(8 << 20, 256), (200, 3)])
def test_alignment_against_brute_force(spark, chunk_bytes, fan_in):
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame([(i, t, "r", 3) for i, t in rows], "doc_id long, text string, run string, chunk int").repartition(4)
    assert _got(pa_.align(docs, A, B, chunk_bytes, fan_in)) == brute(rows)


def test_pair_counts_and_groups(spark):
    rows = [(1, "the cat sat"), (1, "the cat sat"), (2, "the dog"), (3, None), (4, "▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = _tokenizers()
    of = _bytes_of(a, b)
    held = Counter()
    for _, t in rows:
        held.update({(x, y) for p, q in brute_groups(t, a, b, *of) or () for x in p for y in q})
    got = {(r["a_id"], r["b_id"]): (r["n_docs"], r["best"]) for r in pa_.pair_counts(docs, A, B).collect()}
    assert {k: n for k, (n, _) in got.items()} == dict(held)
    assert all(best == (n == max(m for (x, _), m in held.items() if x == k[0])) for k, (n, best) in got.items())
    said = {r["groups"] for r in pa_.token_groups(docs, A, B).collect()}
    assert len(said) == 3 and "" in said


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").filter("false")
    out = pa_.align(docs, A, B)
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "n_a"]
