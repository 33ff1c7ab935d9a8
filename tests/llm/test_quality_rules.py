import re
import random

from landrank.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spots = {}
    for i in range(len(words) - 7):
        spots.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for s in spots.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "Of " * 500, "é ü x\x1cy", "a b c d e f g h " * 2, "a b c d e f g h a b c d e f g i", "| # $ " * 20, "X!! " * 60, "same line\n" * 30, "w" * 20000]
    return out + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]


def test_against_brute_force(spark):
    rows = [(None if i == 3 else i, t, "c", 1) for i, t in enumerate(texts() * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int").repartition(3)
    got = qr.op4_quality_rules(docs).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(key((i, *brute(t))) for i, t, *_ in rows)
    assert sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    rows = qr.ledger(docs).cache()
    policy = qr.POLICIES["v2"]
    bits = [r.fail_bits & policy.mask for r in rows.collect()]
    got = {r.rule: (r.n_failed, r.n_only) for r in qr.ablation(rows, policy).collect()}
    assert got == {r: (sum(bool(b & qr.BIT[r]) for b in bits), sum(b == qr.BIT[r] for b in bits)) for r in policy.rules}
    assert qr.apply_policy(rows, policy).filter("kept").count() == sum(b == 0 for b in bits)
    assert qr.ledger(docs.limit(0)).count() == 0
