import random
import re

from landrank.llm import license_scan as ls


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words(text)
    at, labels = [], set()
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        if hits:
            labels.add(label)
    base, share = ",".join(sorted(labels)), 0.0
    for name, template in ls.TEMPLATES.items():
        t = template.split()
        told = [(i, i + len(p)) for p in (x.split() for x in ls.TELLS.get(name, ())) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        hits = {}
        for i in range(len(w) - ls.K + 1):
            for j in range(len(t) - ls.K + 1):
                if w[i : i + ls.K] == t[j : j + ls.K]:
                    hits.setdefault(i - j, []).append((i, j))
        runs = []
        for d in sorted(hits):
            if not runs or d - runs[-1][-1] > ls.DRIFT:
                runs.append([])
            runs[-1].append(d)
        for some in [*runs, *([d] for d in hits)]:
            pairs = [h for d in some for h in hits[d]]
            text = {i + x for i, _ in pairs for x in range(ls.K)}
            foreign = set(range(min(text), max(text) + 1)) - text
            s = (len({j + x for _, j in pairs for x in range(ls.K)}) - len(foreign)) / len(t)
            if s >= ls.COVER and (name not in ls.TELLS or any(a <= max(text) and b > min(text) for a, b in told)):
                labels.add(name)
                share = max(share, s)
    score = max(share, 0.5 if at else 0.0)
    return len(w), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), score


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "MIT License", "CC BY-NC 4.0 cc\x00by CC  BY", "mit licensé", "Gnu General\nPublic. License!", "mit license " * 40, "x" * 5000]
    for _ in range(60):
        w = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice([*ls.TEMPLATES.values(), *ls.PHRASES, *sum(ls.TELLS.values(), ())]).split()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = rng.choice([[], ["Extra"], ["é"]])
            w += t[: rng.randint(1, len(t))] if t else []
            w += ["filler"] * rng.randint(0, 4)
        texts.append(rng.choice([" ", "\n", ", "]).join(w))
    rows = [(None if i == 9 else i % 60, t, "s", 0.5) for i, t in enumerate(texts)]
    got = ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got)) == sorted(key((i, *brute(t))) for i, t, *_ in rows)
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def similar(w, t):
    """Independent of k-grams: words in common by the best alignment of a template with any part of a text, less what the part has
    beyond them, as a share of the template."""
    best = [0] * (len(t) + 1)
    for x in w:
        row = [0]
        for j, y in enumerate(t):
            row.append(max(best[j] + 1 if x == y else 0, best[j + 1] - 1, row[j]))
        best = row
    return max(best) / len(t)


def test_spans_against_alignment(spark):
    rng = random.Random(8)
    t = ls.TEMPLATES["mit-notice"].split()
    texts = [" ".join(sum(([*t[i : i + 3], "foreign", "words"] for i in range(0, len(t), 3)), [])), " ".join(t)]
    for _ in range(200):
        out = []
        rate = rng.random() * 0.5
        for x in t:
            out += rng.choice([[], [x, "one"], ["two"], ["one", "two", "six"]]) if rng.random() < rate else [x]
        texts.append(" ".join(["before"] * rng.randint(0, 5) + out + ["after"] * 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id for r in ls.diagonal_spans(docs, {"mit-notice": " ".join(t)}).collect()}
    near = {i: similar(x.split(), t) for i, x in enumerate(texts)}
    assert 0 not in found and 1 in found
    assert all(i in found for i, s in near.items() if s >= 0.9)
    assert not any(i in found for i, s in near.items() if s < 0.5)
    assert 20 < len(found) < 180


def test_long_texts_and_clashing_columns(spark):
    text = "filler " * 300_000 + ls.TEMPLATES["mit-release"]
    docs = spark.createDataFrame([(1, text, 1, 2), (None, None, 3, 4)], "doc_id long, text string, template int, share int")
    got = {r.doc_id: r for r in ls.scan_licenses(docs).collect()}
    assert got[1].labels == "mit,mit-release" and got[1].n_words == 300_005 and got[None].labels == ""
