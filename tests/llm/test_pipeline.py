import random

import corpus_pipeline
from landrank.llm import cube_mixing, prefix_join
from tests.llm.test_prefix_join import brute as components
from tests.llm.test_repeats import brute as covered


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}x" for i in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [line(25) for _ in range(3)]
    rows = [(i, line(rng.randint(25, 60)) + "\n" + (rng.choice(shared) if i % 4 == 0 else line(20)), "en", f"s{i % 3}") for i in range(150)]
    rows += [(200 + i, rows[i][1] + " tail", "en", None) for i in range(20)]
    rows += [(300, "too short", "en", "s1"), (301, "!! " * 40, "en", "s1"), (302, None, None, None), (303, "Of " * 60, "en", "s1")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"step{k}"))
        docs = spark.read.parquet(str(tmp_path / f"step{k}"))
        steps.append(docs)
        if k < 4:
            assert docs.columns == columns
    good = [r for r in rows if r[0] < 300]
    assert sorted(r.doc_id for r in steps[0].collect()) == [r[0] for r in good]
    kept = {c for _, _, c in components([(r[0], r[1]) for r in good], prefix_join.JoinSpec())}
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(kept)
    one = [r for r in good if r[0] in kept]
    want = {}
    for r, (s, gone) in zip(one, covered(lambda t: t.encode(), 50, [(r[0], r[1]) for r in one])):
        text = bytes(x for x, y in zip(s, gone) if not y).decode()
        if text:
            want[r[0]] = (text, len(text), r[2], r[3])
    assert {r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in steps[2].collect()} == want
    taken = {r.doc_id: r.taken // r["size"] for r in cube_mixing.mix_documents(steps[2]).collect() if r.taken}
    mixed = [r.doc_id for r in steps[3].collect()]
    assert {i: mixed.count(i) for i in set(mixed)} == taken
    packed = steps[4].toPandas()
    assert sorted(packed[packed.piece == 0].doc_id) == sorted(mixed)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_odd_rows_and_columns(spark, tmp_path):
    """Null ids, repeated rows, null texts and clashing names through all stages; what they lead to is stated in the operators."""
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randint(0, 500)}x" for _ in range(n))
    texts = [line(rng.randint(25, 50)) for _ in range(30)]
    rows = [(i if i % 5 else None, t, None if i % 3 else "en", "s" if i % 2 else None, None, i, i, i, "q", "r") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, None, None, None, None, 0, 0, 0, None, None), (700, "", "en", "s", 0, 0, 0, 0, "", ""), (701, line(30_000), "en", "s", 1, 1, 1, 1, "", "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, chunk int, size int, carried string, at string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, counts = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"odd{k}"))
        docs = spark.read.parquet(str(tmp_path / f"odd{k}"))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    # Repeated rows of one id become one, rows without an id all stay, the long text stays whole.
    assert counts[0] == 33 and counts[1] == 31
    kept = spark.read.parquet(str(tmp_path / "odd2"))
    assert kept.filter("doc_id is null").count() == 6
    assert kept.filter("doc_id = 701").first().text == rows[-1][1]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
