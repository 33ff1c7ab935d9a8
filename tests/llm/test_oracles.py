"""The SQL of corpus queries against the operators, on odd texts and vectors and on the smallest tables."""

import duckdb
import pytest

from landrank.llm import oracles, queries

WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(WORDS)
TEXTS = [
    None, "", " \t\n ", "Ä ß 漢字", LONG, LONG.upper(), f"x {LONG} y", " ".join(WORDS[5:40]), " ".join(WORDS[:30] + ["new"] + WORDS[30:]),
    "a b", "A  b", "ab " * 40, "漢" * 40, "漢" * 41 + "z", "ab " * 39 + "漢", " ".join(WORDS[::-1]), LONG + " " + LONG,
]
VECTORS = [
    (0, [1.0, 0.0, 0.0], 1), (1, [2.0, 0.0, 0.1], 1), (2, [4.0, 0.0, 0.9], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 0.0], 1),
    (5, [1.0, float("nan"), 0.0], 1), (6, [1.0, 0.0, 0.0], None), (7, [1.0, 0.0, 0.0], 2), (8, None, 2), (9, [1.0, 0.0, 0.0], 2), (10, [], 2),
]


def rows(table):
    return sorted(map(tuple, table), key=str)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = [(i * 3, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def answers(spark, folder, name, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SMALL else ''}')")
    found = con.execute(sql)
    columns = sorted(d[0] for d in found.description)
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    order = [[d[0] for d in found.description].index(c) for c in columns]
    return rows(got.select(*columns).collect()), rows([r[i] for i in order] for r in found.fetchall())


SMALL = "/root/testdata/sf0.001"
NAMES = {"op2_itq_neighbours": oracles.COSINE, "op5_phrase_automata": oracles.PHRASES, "op8_column_bwt": oracles.BYTES, "op9_prefix_join": oracles.JACCARD}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    got, want = answers(spark, odd, name, NAMES[name])
    assert got == want and len(want) == (len(VECTORS) if name.startswith("op2") else len(TEXTS))


@pytest.mark.parametrize("name", NAMES)
def test_small_tables(spark, name):
    got, want = answers(spark, SMALL, name, NAMES[name])
    assert got == want
