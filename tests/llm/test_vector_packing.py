import zlib

import numpy as np
import pytest

from landrank.llm import vector_packing as vp

TEXTS = [
    None, "", " \n", "The mit license.", "café é ﬁ İ ſ ΑΣ. x's don't 'S A.B a1b2c3 <|endoftext|> x \x1c \x85 a\xa0b ß. ẞ. ...a it's. K",
    "\x00 a\x00b. naïve!! «quoted». ÀÉ. µ. ª º. İ. Ǆ.", "word " * 5000, "x" * 9000, "the of and " * 700,
]


def test_word_cache_equals_whole_text_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vp.default_tokenizer())
    cache = vp.WordCache(vp.default_tokenizer())
    for _ in range(2):
        got = cache.encode([(t or "").encode() for t in TEXTS])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_holds_every_capacity(rule):
    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(1, 100, 400))[::-1].astype(float)
    limit = np.array([100.0, 4.0, 5000.0])
    size = size[size**2 <= limit[2]]
    demand = np.stack([size, np.ones_like(size), size**2], 1)
    bins, offsets = vp.best_fit(demand, limit, np.array([1.0, 0.1, 0.1]), rule)
    for b in np.unique(bins):
        rows = bins == b
        assert (demand[rows].sum(0) <= limit).all()
        at = np.argsort(offsets[rows])
        assert (offsets[rows][at] == np.concatenate([[0], np.cumsum(size[rows][at])[:-1]])).all()


def test_pack_documents_against_plain_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vp.default_tokenizer())
    rows = [(i if i else None, t, "s", 1, 7) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, sequence_id int, ids int")
    out = vp.pack_documents(docs, vp.default_tokenizer()).toPandas()
    want = []
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want.append((-1 if i is None else i, k // 2048, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    got = out.assign(doc_id=out.doc_id.fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, got.values.tolist())) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and (g.offset.values == np.concatenate([[0], g.length.cumsum().values[:-1]])).all()
    assert out.sequence_id.nunique() <= np.ceil(out.length.sum() / 2048) + 1


def test_empty_table(spark):
    assert vp.pack_documents(spark.createDataFrame([], "doc_id long, text string"), vp.default_tokenizer()).count() == 0
