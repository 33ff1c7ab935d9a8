import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landrank.llm import token_files as tf

TEXTS = [
    None, "", " ", "  ", " \n", "The mit license.", "café é ﬁ İ ſ x's don't 'S A.B a1b2c3 <|endoftext|> x \x1c \x85 a\xa0 b\xa0  c  ß.    x　 y",
    "\x00 a\x00b. naïve!! «quoted».\n\n  two\t\ttabs  ", "word " * 5000, "x" * 9000, "the of and " * 700, "日本語 の テキスト。 " * 30, "tail  ", "  head", "end <|endoftext|>", " <|endoftext|> ",
]


class Source:
    def __init__(self, parts):
        self.raw = b"".join(parts)

    def read_at(self, size, offset):
        return self.raw[offset : offset + size]


def _file(ids):
    return tf.DacFile(Source(tf.dac_file(np.array([5]), np.array([True]), np.array([0, len(ids)]), ids)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_any_token_and_any_slice_come_back(values, data):
    ids = np.array(values, np.uint32)
    file = _file(ids)
    assert file.slice(0, len(ids)).tolist() == values
    for _ in range(5):
        i = data.draw(st.integers(0, len(ids)))
        j = data.draw(st.integers(i, len(ids)))
        assert file.slice(i, j).tolist() == values[i:j]
    assert [file.token(i) for i in range(0, len(ids), 97)] == values[::97]


def test_a_token_takes_few_bytes_whatever_the_size():
    rng = np.random.default_rng(1)
    for n in (10_000, 3_000_000):
        ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
        file = _file(ids)
        assert len(file.source.raw) < 2 * n
        file.bytes_read = 0
        for i in rng.integers(0, n, 50).tolist():
            assert file.token(i) == ids[i]
        assert file.bytes_read / 50 < 120 * len(file.levels)


def test_widths_are_the_cheapest():
    ids = np.array([1] * 1000 + [50_000] * 3, np.uint32)
    widths = tf.level_widths(ids)
    assert sum(widths) == 16 and widths[0] == 1 and len(widths) == 2
    assert tf.level_widths(np.array([3], np.uint32)) == [2] and tf.level_widths(np.zeros(0, np.uint32)) == [1]


def test_parts_equal_whole_text_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tf.default_tokenizer())
    rng = np.random.default_rng(5)
    odd = list("ab1.,'s \n\t\xa0 é\x1c  ") + ["<|endoftext|>", "don't", " the"]
    texts = [(t or "") for t in TEXTS] + ["".join(rng.choice(odd, rng.integers(0, 40))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    for _ in range(2):
        ids, ends = tf.encode(tf.default_tokenizer(), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def _brute(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tf.default_tokenizer())
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [1 << 22, 300])
def test_files_read_back_against_plain_tokenizer(spark, file_ids):
    rows = [((i * 7) % 48 if i else None, t, "s", 1) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, part int").repartition(3)
    files = tf.write_ids(docs, tf.default_tokenizer(), file_ids=file_ids)
    assert files.count() > 3 or file_ids > 300
    got = sorted(map(tuple, tf.document_ids(files).collect()), key=lambda r: r[1])
    assert got == _brute([r[:2] for r in rows])
    # Random access by place in the whole set, across files.
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tf.default_tokenizer())
    flat = [x for _, t in sorted([r[:2] for r in rows], key=lambda r: (r[0] is not None, r[0] or 0)) for x in [*plain.encode(t or "", add_special_tokens=False).ids, 0]]
    asked = [(0, 5), (17, 1), (100, 4000), (len(flat) - 3, 50), (len(flat), 2), (-1, 3), (5, 0)]
    found = {}
    for r in sorted(tf.fetch(files, spark.createDataFrame(asked, "start long, length long")).collect(), key=lambda r: r["at"]):
        assert r["at"] == r["start"] + len(found.get((r["start"], r["length"]), []))
        found.setdefault((r["start"], r["length"]), []).extend(r["ids"])
    assert found == {(s, n): flat[s : s + n] for s, n in asked if 0 <= s < len(flat) and n}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b")] * 4 + [(3, "c")], "doc_id long, text string")
    out = tf.token_files(docs, tf.default_tokenizer()).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [3] * 5 and sum(r["n_tokens"] for r in out) == 4 * 3 + 2 and [r["start"] for r in out][0] == 0
    none = tf.token_files(docs.filter("false"), tf.default_tokenizer())
    assert none.count() == 0 and none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_another_file_is_told():
    with pytest.raises(ValueError):
        tf.DacFile(Source([io.BytesIO(b"\0" * 64).getvalue()]))
