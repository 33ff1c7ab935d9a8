"""Hashed text features, a batch of documents at a time in numpy, for the two classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import ALNUM, NOT_SPACE, byte_symbols, lower, mix, prefix, span_hash, word_spans
from ._shared import batchwise, doc_texts, slices, spread_sample, string_parts

_BATCH_BYTES = 1 << 20
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&|<>{}[]^~=_@\\"]] = True


class Texts:
    """A batch of texts: lower-cased words with their hashes, and the document of each."""

    def __init__(self, raw: np.ndarray, where: np.ndarray, member: np.ndarray = ALNUM):
        self.raw = np.frombuffer(b"\n".join(raw[i:j].tobytes() for i, j in zip(where[:-1], where[1:], strict=True)), np.uint8)
        self.n = len(where) - 1
        self.size = np.diff(where)
        low = lower(self.raw)
        self.first, self.last = word_spans(low, member)
        self.sums = prefix(byte_symbols(low))
        self.edge = np.searchsorted(self.first, where - where[0] + np.arange(len(where)))
        self.doc = np.repeat(np.arange(self.n), np.diff(self.edge))
        self.words = span_hash(self.sums, self.first, self.last)

    def starts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of the first n bytes of the words that have more."""
        long = np.flatnonzero(self.last - self.first > n)
        return self.doc[long], mix(span_hash(self.sums, self.first[long], self.first[long] + n) + np.uint64(n))

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document are in the mask (one entry a byte of raw)."""
        total = np.concatenate([[0], np.cumsum(mask)])
        start = np.concatenate([[0], np.cumsum(self.size + 1)])[: self.n]
        return total[start + self.size] - total[start]


def distinct(doc: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) pairs in order of document."""
    pair = np.unique(doc.astype(np.int64) << 32 | slot.astype(np.int64))
    return pair >> 32, pair & 0xFFFFFFFF


def statistics(raw: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Structure of each text as shares and logarithms (n x 9)."""
    t = Texts(raw, where, NOT_SPACE)
    words = np.diff(t.edge)
    some, size = np.maximum(words, 1), np.maximum(t.size, 1)
    kinds = np.bincount(distinct(t.doc, t.words & np.uint64(0xFFFFFFFF))[0], minlength=t.n)
    same = np.concatenate([[False], (t.words[1:] == t.words[:-1]) & (t.doc[1:] == t.doc[:-1])]) if len(t.words) else np.zeros(0, bool)
    return np.stack(
        [
            np.log1p(words), np.log1p(t.size), t.size / some, t.per_doc(_UPPER[t.raw]) / size, t.per_doc(_DIGIT[t.raw]) / size,
            t.per_doc(_MARK[t.raw]) / some, t.per_doc(t.raw == 33) / some, np.bincount(t.doc[same], minlength=t.n) / some, kinds / some,
        ],
        axis=1,
    )


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], held_out: str, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; score gets the bytes and bounds of a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            where, raw = string_parts(whole.column("text"))
            for i, j in slices(where, _BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(i, j - i), pa.array(score(raw, where[i : j + 1]).astype(float))], ["doc_id", "score"])

    rows = doc_texts(docs).mapInArrow(batchwise(run), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def sample_features(docs: DataFrame, chosen: DataFrame, extract: Callable, label: str | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of the texts of a bounded set of rows, brought to the driver: arrays in order of doc_id, and
    labels. Of rows that repeat an id one counts, the same each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            where, raw = string_parts(whole.column("text"))
            for i, j in slices(where, _BATCH_BYTES):
                found = [x.tobytes() for x in extract(raw, where[i : j + 1])]
                yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(i, j - i), whole.column("label").slice(i, j - i), pa.array(found, pa.binary())], ["doc_id", "label", "features"])

    texts = doc_texts(docs).join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label") if label else F.lit(0).alias("label"))), "doc_id")
    rows = texts.select("doc_id", "text", "label").mapInArrow(batchwise(run), "doc_id long, label int, features binary").groupBy("doc_id").agg(F.min(F.struct("features", "label")).alias("row")).select("doc_id", "row.label", "row.features").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    features = rows.column("features").to_pylist()
    return [np.frombuffer(features[i], np.int32) for i in order.tolist()], rows.column("label").to_numpy()[order]


def labelled(labels: DataFrame, column: str, held_out: str) -> DataFrame:
    """(doc_id, label) of labelled rows outside the held-out fold; of conflicting labels the larger counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return rows.filter(f"not ({held_out})").groupBy("doc_id").agg(F.max("label").alias("label"))


def first_by_hash(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows of distinct doc_ids by their hash: the same ones each run, spread over the table."""
    return spread_sample(rows, "doc_id", n, rows.count(), seed)
