"""Chunk tables: documents in rows of about a megabyte, written once, so that later passes can name a chunk.

A pass over the corpus that needs an answer from elsewhere (which fingerprints recur, which passages to cut) sends small
arrays to hash buckets and gets small arrays back, keyed by chunk. What a chunk sends about one fingerprint is one entry,
however often its documents hold it, so a hot passage costs a bucket at most one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import batchwise, doc_texts, save, slices, string_parts

CHUNK_BYTES = 1 << 20


def chunk_table(docs: DataFrame, carry: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk long, n_bytes long, ids array<long>, sizes array<int>, body binary[, carry array]) written to the shared folder.

    body: zstd of the UTF-8 texts one after another; ids may hold nulls. No shuffle: a chunk is a run of rows of one task.
    """
    rows = doc_texts(docs, *([carry] if carry else []))
    fields = "chunk long, n_bytes long, ids array<long>, sizes array<int>, body binary"
    schema = T.StructType(T._parse_datatype_string(fields).fields + ([T.StructField(carry, T.ArrayType(rows.schema[carry].dataType))] if carry else []))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            where, raw = string_parts(whole.column("text"))
            for i, j in slices(where, chunk_bytes):
                ids = whole.column("doc_id").slice(i, j - i)
                spans = np.array([0, j - i], np.int32)
                columns = [
                    pa.array([(part << 32) + seq], pa.int64()),
                    pa.array([int(where[j] - where[i])], pa.int64()),
                    pa.ListArray.from_arrays(spans, ids),
                    pa.ListArray.from_arrays(spans, pa.array(np.diff(where[i : j + 1]).astype(np.int32))),
                    pa.array([press.compress(raw[where[i] : where[j]].tobytes())], pa.binary()),
                ]
                if carry:
                    columns.append(pa.ListArray.from_arrays(spans, whole.column(carry).slice(i, j - i)))
                seq += 1
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return save(rows.mapInArrow(batchwise(build), schema), "chunks")


def corpus_bytes(chunks: DataFrame) -> int:
    return int(chunks.agg(F.sum("n_bytes")).first()[0] or 0)


class Chunk:
    """One row of a chunk table, opened: ids (float NaN-free: nulls flagged in `known`), and texts' byte ranges."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.known = np.array([i is not None for i in row["ids"]], bool)
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        sizes = np.array(row["sizes"], np.int64)
        self.where = np.concatenate([[0], np.cumsum(sizes)])
        body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(self.where[-1]))) if len(sizes) and self.where[-1] else b""
        self.raw = np.frombuffer(body, np.uint8)

    def __len__(self) -> int:
        return len(self.ids)


def opened(table: pa.Table | pa.RecordBatch) -> Iterator[Chunk]:
    keep = [c for c in ("chunk", "ids", "sizes", "body") if c in table.schema.names]
    for row in table.select(keep).to_pylist():
        yield Chunk(row)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows of it) for every bucket met."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edges = np.flatnonzero(np.diff(sorted_)) + 1
    for rows in np.split(order, edges) if len(order) else []:
        yield int(bucket[rows[0]]), rows


def in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """values that stand in the sorted array `among`."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values
