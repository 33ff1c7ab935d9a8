"""Where windows of documents occur in a document with a smaller id: the plan that op5 and op8 share.

Each window of n symbols (words or bytes) has an anchor, its k-gram with the smallest hash, so equal windows have equal
anchors. Consecutive windows with one anchor form a segment. In four passes over a chunk table:

1. chunks send 32-bit marks of their distinct anchors to hash buckets; a bucket tells each chunk which of them recur;
2. chunks send the distinct segments of recurring anchors, with the smallest and largest doc_id that has them, to shards by
   anchor, so that all equal windows meet; anchors in very many chunks send single windows, sharded by content;
3. a shard finds for every distinct segment which of its windows start in an earlier document (the operator's method);
4. chunks turn answers into covered symbols.

A mark that recurs by chance only adds a candidate; shards compare whole texts. Chunks compare their own segments by 64-bit
hashes. What a shard receives of a hot passage is one entry a chunk, and nothing is dropped, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import Chunk, by_bucket, corpus_bytes, in_sorted, opened
from ._hashing import NOT_SPACE, byte_symbols, mix, prefix, sliding_min, span_hash, window_hash, word_spans
from ._shared import batchwise, groupwise, pairwise, save

_LATE = np.iinfo(np.int64).max
_BUCKET_BYTES = 16 << 20
_SHARD_BYTES = 4 << 20
#: Recurring windows that a string has on average, for the size of batches only.
_WINDOWS_A_STRING = 8
#: An anchor in more chunks than this is split over shards by window content.
HEAVY_CHUNKS = 4096


@dataclass(frozen=True)
class Spec:
    """Windows of `window` symbols with anchors of `anchor` symbols; symbols are words, or else bytes."""

    words: bool
    window: int
    anchor: int

    @property
    def reach(self) -> int:
        """Most windows of a segment."""
        return self.window - self.anchor + 1


class Symbols:
    """A chunk's texts as symbols: doc_start in symbols, and begin/end of each symbol in `canon`."""

    def __init__(self, chunk: Chunk, words: bool):
        if words:
            texts = b"\n".join(chunk.raw[i:j].tobytes() for i, j in zip(chunk.where[:-1], chunk.where[1:], strict=True))
            raw = np.frombuffer(texts, np.uint8)
            first, last = word_spans(raw, NOT_SPACE)
            inside = NOT_SPACE[raw]
            keep = inside.copy()
            keep[1:] |= inside[:-1]
            place = np.cumsum(keep) - 1
            self.canon = np.where(inside, raw, np.uint8(32))[keep]
            self.begin = place[first]
            self.end = self.begin + (last - first)
            self.hashes = span_hash(prefix(byte_symbols(raw)), first, last)
            self.doc_start = np.searchsorted(first, chunk.where + np.arange(len(chunk.where)))
        else:
            self.canon = chunk.raw
            self.begin = np.arange(len(chunk.raw))
            self.end = self.begin + 1
            self.hashes = byte_symbols(chunk.raw)
            self.doc_start = chunk.where


class Segments:
    """Segments of a chunk: start symbol, number of windows, mixed anchor and document row of each."""

    def __init__(self, chunk: Chunk, symbols: Symbols, spec: Spec):
        n = len(symbols.hashes)
        self.start = self.count = self.doc = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n < spec.window:
            return
        least = sliding_min(window_hash(symbols.hashes, spec.anchor), spec.reach)
        doc = np.repeat(np.arange(len(chunk), dtype=np.int32), np.diff(symbols.doc_start))
        valid = (doc[: len(least)] == doc[spec.window - 1 :]) & chunk.known[doc[: len(least)]]
        new = valid.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        start = np.flatnonzero(new)
        if not len(start):
            return
        run = np.add.reduceat(valid.astype(np.int64), start)
        pieces = -(-run // spec.reach)
        which = np.repeat(np.arange(len(start)), pieces)
        step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = start[which] + step * spec.reach
        self.count = np.minimum(spec.reach, run[which] - step * spec.reach)
        self.doc = doc[self.start].astype(np.int64)
        self.anchor = mix(least[start][which] ^ np.uint64(0xD6E8FEB86659FD93))

    def marks(self, buckets: int) -> np.ndarray:
        """Bucket in the high, mark in the low half."""
        return ((self.anchor >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (self.anchor & np.uint64(0xFFFFFFFF))

    def keep(self, rows: np.ndarray) -> None:
        self.start, self.count, self.doc, self.anchor = self.start[rows], self.count[rows], self.doc[rows], self.anchor[rows]


def _numbers(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in table.column(name).to_pylist()]


def recurring_marks(chunks: DataFrame, spec: Spec, buckets: int, heavy: int) -> DataFrame:
    """(chunk, bucket, light binary, heavy binary): marks of each chunk that some other document may share."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in opened(batch):
                found = Segments(chunk, Symbols(chunk, spec.words), spec)
                marks = found.marks(buckets)
                order = np.argsort(marks, kind="stable")
                marks, doc = marks[order], found.doc[order]
                first = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])) if len(marks) else np.zeros(0, np.int64)
                last = np.concatenate([first[1:], [len(marks)]]) - 1 if len(marks) else first
                # A mark of two documents of the chunk goes twice: that alone makes it recur.
                marks = np.repeat(marks[first], 1 + (doc[first] != doc[last]))
                sent = list(by_bucket((marks >> np.uint64(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in sent], pa.int32()), pa.array([chunk.chunk] * len(sent), pa.int64()), pa.array([marks[r].astype(np.uint32).tobytes() for _, r in sent], pa.binary())],
                    ["bucket", "chunk", "marks"],
                )

    def tell(key, table):
        sent = _numbers(table, "marks")
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        again, much = values[counts > 1], values[counts > heavy]
        light_out, heavy_out = [], []
        for own in sent:
            mine = np.unique(own[in_sorted(own, again)])
            is_heavy = in_sorted(mine, much)
            light_out.append(mine[~is_heavy].tobytes())
            heavy_out.append(mine[is_heavy].tobytes())
        rows = [i for i, (a, b) in enumerate(zip(light_out, heavy_out, strict=True)) if a or b]
        return pa.table([table.column("chunk").take(pa.array(rows, pa.int64())), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([light_out[i] for i in rows], pa.binary()), pa.array([heavy_out[i] for i in rows], pa.binary())], ["chunk", "bucket", "light", "heavy"])

    sent = chunks.mapInArrow(batchwise(send), "bucket int, chunk long, marks binary")
    return save(sent.groupBy("bucket").applyInArrow(groupwise(tell), "chunk long, bucket int, light binary, heavy binary"), "marks")


class Candidates:
    """A chunk's segments with recurring anchors, and the distinct ones among them in order of their content hash."""

    def __init__(self, chunk: Chunk, told: pa.Table, spec: Spec, buckets: int):
        self.symbols = Symbols(chunk, spec.words)
        self.segments = Segments(chunk, self.symbols, spec)
        told = told.filter(pc.is_valid(told.column("bucket")))
        bucket = told.column("bucket").to_pylist()
        light, heavy = (np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.uint64(b << 32) | x.astype(np.uint64) for b, x in zip(bucket, _numbers(told, name), strict=True)]])) for name in ("light", "heavy"))
        marks = self.segments.marks(buckets)
        is_heavy = in_sorted(marks, heavy)
        hit = is_heavy | in_sorted(marks, light)
        is_heavy = is_heavy[hit]
        s = self.segments
        s.keep(hit)
        sums = prefix(self.symbols.hashes)
        if is_heavy.any():
            many = np.where(is_heavy, s.count, 1)
            which = np.repeat(np.arange(len(many)), many)
            step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            s.keep(which)
            alone = is_heavy[which]
            s.start = s.start + step
            s.count = np.where(alone, 1, s.count)
            s.anchor = np.where(alone, span_hash(sums, s.start, s.start + spec.window), s.anchor)
        keys = span_hash(sums, s.start, s.start + s.count + spec.window - 1)
        self.keys, self.first, self.which = np.unique(keys, return_index=True, return_inverse=True)
        ids = chunk.ids[s.doc]
        self.low, self.high = np.full(len(self.keys), _LATE), np.full(len(self.keys), -_LATE)
        np.minimum.at(self.low, self.which, ids)
        np.maximum.at(self.high, self.which, ids)


@dataclass
class Meeting:
    """Windows that may stand in strings of different `low`: the strings that hold them, and one place of each window."""

    strings: np.ndarray
    owner: np.ndarray
    start: np.ndarray


def meeting(hashes: np.ndarray, size: np.ndarray, window: int, low: np.ndarray, anchors: np.ndarray, batch: int) -> Iterator[Meeting]:
    """Groups of windows with equal hashes in strings with different `low`, in batches of about `batch` strings or windows.

    hashes: of all windows of the strings' symbols one after another; size: symbols of each string. Groups are never parted
    and go by their anchor, so that a string is in few batches; an anchor of any number of strings is cut between windows.
    """
    n = len(size)
    where = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), np.maximum(0, size - window + 1))
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, size - window + 1)) - np.maximum(0, size - window + 1), np.maximum(0, size - window + 1))
    values = hashes[where[owner] + inner] if len(owner) else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    if not len(order):
        return
    sorted_ = values[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    count = np.diff(np.append(first, len(order)))
    of = low[owner[order]]
    mixed = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
    first, count = first[mixed], count[mixed]
    by = np.argsort(anchors[owner[order[first]]], kind="stable")
    first, count = first[by], count[by]
    total = np.cumsum(count)
    at = 0
    while at < len(first):
        # Strings of a batch: at most its windows; a batch ends before it has too many, but has one window's at least.
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + batch * _WINDOWS_A_STRING, "right")))
        rows = order[np.repeat(first[at:stop] - np.cumsum(count[at:stop]) + count[at:stop], count[at:stop]) + np.arange(count[at:stop].sum())]
        yield Meeting(np.unique(owner[rows]), owner[order[first[at:stop]]], inner[order[first[at:stop]]])
        at = stop


Solver = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def solve_shards(chunks: DataFrame, told: DataFrame, spec: Spec, buckets: int, shards: int, solver: Solver) -> DataFrame:
    """(chunk, answers binary): for distinct segments the smallest doc_id and the bits of windows found earlier still."""
    # The two sides of a cogroup have their chunk first.
    def send(key, left, right):
        press = zstandard.ZstdCompressor(level=1)
        out_shard, out_blob = [], []
        for chunk in opened(left):
            found = Candidates(chunk, right, spec, buckets)
            s, y = found.segments, found.symbols
            start = s.start[found.first]
            stop = start + s.count[found.first] + spec.window - 2
            begin, end = (y.begin[start], y.end[stop]) if len(start) else (start, stop)
            anchor = s.anchor[found.first]
            for shard, rows in by_bucket(((anchor >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)):
                size = end[rows] - begin[rows]
                text = y.canon[np.repeat(begin[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                parts = (rows.astype(np.uint32), found.low[rows], found.high[rows], anchor[rows], size.astype(np.uint32), text)
                out_shard.append(shard)
                out_blob.append(press.compress(np.uint32(len(rows)).tobytes() + b"".join(p.tobytes() for p in parts)))
        n = len(out_shard)
        return pa.table([pa.array(out_shard, pa.int32()), pa.array([key[0].as_py()] * n, pa.int64()), pa.array(out_blob, pa.binary())], ["shard", "chunk", "blob"])

    def answer(key, table):
        unpress = zstandard.ZstdDecompressor()
        distinct: dict[bytes, int] = {}
        low, high, anchors, sent = [], [], [], []
        for blob in table.column("blob").to_pylist():
            raw = unpress.decompress(blob)
            n, at = int(np.frombuffer(raw, np.uint32, 1)[0]), 4
            columns = []
            for kind in (np.uint32, np.int64, np.int64, np.uint64, np.uint32):
                columns.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            edge = (at + np.concatenate([[0], np.cumsum(columns[4], dtype=np.int64)])).tolist()
            which = np.empty(n, np.int64)
            for i in range(n):
                text = raw[edge[i] : edge[i + 1]]
                k = distinct.get(text)
                if k is None:
                    k = distinct[text] = len(distinct)
                    low.append(_LATE)
                    high.append(-_LATE)
                    anchors.append(columns[3][i])
                which[i] = k
                if columns[1][i] < low[k]:
                    low[k] = columns[1][i]
                if columns[2][i] > high[k]:
                    high[k] = columns[2][i]
            sent.append((columns[0], columns[2], which))
        least = np.array(low, np.int64)
        bits = solver(list(distinct), least, np.array(high, np.int64), np.array(anchors, np.uint64))
        out = []
        for rows, own_high, which in sent:
            say = (own_high > least[which]) | (bits[which] != 0)
            out.append(rows[say].tobytes() + least[which][say].tobytes() + bits[which][say].tobytes())
        rows = [i for i, x in enumerate(out) if x]
        return pa.table([table.column("chunk").take(pa.array(rows, pa.int64())), pa.array([out[i] for i in rows], pa.binary())], ["chunk", "answers"])

    sent = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(pairwise(send), "shard int, chunk long, blob binary")
    return save(sent.groupBy("shard").applyInArrow(groupwise(answer), "chunk long, answers binary"), "answers")


Finish = Callable[[Chunk, Symbols, np.ndarray, dict], pa.Table]


def earlier_windows(chunks: DataFrame, spec: Spec, solver: Solver, finish: Finish, schema: str, heavy: int = HEAVY_CHUNKS) -> DataFrame:
    """finish(chunk, symbols, covered mask, row) of every chunk, `covered` being symbols of windows that start earlier."""
    total = corpus_bytes(chunks)
    buckets, shards = max(1, total // _BUCKET_BYTES), max(1, total // _SHARD_BYTES)
    told = recurring_marks(chunks, spec, buckets, heavy)
    answers = solve_shards(chunks, told, spec, buckets, shards, solver)
    back = told.withColumn("answers", F.lit(None).cast("binary")).unionByName(
        answers.select("chunk", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("light"), F.lit(None).cast("binary").alias("heavy"), "answers")
    )

    def close(key, left, right):
        out = []
        for row in left.to_pylist():
            chunk = Chunk(row)
            found = Candidates(chunk, right, spec, buckets)
            least, bits = np.full(len(found.keys), _LATE), np.zeros(len(found.keys), np.uint64)
            for blob in right.column("answers").to_pylist():
                if blob:
                    n = len(blob) // 20
                    rows = np.frombuffer(blob, np.uint32, n)
                    least[rows], bits[rows] = np.frombuffer(blob, np.int64, n, 4 * n), np.frombuffer(blob, np.uint64, n, 12 * n)
            s = found.segments
            later = chunk.ids[s.doc] > least[found.which]
            starts, stops = [s.start[later]], [s.start[later] + s.count[later] + spec.window - 1]
            own, start = bits[found.which][~later], s.start[~later]
            for t in range(spec.reach):
                at = start[(own >> np.uint64(t)) & np.uint64(1) != 0] + t
                starts.append(at)
                stops.append(at + spec.window)
            n = len(found.symbols.hashes) + 1
            turn = np.bincount(np.concatenate(starts), minlength=n) - np.bincount(np.concatenate(stops), minlength=n)
            out.append(finish(chunk, found.symbols, np.cumsum(turn)[:-1] > 0, row))
        return pa.concat_tables(out) if out else None

    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(pairwise(close), schema)
