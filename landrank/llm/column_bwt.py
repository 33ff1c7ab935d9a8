"""Suffix-array dedup with a Burrows-Wheeler transform built column by column.

`build` takes a collection of strings and inserts one symbol of each a round, from the last to the first: round j places
the suffixes of length j among all shorter ones by counting symbols (LF mapping) and updates common-prefix lengths from
range minima between neighbouring equal symbols. The transform and the prefix lengths live in two files that each round
reads and writes once, front to back; a task holds one collection of bounded size.

Collections are the segments of a shard (see _repeats: every 50-byte string that two documents share meets in one shard);
they are shorter than two windows, so rounds are few however long documents are. Runs of common prefixes of 50 bytes or
more then give every window's smallest doc_id, and bytes of windows that also start in a smaller document are removed.

Defined results: a null text is empty; documents with a null id neither lose bytes nor cause losses; rows that repeat an id
do not remove each other's bytes; texts below one window stay whole; an empty table gives none; clashing column names do no
harm, since other columns travel in one struct. Cuts fall between bytes: a text is decoded with what is left of a broken
character left out.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import Chunk, chunk_table
from ._hashing import byte_symbols, window_hash
from ._repeats import HEAVY_CHUNKS, Spec, Symbols, earlier_windows, meeting
from .phrase_automata import kept_runs

WINDOW = 50
SPEC = Spec(words=False, window=WINDOW, anchor=20)
_BATCH = 16_000
#: Entries that a round reads and writes at a time.
_BLOCK = 1 << 16
#: Stands in the transform where a string begins; no UTF-8 text has this byte.
_END = 255


class _External:
    """The transform and its common prefixes as pairs of bytes in two files: each round reads one and writes the other."""

    def __init__(self, folder: str):
        self.paths = [os.path.join(folder, name) for name in ("even", "odd")]
        for path in self.paths:
            open(path, "wb").close()
        self.now = 0

    def blocks(self) -> Iterator[np.ndarray]:
        """The current file from front to back, `_BLOCK` entries (symbol, common prefix) at a time."""
        with open(self.paths[self.now], "rb") as f:
            while data := f.read(2 * _BLOCK):
                yield np.frombuffer(data, np.uint8).reshape(-1, 2)

    def rewrite(self, blocks: Iterator[np.ndarray]) -> None:
        """Write the other file from front to back, over what it held (it only grows), and turn to it."""
        with open(self.paths[1 - self.now], "r+b") as f:
            for block in blocks:
                f.write(block.tobytes())
        self.now = 1 - self.now


class _Neighbours:
    """One scan over the transform: for entries asked about, in order, how many equal symbols stand before, and the smallest
    common prefix between an entry and the nearest equal symbols before and after it (-1 where there is none)."""

    def __init__(self, n: int):
        self.occ, self.before, self.after = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.count = np.zeros(256, np.int64)
        #: Smallest prefix since the last entry with a symbol; who waits for the next one.
        self.since = np.full(256, -1, np.int64)
        self.waits = np.full(256, -1, np.int64)

    def scan(self, block: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """block: next entries; rows: numbers of those asked about, at: their places in the block."""
        bwt, lcp = np.ascontiguousarray(block[:, 0]), np.ascontiguousarray(block[:, 1])
        order = np.argsort(bwt, kind="stable")
        counts = np.bincount(bwt, minlength=256)
        start = np.cumsum(counts) - counts
        kinds = np.flatnonzero(counts)
        first, last = order[start[kinds]], order[start[kinds] + counts[kinds] - 1]
        # The first entry of each symbol in the block ends what was open before it.
        head = np.minimum.accumulate(lcp)
        opened = np.full(256, -1, np.int64)
        opened[kinds] = np.where(self.since[kinds] >= 0, np.minimum(self.since[kinds], head[first]), -1)
        met = kinds[self.waits[kinds] >= 0]
        self.after[self.waits[met]] = opened[met]
        self.waits[kinds] = -1
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        seat, symbol = place[at].astype(np.int64), bwt[at]
        self.occ[rows] = self.count[symbol] + seat - start[symbol]
        inner = seat > start[symbol]
        self.before[rows] = opened[symbol]
        self.before[rows[inner]] = _range_min(lcp, order[seat[inner] - 1], at[inner])
        inner = seat < start[symbol] + counts[symbol] - 1
        self.after[rows[inner]] = _range_min(lcp, at[inner], order[seat[inner] + 1])
        self.waits[symbol[~inner]] = rows[~inner]
        # What follows the last entry of each symbol, to the end of the block.
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1].astype(np.int64), 255)
        seen = self.since >= 0
        self.since[seen] = np.minimum(self.since[seen], tail[0])
        self.since[kinds] = tail[last + 1]
        self.count += counts


def build(texts: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefix with the entry before) of all suffixes of all strings, in order; strings' ends come first.

    Strings must be shorter than 255 bytes. A round scans the file twice in blocks: once to rank the symbols to insert, once
    to merge them in; what stays in memory is one number a string and 256 counters.
    """
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum(size)
    files = _External(folder)
    ends = np.where(size > 0, raw[np.maximum(end - 1, 0)], _END).astype(np.uint8) if len(raw) else np.full(n, _END, np.uint8)
    files.rewrite(iter([np.stack([ends, np.zeros(n, np.uint8)], 1)]))
    counts = np.bincount(ends, minlength=256)
    place, live = np.arange(n), np.flatnonzero(size > 0)
    for j in range(1, int(size.max(initial=0)) + 1):
        live = live[size[live] >= j]
        live = live[np.argsort(place[live], kind="stable")]
        at = place[live]
        found = _Neighbours(len(live))
        base = 0
        for block in files.blocks():
            rows = np.arange(*np.searchsorted(at, [base, base + len(block)]))
            found.scan(block, rows, at[rows] - base)
            base += len(block)
        symbol = raw[end[live] - j]
        new = n + (np.cumsum(counts) - counts)[symbol] + found.occ
        fresh = np.where(size[live] > j, raw[np.maximum(end[live] - j - 1, 0)], _END).astype(np.uint8)
        by = np.argsort(new, kind="stable")
        entry = np.stack([fresh, found.before + 1], 1).astype(np.uint8)[by]
        files.rewrite(_merged(files.blocks(), new[by], entry, (found.after + 1)[by].astype(np.uint8), base))
        counts += np.bincount(fresh, minlength=256)
        place[live] = new
    out = np.concatenate([np.zeros((0, 2), np.uint8), *files.blocks()])
    return out[:, 0].copy(), out[:, 1].copy()


def _merged(blocks: Iterator[np.ndarray], new: np.ndarray, entry: np.ndarray, after: np.ndarray, total: int) -> Iterator[np.ndarray]:
    """Blocks with entries put in at places `new` of the result; what stands behind an entry shares `after` with it."""
    before = new - np.arange(len(new))
    base = 0
    for block in blocks:
        stop = base + len(block)
        a, b = np.searchsorted(before, base), np.searchsorted(before, stop) if stop < total else len(before)
        out = block.copy()
        # Of entries in one gap the last one stands before the old entry.
        gap = before[a:b] - base
        old = gap < len(block)
        out[gap[old], 1] = after[a:b][old]
        pairs = lambda x: np.ascontiguousarray(x).view(np.uint16).ravel()
        yield np.insert(pairs(out), gap, pairs(entry[a:b])).view(np.uint8).reshape(-1, 2)
        base = stop


def _range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of values[a + 1 .. b] for pairs a < b. One pass: pairs go by their end."""
    if not len(a):
        return np.zeros(0, np.int64)
    padded = np.append(values, 0)
    pairs = np.empty(2 * len(a), np.int64)
    pairs[0::2], pairs[1::2] = a + 1, b + 1
    return np.minimum.reduceat(padded, pairs)[0::2].astype(np.int64)


def earliest(texts: list[bytes], low: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Bits of the windows of each text that occur in a text with a smaller `low`."""
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = build(texts, folder)
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(order), np.int64)
    step[order] = n + np.arange(len(order))
    group = np.cumsum(lcp < window)
    least = np.full(int(group[-1]) + 1 if n else 0, np.iinfo(np.int64).max)
    walks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place, live = np.arange(n), np.arange(n)
    for j in range(1, int(size.max(initial=0)) + 1):
        live = live[size[live] >= j]
        place[live] = step[place[live]]
        if j >= window:
            met = group[place[live]]
            np.minimum.at(least, met, low[live])
            walks.append((live, size[live] - j, met))
    bits = np.zeros(n, np.uint64)
    for rows, start, met in walks:
        bits[rows] |= (least[met] < low[rows]).astype(np.uint64) << start.astype(np.uint64)
    return bits


def solver(texts: list[bytes], low: np.ndarray, high: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Bits as `earliest` gives them. Strings that no other one with another `low` can share a window with, by the windows'
    hashes, stay out of the collections; equal hashes always meet in one, so nothing is lost."""
    bits = np.zeros(len(texts), np.uint64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    for rows in meeting(window_hash(byte_symbols(raw), WINDOW), np.fromiter(map(len, texts), np.int64, len(texts)), WINDOW, low, anchors, _BATCH):
        bits[rows.strings] |= earliest([texts[i] for i in rows.strings.tolist()], low[rows.strings])
    return bits


def _finish(chunk: Chunk, symbols: Symbols, covered: np.ndarray, row: dict) -> pa.Table:
    size, gone, spans, sha = [], [], [], []
    for i, j in zip(chunk.where[:-1].tolist(), chunk.where[1:].tolist(), strict=True):
        mask = covered[i:j]
        n = int(mask.sum())
        size.append(j - i)
        gone.append(n)
        spans.append(int((mask[1:] & ~mask[:-1]).sum() + mask[0]) if n else 0)
        sha.append(hashlib.sha256((chunk.raw[i:j][~mask] if n else chunk.raw[i:j]).tobytes()).hexdigest())
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.table([pa.array(x, k) for x, k in zip((row["ids"], size, gone, spans, sha), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(chunk: Chunk, symbols: Symbols, covered: np.ndarray, row: dict) -> pa.Table:
    texts, spans = [], []
    for i, j in zip(chunk.where[:-1].tolist(), chunk.where[1:].tolist(), strict=True):
        mask = covered[i:j]
        texts.append(chunk.raw[i:j][~mask].tobytes().decode(errors="ignore"))
        spans.append([{"start": a, "end": b} for a, b in kept_runs(~mask)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([pa.array(row["ids"], pa.int64()), pa.array(texts, pa.string()), pa.array(spans, span)], ["doc_id", "text", "removed"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed): what stays of each text, and the removed byte spans of the text as it was."""
    return earlier_windows(chunk_table(docs), SPEC, solver, _texts, "doc_id long, text string, removed array<struct<start: long, end: long>>")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with texts cut and n_chars counted anew; documents of which nothing is left go, other columns stay as they were."""
    others = [c for c in docs.columns if c != "text"]
    carried = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried"))
    chunks = chunk_table(carried, "carried")
    kind = chunks.schema["carried"].dataType.elementType

    def finish(chunk: Chunk, symbols: Symbols, covered: np.ndarray, row: dict) -> pa.Table:
        kept = _texts(chunk, symbols, covered, row)
        return pa.table([kept.column("text"), pa.array(row["carried"], _arrow(kind))], ["text", "carried"])

    cut = earlier_windows(chunks, SPEC, solver, finish, f"text string, carried {kind.simpleString()}")
    columns = [F.col("text") if c == "text" else F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"carried.`{c}`") for c in docs.columns]
    return cut.filter(F.col("text") != "").select(*columns)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def suffix_dedup(docs: DataFrame, heavy: int = HEAVY_CHUNKS) -> DataFrame:
    """op8: counts and digest of what stays of every document."""
    return earlier_windows(chunk_table(docs), SPEC, solver, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", heavy)
