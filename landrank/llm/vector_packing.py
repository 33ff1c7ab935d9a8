"""Best-fit packing of token pieces into sequences under several capacities at once.

Tokens: `encode` gives for every text the ids of the tokenizer file. Text splits at white space first, because no token
of this vocabulary crosses it; a worker keeps the ids of the words it has met, and only new words reach the tokenizer.

Packing: every sequence has residual capacities for tokens, documents and attention cost (the sum of squared lengths).
Pieces go in by descending length to the open sequence that fits under every constraint and scores best: the largest
weighted dot product of demand and residual ("dot"), or the smallest norm of what would be left ("norm"). Pieces are
dealt evenly to shards of bounded size, each packed by one task; a shard leaves about one sequence unfilled.

Defined results: null and empty texts have only the end id 0; null doc_ids are packed like others; repeated rows are packed
once a row; pieces of equal length go in by (doc_id, piece); an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import NOT_SPACE, byte_symbols, prefix, span_hash, word_spans
from ._shared import batchwise, doc_texts, groupwise, slices, string_parts, text_bytes

CAPACITY = 2048
END_ID = 0
#: Words of these letters and one run of plain marks behind them tokenize as the letters and the marks do alone.
_PLAIN = regex.compile(r"([a-zß-öø-ÿ]+)([.,;:!?|%&$*#]+)")
_ONE = regex.compile(r"[a-zß-öø-ÿ]+|[.,;:!?|%&$*#]+")
#: Words that a worker keeps, some 40 bytes each; beyond that it starts again.
_WORDS_KEPT = 1_000_000
_RECENT = 200_000
_SHARD_BYTES = 8 << 20
_BATCH_BYTES = 1 << 20
_workers: dict[str, WordCache] = {}


class _Store:
    """Ids by word hash in sorted arrays: about 25 bytes a word and lookups for a whole batch at a time.

    New words go to a small recent level, merged into the large one when it is full; a full store starts again.
    """

    def __init__(self):
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))] * 2
        self.flat, self.end = np.zeros(1 << 20, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hit, begin, size = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for known, start, length in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                here = known[at] == keys
                hit |= here
                begin[here], size[here] = start[at[here]], length[at[here]]
        return hit, begin, size

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        new = np.frombuffer(b"".join(ids), "<u4")
        while self.end + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.end : self.end + len(new)] = new
        begin = self.end + np.cumsum(size) - size
        self.end += len(new)
        self.levels[1] = self._merged(self.levels[1], (keys, begin.astype(np.int64), size))
        if len(self.levels[1][0]) > _RECENT:
            self.levels = [self._merged(*self.levels), (keys[:0], begin[:0].astype(np.int64), size[:0])]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def __len__(self) -> int:
        return sum(len(k) for k, _, _ in self.levels)


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begin : begin + size] in a row, and where each of them ends."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends


class WordCache:
    """Ids of words, for one tokenizer file in one Python worker."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.store = _Store()

    def _tokenize(self, parts: list[str]) -> list[bytes]:
        one = [_ONE.fullmatch(p) is not None for p in parts]
        # Each of these is one pre-token, so the tokenizer's word numbers tell them apart in a text of them all.
        joined = self.tokenizer.encode(" ".join(p for p, o in zip(parts, one, strict=True) if o), add_special_tokens=False)
        raw, word = np.array(joined.ids, "<u4").tobytes(), np.array(joined.word_ids, np.int64)
        cut = (4 * np.searchsorted(word, np.arange(sum(one) + 1))).tolist()
        easy = iter([raw[i:j] for i, j in zip(cut, cut[1:], strict=False)])
        hard = iter(self.tokenizer.encode_batch([p for p, o in zip(parts, one, strict=True) if not o], add_special_tokens=False))
        return [next(easy) if o else np.array(next(hard).ids, "<u4").tobytes() for o in one]

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words; those of plain letters and marks are put together from parts, most of them met before."""
        split: list[tuple[str, str]] = []
        for raw in words:
            word = (raw.lower() if raw.isascii() else raw).decode()
            m = _PLAIN.fullmatch(word)
            split.append((m[1], m[2]) if m is not None else (word, ""))
        parts = list(dict.fromkeys(p for pair in split for p in pair if p))
        text = np.frombuffer("\n".join(parts).encode(), np.uint8)
        first, last = word_spans(text, NOT_SPACE)
        keys = span_hash(prefix(byte_symbols(text)), first, last)
        hit, begin, size = self.store.find(keys)
        ids, ends = _gather(self.store.flat, begin, size)
        raw, cut = ids.tobytes(), (4 * ends).tolist()
        known = {"": b""}
        new = []
        for p, h, i, j in zip(parts, hit.tolist(), cut, cut[1:], strict=False):
            if h:
                known[p] = raw[i:j]
            else:
                new.append(p)
        found = self._tokenize(new)
        known.update(zip(new, found, strict=True))
        self.store.add(keys[~hit], found)
        return [known[a] + known[b] for a, b in split]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian 32-bit numbers.

        Words are hashed in numpy, so each distinct word of the batch is looked up once and ids are gathered at a stroke.
        """
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        first, last = word_spans(raw, NOT_SPACE)
        if len(self.store) > _WORDS_KEPT:
            self.store = _Store()
        keys, at, inverse = np.unique(span_hash(prefix(byte_symbols(raw)), first, last), return_index=True, return_inverse=True)
        missed = np.flatnonzero(~self.store.find(keys)[0])
        if len(missed):
            where = at[missed]
            words = [raw[i:j].tobytes() for i, j in zip(first[where].tolist(), last[where].tolist(), strict=True)]
            ids = self.learn(words)
            # A word that is itself one of the parts is in the store by now.
            new = np.flatnonzero(~self.store.find(keys[missed])[0])
            self.store.add(keys[missed[new]], [ids[i] for i in new.tolist()])
        _, begin, size = self.store.find(keys)
        ids, ends = _gather(self.store.flat, begin[inverse], size[inverse])
        raw_ids = ids.tobytes()
        cuts = (4 * ends[np.searchsorted(first, np.cumsum([0] + [len(t) + 1 for t in texts]))]).tolist()
        return [raw_ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def encoder(path: str) -> WordCache:
    if path not in _workers:
        _workers[path] = WordCache(path)
    return _workers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids binary): every document's ids and end_id, cut only where longer."""
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder(tokenizer_path)
        for whole in batches:
            where, raw = string_parts(whole.column("text"))
            for first, last in slices(where, _BATCH_BYTES):
                part = whole.slice(first, last - first)
                keys, starts, ids = [], [], []
                encoded = cache.encode([raw[where[i] : where[i + 1]].tobytes() for i in range(first, last)])
                for row, found in enumerate(encoded):
                    found += end
                    for at in range(0, len(found), width):
                        keys.append(row)
                        starts.append(at // 4)
                        ids.append(found[at : at + width])
                start = np.array(starts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(keys, pa.int32())), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return doc_texts(docs).mapInArrow(batchwise(cut), "doc_id long, piece int, start long, length long, ids binary")


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bins (numbered from 0) and token offsets of demands (n x resources, tokens first), given in packing order.

    A demand that meets no open bin under every capacity opens one; demands beyond a capacity get a bin of their own.
    """
    n = len(demand)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    scale = weights / capacity**2
    left = np.zeros((64, len(capacity)))
    open_ids = np.zeros(64, np.int64)
    used, made = 0, 0
    least = demand[:, 0].min() if n else 0
    for i in range(n):
        need = demand[i]
        at = -1
        if used:
            rest = left[:used] - need
            fits = (rest >= 0).all(1)
            if fits.any():
                if rule == "dot":
                    # Normalised by the residual, so that a bin with much room does not win for having room.
                    room = left[:used]
                    score = (room * need * scale).sum(1) / np.sqrt((room * room * scale).sum(1))
                    at = int(np.argmax(np.where(fits, score, -np.inf)))
                else:
                    score = (rest * rest * scale).sum(1)
                    at = int(np.argmin(np.where(fits, score, np.inf)))
        if at < 0:
            if used == len(left):
                left = np.concatenate([left, np.zeros_like(left)])
                open_ids = np.concatenate([open_ids, np.zeros_like(open_ids)])
            at, used = used, used + 1
            left[at], open_ids[at], made = capacity, made, made + 1
        bins[i], offsets[i] = open_ids[at], round(capacity[0] - left[at, 0])
        left[at] -= need
        if left[at, 0] < least or (left[at] <= 0).any():
            used -= 1
            left[at], open_ids[at] = left[used], open_ids[used]
    return bins, offsets


def pack(found: DataFrame, shards: int, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.05), rule: str = "norm") -> DataFrame:
    """Add sequence_id long and offset long to pieces (any columns; length long, doc_id, piece are read).

    max_docs and max_attention (sum of squared lengths) default to what `capacity` tokens allow anyway. Sequences are
    numbered within their shard, the shard in the high bits.
    """
    limit = np.array([capacity, max_docs or capacity, max_attention or float(capacity) ** 2], float)
    weight = np.array(weights, float)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "__shard") + ", sequence_id long, offset long"

    def fill(key, table):
        table = table.drop_columns(["__shard"])
        length = table.column("length").to_numpy().astype(np.int64)
        frame = pd.DataFrame({"l": -length, "d": table.column("doc_id").to_numpy(zero_copy_only=False), "p": table.column("piece").to_numpy()})
        order = frame.sort_values(["l", "d", "p"], kind="stable").index.to_numpy()
        size = length[order].astype(float)
        bins, offsets = best_fit(np.stack([size, np.ones_like(size), size**2], 1), limit, weight, rule)
        sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sequence[order], offset[order] = bins + (int(key[0].as_py()) << 32), offsets
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    shard = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)).cast("int")
    return found.withColumn("__shard", shard).groupBy("__shard").applyInArrow(groupwise(fill), schema)


def shards_for(docs: DataFrame) -> int:
    return max(1, text_bytes(docs) // _SHARD_BYTES)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: float | None = None) -> DataFrame:
    """op10: one row a piece, ids as their checksum; pieces travel to their shard as numbers, not as ids.

    op10 asks for as few sequences as the tokens allow, so it sets no other limit; `max_docs` and `max_attention` bind where given.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = pa.array([zlib.crc32(x) for x in b.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], crc], ["doc_id", "piece", "start", "length", "ids_crc32"])

    found = pieces(docs, tokenizer_path, capacity).mapInArrow(batchwise(digest), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack(found, shards_for(docs), capacity, max_docs, max_attention)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


__all__ = ["best_fit", "default_tokenizer", "encoder", "pack", "pack_documents", "pieces", "shards_for"]
