"""Tokens of two tokenizers over the same bytes: groups between common ends, links inside them, and what each id goes with most.

Texts are taken apart where neither tokenizer lets a token cross (`_space_chunks`), so both end a token at every such place and the
groups of a distinct part are found once a worker. What a document holds of an id pair, and how often, is a record.

Counting: a task takes documents in chunks of some megabytes, sorts their records side-major (id of A, id of B, document),
and splits the pairs by a radix into zstd runs: for each pair how many of the chunk's documents hold it, in blocks. The
records themselves stay behind with the chunk. For each radix a heap over the heads of the runs' blocks merges at most FAN_IN
runs, adds up every pair, and streams the totals back into an answer for each run, in the run's order; more runs than that are
merged in levels, and their answers come back down the same levels. Because a merged run is side-major, the greatest count of
an A id is a maximum over neighbours. An answer goes to its chunk, where the records turn it into figures of documents.

Of each chunk a pair is one entry, however many documents hold it, and the radix of a pair takes two bits of its B id too,
so an A id that stands in all documents is dealt to four places. Greatest counts are one number an A id: bounded by the vocabulary.

Defined results: null, empty and differing texts (whose joined A or B bytes aren't space + text) have zeros and '' and count in
no pair; repeated rows count as often as they stand; null doc_ids are kept; very long texts are chunks of their own; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import by_bucket
from ._hashing import mix
from ._shared import batchwise, doc_texts, groupwise, pairwise, save, slices, string_parts, text_bytes
from ._space_chunks import Joined, PartCache, gather, part_spans
from .token_files import byte_level_ids, id_bytes

CHUNK_BYTES = 8 << 20
FAN_IN = 256
_BATCH_BYTES = 1 << 20
_RUN_BLOCK = 4096
_RADIX_BYTES = 16 << 20
_MOST_RADIX = 4096
_WORD = np.uint64(32)
#: What a part's run begins with: whether bytes agree, tokens of A, of B, groups, links (low, high), pairs, bytes of the groups' text.
_HEAD = 8
#: Groups' texts of the parts together are cut to pieces of this many bytes when a tokenizer takes them in one text.
_JOIN_BYTES = 1 << 16
_workers: dict[tuple[str, str], Aligner] = {}


# --- tokens of a part ------------------------------------------------------------------------------------------------


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size


def byte_level_entries(tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary. Its entries write printable bytes as themselves and the other
    bytes, in order, as the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(of[c] for c in piece)
    return out


def piece_entries(processor) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, a byte piece <0xHH> the byte HH."""
    return [bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace("▁", " ").encode() for i in range(processor.get_piece_size())]


def ends_in(ids: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], raw: bytes) -> np.ndarray | None:
    """Where each token ends in raw, or nothing where the tokens' bytes are not raw."""
    flat, begin, size = entries
    found, ends = gather(flat, begin[ids], size[ids])
    return ends[1:] if found.tobytes() == raw else None


def aligned(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common ends, group of each A token, group of each B token)."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return common, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) of the distinct ids of each group, by group."""
    key, times = np.unique(group.astype(np.uint64) << _WORD | ids.astype(np.uint64), return_counts=True)
    return (key >> _WORD).astype(np.int64), key & np.uint64(0xFFFFFFFF), times


def linked(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links) of every distinct pair of ids that share a group; a pair is A's id and B's in 64 bits."""
    ga, ida, ta = _distinct(group_a, a)
    gb, idb, tb = _distinct(group_b, b)
    have = np.bincount(gb, minlength=n_groups)
    begin = np.cumsum(have) - have
    rows = np.repeat(np.arange(len(ga)), have[ga])
    at, _ = gather(np.arange(len(gb)), begin[ga], have[ga])
    return ga[rows], ida[rows] << _WORD | idb[at], ta[rows] * tb[at]


def summed(order_by: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (first array major), sorted, and the sums of their values."""
    order = np.lexsort(order_by[::-1])
    keys = [k[order] for k in order_by]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(values[order], at) if len(at) else values[:0]


class Aligner:
    """Both tokenizers, and the alignment of the parts met, in one Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_a = id_bytes(self.a)
        self.entries_a, self.entries_b = _flat(byte_level_entries(self.a)), _flat(piece_entries(self.b))
        most = max(len(self.entries_a[2]), len(self.entries_b[2]))
        self.said = _flat([f"{i}{mark}".encode() for i in range(most) for mark in ",|;"])
        self.cache = PartCache(self.learn)

    def _pieces(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray | None]:
        """B's ids of each part, or nothing where their bytes differ from the part. A part begins with the space that B adds."""
        joined = Joined(raw, first, last)
        out: list[np.ndarray | None] = [None] * len(first)
        alone = joined.alone.tolist()
        for i, j in slices(joined.ends, _JOIN_BYTES):
            text = joined.raw[joined.ends[i] : joined.ends[j]].tobytes()
            ids = np.array(self.b.encode(text[1:].decode()), np.int64)
            ends = ends_in(ids, self.entries_b, text)
            stops = joined.ends[i + 1 : j + 1] - joined.ends[i]
            cut = np.searchsorted(ends, stops) + 1 if ends is not None else None
            if cut is None or (ends[np.minimum(cut - 1, len(ends) - 1)] != stops).any():
                alone += joined.together[i:j].tolist()
                continue
            for row, lo, hi in zip(joined.together[i:j].tolist(), [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                out[row] = ids[lo:hi]
        for row in alone:
            # Behind a dot, because B gives an empty text no space: the dot and the space before it are the first two bytes.
            text = b"." + raw[first[row] : last[row]].tobytes()
            ids = np.array(self.b.encode(text.decode()), np.int64)
            ends = ends_in(ids, self.entries_b, b" " + text)
            out[row] = ids[ends > 2] if ends is not None else None
        return out

    def learn(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """For each part its run: head, then pairs (A's id, B's, links low and high), then the groups' text with a last ';'."""
        said_a = byte_level_ids(self.a, raw, first, last, self.size_a)
        ids_b = self._pieces(raw, first, last)
        length = last - first
        n_a = np.array([len(x) // 4 for x in said_a], np.int64)
        a = np.frombuffer(b"".join(said_a), "<u4").astype(np.int64)
        fits = (np.add.reduceat(self.entries_a[2][a], np.cumsum(n_a) - n_a) == length) & np.array([b is not None for b in ids_b])
        at, _ = gather(np.arange(len(a)), (np.cumsum(n_a) - n_a)[fits], n_a[fits])
        same = gather(self.entries_a[0], self.entries_a[1][a[at]], self.entries_a[2][a[at]])[0] == gather(raw, first[fits], length[fits])[0]
        fine = np.flatnonzero(fits)
        if len(fine):
            fine = fine[np.logical_and.reduceat(same, np.cumsum(length[fits]) - length[fits])]
        out = [bytes(4 * _HEAD)] * len(first)
        if not len(fine):
            return out
        at, _ = gather(np.arange(len(a)), (np.cumsum(n_a) - n_a)[fine], n_a[fine])
        a, b, n = a[at], np.concatenate([ids_b[r] for r in fine.tolist()]), len(fine)
        stops = np.cumsum(length[fine])
        ends_a, ends_b = np.cumsum(self.entries_a[2][a]), np.cumsum(self.entries_b[2][b])
        common, group_a, group_b = aligned(a, ends_a, b, ends_b)
        part_of = np.searchsorted(stops, common)
        group, pair, links = linked(a, group_a, b, group_b, len(common))
        (part, pair), links = summed((part_of[group].astype(np.uint64), pair), links)
        n_groups, n_pairs = np.bincount(part_of, minlength=n), np.bincount(part.astype(np.int64), minlength=n)
        per_group = np.bincount(group_a, minlength=len(common)) * np.bincount(group_b, minlength=len(common))
        n_links = np.add.reduceat(per_group, np.cumsum(n_groups) - n_groups)
        records = np.stack([pair >> _WORD, pair & np.uint64(0xFFFFFFFF), links.astype(np.uint64) & np.uint64(0xFFFFFFFF), links.astype(np.uint64) >> _WORD], 1).astype("<u4").tobytes()
        # The groups' text: A's tokens and then B's of each group, every id with the mark that follows it.
        of = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(of, kind="stable")
        of, ids = of[order], np.concatenate([a, b])[order]
        more = np.append(of[1:] == of[:-1], False)
        flat, begin, size = self.said
        entry = 3 * ids + np.where(more, 0, 1 + of % 2)
        text = gather(flat, begin[entry], size[entry])[0].tobytes()
        n_text = np.bincount(part_of[of // 2], weights=size[entry], minlength=n).astype(np.int64)
        counted = (np.bincount(np.searchsorted(stops, e), minlength=n) for e in (ends_a, ends_b))
        heads = np.stack([np.ones(n, np.int64), *counted, n_groups, n_links & 0xFFFFFFFF, n_links >> 32, n_pairs, n_text], 1).astype("<u4").tobytes()
        cut_r, cut_t = (16 * np.append(0, np.cumsum(n_pairs))).tolist(), np.append(0, np.cumsum(n_text)).tolist()
        for k, row in enumerate(fine.tolist()):
            i, j = cut_t[k], cut_t[k + 1]
            out[row] = heads[4 * _HEAD * k : 4 * _HEAD * (k + 1)] + records[cut_r[k] : cut_r[k + 1]] + text[i:j] + b"\0" * ((i - j) % 4)
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _workers:
        _workers[path_a, path_b] = Aligner(path_a, path_b)
    return _workers[path_a, path_b]


class Aligned:
    """Figures, groups' texts and records of a batch of texts."""

    NAMES = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, tokens: Aligner, texts: list[bytes]):
        n = len(texts)
        rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
        self.figures = np.zeros((4, n), np.int64)
        self.said, self.spans = b"", np.zeros((n, 2), np.int64)
        self.doc, self.pair, self.links = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not len(rows):
            return
        raw = np.frombuffer(b"".join(b" " + texts[i] for i in rows.tolist()), np.uint8)
        where = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in rows.tolist()])])
        first, last = part_spans(raw, where)
        flat, begin, _, part = tokens.cache.runs(raw, first, last)
        head = flat[begin[:, None] + np.arange(_HEAD)].astype(np.int64)
        starts = np.searchsorted(first, where[:-1])
        fine = np.minimum.reduceat(head[part, 0], starts) > 0
        doc_of = np.repeat(rows, np.diff(np.append(starts, len(first))))
        keep = np.repeat(fine, np.diff(np.append(starts, len(first))))
        part, doc_of = part[keep], doc_of[keep]
        if not len(part):
            return
        places = np.flatnonzero(np.concatenate([[True], doc_of[1:] != doc_of[:-1]]))
        kept = doc_of[places]
        links = head[:, 4] | head[:, 5] << 32
        for k, column in enumerate((head[:, 1], head[:, 2], head[:, 3], links)):
            self.figures[k, kept] = np.add.reduceat(column[part], places)
        said, ends = gather(flat.view(np.uint8), 4 * (begin + _HEAD + 4 * head[:, 6])[part], head[part, 7])
        self.said = said.tobytes()
        cut = np.append(ends[places], ends[-1])
        self.spans[kept] = np.stack([cut[:-1], cut[1:] - 1], 1)
        met, times = np.unique(doc_of * len(head) + part, return_counts=True)
        doc, u = np.divmod(met, len(head))
        at, _ = gather(np.arange(int(head[:, 6].sum())), (np.cumsum(head[:, 6]) - head[:, 6])[u], head[u, 6])
        all_records, _ = gather(flat, begin + _HEAD, 4 * head[:, 6])
        record = all_records.reshape(-1, 4)[at].astype(np.uint64)
        rows_of = np.repeat(np.arange(len(u)), head[u, 6])
        self.doc, self.pair = doc[rows_of].astype(np.uint64), record[:, 0] << _WORD | record[:, 1]
        self.links = (record[:, 2] | record[:, 3] << _WORD).astype(np.int64) * times[rows_of]

    def groups(self, i: int) -> bytes:
        """A document's groups, `a1,a2|b1;a3|b2,b3`."""
        return self.said[self.spans[i, 0] : self.spans[i, 1]]


# --- runs ------------------------------------------------------------------------------------------------------------


def _press(x: np.ndarray) -> bytes:
    """An array as zstd of its smallest unsigned type, with a letter for the type."""
    most = int(x.max(initial=0))
    kind = next(k for k, top in (("B", 1 << 8), ("H", 1 << 16), ("I", 1 << 32), ("Q", 1 << 64)) if most < top)
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unpress(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), raw[:1].decode())


def _bound(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unbound(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "little")
        yield raw[at + 4 : at + 4 + size]
        at += 4 + size


def write_run(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """A run of side-major pairs and their counts in blocks: first pair, steps to the next ones, counts."""
    out = []
    for i in range(0, len(pairs), _RUN_BLOCK):
        block = pairs[i : i + _RUN_BLOCK]
        out += [int(block[0]).to_bytes(8, "little"), _press(np.diff(block)), _press(counts[i : i + _RUN_BLOCK])]
    return _bound(out)


def read_run(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks of a run, one at a time."""
    parts = _unbound(raw)
    for first in parts:
        steps = _unpress(next(parts)).astype(np.uint64)
        pairs = np.concatenate([[np.uint64(int.from_bytes(first, "little"))], steps]).astype(np.uint64)
        yield np.cumsum(pairs, dtype=np.uint64), _unpress(next(parts)).astype(np.int64)


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """A heap over the last pairs of the runs' open blocks: (pairs, total counts, for each run that holds some its totals), side-major."""
    blocks = [read_run(r) for r in runs]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def refill(r: int) -> None:
        block = next(blocks[r], None)
        if block is None:
            held.pop(r, None)
        else:
            held[r] = block
            heapq.heappush(heap, (int(block[0][-1]), r))

    for r in range(len(runs)):
        refill(r)
    while heap:
        bound, r = heapq.heappop(heap)
        if r not in held or int(held[r][0][-1]) != bound:
            continue
        parts = []
        for q, (pairs, counts) in held.items():
            n = int(np.searchsorted(pairs, np.uint64(bound), side="right"))
            if n:
                parts.append((q, pairs[:n], counts[:n]))
        pairs, place = np.unique(np.concatenate([p for _, p, _ in parts]), return_inverse=True)
        totals = np.zeros(len(pairs), np.int64)
        np.add.at(totals, place, np.concatenate([c for _, _, c in parts]))
        back, at = [], 0
        for q, p, _ in parts:
            back.append((q, totals[place[at : at + len(p)]]))
            at += len(p)
            left = held[q]
            if len(p) == len(left[0]):
                refill(q)
            else:
                held[q] = (left[0][len(p) :], left[1][len(p) :])
        yield pairs, totals, back


def best_of(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A id, its greatest count) of side-major pairs."""
    a = (pairs >> _WORD).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return a[at], np.maximum.reduceat(counts, at) if len(at) else counts[:0]


# --- Spark -----------------------------------------------------------------------------------------------------------


def radix_of(pairs: np.ndarray, n: int) -> np.ndarray:
    """Place of a pair: by its A id and two bits of its B id."""
    a, b = mix(pairs >> _WORD), mix(pairs & np.uint64(0xFFFFFFFF))
    return ((a + (b & np.uint64(3))) % np.uint64(n)).astype(np.int64)


_TABLE = "chunk long, radix int, run binary, ids array<long>, figures array<array<long>>, digests array<string>, records binary"


def record_table(docs: DataFrame, path_a: str, path_b: str, radix: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Saved rows of two kinds: a chunk's documents with their figures and records (radix null), and its run for each radix."""
    schema = pa.schema([("chunk", pa.int64()), ("radix", pa.int32()), ("run", pa.binary()), ("ids", pa.list_(pa.int64())), ("figures", pa.list_(pa.list_(pa.int64()))), ("digests", pa.list_(pa.string())), ("records", pa.binary())])
    empty = {"run": None, "ids": None, "figures": None, "digests": None, "records": None}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[list, Aligned, list[str]]] = []
        size = 0
        tokens = aligner(path_a, path_b)

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            chunk, seq = (part << 32) + seq, seq + 1
            first = np.cumsum([0] + [len(i) for i, _, _ in held])
            (pair, doc), links = summed((np.concatenate([x.pair for _, x, _ in held]), np.concatenate([x.doc + np.uint64(f) for (_, x, _), f in zip(held, first, strict=False)])), np.concatenate([x.links for _, x, _ in held]))
            pairs, counts = np.unique(pair, return_counts=True)
            ids = [i for x, _, _ in held for i in x]
            figures = np.concatenate([x.figures for _, x, _ in held], 1)
            rows = [empty | {"chunk": chunk, "radix": None, "ids": ids, "figures": figures.tolist(), "digests": [d for _, _, x in held for d in x], "records": _bound([write_run(pairs, counts), _press(doc), _press(links)])}]
            rows += [empty | {"chunk": chunk, "radix": r, "run": write_run(pairs[where], counts[where])} for r, where in by_bucket(radix_of(pairs, radix))]
            held, size = [], 0
            return pa.RecordBatch.from_pylist(rows, schema)

        for whole in batches:
            where, raw = string_parts(whole.column("text"))
            for i, j in slices(where, min(_BATCH_BYTES, chunk_bytes)):
                if size and size + where[j] - where[i] > chunk_bytes:
                    yield flush()
                found = Aligned(tokens, [raw[where[k] : where[k + 1]].tobytes() for k in range(i, j)])
                digests = [hashlib.sha256(found.groups(k)).hexdigest() if found.figures[0, k] else "" for k in range(j - i)]
                found.said = b""
                held.append((whole.column("doc_id").slice(i, j - i).to_pylist(), found, digests))
                size += int(where[j] - where[i])
        if held:
            yield flush()

    return save(doc_texts(docs).mapInArrow(batchwise(build), _TABLE), "pair-records")


_ANSWER = "radix int, chunk long, answer binary"


def count_runs(runs: DataFrame, n: int, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, chunk, answer): for each run the corpus-wide counts of its pairs; for each radix, chunk null, the merged run itself.

    runs: (radix int, chunk long, run binary) of n chunks.
    """

    def answers(key, table):
        back: list[list[np.ndarray]] = [[] for _ in range(len(table))]
        pairs, totals = [], []
        for p, t, given in merged(table.column("run").to_pylist()):
            pairs.append(p)
            totals.append(t)
            for r, counts in given:
                back[r].append(counts)
        out = [_press(np.concatenate(b)) if b else _press(np.zeros(0, np.int64)) for b in back]
        top = write_run(np.concatenate(pairs), np.concatenate(totals)) if pairs else b""
        chunks = [*table.column("chunk").to_pylist(), None]
        return pa.table([pa.array([key[0].as_py()] * len(chunks), pa.int32()), pa.array(chunks, pa.int64()), pa.array([*out, top], pa.binary())], ["radix", "chunk", "answer"])

    if n <= fan_in:
        return save(runs.groupBy("radix").applyInArrow(groupwise(answers), _ANSWER), "pair-counts")

    def merge(key, table):
        found = [(p, t) for p, t, _ in merged(table.column("run").to_pylist())]
        run = write_run(np.concatenate([p for p, _ in found]), np.concatenate([t for _, t in found]))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([run], pa.binary())], ["radix", "chunk", "run"])

    def down(left, right):
        run, answer = right.column("run").to_pylist()[0], _unpress(right.column("answer").to_pylist()[0]).astype(np.int64)
        known = np.concatenate([p for p, _ in read_run(run)])
        out = []
        for r in left.column("run").to_pylist():
            out.append(_press(answer[np.searchsorted(known, np.concatenate([p for p, _ in read_run(r)]))]))
        return pa.table([left.column("radix"), left.column("chunk"), pa.array(out, pa.binary())], ["radix", "chunk", "answer"])

    supers = -(-n // fan_in)
    # Two kinds of draws would differ between runs of a task: a chunk's group follows from its number alone.
    grouped = runs.withColumn("super", F.pmod(F.xxhash64("chunk"), F.lit(supers)))
    above = save(grouped.groupBy("radix", "super").applyInArrow(groupwise(merge), "radix int, chunk long, run binary"), "pair-runs")
    told = count_runs(above, supers, fan_in)
    given = above.join(told, ["radix", "chunk"]).withColumnRenamed("chunk", "super")
    members = grouped.groupBy("radix", "super").cogroup(given.groupBy("radix", "super")).applyInArrow(pairwise(lambda _, x, y: down(x, y)), _ANSWER)
    return save(members.unionByName(told.filter("chunk is null")), "pair-counts")


def _tables(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int, fan_in: int) -> tuple[DataFrame, DataFrame, int]:
    radix = int(min(_MOST_RADIX, max(8, text_bytes(docs) // _RADIX_BYTES)))
    table = record_table(docs, path_a, path_b, radix, chunk_bytes)
    n = table.filter("radix is null").select("chunk").count()
    return table, count_runs(table.filter("radix is not null").select("radix", "chunk", "run"), n, fan_in), radix


def best_counts(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(A ids, their greatest counts), sorted: at most one number an entry of the vocabulary."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("answer").to_pylist():
                for pairs, counts in read_run(raw):
                    a, most = best_of(pairs, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(most)], ["a_id", "most"])

    rows = counted.filter("chunk is null").select("answer").mapInArrow(batchwise(tops), "a_id long, most long").groupBy("a_id").agg(F.max("most").alias("most")).toPandas().sort_values("a_id")
    return rows["a_id"].to_numpy(np.int64), rows["most"].to_numpy(np.int64)


def pair_counts(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """(a_id, b_id, n_docs, best): every linked pair of ids, how many documents hold it, and whether it is its A id's most frequent."""
    _, counted, _ = _tables(docs, path_a, path_b, chunk_bytes, fan_in)
    ids, most = best_counts(counted)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("answer").to_pylist():
                for pairs, counts in read_run(raw):
                    a = (pairs >> _WORD).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts), pa.array(counts == most[np.searchsorted(ids, a)])], ["a_id", "b_id", "n_docs", "best"])

    return counted.filter("chunk is null").select("answer").mapInArrow(batchwise(unpack), "a_id long, b_id long, n_docs long, best boolean")


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups): the groups of every document as text, '' where it has no tokens. No shuffle."""

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = aligner(path_a, path_b)
        for whole in batches:
            where, raw = string_parts(whole.column("text"))
            for i, j in slices(where, _BATCH_BYTES):
                found = Aligned(tokens, [raw[where[k] : where[k + 1]].tobytes() for k in range(i, j)])
                yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(i, j - i), pa.array([found.groups(k).decode() if found.figures[0, k] else "" for k in range(j - i)])], ["doc_id", "groups"])

    return doc_texts(docs).mapInArrow(batchwise(say), "doc_id long, groups string")


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """op11: figures of every document's alignment against the counts of the whole corpus."""
    table, counted, radix = _tables(docs, path_a, path_b, chunk_bytes, fan_in)
    ids, most = best_counts(counted)

    def tell(left, right):
        row = left.to_pylist()[0]
        run, doc, links = _unbound(row["records"])
        blocks = list(read_run(run))
        pairs, holders = (np.concatenate([b[k] for b in blocks]) if blocks else np.zeros(0, np.uint64) for k in (0, 1))
        counts, place = np.zeros(len(pairs), np.int64), radix_of(pairs, radix)
        given = {r["radix"]: r["answer"] for r in right.to_pylist()}
        for r, where in by_bucket(place):
            counts[where] = _unpress(given[r])
        best = counts == most[np.searchsorted(ids, (pairs >> _WORD).astype(np.int64))] if len(pairs) else np.zeros(0, bool)
        of = np.repeat(np.arange(len(pairs)), holders.astype(np.int64))
        doc, links = _unpress(doc).astype(np.int64), _unpress(links).astype(np.int64)
        n_best, count_sum = np.zeros(len(row["ids"]), np.int64), np.zeros(len(row["ids"]), np.int64)
        np.add.at(n_best, doc, links * best[of])
        np.add.at(count_sum, doc, links * counts[of])
        return pa.table([pa.array(row["ids"], pa.int64()), *(pa.array(f, pa.int64()) for f in row["figures"]), pa.array(n_best), pa.array(count_sum), pa.array(row["digests"], pa.string())], _RESULT.replace(" long", "").replace(" string", "").split(", "))

    kept = table.filter("radix is null").select("chunk", "ids", "figures", "digests", "records")
    back = counted.filter("chunk is not null")
    return kept.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(pairwise(lambda _, x, y: tell(x, y)), _RESULT)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


__all__ = ["Aligner", "align", "best_counts", "count_runs", "default_tokenizers", "merged", "pair_counts", "read_run", "token_groups", "write_run"]
