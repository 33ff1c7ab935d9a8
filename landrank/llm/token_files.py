"""Token ids in files of directly addressable codes.

An id is split into chunks of few bits, low ones first. Level k holds chunk k of every id that has one, packed, with a
bitmap that says which ids go on to level k + 1 and a rank directory that counts the bitmap's ones every 512 bits. The
place of an id on the next level is the rank of its bit, so any id is read from a few words a level: no block is decoded.
Widths of the levels are the cheapest for the ids of the file, found from the counts of their bit lengths.

Files hold whole documents in ascending doc_id order (nulls first, then by a hash of the text), some FILE_IDS ids each.
Tasks write them to the shared folder and return the table of files, which carries each file's first id; only files that this
table names belong to the set, so attempts that were lost or ran twice leave nothing in it.

Defined results: null and empty texts have only the end id; null doc_ids are kept and come first; repeated rows are written
once a row; an empty table gives no files and no rows; special tokens' strings in texts become those tokens, as the
library's default has it; very long texts are one document of one file; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._files import open_file, write_file
from ._shared import batchwise, doc_texts, save, shared_dir, slices, string_parts, text_bytes
from ._space_chunks import Joined, PartCache, gather, part_spans

END_ID = 0
FILE_IDS = 1 << 22
_PARTITION_BYTES = 16 << 20
_BATCH_BYTES = 1 << 20
_READ_IDS = 1 << 20
_RANK_BITS = 512
_MAGIC = b"LRDAC001"
#: magic, documents, ids, levels; then for each level its width, its ids, and where chunks, bitmap and directory begin.
_HEAD, _LEVEL = struct.Struct("<8sqqq"), struct.Struct("<qqqqq")
#: Numbers of files are added up in groups of this many partitions first.
_GROUP = 1024
_workers: dict[str, PartCache] = {}


# --- codes ---------------------------------------------------------------------------------------------------------


def level_widths(ids: np.ndarray) -> list[int]:
    """Bits of each level, with the least total of chunks, bitmaps and directories for these ids."""
    length = np.bincount(np.searchsorted(np.int64(1) << np.arange(33, dtype=np.int64), ids.astype(np.int64), side="right"), minlength=34)
    most = max(1, int(np.flatnonzero(length)[-1])) if len(ids) else 1
    going = [int(length[j + 1 :].sum()) if j else len(ids) for j in range(most + 1)]  # ids of more than j bits
    best: dict[int, tuple[float, list[int]]] = {most: (0.0, [])}
    for at in range(most - 1, -1, -1):
        cost = lambda to: going[at] * (to - at + (0 if to == most else 1 + 32 / _RANK_BITS)) + best[to][0]  # noqa: B023, E731
        to = min(range(at + 1, most + 1), key=cost)
        best[at] = (cost(to), [to - at, *best[to][1]])
    return best[0][1]


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """values of `width` bits each, one after another in 64-bit words, and a spare word behind."""
    n = -(-len(values) // 64)
    padded = np.zeros(64 * n, np.uint64)
    padded[: len(values)] = values
    column = np.ascontiguousarray(padded.reshape(n, 64).T)  # 64 values take exactly `width` words
    words = np.zeros((width, n), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[word] |= column[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= column[k] >> np.uint64(64 - shift)
    return np.append(np.ascontiguousarray(words.T).ravel(), np.uint64(0))


def dac_file(doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file: head, levels' places, documents (id, whether it is known, first id), then each level."""
    widths = level_widths(ids)
    documents = [doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), starts.astype("<i8").tobytes()]
    at = _HEAD.size + _LEVEL.size * len(widths) + sum(map(len, documents))
    places, body, rest = [], [], ids.astype(np.uint64)
    for k, width in enumerate(widths):
        parts = [pack_bits(rest & np.uint64((1 << width) - 1), width).astype("<u8").tobytes()]
        goes_on = rest >> np.uint64(width) > 0
        if k + 1 < len(widths):
            bits = np.packbits(goes_on, bitorder="little")
            whole = np.zeros(-(-(len(bits) + 1) // (_RANK_BITS // 8)) * (_RANK_BITS // 8), np.uint8)
            whole[: len(bits)] = bits
            counts = np.bitwise_count(whole.view("<u8")).reshape(-1, _RANK_BITS // 64).sum(1)
            parts += [whole.tobytes(), (np.cumsum(counts) - counts).astype("<u4").tobytes()]
        begins = [at, *(at + sum(map(len, parts[:i])) for i in range(1, len(parts)))]
        places.append(_LEVEL.pack(width, len(rest), *(begins + [0, 0])[:3]))
        body += parts
        at += sum(map(len, parts))
        rest = rest[goes_on] >> np.uint64(width)
    return [_HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(widths)), *places, *documents, *body]


class DacFile:
    """A file of codes, read by place: `source` has read_at(size, offset)."""

    def __init__(self, source):
        self.source, self.bytes_read = source, 0
        magic, self.n_docs, self.n_ids, n = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.levels = list(_LEVEL.iter_unpack(self._read(_HEAD.size, n * _LEVEL.size)))
        self._documents = _HEAD.size + n * _LEVEL.size

    def _read(self, offset: int, size: int) -> bytes:
        self.bytes_read += size
        return self.source.read_at(size, offset)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc_ids, known, starts): starts has one more, the number of ids."""
        n, at = self.n_docs, self._documents
        return np.frombuffer(self._read(at, 8 * n), "<i8"), np.frombuffer(self._read(at + 8 * n, n), np.uint8) > 0, np.frombuffer(self._read(at + 9 * n, 8 * (n + 1)), "<i8")

    def _chunks(self, level: tuple, lo: int, hi: int) -> np.ndarray:
        width, _, at, _, _ = level
        bit = np.arange(lo, hi, dtype=np.int64) * width
        base = lo * width // 64
        words = np.frombuffer(self._read(at + 8 * base, 8 * ((hi * width) // 64 - base + 1)), "<u8")
        word, shift = bit // 64 - base, (bit % 64).astype(np.uint64)
        out = words[word] >> shift
        over = np.flatnonzero(shift + np.uint64(width) > 64)
        out[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << width) - 1)

    def _bits(self, level: tuple, lo: int, hi: int) -> tuple[np.ndarray, int]:
        """Bits lo to hi of the bitmap, and how many ones stand before lo."""
        begin = lo // _RANK_BITS * (_RANK_BITS // 8)
        raw = np.frombuffer(self._read(level[3] + begin, -(-hi // 8) - begin), np.uint8)
        bits = np.unpackbits(raw, bitorder="little")
        skip = lo - 8 * begin
        before = int(np.frombuffer(self._read(level[4] + 4 * (lo // _RANK_BITS), 4), "<u4")[0]) + int(bits[:skip].sum())
        return bits[skip : skip + hi - lo] > 0, before

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the file; reads only the words that hold them."""
        lo, hi = max(0, lo), min(hi, self.n_ids)
        out = np.zeros(max(0, hi - lo), np.uint64)
        here, shift = np.arange(len(out)), 0
        for k, level in enumerate(self.levels):
            if not len(here):
                break
            out[here] |= self._chunks(level, lo, hi) << np.uint64(shift)
            if k + 1 < len(self.levels):
                bits, lo = self._bits(level, lo, hi)
                here, shift = here[bits], shift + level[0]
                hi = lo + len(here)
        return out.astype(np.uint32)

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


# --- tokenizer -----------------------------------------------------------------------------------------------------


def id_bytes(tokenizer) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for: every character of an entry is one byte."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for piece, i in vocab.items():
        out[i] = len(piece)
    return out


def byte_level_ids(tokenizer, raw: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Ids of each part, little-endian; most parts go through the tokenizer as one text and are cut by byte counts after."""
    joined = Joined(raw, first, last)
    out: list[bytes] = [b""] * len(first)
    if len(joined.together):
        ids = np.array(tokenizer.encode(joined.raw.tobytes().decode(), add_special_tokens=False).ids, "<u4")
        cut = (4 * np.searchsorted(np.cumsum(size[ids]), joined.ends, side="left")).tolist()
        cut[1:] = [c + 4 for c in cut[1:]]
        flat = ids.tobytes()
        for row, i, j in zip(joined.together.tolist(), cut, cut[1:], strict=False):
            out[row] = flat[i:j]
    alone = [raw[first[i] : last[i]].tobytes().decode() for i in joined.alone.tolist()]
    for row, e in zip(joined.alone.tolist(), tokenizer.encode_batch(alone, add_special_tokens=False), strict=True):
        out[row] = np.array(e.ids, "<u4").tobytes()
    return out


def _cache(path: str) -> PartCache:
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        size = id_bytes(tokenizer)
        _workers[path] = PartCache(lambda raw, first, last: byte_level_ids(tokenizer, raw, first, last, size))
    return _workers[path]


def encode(path: str, raw: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts raw[where[i] : where[i + 1]] in a row, where each text's ids end, from 0)."""
    first, last = part_spans(raw, where)
    flat, begin, size, part = _cache(path).runs(raw, first, last)
    ids, ends = gather(flat, begin[part], size[part])
    return ids, ends[np.searchsorted(first, where)]


# --- writing and reading ---------------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write every document's ids and end_id to files under `folder`; the table of files: (part, path, n_docs, n_ids, start).

    One shuffle: documents go to ranges of doc_id as texts, and each range is tokenized and written in order by one task.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    n = max(1, text_bytes(docs) // _PARTITION_BYTES)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, done
            doc = pa.concat_arrays([d for d, _, _ in held])
            ids = np.concatenate([i for _, i, _ in held])
            starts = np.concatenate([[0], np.cumsum(np.concatenate([c for _, _, c in held]))])
            path = write_file(folder, f"ids-{part:06d}", dac_file(doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), starts, ids))
            row = pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(doc), "n_ids": len(ids), "at": done}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("at", pa.int64())]))
            held, size, done = [], 0, done + len(ids)
            return row

        for whole in batches:
            where, raw = string_parts(whole.column("text"))
            for i, j in slices(where, min(_BATCH_BYTES, file_ids)):
                ids, ends = encode(tokenizer_path, raw[where[i] : where[j]], where[i : j + 1] - where[i])
                held.append((whole.column("doc_id").slice(i, j - i), np.insert(ids, ends[1:], end_id), np.diff(ends) + 1))
                size += len(ids) + j - i
                if size >= file_ids:
                    yield flush()
        if held:
            yield flush()

    order = ["doc_id", F.xxhash64("text"), F.spark_partition_id()]
    rows = doc_texts(docs).repartitionByRange(n, *order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = save(rows.mapInArrow(batchwise(put), "part int, path string, n_docs long, n_ids long, at long"), "token-files")
    # A partition knows the ids before each of its files; partitions are added up in groups, then groups.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("group", F.expr(f"part div {_GROUP}"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = groups.select("group", before(Window.orderBy("group")).alias("ahead"))
    base = parts.withColumn("inside", before(Window.partitionBy("group").orderBy("part"))).join(ahead, "group").select("part", (F.col("ahead") + F.col("inside")).alias("base"))
    return save(files.join(base, "part").select("part", "path", "n_docs", "n_ids", (F.col("base") + F.col("at")).alias("start")), "token-files")


def _spread(files: DataFrame) -> DataFrame:
    """The table of files with about a file a task."""
    return files.repartition(max(1, min(files.count(), 1 << 16)))


def document_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files in pieces of bounded size."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with open_file(row["path"]) as source:
                    file = DacFile(source)
                    doc, known, starts = file.documents()
                    lo = 0
                    while lo < len(doc):
                        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _READ_IDS, side="right")) - 1)
                        raw, cut = memoryview(file.slice(int(starts[lo]), int(starts[hi])).astype("<u4").tobytes()), (4 * (starts[lo : hi + 1] - starts[lo])).tolist()
                        crc = [zlib.crc32(raw[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi], mask=~known[lo:hi]), pa.array(starts[lo:hi] + row["start"]), pa.array(np.diff(starts[lo : hi + 1])), pa.array(crc, pa.int64())], names)
                        lo = hi

    return _spread(files).mapInArrow(batchwise(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Ids `start` to `start + length` of the whole set: (start, length, at, ids), one row for each file that holds some of them.

    Files and spans meet by blocks of ids that they touch; a task reads from a file only the words of what is asked for.
    """
    block = FILE_IDS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted(b.to_pylist(), key=lambda r: r["path"])
            path, source, file = None, None, None
            for r in rows:
                if r["path"] != path:
                    if source is not None:
                        source.close()
                    path, source = r["path"], open_file(r["path"])
                    file = DacFile(source)
                lo, hi = max(r["start"], r["base"]), min(r["start"] + r["length"], r["base"] + r["n_ids"])
                r["at"], r["ids"] = lo, file.slice(lo - r["base"], hi - r["base"]).tolist()
            if source is not None:
                source.close()
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("start", pa.int64()), ("length", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    touched = lambda first, size: F.explode(F.sequence(F.expr(f"({first}) div {block}"), F.expr(f"({first} + {size} - 1) div {block}")))
    held = files.select("path", "n_ids", F.col("start").alias("base")).filter("n_ids > 0").withColumn("block", touched("base", "n_ids"))
    asked = spans.select(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")).filter("start >= 0 and length > 0").withColumn("block", touched("start", "length"))
    # A file and a span that share several blocks meet in the first of them.
    met = asked.join(held, "block").filter("start < base + n_ids and base < start + length").filter(f"block = greatest(start, base) div {block}")
    return met.drop("block").mapInArrow(batchwise(read), "start long, length long, at long, ids array<long>")


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """op13: every document's place and checksum, from files written and read back."""
    return document_ids(write_ids(docs, tokenizer_path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


__all__ = ["DacFile", "dac_file", "default_tokenizer", "document_ids", "encode", "fetch", "level_widths", "token_files", "write_ids"]
