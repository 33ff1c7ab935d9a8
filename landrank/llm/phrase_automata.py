"""Substring dedup by repeated-phrase automata.

Recurring passages are confirmed by hash inside shards (see _repeats: every window that two documents share meets in one
shard), compiled into Aho-Corasick automata over words as numbers, and all segments of all documents that can hold one
stream through the automaton of their shard. Its finds are every occurrence, and they alone say which document is the first
one. Words covered by a passage that also starts in a document with a smaller id are removed.

Defined results: null and empty texts have no words; documents with a null id neither lose words nor cause losses; rows
that repeat an id do not remove each other's words; documents below one window stay whole; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._chunks import Chunk, chunk_table
from ._hashing import NOT_SPACE, byte_symbols, prefix, span_hash, window_hash, word_spans
from ._repeats import HEAVY_CHUNKS, Spec, Symbols, earlier_windows, meeting

WINDOW = 13
SPEC = Spec(words=True, window=WINDOW, anchor=4)
#: About how many segments stream through one automaton.
_BATCH = 20_000


def compile_phrases(phrases: list[list[bytes]]) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """Automaton over words as numbers, any number of distinct ones, and the numbers; 0 stands for all other words."""
    code: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, phrase in enumerate(phrases):
        automaton.add_word(tuple([code.setdefault(w, len(code) + 1) for w in phrase]), k)
    automaton.make_automaton()
    return automaton, code


def locate(texts: list[bytes], low: np.ndarray, high: np.ndarray, window: int = WINDOW, anchors: np.ndarray | None = None, batch: int = _BATCH) -> np.ndarray:
    """Bits of the windows of each text that occur in a text with a smaller `low`.

    low and high: smallest and largest id of the documents with this text; callers judge by `high` whole texts that recur.

    Phrases that recur under different ids are confirmed by their hashes and compiled; the texts that can hold one stream
    through the automaton. Where it finds a phrase says in which documents it stands, and so which of them is the first.
    """
    bits = np.zeros(len(texts), np.uint64)
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    first, last = word_spans(raw, NOT_SPACE)
    hashes = window_hash(span_hash(prefix(byte_symbols(raw)), first, last), window)
    edge = np.cumsum([0, *[len(t) + 1 for t in texts]])
    size = np.diff(np.searchsorted(first, edge))
    for group in meeting(hashes, size, window, low, np.zeros(len(texts), np.uint64) if anchors is None else anchors, batch):
        phrases = [texts[i].split(b" ")[t : t + window] for i, t in zip(group.owner.tolist(), group.start.tolist(), strict=True)]
        automaton, code = compile_phrases(phrases)
        owner, phrase, start = [], [], []
        for i in group.strings.tolist():
            for end, k in automaton.iter(tuple([code.get(w, 0) for w in texts[i].split(b" ")])):
                owner.append(i)
                phrase.append(k)
                start.append(end - window + 1)
        at, k = np.array(owner, np.int64), np.array(phrase, np.int64)
        earliest = np.full(len(phrases), np.iinfo(np.int64).max)
        np.minimum.at(earliest, k, low[at])
        later = earliest[k] < low[at]
        np.bitwise_or.at(bits, at[later], np.uint64(1) << np.array(start, np.uint64)[later])
    return bits


def solver(texts: list[bytes], low: np.ndarray, high: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return locate(texts, low, high, anchors=anchors)


def kept_runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of False."""
    turn = np.diff(np.concatenate([[True], mask, [True]]).astype(np.int8))
    return list(zip(np.flatnonzero(turn == -1).tolist(), np.flatnonzero(turn == 1).tolist(), strict=True))


def _kept(symbols: Symbols, covered: np.ndarray, i: int, j: int) -> bytes:
    canon = symbols.canon
    return b" ".join(canon[symbols.begin[i + a] : symbols.end[i + b - 1]].tobytes() for a, b in kept_runs(covered[i:j]))


def _finish(chunk: Chunk, symbols: Symbols, covered: np.ndarray, row: dict) -> pa.Table:
    edge = symbols.doc_start
    gone = np.concatenate([[0], np.cumsum(covered)])[edge]
    sha = [hashlib.sha256(_kept(symbols, covered, i, j)).hexdigest() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.table([pa.array(row["ids"], pa.int64()), pa.array(np.diff(edge)), pa.array(np.diff(gone)), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(chunk: Chunk, symbols: Symbols, covered: np.ndarray, row: dict) -> pa.Table:
    edge = symbols.doc_start
    texts = [_kept(symbols, covered, i, j).decode() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.table([pa.array(row["ids"], pa.int64()), pa.array(texts)], ["doc_id", "text"])


def remove_phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words that stay, joined by one space."""
    return earlier_windows(chunk_table(docs), SPEC, solver, _texts, "doc_id long, text string")


def substring_dedup(docs: DataFrame, heavy: int = HEAVY_CHUNKS) -> DataFrame:
    """op5: counts and digest of what stays of every document."""
    return earlier_windows(chunk_table(docs), SPEC, solver, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", heavy)
