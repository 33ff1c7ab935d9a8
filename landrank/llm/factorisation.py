"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length of a text.

A text's features are its distinct words (2 ** 16 slots) and the bins of its statistics; every pair of features interacts
through the dot product of their factors. The sum over all pairs takes linear time: half of (sum of factors) squared
minus the sum of squares. Training is Adagrad on at most `SAMPLE` labelled rows outside the held-out fold, the first by a
hash of doc_id; labels, lang, source and doc_id are never features.

Defined results: null and empty texts score by their statistics alone; null doc_ids are scored (held_out false); repeated
rows score alike; an empty table gives none; without training labels every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ._features import Texts, distinct, first_by_hash, labelled, sample_features, scored, statistics

#: Bound of the training sample, in rows.
SAMPLE = 8192
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"
THRESHOLD = 0.3
_SLOTS = 1 << 16
_BINS = 16
#: Bin edges of each statistic of _features.statistics.
_EDGES = [
    np.linspace(0.5, 10, _BINS - 1), np.linspace(1, 13, _BINS - 1), np.linspace(1, 20, _BINS - 1), np.geomspace(0.002, 0.9, _BINS - 1), np.geomspace(0.001, 0.5, _BINS - 1),
    np.geomspace(0.005, 2, _BINS - 1), np.geomspace(0.005, 2, _BINS - 1), np.geomspace(0.002, 0.9, _BINS - 1), np.linspace(0.05, 0.99, _BINS - 1),
]
_STATS = len(_EDGES)
WIDTH = _SLOTS + _STATS * _BINS


def extract(raw: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of each text: bins of statistics first, then slots of words."""
    n = len(where) - 1
    stats = statistics(raw, where)
    bins = np.stack([_SLOTS + k * _BINS + np.searchsorted(e, stats[:, k]) for k, e in enumerate(_EDGES)], 1)
    t = Texts(raw, where)
    doc, slot = distinct(t.doc, t.words & np.uint64(_SLOTS - 1))
    edge = np.searchsorted(doc, np.arange(n + 1))
    return [np.concatenate([bins[i], slot[edge[i] : edge[i + 1]]]).astype(np.int32) for i in range(n)]


def _values(size: int) -> np.ndarray:
    """Statistics weigh 1 each, words together 1."""
    out = np.full(size, 1 / np.sqrt(max(1, size - _STATS)), np.float32)
    out[:_STATS] = 1
    return out


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        at, x, edge = flat(rows)
        v = self.factor[at] * x[:, None]
        linear = np.add.reduceat(self.weight[at] * x, edge)
        pairs = 0.5 * (np.add.reduceat(v, edge) ** 2 - np.add.reduceat(v * v, edge)).sum(1)
        return self.bias + linear + pairs


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.concatenate([_values(s) for s in size.tolist()]), np.cumsum(size) - size


def train(rows: list[np.ndarray], label: np.ndarray, rank: int = 8, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 1) -> Machine:
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(WIDTH, np.float32), rng.normal(0, 0.01, (WIDTH, rank)).astype(np.float32))
    sw, sv, sb = np.full(WIDTH, 1e-2, np.float32), np.full((WIDTH, rank), 1e-2, np.float32), 1e-2
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            at, x, edge = flat([rows[i] for i in batch])
            v = m.factor[at] * x[:, None]
            total = np.add.reduceat(v, edge)
            z = m.bias + np.add.reduceat(m.weight[at] * x, edge) + 0.5 * (total**2 - np.add.reduceat(v * v, edge)).sum(1)
            gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[batch]) / len(batch)
            owner = np.repeat(np.arange(len(batch)), np.diff(np.append(edge, len(at))))
            g = (gap[owner] * x).astype(np.float32)
            gv = g[:, None] * (total[owner] - v).astype(np.float32)
            slots, inverse = np.unique(at, return_inverse=True)
            gw = np.bincount(inverse, g, len(slots)) + decay * m.weight[slots]
            by = np.argsort(inverse, kind="stable")
            gf = np.add.reduceat(gv[by], np.searchsorted(inverse[by], np.arange(len(slots)))) + decay * m.factor[slots]
            sw[slots] += gw**2
            sv[slots] += gf**2
            sb += gap.sum() ** 2
            m.weight[slots] -= rate * gw / np.sqrt(sw[slots])
            m.factor[slots] -= rate * gf / np.sqrt(sv[slots])
            m.bias -= rate * gap.sum() / np.sqrt(sb)
    return m


def fit(docs: DataFrame, labels: DataFrame, held_out: str = HELD_OUT, sample: int = SAMPLE) -> Machine:
    chosen = first_by_hash(labelled(labels, "quality", held_out), sample, 3)
    return train(*sample_features(docs, chosen, extract, "label"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op3: held_out, score and verdict of every document; the model, of fixed size, goes to executors as a broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(raw: np.ndarray, where: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(model.value.raw(extract(raw, where)), -30, 30)))

    return scored(docs, score, HELD_OUT, THRESHOLD)
