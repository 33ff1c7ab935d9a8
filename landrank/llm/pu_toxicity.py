"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning.

The risk of a classifier on positives and negatives is estimated without negatives: prior * R(positives as 1) plus
R(unlabelled as 0) - prior * R(positives as 0). The second part can't really be below 0; where a batch takes it there, the
step goes the other way, so the model can't fit the unlabelled sample's own positives. The class prior is the share of
toxic rows among labelled rows outside the held-out fold.

Features are presence of words and of word beginnings (4, 5 and 6 bytes, so that inflected forms of a stem count together);
those that stand out among positives are kept, and a linear model on them is trained in numpy. Samples are bounded:
at most `POSITIVES` confirmed and `UNLABELLED` other texts, the first by a hash of doc_id.

Defined results: null and empty texts have no features and score by the bias; null doc_ids are scored (held_out false);
repeated rows score alike; an empty table gives none; without positives every score is 0; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import Texts, distinct, first_by_hash, labelled, sample_features, scored

#: Bounds of the training samples, in rows.
POSITIVES = 4096
UNLABELLED = 8192
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"
THRESHOLD = 0.7
_SLOTS = 1 << 22
_KEPT = 1024
_STARTS = (4, 5, 6)


def extract(raw: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    """Slots of the words and word beginnings of each text."""
    t = Texts(raw, where)
    doc, keys = [t.doc], [t.words]
    for n in _STARTS:
        d, k = t.starts(n)
        doc.append(d)
        keys.append(k)
    owner, slot = distinct(np.concatenate(doc), np.concatenate(keys) & np.uint64(_SLOTS - 1))
    edge = np.searchsorted(owner, np.arange(t.n + 1))
    return [slot[edge[i] : edge[i + 1]].astype(np.int32) for i in range(t.n)]


@dataclass
class Linear:
    slots: np.ndarray
    weight: np.ndarray
    bias: float

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        if len(self.slots) and rows:
            at = np.concatenate(rows)
            place = np.minimum(np.searchsorted(self.slots, at), len(self.slots) - 1)
            hit = self.slots[place] == at
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            out += np.bincount(owner[hit], self.weight[place[hit]], len(rows))
        return out


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], kept: int = _KEPT) -> np.ndarray:
    """Slots by how far their share among positives exceeds chance, given their share among the unlabelled."""
    p = np.bincount(np.concatenate(positive), minlength=_SLOTS) / len(positive)
    u = np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.int32)]), minlength=_SLOTS) / max(1, len(unlabelled))
    gain = (p - u) / np.sqrt(np.maximum(u, 1e-9) / len(positive) + 1 / len(positive) ** 2)
    best = np.argsort(-gain, kind="stable")[:kept]
    return np.sort(best[(gain[best] > 4) & (p[best] >= max(0.02, 3 / len(positive)))])


def _dense(rows: list[np.ndarray], slots: np.ndarray) -> np.ndarray:
    place = np.full(_SLOTS, -1, np.int32)
    place[slots] = np.arange(len(slots))
    out = np.zeros((len(rows), len(slots)), np.float32)
    for i, r in enumerate(rows):
        at = place[r]
        out[i, at[at >= 0]] = 1
    return out


def risks(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk with logistic loss, of raw scores: positives as 1, and what is estimated of negatives as 0."""
    loss = lambda z: np.logaddexp(0, -z)
    return prior * loss(zp).mean(), (loss(-zu).mean() if len(zu) else 0.0) - prior * loss(-zp).mean()


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float, back: float) -> tuple[np.ndarray, np.ndarray]:
    """By which the step goes down, for each raw score: the gradient of the whole risk, or where its second part is below 0 that
    of this part alone, turned round and scaled by `back`."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    gp, gu = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / max(1, len(zu))
    if risks(zp, zu, prior)[1] < 0:
        return -back * gp, -back * gu
    return gp + prior * (sigmoid(zp) - 1) / len(zp), gu


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 200, rate: float = 0.05, decay: float = 3e-4, back: float = 1.0) -> Linear:
    """Adam on the non-negative risk of the whole samples with logistic loss; `back` scales the steps that undo overfitting (1 in the
    published method; small values leave scores of the toxic low)."""
    if not positive:
        return Linear(np.zeros(0, np.int64), np.zeros(0, np.float32), -30.0)
    slots = choose(positive, unlabelled)
    xp, xu = _dense(positive, slots), _dense(unlabelled, slots)
    w, b = np.zeros(len(slots), np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)
    for step in range(1, steps + 1):
        gp, gu = (g.astype(np.float32) for g in slopes(xp @ w + b, xu @ w + b, prior, back))
        g = np.append(gp @ xp + gu @ xu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return Linear(slots, w.astype(np.float32), float(b))


def fit(docs: DataFrame, labels: DataFrame, held_out: str = HELD_OUT) -> Linear:
    known = labelled(labels, "toxic", held_out)
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic:
        return train([], [], 0.5)
    confirmed = known.filter("label = 1")
    others = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    positive, _ = sample_features(docs, first_by_hash(confirmed, POSITIVES, 5), extract, None)
    unlabelled, _ = sample_features(docs, first_by_hash(others, UNLABELLED, 7), extract, None)
    return train(positive, unlabelled, min(0.9, toxic / n))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op7: held_out, score and verdict of every document; the model, of fixed size, goes to executors as a broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(raw: np.ndarray, where: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(model.value.raw(extract(raw, where)), -30, 30)))

    return scored(docs, score, HELD_OUT, THRESHOLD)
