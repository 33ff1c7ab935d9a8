"""Clusters around centroids, with vectors in Hilbert order and zone maps of their blocks.

Vectors are projected on the axes of greatest variance, cut into equally filled steps and put in the order of a Hilbert
curve; runs of BLOCK vectors become the rows of a zone table, each with the least and greatest value of every component.
The distance from a centroid to such a box bounds its distance to all vectors of the block from below, and that to the box's far
corner from above: a centroid whose lower bound is above another's upper bound can't be nearest, not even by a tie. Only
the centroids that remain are compared with the block's vectors, all at once. A block with one such centroid needs no comparison
to be assigned.

Everything is exact: components are integers; blocks of components below WIDE in size are compared in double precision, where
every sum here is a whole number below 2**53, and others, kept in blocks of their own, in Python's integers. Sums travel as
digits of base 2**40.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out; repeated rows count
as often as they stand; null vec_ids are clustered too and hash as an empty text; equal hashes go by the components; with fewer
vectors than centroids there are as many centroids as vectors; an empty table gives no rows; a distance or an inertia
that no long can hold is null; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batchwise, save, spread_sample

BLOCK = 1024
AXES, BITS = 8, 7
SAMPLE = 4096
WIDE = 1 << 22
_BASE = 1 << 40
_LONG = 1 << 63
_ROWS_A_TASK = 1 << 16


# --- order ---------------------------------------------------------------------------------------------------------


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points x (n x axes, whole numbers below 2**bits), by Skilling's transposed form."""
    x = x.astype(np.uint64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(axes):
            set_ = (x[i] & np.uint64(q)) > 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & np.uint64(q)) > 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << np.uint64(1) | (x[i] >> np.uint64(bit) & np.uint64(1))
    return key


class Order:
    """Axes and steps learned from a sample of vectors; they shape the blocks, never the results."""

    def __init__(self, sample: np.ndarray):
        n = min(AXES, sample.shape[1])
        self.mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
        spread = np.cov(sample.T) if len(sample) > 1 else np.eye(sample.shape[1])
        self.axes = np.linalg.eigh(np.nan_to_num(spread))[1][:, ::-1][:, :n]
        along = (sample - self.mean) @ self.axes
        share = np.arange(1, 1 << BITS) / (1 << BITS)
        self.steps = np.quantile(along, share, axis=0).T if len(sample) else np.zeros((n, len(share)))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            along = np.nan_to_num((vectors - self.mean) @ self.axes)
        return hilbert_key(np.stack([np.searchsorted(s, a, side="right") for s, a in zip(self.steps, along.T, strict=True)], 1), BITS).astype(np.int64)


# --- vectors and blocks ----------------------------------------------------------------------------------------------


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray | list[int]:
    """floor(scale * x) as doubles; as Python's integers where a component is too large for them to be exact everywhere."""
    with np.errstate(over="ignore"):
        out = np.floor(x * scale)
    if np.abs(out).max(initial=0) < WIDE:
        return out
    return [math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in x.tolist()]


def _body(x: np.ndarray, scale: int) -> tuple[bytes, bool]:
    found = whole_numbers(x, scale)
    return (json.dumps(found).encode(), True) if isinstance(found, list) else (found.astype("<i4").tobytes(), False)


def good_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id long, v array<double>) of the vectors with `dims` finite components."""
    v = F.col("embedding").cast("array<double>")
    inf = F.lit(math.inf)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce((F.size("v") == dims) & fine, F.lit(False)))


def zone_table(vectors: DataFrame, dims: int, scale: int, block: int = BLOCK) -> DataFrame:
    """Blocks of vectors in Hilbert order, saved: (wide boolean, ids array<long>, body binary, low array<double>, high array<double>).

    `vectors` as good_vectors gives them. Equal vectors are dealt to several ranges by their ids.
    """
    n = vectors.count()
    sample = spread_sample(vectors.select("v"), "v", SAMPLE, n).toPandas()["v"]
    order = Order(np.floor(np.stack(sample.to_list()) * scale) if len(sample) else np.zeros((0, dims)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            found = [_body(row, scale) for row in x]
            with np.errstate(over="ignore"):
                keys = order.keys(np.floor(x * scale))
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("vec_id"), pa.array([f for f, _ in found], pa.binary()), pa.array([w for _, w in found], pa.bool_())], ["key", "vec_id", "body", "wide"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["wide", "ids", "body", "low", "high"]
        schema = pa.schema([("wide", pa.bool_()), ("ids", pa.list_(pa.int64())), ("body", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        held: dict[bool, list[tuple[int | None, bytes]]] = {False: [], True: []}

        def flush(wide: bool) -> pa.RecordBatch:
            rows, held[wide] = held[wide], []
            ids = [i for i, _ in rows]
            if wide:
                values = [True, ids, b"[" + b",".join(x for _, x in rows) + b"]", None, None]
            else:
                body = b"".join(x for _, x in rows)
                x = np.frombuffer(body, "<i4").reshape(-1, dims)
                values = [False, ids, body, x.min(0).astype(float).tolist(), x.max(0).astype(float).tolist()]
            return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], schema)

        for b in batches:
            for i, body, wide in zip(b.column("vec_id").to_pylist(), b.column("body").to_pylist(), b.column("wide").to_pylist(), strict=True):
                held[wide].append((i, body))
                if len(held[wide]) == block:
                    yield flush(wide)
        yield from (flush(w) for w in (False, True) if held[w])

    keyed = vectors.mapInArrow(batchwise(key), "key long, vec_id long, body binary, wide boolean")
    parts = max(1, n // _ROWS_A_TASK)
    dealt = keyed.repartitionByRange(parts, "key", F.xxhash64("vec_id"), F.spark_partition_id()).sortWithinPartitions("key")
    return save(dealt.mapInArrow(batchwise(build), "wide boolean, ids array<long>, body binary, low array<double>, high array<double>"), "zones")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to, or tie for, some point of the box."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((outside * outside).sum(1) <= (far * far).sum(1).min())


class Centroids:
    """Centroids as Python's integers; those below WIDE also as doubles, for boxes and products."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.wide = any(max(map(abs, c)) >= WIDE for c in rows)
        self.points = None if self.wide else np.array(rows, float)

    def nearest(self, wide: bool, body: bytes, low, high, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(vectors, cluster, squared distance, comparisons) of a block; ties go to the smaller number."""
        if wide or self.wide:
            v = np.array(json.loads(body) if wide else np.frombuffer(body, "<i4").reshape(-1, dims).tolist(), object).reshape(-1, dims)
            far = np.stack([((v - np.array(c, object)) ** 2).sum(1) for c in self.rows], 1)
            best = far.argmin(1)
            return v, best, far[np.arange(len(v)), best], far.size
        v = np.frombuffer(body, "<i4").reshape(-1, dims).astype(float)
        able = candidates(np.array(low), np.array(high), self.points)
        c = self.points[able]
        if len(able) == 1:
            return v, np.full(len(v), able[0]), ((v - c[0]) ** 2).sum(1).astype(np.int64), 0
        far = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
        best = far.argmin(1)
        return v, able[best], far[np.arange(len(v)), best].astype(np.int64), far.size


def digits(x: int) -> list[int]:
    """Digits of x in base 2**40, lowest first, each with x's sign."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x:
        out.append(sign * (x % _BASE))
        x //= _BASE
    return out


def totals(zones: DataFrame, centroids: Centroids, dims: int) -> tuple[dict[int, int], dict[int, list[int]], int]:
    """(vectors, componentwise sums) by cluster of an assignment, and how many comparisons it took."""
    k = len(centroids.rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, work = [0] * k, [[0] * dims for _ in range(k)], 0
        for b in batches:
            for r in b.to_pylist():
                v, cluster, _, compared = centroids.nearest(r["wide"], r["body"], r["low"], r["high"], dims)
                work += compared
                for c in np.unique(cluster).tolist():
                    rows = v[cluster == c]
                    count[c] += len(rows)
                    sums[c] = [a + int(x) for a, x in zip(sums[c], rows.sum(0).tolist(), strict=True)]
        out = [(c, d, p, x) for c in range(k) for d, total in enumerate([count[c], *sums[c]]) for p, x in enumerate(digits(total))]
        out += [(-1, 0, p, x) for p, x in enumerate(digits(work))]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "dim", "place", "value"])

    found = zones.mapInArrow(batchwise(add), "cluster int, dim int, place int, value long").groupBy("cluster", "dim", "place").agg(F.sum("value").alias("value")).collect()
    count, sums, work = dict.fromkeys(range(k), 0), {c: [0] * dims for c in range(k)}, 0
    for r in found:
        part = r["value"] * _BASE ** r["place"]
        if r["cluster"] < 0:
            work += part
        elif r["dim"] == 0:
            count[r["cluster"]] += part
        else:
            sums[r["cluster"]][r["dim"] - 1] += part
    return count, sums, work


def first_centroids(vectors: DataFrame, k: int, scale: int, salt: str = "1:") -> list[list[int]]:
    """The vectors with the k smallest hashes of salt and vec_id; a vector whose id stands on two rows counts twice."""
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(order, "v").limit(k).collect()
    return [[int(x) for x in whole_numbers(np.array(r["v"], float), scale)] for r in rows]


def assign(zones: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    """(vec_id, cluster int, distance long) of every vector."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                _, cluster, far, _ = centroids.nearest(r["wide"], r["body"], r["low"], r["high"], dims)
                held = pa.array([int(x) if x < _LONG else None for x in far.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), held], ["vec_id", "cluster", "distance"])

    return zones.mapInArrow(batchwise(each), "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every good vector, and the last centroids."""
    spark = vectors.sparkSession
    good = good_vectors(vectors, dims)
    centroids = Centroids(first_centroids(good, k, scale))
    zones = zone_table(good, dims, scale, block)
    for _ in range(rounds if centroids.rows else 0):
        count, sums, _ = totals(zones, centroids, dims)
        centroids = Centroids([[x // count[c] for x in sums[c]] if count[c] else old for c, old in enumerate(centroids.rows)])
    assigned = save(assign(zones, centroids, dims), "clusters")
    far = F.col("distance").cast("decimal(38,0)")
    found = assigned.groupBy("cluster").agg(F.sum(far).alias("far"), F.count(F.when(F.col("distance").isNull(), 1)).alias("odd")).collect()
    inertia = {r["cluster"]: int(r["far"]) if r["far"] is not None and not r["odd"] else None for r in found}
    fits = lambda x: x if x is not None and x < _LONG else None
    total = fits(None if None in inertia.values() else sum(inertia.values()))
    told = [(c, fits(inertia.get(c, 0)), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.rows)]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids.rows


def cluster_vectors(vectors: DataFrame) -> DataFrame:
    """op12: clusters of all vectors of `embeddings`."""
    return cluster(vectors)[0]


__all__ = ["Centroids", "assign", "candidates", "cluster", "cluster_vectors", "good_vectors", "hilbert_key", "totals", "zone_table"]
