"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

`learn` fits rotations on a bounded sample: principal axes of the centred vectors, then alternating steps (signs of the
rotated vectors; the rotation that best fits them, by Procrustes) so that the signs are balanced binary codes. Codes are cut
into chunks, one Hamming table each: two vectors meet where they have a chunk and their label in common, so codes of m
chunks that differ in fewer than m bits always meet. All rows are indexed. Within a table's bucket the original vectors
decide, by cosine in double precision, and a pair counts in the first table where it meets.

Equal vectors of one label are one row first. Buckets are worked on in blocks inside a task, and give sums and a spanning
forest per bucket instead of pairs. A bucket with more rows than `PART` is split into parts and every two of them meet in a task
of their own: links are counted exactly, so n near copies take n * n comparisons, and their rows are sent n / PART times.

Chunk width grows with the number of rows so that buckets stay small; the number of tables follows from how often vectors of the
sample, moved to the threshold, keep a chunk (see `plan`), so that codes of vectors with a common direction find their pairs
too.

Defined results: vectors that are null, zero, or hold null or non-finite components, those without a label, and rows with a
null vec_id link with nothing (component_id is their vec_id); vectors of different length do not link; repeated rows count
as other vectors; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._shared import batchwise, save, spread_sample

THRESHOLD = 0.98
#: Bound of the sample that rotations are fitted on, in rows.
SAMPLE = 4096
PART = 16384
#: Share of pairs at the threshold that must meet, by the sample.
RECALL = 0.995
#: Share of the sample's own links that must meet; without it codes are not centred.
OWN_RECALL = 0.97
_TABLES = 48
_ROUNDS = 20
_BLOCK = 1024


def learn(sample: np.ndarray, rotations: int, seed: int = 1, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, stacked projections d x (rotations * d)) by iterative quantisation of the rows of sample; the mean is 0 if not centred."""
    d = sample.shape[1]
    mean = sample.mean(0) if len(sample) and centred else np.zeros(d)
    x = sample - mean
    axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(d))[1][:, ::-1]
    v = x @ axes
    out = []
    for k in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(d, d)))[0]
        for _ in range(_ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.concatenate(out, 1)


def bits_for(rows: int, dims: int) -> int:
    """Bits of a chunk: buckets of about 64 rows where codes are balanced."""
    return min(dims, max(4, min(24, round(math.log2(max(2, rows) / 64)))))


def moved(x: np.ndarray, threshold: float = THRESHOLD, seed: int = 5) -> np.ndarray:
    """Unit vectors at a cosine of just `threshold` to those of x, in random directions."""
    u = np.random.default_rng(seed).normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    return threshold * x + math.sqrt(1 - threshold**2) * u


def plan(sample: np.ndarray, rows: int, threshold: float = THRESHOLD) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(bits of a chunk, number of tables, mean, projection) for this many rows, from what the sample's codes do.

    Every sample vector is moved to a cosine of just the threshold (in several directions where the sample is small, so that
    `SAMPLE` pairs or more are measured), and codes are compared: centring widens angles where vectors
    share a direction, so the chance to meet is measured, not derived. Tables are as many as bring RECALL of these pairs
    together, over the whole sample and over the quarter of it that is nearest to the mean; where that takes more than
    `_TABLES`, chunks get narrower (at one bit, half of the bits may differ and some ten tables do).

    Links of the sample itself are asked too: where vectors lie so near to each other that pairs have the mean between them, the
    signs of centred vectors part what links, and codes are taken without centring.
    """
    d = sample.shape[1]
    middle = sample.mean(0)
    nearest = np.argsort(np.linalg.norm(sample - middle, axis=1), kind="stable")[: max(1, len(sample) // 4)]
    at = np.tile(np.arange(len(sample)), -(-SAMPLE // len(sample)))
    near, few = np.isin(at, nearest), sample[at]
    pairs = moved(few, threshold) if d > 1 else few

    def fit(centred: bool) -> tuple[int, int, np.ndarray, np.ndarray]:
        bits = bits_for(rows, d)
        while True:
            rotations = -(-_TABLES // (d // bits))
            mean, projection = learn(sample, rotations, centred=centred)
            met = np.cumsum(_chunks(few, mean, projection, bits, _TABLES) == _chunks(pairs, mean, projection, bits, _TABLES), axis=1) > 0
            enough = np.flatnonzero(np.minimum(met.mean(0), met[near].mean(0)) >= RECALL)
            if len(enough) or bits == 1:
                tables = int(enough[0]) + 1 if len(enough) else _TABLES
                return bits, tables, mean, projection[:, : d * -(-tables // (d // bits))]
            bits = max(1, bits - 2)

    bits, tables, mean, projection = fit(True)
    if _own_recall(sample, _chunks(sample, mean, projection, bits, tables), threshold) < OWN_RECALL:
        return fit(False)
    return bits, tables, mean, projection


def _own_recall(sample: np.ndarray, keys: np.ndarray, threshold: float) -> float:
    """Share of the pairs of the sample that link which have a key in common, 1 if none links; a block of rows at a time."""
    links = met = 0
    for i in range(0, len(sample), 256):
        x, y = np.nonzero(np.triu(sample[i : i + 256] @ sample.T >= threshold, i + 1))
        links += len(x)
        share = np.zeros(len(x), bool)
        for k in keys.T:
            share |= k[x + i] == k[y]
        met += int(share.sum())
    return met / links if links else 1.0


def _chunks(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys (n x tables) of unit vectors; chunks do not cross rotations."""
    d = x.shape[1]
    per = d // bits
    signs = (x - mean) @ projection >= 0
    out = np.zeros((len(x), tables), np.int32)
    for t in range(tables):
        at = t // per * d + t % per * bits
        for b in range(bits):
            out[:, t] = out[:, t] << 1 | signs[:, at + b]
    return out


def _usable(vectors: DataFrame) -> DataFrame:
    """(rid, label, n, raw binary, dims): distinct usable vectors of each label; rid the smallest vec_id, n how many."""
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.coalesce(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists("v", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), doubles.alias("v"))
    # -0.0 and 0.0 are one value.
    rows = rows.filter(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("v", F.transform("v", lambda v: v + F.lit(0.0)))
    return rows.groupBy("label", "v").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("n"))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _solve(x: np.ndarray, keys: np.ndarray, table: int, split: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of one bucket that link and have no earlier table in common, a block of rows against another at a time.

    split: rows before it meet rows from it on only; 0 if all meet all.
    """
    n = len(x)
    for i in range(0, split or n, _BLOCK):
        for j in range(split or i, n, _BLOCK):
            a, b = np.nonzero(x[i : min(i + _BLOCK, split or n)] @ x[j : j + _BLOCK].T >= threshold)
            a, b = a + i, b + j
            if not split:
                keep = a < b
                a, b = a[keep], b[keep]
            if table and len(a):
                new = ~(keys[a, :table] == keys[b, :table]).any(1)
                a, b = a[new], b[new]
            if len(a):
                yield a, b


def _join(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """comp, each row's smallest row that links reach, with links a-b added."""
    while True:
        u, v = comp[a], comp[b]
        apart = u != v
        if not apart.any():
            return comp
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(comp, np.maximum(u, v), np.minimum(u, v))
        while (comp[comp] != comp).any():
            comp = comp[comp]


def link(distinct: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(rid, links) sums and (a, b) forest edges over distinct vectors of one length (rid, label, v, n)."""
    spark = distinct.sparkSession
    total = distinct.count()
    some = spread_sample(distinct, "rid", sample, total).select("v").collect()
    dims = len(some[0].v)
    bits, tables, mean, projection = plan(_unit([r.v for r in some]), total, threshold)
    model = spark.sparkContext.broadcast((mean, projection))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("v").to_pylist())
            keys = _chunks(x, m, p, bits, tables)
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            codes = pa.array([r.tobytes() for r in keys], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(keys[:, t]), batch.column("label"), batch.column("rid"), batch.column("n"), raw, codes],
                    ["t", "k", "label", "rid", "n", "x", "codes"],
                )

    rows = distinct.select("label", "v", "rid", "n").mapInArrow(batchwise(index), "t int, k int, label string, rid long, n long, x binary, codes binary")
    # Buckets of more than `part` rows are split by a hash, and every two parts of one meet under a key of their own.
    large = save(rows.groupBy("t", "k", "label").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > part).withColumn("parts", F.ceil(F.col("size") / part).cast("int")), "large")
    mine = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    meets = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda p: F.struct(F.least(p, F.col("mine")).alias("lo"), F.greatest(p, F.col("mine")).alias("hi")))
    )
    dealt = rows.join(large.drop("size"), ["t", "k", "label"], "left").withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("meet", F.explode(meets))
    dealt = dealt.select("t", "k", "label", "meet.lo", "meet.hi", "mine", "rid", "n", "x", "codes")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by bucket; a bucket may go over several batches.
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("t", "k", "label", "lo", "hi")), strict=True))
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i < j and names[i] != name:
                    yield from _bucket(held, name, tables, dims, threshold)
                    held, name = [], names[i]
                if i < j:
                    held.append(batch.slice(i, j - i))
        yield from _bucket(held, name, tables, dims, threshold)

    found = dealt.repartition("t", "k", "label", "lo", "hi").sortWithinPartitions("t", "k", "label", "lo", "hi", "mine", "rid").mapInArrow(batchwise(buckets), "rid long, links long, other long")
    found = save(found, "links")
    return found.filter("other is null").groupBy("rid").agg(F.sum("links").alias("links")), found.filter("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b"))


def _bucket(held: list[pa.RecordBatch], name: tuple | None, tables: int, dims: int, threshold: float) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held) if held else None
    if rows is None or rows.num_rows < 2:
        return
    count = rows.num_rows
    rid, n, mine = (rows.column(c).to_numpy() for c in ("rid", "n", "mine"))
    split = int(np.searchsorted(mine, name[4])) if name[3] != name[4] else 0
    if name[3] != name[4] and split in (0, count):
        return
    x = np.frombuffer(b"".join(rows.column("x").to_pylist())).reshape(-1, dims)
    keys = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int32).reshape(-1, tables)
    links, comp = np.zeros(count), np.arange(count)
    for a, b in _solve(x, keys, name[0], split, threshold):
        links += np.bincount(a, n[b], count) + np.bincount(b, n[a], count)
        comp = _join(comp, a, b)
    some, hung = np.flatnonzero(links), np.flatnonzero(comp != np.arange(count))
    if len(some):
        out = [np.concatenate([rid[some], rid[hung]]), np.concatenate([links[some], np.zeros(len(hung))]).astype(np.int64)]
        other = np.concatenate([np.zeros(len(some), np.int64), rid[comp[hung]]])
        yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(other, mask=np.arange(len(other)) < len(some))], ["rid", "links", "other"])


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """op2: (vec_id, n_links, component_id, kept) of every row."""
    distinct = save(_usable(vectors), "vectors")
    sums = edges = None
    # Vectors of different length can't link, and lengths are a property of the table: usually there is one.
    for size in sorted(r[0] for r in distinct.select(F.size("v").alias("d")).distinct().collect()):
        s, e = link(distinct.filter(F.size("v") == size), threshold)
        sums, edges = (s, e) if sums is None else (sums.unionByName(s), edges.unionByName(e))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("v"))
    if sums is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    joined = components(edges).withColumnRenamed("node", "rid").withColumnRenamed("component", "c")
    named = distinct.join(sums, "rid", "left").join(joined, "rid", "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("c", "rid").alias("c"))
    own = F.col("vec_id").isNotNull()
    out = every.withColumn("at", F.when(own, F.col("label"))).join(named.withColumnRenamed("label", "at"), ["at", "v"], "left")
    n, c = F.coalesce("links", F.lit(0)).cast("long"), F.coalesce("c", "vec_id")
    return out.select("vec_id", n.alias("n_links"), c.alias("component_id"), F.coalesce(c == F.col("vec_id"), F.lit(False)).alias("kept"))
