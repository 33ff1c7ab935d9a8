"""Mixing sources to target weights by the cube method of balanced sampling.

Every source gets a target in words; target / size of the source is the expected number of copies of each of its
documents. Whole copies are taken outright. The fraction left over is an inclusion probability, and the cube method's
flight phase moves the probabilities of a block through the null space of two constraints, words and documents, until
at most two of a block are still between 0 and 1, beside twelve that are held back. These few of all blocks meet in
blocks of the next level, and only the last level of a source lands: all choices for its at most fourteen documents are weighed by
how near words and documents come to what is expected.

Blocks have bounded size and the hot source has many, so no task sees a source whole; they hold sizes, never texts.
Randomness comes from hashes of doc_ids, texts and block numbers: reruns agree, whatever the partitioning (for `mix`, rows
without an id are told apart by their place in the table that it writes).

Defined results: null texts have size 0 and are never taken; a null source is a source and comes last; null doc_ids and
repeated rows are units of their own; an empty table gives none; other columns are carried in a struct and clash with
nothing.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACE, groupwise, save

WEIGHTS = (5, 2, 1)
CAP = 3.0
BLOCK = 1024
_FAN = 256
#: Units of a source that land beside the two that flight leaves, and the share of its target by which words may give way to documents.
HELD = 12
SLACK = 0.003
_EPS = 1e-9


def n_words(column: str):
    text = F.btrim(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(SPACE))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, rank, source_size, n_docs, target): weights repeat over sources by code point, null last.

    Ranks come from a range partitioning and its partition counts; the water level of the capped shares comes from one small
    aggregate a round, so sources are never collected.
    """
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    null_last = F.col("source").isNull()
    ranged = save(per.repartitionByRange(null_last, F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    counts = dict(ranged.groupBy("part").count().collect())
    offset, before = {}, 0
    for part in sorted(counts):
        offset[part], before = before, before + counts[part]
    starts = spark.createDataFrame(list(offset.items()) or [(0, 0)], "part int, before long")
    order = Window.partitionBy("part").orderBy(null_last, "source")
    ranked = ranged.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    plan = save(ranked.select("source", "rank", "source_size", "n_docs", weight.alias("weight")), "targets")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    level, known = 0.0, None
    while True:
        # One round caps what is above; the next reshares the excess among the others by weight.
        capped = F.lit(level) * F.col("weight") > cap * F.col("source_size")
        full, open_weight, n = plan.agg(
            F.sum(F.when(capped, cap * F.col("source_size")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(capped.cast("long"))
        ).first()
        if not open_weight or n == known:
            break
        known, level = n, (total - full) / open_weight
    return plan.select("source", "rank", F.col("source_size").cast("long"), "n_docs", F.least(F.lit(level) * F.col("weight"), cap * F.col("source_size")).alias("target"))


def flight(prob: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Cube flight for the totals of size and of count: at most two results stay between 0 and 1."""
    out, queue = list(prob), [i for i in range(len(prob) - 1, -1, -1) if _EPS < prob[i] < 1 - _EPS]
    live: list[int] = []
    while True:
        while len(live) < 3 and queue:
            live.append(queue.pop())
        if len(live) < 3 and not (len(live) == 2 and size[live[0]] == size[live[1]]):
            return [round(p) if p <= _EPS or p >= 1 - _EPS else p for p in out]
        if len(live) == 3:
            a, b, c = (size[i] for i in live)
            move = [b - c, c - a, a - b]
            if a == b == c:
                move = [1.0, -1.0, 0.0]
        else:
            move = [1.0, -1.0]
        up = min(((1 - out[i]) / u if u > 0 else out[i] / -u) for i, u in zip(live, move, strict=True) if u)
        down = min((out[i] / u if u > 0 else (1 - out[i]) / -u) for i, u in zip(live, move, strict=True) if u)
        step = up if rng.random() * (up + down) < down else -down
        for i, u in zip(live, move, strict=True):
            out[i] = min(1.0, max(0.0, out[i] + step * u))
            if out[i] <= _EPS or out[i] >= 1 - _EPS:
                out[i] = float(round(out[i]))
        live = [i for i in live if 0 < out[i] < 1]


def land(prob: list[float], size: list[float], slack: float = 0.0) -> list[float]:
    """Settle the few that are left: of the choices for them whose size comes near the expected one, the one whose count does.

    Near is within `slack`, or else as near as any choice comes; equal ones go by the first.
    """
    left = [i for i, p in enumerate(prob) if 0 < p < 1]
    sizes, chance = np.array([size[i] for i in left]), np.array([prob[i] for i in left])
    choice = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    words, docs = np.abs(choice @ sizes - chance @ sizes), np.abs(choice.sum(1) - chance.sum())
    near = np.flatnonzero(words <= max(words.min(), slack))
    best = near[np.lexsort((near, words[near], docs[near]))[0]]
    out = list(prob)
    for k, i in enumerate(left):
        out[i] = float(choice[best, k])
    return out


def fly(prob: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Flight for all open units but HELD, which stay open beside the two that it leaves: the largest four, and some of every size.

    A large unit hardly moves beside small ones, so flight would leave it to the end, with one other to make up for it; beside
    others of its kind it can be settled either way, and small ones make up for what is left.
    """
    open_ = sorted((i for i, p in enumerate(prob) if _EPS < p < 1 - _EPS), key=lambda i: (-size[i], i))
    held = set(open_)
    if len(open_) > HELD:
        held = {*open_[:4], *(open_[4 + (len(open_) - 5) * k // (HELD - 5)] for k in range(HELD - 4))}
    free = [i for i in range(len(prob)) if i not in held]
    out = list(prob)
    for i, p in zip(free, flight([prob[i] for i in free], [size[i] for i in free], rng), strict=True):
        out[i] = p
    return out


def _fly(schema: str, last: bool):
    def solve(key, table):
        rank, block = key[0].as_py(), key[1].as_py()
        frame = pd.DataFrame({c: table.column(c).to_numpy(zero_copy_only=False) for c in ("order", "size", "row", "prob")})
        at = frame.sort_values(["order", "size", "row"], kind="stable").index.to_numpy()
        size, prob = frame["size"].to_numpy(float)[at].tolist(), frame["prob"].to_numpy(float)[at].tolist()
        got = fly(prob, size, random.Random(rank * 1_000_003 + block * 2 + last))
        if last:
            got = land(got, size, SLACK * table.column("target")[0].as_py())
        out = np.empty(len(at))
        out[at] = got
        return table.set_column(table.schema.get_field_index("prob"), "prob", pa.array(out))

    return solve


def _unit_columns(docs: DataFrame) -> list:
    """What tells units apart: id, source and size, and the text by its hash, so that rows without an id differ too."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest")]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """mix_sized over rows that carry all columns of docs.

    Rows are written once with a number; only numbers and sizes take part in the method, and texts are joined back on them.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = save(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("at"), *_unit_columns(docs)), "rows")
    units = rows.select("at", "doc_id", "source", "size", "digest", F.when(F.col("doc_id").isNull(), F.col("at")).otherwise(0).alias("number"))
    got = mix_sized(units, weights, cap, "at").withColumnRenamed("row", "at")
    return rows.select("at", "row").join(got, "at").select("row", "size", "source_size", "target", "copies")


def mix_sized(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, carry: str = "doc_id") -> DataFrame:
    """(row, the carried column, size, source_size, target, copies long): how often each unit goes into the mix.

    units: doc_id, source, size, digest, number and the carried column; the hash of doc_id, digest and number places a unit,
    so that neither rows without an id nor repeats of one meet in one block.
    """
    plan = source_targets(units.select("source", "size"), weights, cap).withColumnRenamed("source", "plan_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64("doc_id", "digest", "number", F.lit(17))
    blocks = F.ceil(F.col("n_docs") / BLOCK).cast("int")
    rows = units.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select(
        F.col(carry).alias("row"), "size", "source_size", "target", "rank", F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("prob"),
        key.alias("order"), F.pmod(F.shiftrightunsigned(key, 7), blocks).cast("int").alias("block"),
    )
    rows = rows.withColumn("prob", F.when(F.col("size") > 0, F.col("prob")).otherwise(0.0))
    most = plan.agg(F.max("n_docs")).first()[0] or 0
    n_blocks = max(1, -(-most // BLOCK))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    settled: list[DataFrame] = []
    while True:
        last = n_blocks == 1
        rows = save(rows.groupBy("rank", "block").applyInArrow(groupwise(_fly(schema, last)), schema), "cube")
        open_ = (F.col("prob") > 0) & (F.col("prob") < 1)
        settled.append(rows if last else rows.filter(~open_))
        if last:
            break
        n_blocks = -(-n_blocks // _FAN)
        rows = rows.filter(open_).withColumn("block", F.expr(f"cast(block div {_FAN} as int)"))
    taken = reduce(DataFrame.unionByName, settled)
    return taken.select("row", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.col("prob").cast("long")).otherwise(0).cast("long").alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """op6: words that the mix takes of every document.

    Rows alike in id, source and text are counted first and numbered from their count, so that a rerun numbers them alike.
    """
    alike = docs.select(*_unit_columns(docs)).groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n"))
    units = save(alike.select("doc_id", "source", "size", "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("number")), "units")
    got = mix_sized(units)
    return got.select(F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def sample(docs: DataFrame) -> DataFrame:
    """docs as mixed: every row as often as it is taken, columns as they were."""
    return mix(docs).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
