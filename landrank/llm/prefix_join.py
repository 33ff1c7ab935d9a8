"""N-gram Jaccard self-join by grouped prefixes.

A document's set holds its distinct k-word shingles. Documents with equal sets become one class; classes whose size and
prefix (the rarest shingles, one of which a partner must share) are equal become one group. Groups that share a prefix
shingle form group pairs, these expand into members, and members are verified on their whole sets.

Shingles are ordered by a table of 2 ** 18 counters over the corpus, then by hash: any order is right, a rare-first one
leaves few candidates. Prefix shingles that only one group has are found in hash buckets and never become rows.

Links only matter up to connection, so candidates come in two steps. Each group is verified against the first holder of each
of its shingles and joined into components; then all other pairs that share one and are still in different components. A large group
of near copies so costs about its size, and no link between components can be missed. Signatures of 512 bits, whose
difference never exceeds that of the sets, spare most verifications and can't reject a link.

Shingles stand for their 64-bit hashes. Defined results: null and empty texts have an empty set and link with nothing;
texts below k words have their whole sequence as one shingle; rows with a null doc_id are counted but take no part
(component_id null); repeated rows are one class; an empty table gives none; other columns travel in one struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import Chunk, by_bucket, chunk_table, corpus_bytes, in_sorted, opened
from ._components import components
from ._hashing import NOT_SPACE, byte_symbols, lower, mix, prefix, span_hash, window_hash, word_spans
from ._shared import batchwise, groupwise, pairwise, save, scratch

_SLOTS = 1 << 18
_PARTS = 16
_BUCKET_BYTES = 16 << 20
_SIGNATURE_WORDS = 8
#: Sets above _WIDE_FROM shingles also have a signature of 4096 bits: 512 say nothing about thousands of shingles.
_WIDE_WORDS = 64
_WIDE_FROM = 256
#: Groups of one shingle and size class that one task compares with all others.
PART = 4096


@dataclass(frozen=True)
class JoinSpec:
    """Link when percent * union <= 100 * intersection of the sets of `shingle`-word shingles."""

    shingle: int = 5
    percent: int = 80


class Sets:
    """The shingle sets of a chunk's documents: `values` sorted within each document, document i at start[i]:start[i+1]."""

    def __init__(self, chunk: Chunk, spec: JoinSpec):
        texts = b"\n".join(chunk.raw[i:j].tobytes() for i, j in zip(chunk.where[:-1], chunk.where[1:], strict=True))
        raw = lower(np.frombuffer(texts, np.uint8))
        first, last = word_spans(raw, NOT_SPACE)
        words = span_hash(prefix(byte_symbols(raw)), first, last)
        edge = np.searchsorted(first, chunk.where + np.arange(len(chunk.where)))
        count, k = np.diff(edge), spec.shingle
        doc_of = np.repeat(np.arange(len(chunk)), count)
        whole = window_hash(words, k)
        inside = doc_of[: len(whole)] == doc_of[k - 1 :] if len(whole) else np.zeros(0, bool)
        short = np.flatnonzero((count > 0) & (count < k))
        values = np.concatenate([whole[inside], span_hash(prefix(words), edge[short], edge[short + 1])])
        doc = np.concatenate([doc_of[: len(whole)][inside], short])
        order = np.lexsort((values, doc))
        values, doc = values[order], doc[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        self.values, self.doc = values[new], doc[new]
        self.start = np.searchsorted(self.doc, np.arange(len(chunk) + 1))
        self.size = np.diff(self.start)

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[self.start[1:]] - total[self.start[:-1]]

    def signatures(self, words: int = _SIGNATURE_WORDS, above: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, 64 * words bits each), each bit the parity of the shingles that hash to it; of sets larger than `above`."""
        chosen = np.flatnonzero(self.size >= above)
        place = np.full(len(self.size), -1)
        place[chosen] = np.arange(len(chosen))
        at = place[self.doc]
        bit = (mix(self.values[at >= 0] ^ np.uint64(0x51ED270B)) % np.uint64(64 * words)).astype(np.int64)
        count = np.bincount(at[at >= 0] * (64 * words) + bit, minlength=len(chosen) * 64 * words)
        return chosen, np.packbits((count & 1).astype(np.uint8).reshape(len(chosen), 64 * words), axis=1, bitorder="little").view(np.int64)


class Prefixes:
    """Prefix shingles of all documents with an id: `token`, its document and rank, and the group key of each document."""

    def __init__(self, chunk: Chunk, sets: Sets, counts: np.ndarray, spec: JoinSpec):
        size = sets.size
        length = np.where(chunk.known & (size > 0), size + (-spec.percent * size) // 100 + 1, 0)
        order = np.lexsort((sets.values, counts[(sets.values & np.uint64(_SLOTS - 1)).astype(np.int64)], sets.doc))
        rank = np.arange(len(order)) - sets.start[sets.doc]
        inside = rank < length[sets.doc]
        self.token, self.doc, self.rank = sets.values[order][inside], sets.doc[inside], rank[inside]
        ends = np.cumsum(length)
        self.group = span_hash(prefix(self.token), ends - length, ends) ^ mix(size.astype(np.uint64))

    def marks(self, buckets: int) -> np.ndarray:
        t = mix(self.token)
        return ((t >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (t & np.uint64(0xFFFFFFFF))


def shingle_counts(chunks: DataFrame, spec: JoinSpec) -> np.ndarray:
    """Documents' shingles by the low bits of their hash: a table of fixed size (2 MB), whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for chunk in opened(batch):
                total += np.bincount((Sets(chunk, spec).values & np.uint64(_SLOTS - 1)).astype(np.int64), minlength=_SLOTS)
        parts = [p.tobytes() for p in np.split(total, _PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(key, table):
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()], axis=0)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    rows = chunks.mapInArrow(batchwise(count), "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((_PARTS, _SLOTS // _PARTS), np.int64)
    for r in rows:
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def profiles(chunks: DataFrame, spec: JoinSpec) -> DataFrame:
    """One row a document: (chunk, row, doc_id, n, key1, key2, group, tokens, signature); tokens: prefix shingles that
    some other group has too."""
    counts = chunks.sparkSession.sparkContext.broadcast(shingle_counts(chunks, spec))
    buckets = max(1, corpus_bytes(chunks) // _BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in opened(batch):
                found = Prefixes(chunk, Sets(chunk, spec), counts.value, spec)
                marks, group = found.marks(buckets), found.group[found.doc]
                order = np.lexsort((group, marks))
                marks, group = marks[order], group[order]
                new = np.ones(len(marks), bool)
                new[1:] = (marks[1:] != marks[:-1]) | (group[1:] != group[:-1])
                marks, group = marks[new], group[new]
                sent = list(by_bucket((marks >> np.uint64(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in sent], pa.int32()), pa.array([chunk.chunk] * len(sent), pa.int64()),
                        pa.array([marks[r].astype(np.uint32).tobytes() for _, r in sent], pa.binary()), pa.array([group[r].tobytes() for _, r in sent], pa.binary()),
                    ],
                    ["bucket", "chunk", "marks", "groups"],
                )

    def tell(key, table):
        marks = [np.frombuffer(x, np.uint32) for x in table.column("marks").to_pylist()]
        values, groups = np.concatenate(marks), np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("groups").to_pylist()])
        order = np.argsort(values, kind="stable")
        values, groups = values[order], groups[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        again = values[first[np.minimum.reduceat(groups, first) != np.maximum.reduceat(groups, first)]]
        told = [np.unique(m[in_sorted(m, again)]).tobytes() for m in marks]
        rows = [i for i, t in enumerate(told) if t]
        return pa.table([table.column("chunk").take(pa.array(rows, pa.int64())), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([told[i] for i in rows], pa.binary())], ["chunk", "bucket", "marks"])

    def close(key, left, right):
        out = []
        for chunk in opened(left):
            sets = Sets(chunk, spec)
            found = Prefixes(chunk, sets, counts.value, spec)
            known = np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.uint64(b << 32) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(right.column("bucket").to_pylist(), right.column("marks").to_pylist(), strict=True)]]))
            hit = in_sorted(found.marks(buckets), known)
            cut = np.searchsorted(found.doc[hit], np.arange(len(chunk) + 1)).astype(np.int32)
            signature = pa.ListArray.from_arrays(np.arange(len(chunk) + 1, dtype=np.int32) * _SIGNATURE_WORDS, pa.array(sets.signatures()[1].ravel()))
            large, bits = sets.signatures(_WIDE_WORDS, _WIDE_FROM)
            wide = pa.array([None] * len(chunk), pa.list_(pa.int64()))
            if len(large):
                lists = pa.ListArray.from_arrays(np.arange(len(large) + 1, dtype=np.int32) * _WIDE_WORDS, pa.array(bits.ravel()))
                seat = np.full(len(chunk), -1)
                seat[large] = np.arange(len(large))
                wide = lists.take(pa.array(seat, mask=seat < 0))
            as_long = lambda x: pa.array(x.view(np.int64))
            out.append(
                pa.table(
                    [
                        pa.array([chunk.chunk] * len(chunk), pa.int64()), pa.array(range(len(chunk)), pa.int32()), pa.array(chunk.ids, mask=~chunk.known), pa.array(sets.size),
                        as_long(sets.sums(mix(sets.values))), as_long(sets.sums(mix(sets.values ^ np.uint64(0x2545F491)))), as_long(found.group),
                        pa.ListArray.from_arrays(cut, as_long(found.token[hit])), signature, wide,
                    ],
                    ["chunk", "row", "doc_id", "n", "key1", "key2", "group", "tokens", "signature", "wide"],
                )
            )
        return pa.concat_tables(out)

    told = chunks.mapInArrow(batchwise(send), "bucket int, chunk long, marks binary, groups binary").groupBy("bucket").applyInArrow(groupwise(tell), "chunk long, bucket int, marks binary")
    schema = "chunk long, row int, doc_id long, n long, key1 long, key2 long, group long, tokens array<long>, signature array<long>, wide array<long>"
    return save(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(pairwise(close), schema), "profiles")


def _needed(na: str, nb: str, spec: JoinSpec):
    """Smallest intersection that links sets of these sizes."""
    return F.ceil(F.lit(spec.percent) * (F.col(na) + F.col(nb)) / F.lit(100 + spec.percent))


def _sizes(spec: JoinSpec):
    return 100 * F.least("na", "nb") >= spec.percent * F.greatest("na", "nb")


def _possible(spec: JoinSpec):
    """What sizes and signatures (a and b's) allow: the sets can't differ in fewer shingles than the signatures in bits."""
    apart = sum((F.bit_count(F.get("sa", F.lit(k)).bitwiseXOR(F.get("sb", F.lit(k)))) for k in range(_SIGNATURE_WORDS)), F.lit(0))
    allowed = F.col("na") + F.col("nb") - 2 * _needed("na", "nb", spec)
    far = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    return _sizes(spec) & (apart <= allowed) & F.coalesce(far <= allowed, F.lit(True))


def _verify(pairs: DataFrame, sets: DataFrame, spec: JoinSpec) -> DataFrame:
    """Pairs (a, b) whose whole sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("xa").to_pylist(), batch.column("xb").to_pylist()
            keep = []
            for x, y in zip(xs, ys, strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int(in_sorted(u, v).sum())
                keep.append(100 * both >= spec.percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("xa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("xb"))
    return save(pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(batchwise(check), "a long, b long"), "links")


def classes(docs_profiles: DataFrame) -> DataFrame:
    """One row a class of equal sets, by its smallest doc_id `node`, written to the shared folder."""
    known = docs_profiles.filter("n > 0 and doc_id is not null")
    least = known.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "chunk", "row")).alias("at"))
    picked = known.join(least.select(F.col("at.chunk").alias("chunk"), F.col("at.row").alias("row")), ["chunk", "row"])
    return save(picked.withColumnRenamed("doc_id", "node"), "classes")


def link(chunks: DataFrame, nodes: DataFrame, spec: JoinSpec) -> DataFrame:
    """(node, component) of every class that links with another; tables on the way are deleted."""
    with scratch(chunks.sparkSession) as keep:
        labels = _link(chunks, nodes, spec)
        keep(labels)
    return labels


def _link(chunks: DataFrame, nodes: DataFrame, spec: JoinSpec) -> DataFrame:
    groups = nodes.groupBy("group").agg(
        F.min("node").alias("gid"), F.first("n").alias("n"), F.count(F.lit(1)).alias("members"), F.first("tokens").alias("tokens"), F.first("signature").alias("signature"), F.first("wide").alias("wide")
    )
    groups = groups.filter((F.size("tokens") > 0) | (F.col("members") > 1)).withColumns({c: F.when(F.col("members") == 1, F.col(c)) for c in ("signature", "wide")})
    groups = save(groups, "groups")
    members = save(nodes.join(groups.select("group", "gid"), "group").select("gid", "node", "n", "signature", "wide", "chunk", "row"), "members")
    tokens = groups.select(F.explode("tokens").alias("token"), "gid")
    side = lambda s: members.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("signature").alias(f"s{s}"), F.col("wide").alias(f"w{s}"))

    # First step: each group with the first holder of each of its shingles, and members with the first one of their group.
    first_holder = tokens.groupBy("token").agg(F.min("gid").alias("b"))
    star = tokens.join(first_holder, "token").select(F.col("gid").alias("a"), "b").unionByName(members.select(F.col("node").alias("a"), F.col("gid").alias("b")))
    near = star.filter("a <> b").distinct()
    first = save(near.join(side("a"), "a").join(side("b"), "b").filter(_possible(spec)).select("a", "b"), "near")

    def fetch(key, left, right):
        rows = dict(zip(right.column("row").to_pylist(), right.column("node").to_pylist(), strict=True))
        node, found = [], []
        for chunk in opened(left):
            sets = Sets(chunk, spec)
            for r, n in rows.items():
                node.append(n)
                found.append(sets.values[sets.start[r] : sets.start[r + 1]].tobytes())
        return pa.table([pa.array(node, pa.int64()), pa.array(found, pa.binary())], ["node", "set"])

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(members.select("node", "chunk", "row"), "node")
        got = chunks.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(pairwise(fetch), "node long, set binary")
        return save(got, "sets")

    links = _verify(first, sets_of(first), spec)
    labels = components(links)

    # Second step: all pairs of groups that share a shingle, wherever members are not connected yet.
    placed = members.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    placed = save(placed, "placed")
    spread = placed.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    held = tokens.join(spread, "gid")
    mixed = held.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l <> h").select("token")
    rows = save(held.join(mixed, "token").join(groups.select("gid", "n", "signature"), "gid"), "open")
    # Pairs go by size, the smaller set first: sets that can link are of one size class or of neighbouring ones. A shingle is so
    # split by size, and where a class has more than PART groups, its smaller sides are dealt to parts that each meet all larger.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / spec.percent)).cast("int")
    rows = rows.withColumn("band", band)
    heat = rows.groupBy("token", "band").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > PART).select("token", "band", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    heat = save(heat, "heat")

    def side_of(s: str, band_of, part_of) -> DataFrame:
        named = rows.withColumn("band", band_of).join(heat, ["token", "band"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        return named.select("token", "band", part_of.alias("part"), *[F.col(c).alias(k + s) for c, k in (("gid", "gid"), ("n", "n"), ("lo", "lo"), ("hi", "hi"), ("signature", "s"))], F.lit(None).cast("array<bigint>").alias("w" + s))

    x = side_of("a", F.col("band"), F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))
    y = side_of("b", F.explode(F.array(F.col("band"), F.col("band") - 1)), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    apart = (F.col("loa") != F.col("hia")) | (F.col("lob") != F.col("hib")) | (F.col("loa") != F.col("lob"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("gida") < F.col("gidb")))
    # A group of one member is judged by its signature here, others after they are expanded.
    pairs = x.join(y, ["token", "band", "part"]).filter(ordered & apart & F.coalesce(_possible(spec), F.lit(True)) & _sizes(spec))
    pairs = pairs.select(F.col("gida").alias("gidx"), F.col("gidb").alias("gidy")).distinct()
    inner = spread.filter("lo <> hi").select(F.col("gid").alias("gidx"), F.col("gid").alias("gidy"))
    p, q = (placed.select(F.col("gid").alias("gid" + g), F.col("node").alias(s), F.col("n").alias("n" + s), F.col("signature").alias("s" + s), F.col("wide").alias("w" + s), F.col("c").alias("c" + s)) for g, s in (("x", "a"), ("y", "b")))
    expanded = pairs.unionByName(inner).join(p, "gidx").join(q, "gidy").filter((F.col("ca") != F.col("cb")) & _possible(spec))
    expanded = expanded.filter((F.col("gidx") != F.col("gidy")) | (F.col("a") < F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = save(expanded.join(first, ["a", "b"], "left_anti"), "rest")
    if rest.isEmpty():
        return labels
    more = _verify(rest, sets_of(rest), spec)
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def resolve(docs: DataFrame, spec: JoinSpec, carry: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The chunk table and (chunk, row, doc_id, n_shingles, node, component_id) of every row of docs."""
    chunks = chunk_table(docs, carry)
    found = profiles(chunks, spec)
    nodes = classes(found)
    labels = link(chunks, nodes, spec)
    named = nodes.select("key1", "key2", "node").join(labels, "node", "left").select("key1", "key2", "node", F.coalesce("component", "node").alias("component_id"))
    rows = found.select("chunk", "row", "doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key1")).alias("key1"), "key2")
    out = rows.join(named, ["key1", "key2"], "left").select("chunk", "row", "doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"))
    return chunks, out


def jaccard_components(docs: DataFrame, spec: JoinSpec = JoinSpec(3, 90)) -> DataFrame:
    """op9: (doc_id, n_shingles, component_id)."""
    return resolve(docs, spec)[1].select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of every group of linked ones; rows without a set all stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chunks, found = resolve(docs.select("doc_id", "text", row.alias("carried")), spec, "carried")
    # Of repeated rows of the kept document the first stays.
    alone = found.filter("n_shingles = 0 or doc_id is null").select("chunk", "row")
    best = found.filter("n_shingles > 0 and doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "chunk", "row")).alias("at"))
    kept = save(alone.unionByName(best.select("at.chunk", "at.row")), "kept")
    kind = chunks.schema["carried"].dataType
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType(list(kind.elementType.fields))
    arrow = to_arrow_schema(schema)

    def pick(key, left, right):
        rows = sorted(right.column("row").to_pylist())
        carried = [left.column("carried")[0][r].as_py() for r in rows] if rows else []
        return pa.Table.from_pylist(carried, schema=arrow)

    return chunks.select("chunk", "carried").groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(pairwise(pick), schema).select(*[F.col(f"`{c}`") for c in docs.columns])
