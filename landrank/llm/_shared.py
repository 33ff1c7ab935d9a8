"""Shared-folder tables and small helpers that every corpus operator uses."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it: words are runs of [^\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


_open_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all tasks run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="landrank-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open_scratch:
        _open_scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Own the tables that are saved inside: at the end all go but those of the frames handed to the function it gives."""
    kept: set[str] = set()
    _open_scratch.append([])

    def keep(df: DataFrame) -> None:
        kept.update(f.rsplit("/", 1)[0] for f in df.inputFiles())

    try:
        yield keep
    finally:
        names = {k.rsplit("/", 1)[-1] for k in kept}
        mine = _open_scratch.pop()
        discard(spark, [p for p in mine if p.rsplit("/", 1)[-1] not in names])
        if _open_scratch:
            _open_scratch[-1] += [p for p in mine if p.rsplit("/", 1)[-1] in names]


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays alive between tasks, beside the JVM and its siblings."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batchwise(work: Callable) -> Callable:
    """work for mapInArrow, giving memory back at its end."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def groupwise(work: Callable) -> Callable:
    """work for applyInArrow of a group, giving memory back after each."""

    def run(key, table):
        try:
            return work(key, table)
        finally:
            give_back()

    return run


def pairwise(work: Callable) -> Callable:
    """work for applyInArrow of a cogroup, giving memory back after each."""

    def run(key, left, right):
        try:
            return work(key, left, right)
        finally:
            give_back()

    return run


def doc_texts(docs: DataFrame, *carry: str) -> DataFrame:
    """(carry, doc_id long, text string, null text as empty); other columns, whatever their names, are left behind."""
    return docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, one column scan; partition counts follow from it, so they grow with the data."""
    row = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()
    return int(row["n"] or 0)


def spread_sample(rows: DataFrame, key: str, n: int, total: int, seed: int = 42) -> DataFrame:
    """The n distinct rows whose `key` has the smallest hashes: the same ones each run, spread over the table.

    Of more than that, rows above a bound of the hash (some 4 * n are below) go before they are ordered, so that what meets
    in one task does not grow with the table.
    """
    order = F.xxhash64(key, F.lit(seed))
    if total > 8 * n:
        rows = rows.filter(order < F.lit(-(2**63) + int(2**64 * 4 * n / total)))
    return rows.distinct().orderBy(order, key).limit(n)


def string_parts(column: pa.Array | pa.ChunkedArray):
    """(offsets, bytes) of an Arrow string column as numpy views, without copying."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return where, raw


def slices(where, limit: int):
    """(first, last) row ranges of at most `limit` bytes each; a longer row stands alone."""
    first, n = 0, len(where) - 1
    for i in range(n):
        if where[i + 1] - where[first] > limit and i > first:
            yield first, i
            first = i
    if first < n:
        yield first, n
