"""Provenance: operations as append-only rows, their latest state as a view."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator, Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, seq int, operation string, tool string, params string, inputs string, at timestamp, status string, error string"
ERROR_CHARS = 4000


def append(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)


@contextlib.contextmanager
def operation(spark: SparkSession, path: str, name: str, tool: str, params: Mapping[str, Any], inputs: Mapping[str, Any] | None = None) -> Iterator[dict[str, Any]]:
    """Open a ledger row before the work and close it as ok or failed; what the body puts into the dict is merged into params."""
    key, patch = uuid.uuid4().hex, {}
    base = (key, name, tool)
    given = json.dumps(inputs or {}, sort_keys=True)
    append(spark, path, (key, 0, name, tool, json.dumps(params, sort_keys=True), given, datetime.now(UTC), "running", None))
    try:
        yield patch
    except BaseException as e:
        append(spark, path, (key, 1, *base[1:], json.dumps(dict(params) | patch, sort_keys=True), given, datetime.now(UTC), "failed", str(e)[:ERROR_CHARS]))
        raise
    append(spark, path, (key, 1, *base[1:], json.dumps(dict(params) | patch, sort_keys=True), given, datetime.now(UTC), "ok", None))


def latest(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
