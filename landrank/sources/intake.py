"""Declarative intake: strict source specs, ordered transforms and load modes, as DataFrame plans."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import projection
from ..storage import durable
from . import catalogs, paged, wfs

STEPS = ("reproject", "select", "rename", "filter")
MODES = ("replace", "append", "upsert")


@dataclass(frozen=True)
class Load:
    target: str
    mode: str = "replace"
    upsert_key: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode == "upsert" and not self.upsert_key:
            raise ValueError("upsert needs upsert_key")


@dataclass(frozen=True)
class Source:
    """A source: driver and its parameters, transforms in the author's order, and where the result goes."""

    name: str
    driver: str
    load: Load
    params: Mapping[str, Any] = field(default_factory=dict)
    transform: tuple[Mapping[str, Any], ...] = ()

    @classmethod
    def parse(cls, spec: Mapping[str, Any]) -> Source:
        known = {"name", "driver", "params", "transform", "load"}
        if extra := set(spec) - known:
            raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
        steps = tuple(spec.get("transform", ()))
        for step in steps:
            if len(step) != 1 or next(iter(step)) not in STEPS:
                raise ValueError(f"each step has one of {', '.join(STEPS)}: {step}")
        load = dict(spec["load"])
        return cls(spec["name"], spec["driver"], Load(load.pop("target"), load.pop("mode", "replace"), tuple(load.pop("upsert_key", ())), **load), dict(spec.get("params", {})), steps)

    def dump(self) -> dict[str, Any]:
        load = {"target": self.load.target, "mode": self.load.mode} | ({"upsert_key": list(self.load.upsert_key)} if self.load.upsert_key else {})
        return {"name": self.name, "driver": self.driver, "params": dict(self.params), "transform": [dict(s) for s in self.transform], "load": load}

    def cache_key(self, area: str) -> str:
        """Digest of what decides a fetch; editing transforms or the load keeps it."""
        return hashlib.sha256(json.dumps({"driver": self.driver, "params": self.params, "area": area}, sort_keys=True).encode()).hexdigest()


#: Driver name -> reader of (spark, params, area box or None).
DRIVERS: dict[str, Callable[[SparkSession, Mapping[str, Any], Mapping[str, float] | None], DataFrame]] = {}


def driver(name: str):
    def add(f):
        DRIVERS[name] = f
        return f

    return add


@driver("parquet")
def read_parquet(spark: SparkSession, params: Mapping[str, Any], area: Mapping[str, float] | None) -> DataFrame:
    """A Parquet path; an area box becomes range filters that reach the scan."""
    df = spark.read.parquet(params["path"])
    if "where_in" in params:
        for column, values in params["where_in"].items():
            df = df.filter(F.col(column).isin(list(values)))
    if area:
        df = df.filter((F.col("xmin") <= area["xmax"]) & (F.col("xmax") >= area["xmin"]) & (F.col("ymin") <= area["ymax"]) & (F.col("ymax") >= area["ymin"]))
    return df


def apply(df: DataFrame, steps: Sequence[Mapping[str, Any]], check_rows: bool = False) -> DataFrame:
    """Transforms in order. A missing column is an error that names those there are; with check_rows so is a filter that
    drops every row of a table that had some (this runs two small jobs). `reproject` turns the columns lon and lat (degrees)
    into x and y (metres) of a UTM zone; a reference system it does not know is an error."""
    for step in steps:
        (kind, arg), *_ = step.items()
        if kind in ("select", "rename"):
            if missing := [c for c in arg if c not in df.columns]:
                raise ValueError(f"{kind}: no column {', '.join(missing)}; there are: {', '.join(df.columns)}")
            df = df.select(*[F.col(f"`{c}`") for c in arg]) if kind == "select" else df.withColumnsRenamed(dict(arg))
        elif kind == "reproject":
            if missing := [c for c in ("lon", "lat") if c not in df.columns]:
                raise ValueError(f"reproject: no column {', '.join(missing)}; there are: {', '.join(df.columns)}")
            x, y = projection.utm(F.col("lon"), F.col("lat"), arg)
            df = df.withColumn("x", x).withColumn("y", y).drop("lon", "lat")
        elif kind == "filter":
            kept = df.filter(F.expr(arg))
            if check_rows and kept.isEmpty() and not df.isEmpty():
                raise ValueError(f"filter {arg!r} drops every row")
            df = kept
    return df


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], latest: str | None = None) -> DataFrame:
    """old with the rows of new in place of those of the same key; one shuffle by key.

    Of rows of new that repeat a key the one with the largest `latest` counts; without it keys of new must be unique.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("__new"), *([F.desc_nulls_last(latest)] if latest else []))
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__new", "__rn")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def swap(spark: SparkSession, df: DataFrame, target: str) -> None:
    """Put df in the place of a table that it may read: it is written beside it, then names change. A job that dies on the way
    leaves the old table or, under a name of its own, the whole new one."""
    mark = uuid.uuid4().hex[:8]
    fresh, gone = f"{target}.next-{mark}", f"{target}.gone-{mark}"
    df.write.option("compression", "zstd").parquet(fresh)
    fs, at = _files(spark, target)
    aside, new = _files(spark, gone)[1], _files(spark, fresh)[1]
    there = fs.exists(at)
    if there:
        _rename(fs, at, aside)
    try:
        _rename(fs, new, at)
    except Exception:
        if there:
            _rename(fs, aside, at)
        raise
    if there:
        fs.delete(aside, True)


def _rename(fs, old, new) -> None:
    """A rename that did not happen is told by the answer, not by an error."""
    if not fs.rename(old, new):
        raise OSError(f"{old} could not be renamed to {new}")


def fetch(spark: SparkSession, source: Source, area: Mapping[str, float] | None = None, cache: str | None = None, refresh: bool = False) -> DataFrame:
    """What the driver gives, fetched once. With a cache folder it is written there, under the digest of what decides the fetch, and
    read from then on; without one it is held in the checkpoint folder. A fetch of no rows is an error and is not kept."""
    read = DRIVERS[source.driver]
    if cache is None:
        df = durable(read(spark, source.params, area))
    else:
        path = f"{cache}/{source.cache_key(json.dumps(area, sort_keys=True))}"
        if refresh or not exists(spark, path):
            swap(spark, read(spark, source.params, area), path)
        df = spark.read.parquet(path)
    if df.isEmpty():
        if cache is not None:
            fs, at = _files(spark, path)
            fs.delete(at, True)
        raise ValueError(f"{source.name}: the fetch has no rows")
    return df


@driver("keyed")
def read_keyed(spark: SparkSession, params: Mapping[str, Any], area: Mapping[str, float] | None) -> DataFrame:
    """Two-step read: keys of what the area has (`index`), then rows of those keys (`path`) with attributes joined by key and an
    extra condition. Keys meet rows in a semi join, so their number has no bound."""
    key = params["key"]
    rows = spark.read.parquet(params["path"]).join(read_parquet(spark, {"path": params["index"]}, area).select(key).distinct(), key, "left_semi")
    for part in params.get("attributes", ()):
        extra = spark.read.parquet(part["path"])
        rows = rows.join(extra.filter(part["only"]) if "only" in part else extra, key, "left")
    return rows


def _needs(name: str, params: Mapping[str, Any], keys: Sequence[str], area: Mapping[str, float] | None) -> None:
    if missing := [k for k in keys if k not in params]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    if area is None and params.get("scope", "area") == "area":
        raise ValueError(f"{name} is for an area; give one, or the scope 'all'")


@driver("paged_features")
def read_paged(spark: SparkSession, params: Mapping[str, Any], area: Mapping[str, float] | None) -> DataFrame:
    """A paged feature service. With `buffer_m` the server gets the area's box, that much wider; else rows outside the area's own
    box go here. The scope 'all' takes everything."""
    _needs("paged_features", params, ("url", "schema"), area)
    spark.dataSource.register(paged.PagedFeatures)
    read = spark.read.format("paged_features").schema(params["schema"])
    scoped, around = area is not None and params.get("scope", "area") == "area", float(params.get("buffer_m", 0))
    options = {k: params[k] for k in ("url", "page", "where") if k in params}
    if scoped and around > 0:
        options["envelope"] = ",".join(repr(float(area[c] + s * around)) for c, s in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1)))
    df = read.options(**options).load()
    return df.filter(F.col("x").between(area["xmin"], area["xmax"]) & F.col("y").between(area["ymin"], area["ymax"])) if scoped and around <= 0 else df


@driver("feature_service")
def read_service(spark: SparkSession, params: Mapping[str, Any], area: Mapping[str, float] | None) -> DataFrame:
    """A web feature service over the area's box in degrees, `buffer_m` wider; `where_in` keeps the named values of columns."""
    _needs("feature_service", params, ("url", "type", "schema"), area)
    if area is None:
        raise ValueError("feature_service has no scope 'all'")
    spark.dataSource.register(wfs.FeatureService)
    # Never less than the buffer: the shortest degree of latitude, and of longitude at the latitude farthest from the equator.
    dy = float(params.get("buffer_m", 0)) / 110_500
    dx = dy / max(1e-6, math.cos(math.radians(min(90.0, max(abs(area["ymin"]), abs(area["ymax"])) + dy))))
    box = ",".join(repr(float(v)) for v in (area["xmin"] - dx, area["ymin"] - dy, area["xmax"] + dx, area["ymax"] + dy))
    read = spark.read.format("feature_service").schema(params["schema"]).options(**{k: params[k] for k in ("url", "type", "version", "tiles") if k in params}, box=box)
    df = read.load()
    for column, values in params.get("where_in", {}).items():
        df = df.filter(F.col(column).isin(list(values)))
    return df


def run(spark: SparkSession, source: Source, target_path: str, area: Mapping[str, float] | None = None, cache: str | None = None) -> DataFrame:
    """Fetch, transform and load into a Parquet folder; returns what is there then. An upsert without a target makes it."""
    df = apply(fetch(spark, source, area, cache), source.transform, check_rows=True)
    mode, key = source.load.mode, source.load.upsert_key
    if mode == "append":
        df.write.mode("append").option("compression", "zstd").parquet(target_path)
    elif mode == "replace":
        swap(spark, df, target_path)
    else:
        catalogs.require_unique(df, key)
        swap(spark, upsert(spark.read.parquet(target_path), df, key) if exists(spark, target_path) else df, target_path)
    return spark.read.parquet(target_path)
