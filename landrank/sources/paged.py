"""A Spark data source for paged REST feature services: one partition a page, filters pushed to the server.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFeatures)
    spark.read.format("paged_features").option("url", layer).option("page", 1000).schema("name string, x double, y double").load()

The service answers `query?where=...&returnCountOnly=true` with {"count": n} and `query?...&resultOffset=k&resultRecordCount=m`
with {"features": [{"attributes": {...}, "geometry": {"x": ..., "y": ...}}]}. A reply with an "error" member is an error even when its
HTTP status is 200, and so is a feature without geometry when the schema asks for x or y.

A server may give fewer features than it is asked for: a partition asks on until it has its own, and a reply without any before that is
an error. Pages are cut from one order, the option `order` or else all attributes of the schema, so features neither repeat nor go
missing between them. Only comparisons with numbers and texts are pushed; Spark tests the rest.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def call(url: str, params: Mapping[str, Any], timeout: float = 60) -> dict:
    """A JSON reply, or an error that carries the server's own message."""
    with urllib.request.urlopen(f"{url}/query?{urllib.parse.urlencode({**params, 'f': 'json'})}", timeout=timeout) as reply:
        body = json.load(reply)
    if "error" in body:
        raise OSError(f"{url}: {body['error'].get('message', body['error'])}")
    return body


def count(url: str, where: str = "1=1") -> int:
    """Number of features, without moving any."""
    return int(call(url, {"where": where, "returnCountOnly": "true"})["count"])


def _literal(value: Any) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def _plain(value: Any) -> bool:
    """Numbers and texts are written the same way everywhere; dates, booleans and others are not."""
    return isinstance(value, (int, float, str)) and not isinstance(value, bool) and value == value and value not in (float("inf"), -float("inf"))


class _Page(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        raise ValueError("paged_features needs a schema: attributes by name, x and y for the geometry")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], columns: list[str]):
        self.url, self.page = options["url"], int(options.get("page", 1000))
        self.envelope, self.columns, self.where = options.get("envelope"), columns, [options.get("where", "1=1")]
        self.fields = ",".join(c for c in columns if c not in ("x", "y"))
        self.order = options.get("order", self.fields)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in (None, "x", "y"):
                yield f
            elif type(f) in _OPERATORS and _plain(f.value):
                self.where.append(f"{column} {_OPERATORS[type(f)]} {_literal(f.value)}")
            elif isinstance(f, In) and all(map(_plain, f.value)):
                self.where.append(f"{column} IN ({', '.join(map(_literal, f.value))})")
            else:
                yield f

    def _params(self) -> dict[str, Any]:
        return {"where": " AND ".join(self.where)} | ({"geometry": self.envelope} if self.envelope else {})

    def partitions(self) -> list[InputPartition]:
        total = int(call(self.url, self._params() | {"returnCountOnly": "true"})["count"])
        return [_Page(k, min(k + self.page, total)) for k in range(0, total, self.page)] or [_Page(0, 0)]

    def _features(self, partition: _Page) -> Iterator[dict]:
        at = partition.first
        ordered = {"orderByFields": self.order} if self.order else {}
        while at < partition.last:
            found = call(self.url, self._params() | ordered | {"outFields": self.fields, "resultOffset": at, "resultRecordCount": partition.last - at})["features"]
            if not found:
                raise OSError(f"{self.url}: no more features after {at}, where {partition.last} were counted")
            yield from found[: partition.last - at]
            at += len(found)

    def read(self, partition: _Page) -> Iterator[tuple]:
        for feature in self._features(partition):
            geometry = feature.get("geometry")
            if geometry is None and {"x", "y"} & set(self.columns):
                raise OSError(f"{self.url}: a feature has no geometry: {feature['attributes']}")
            yield tuple(geometry[c] if c in ("x", "y") else feature["attributes"].get(c) for c in self.columns)
