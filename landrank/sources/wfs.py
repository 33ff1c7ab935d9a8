"""A Spark data source for web feature services: one partition a tile of the asked box, each feature from one tile only.

    spark.dataSource.register(FeatureService)
    spark.read.format("feature_service").option("url", u).option("type", "mines").option("box", "-87,36,-86,37").schema("name string, lon double, lat double").load()

Boxes and coordinates are degrees, longitude first, whatever reference system the reply names. Besides attributes a schema may ask for
lon and lat (a point, or the middle of the envelope) and xmin, ymin, xmax, ymax. A feature without geometry or a reply that is not
GML is an error.
"""

from __future__ import annotations

import re
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SHAPE = ("lon", "lat", "xmin", "ymin", "xmax", "ymax")
_TYPES = {"string": str, "int": int, "integer": int, "bigint": int, "long": int, "smallint": int, "double": float, "float": float}


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _points(node: ET.Element) -> list[tuple[float, float]]:
    """All positions below a node, written as coordinates, pos or posList."""
    found = []
    for part in node.iter():
        if _name(part.tag) == "coordinates":
            found += [tuple(map(float, p.split(",")[:2])) for p in (part.text or "").split()]
        elif _name(part.tag) in ("pos", "posList"):
            flat = list(map(float, re.split(r"[\s,]+", (part.text or "").strip())))
            found += list(zip(flat[::2], flat[1::2]))
    return found


def members(body: bytes) -> Iterator[dict[str, str | float | None]]:
    """Attributes and envelope of each feature of a GML reply."""
    try:
        root = ET.fromstring(body)
    except ET.ParseError as e:
        raise OSError(f"the reply is not GML: {body[:200]!r}") from e
    if "Exception" in _name(root.tag):
        raise OSError(" ".join(t.strip() for t in root.itertext() if t.strip()))
    for member in root.iter():
        if _name(member.tag) not in ("featureMember", "member"):
            continue
        for feature in member:
            row: dict[str, str | float | None] = {}
            places: list[tuple[float, float]] = []
            for child in feature:
                if _name(child.tag) == "boundedBy":
                    continue
                if len(child):
                    places += _points(child)
                else:
                    row[_name(child.tag)] = child.text
            if not places:
                raise OSError(f"a feature has no geometry: {row}")
            x, y = [p[0] for p in places], [p[1] for p in places]
            row |= {"xmin": min(x), "xmax": max(x), "ymin": min(y), "ymax": max(y), "lon": (min(x) + max(x)) / 2, "lat": (min(y) + max(y)) / 2}
            yield row


class _Tile(InputPartition):
    def __init__(self, box: tuple[float, float, float, float], last: tuple[bool, bool]):
        super().__init__(box)
        self.box, self.last = box, last


class FeatureService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_service"

    def schema(self) -> str:
        raise ValueError("feature_service needs a schema: attributes by name, lon and lat or xmin, ymin, xmax, ymax for the geometry")

    def reader(self, schema) -> DataSourceReader:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if odd := [f"{n} {k}" for n, k in kinds.items() if k not in _TYPES]:
            raise ValueError(f"feature_service has no columns like {', '.join(odd)}")
        return _Reader(self.options, {n: _TYPES[k] for n, k in kinds.items()})


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], columns: dict[str, type]):
        self.url, self.type, self.version = options["url"], options["type"], options.get("version", "1.0.0")
        self.box, self.tiles = tuple(map(float, options["box"].split(","))), int(options.get("tiles", 1))
        self.columns = columns

    def partitions(self) -> list[InputPartition]:
        x0, y0, x9, y9 = self.box
        n = self.tiles
        xs, ys = [x0 + (x9 - x0) * k / n for k in range(n)] + [x9], [y0 + (y9 - y0) * k / n for k in range(n)] + [y9]
        return [_Tile((xs[i], ys[j], xs[i + 1], ys[j + 1]), (i == n - 1, j == n - 1)) for i in range(n) for j in range(n)]

    def read(self, tile: _Tile) -> Iterator[tuple]:
        x0, y0, x9, y9 = tile.box
        asked = {"service": "WFS", "version": self.version, "request": "GetFeature", "typeName": self.type, "bbox": ",".join(map(repr, tile.box))}
        # Some services refuse the library's own agent name.
        request = urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(asked)}", headers={"User-Agent": "landrank"})
        with urllib.request.urlopen(request, timeout=600) as reply:
            body = reply.read()
        for row in members(body):
            # The lower corner of what lies in the box is in one tile only.
            x, y = max(row["xmin"], self.box[0]), max(row["ymin"], self.box[1])
            if (x0 <= x < x9 or (tile.last[0] and x == x9)) and (y0 <= y < y9 or (tile.last[1] and y == y9)):
                yield tuple(None if row.get(c) is None else kind(row[c]) for c, kind in self.columns.items())
