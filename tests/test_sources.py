import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from landrank.sources import intake, labels, paged

ROWS = [{"name": f"n{i}", "kind": "ab"[i % 2], "x": float(i), "y": 2.0 * i} for i in range(25)]
SEEN = []
#: Most features that the paged service gives at a time.
CAP = {0: 1000}


MINES = [(f"m{i}", "iron" if i % 3 else "lead", -87 + i / 20, 36 + (i * 7 % 20) / 20) for i in range(21)]


def gml(q):
    """Points and one line that meet the asked box, borders included."""
    x0, y0, x9, y9 = map(float, q["bbox"].split(","))
    if q["typeName"] == "none":
        return "<ServiceExceptionReport><ServiceException>no such type</ServiceException></ServiceExceptionReport>"
    point = "<gml:featureMember><mine><gml:boundedBy><gml:null/></gml:boundedBy><name>{0}</name><ore>{1}</ore><depth/><shape><gml:Point><gml:coordinates>{2},{3}</gml:coordinates></gml:Point></shape></mine></gml:featureMember>"
    found = [point.format(*m) for m in MINES if x0 <= m[2] <= x9 and y0 <= m[3] <= y9]
    if x0 <= -86.1 and x9 >= -86.9 and y0 <= 36.9 and y9 >= 36.1:
        found.append("<gml:featureMember><mine><name>vein</name><ore>iron</ore><depth>7</depth><shape><gml:LineString><gml:posList>-86.9 36.1 -86.1 36.9</gml:posList></gml:LineString></shape></mine></gml:featureMember>")
    return f'<w:FeatureCollection xmlns:w="http://www.opengis.net/wfs" xmlns:gml="http://www.opengis.net/gml">{"".join(found)}</w:FeatureCollection>'


class Service(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if q.get("request") == "GetFeature":
            return self.reply(gml(q))
        SEEN.append(q["where"] + q.get("geometry", ""))
        rows = [r for r in ROWS if "kind = 'b'" not in q["where"] or r["kind"] == "b"]
        if "bad" in q["where"]:
            body = {"error": {"message": "no such field"}}
        elif "returnCountOnly" in q:
            body = {"count": len(rows)}
        else:
            at, n = int(q["resultOffset"]), min(CAP[0], int(q["resultRecordCount"]))
            rows = sorted(rows, key=lambda r: [r[c] for c in q["orderByFields"].split(",")])
            body = {"features": [{"attributes": {k: r[k] for k in q["outFields"].split(",")}, "geometry": None if "null" in q["where"] else {"x": r["x"], "y": r["y"]}} for r in rows[at : at + n]]}
        self.reply(json.dumps(body))

    def reply(self, body):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_paged_features(spark, url):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.PagedFeatures)
    read = spark.read.format("paged_features").option("url", url).option("page", 10).schema("name string, kind string, x double, y double")
    assert sorted(map(tuple, read.load().collect())) == sorted((r["name"], r["kind"], r["x"], r["y"]) for r in ROWS)
    assert {r.name for r in read.load().filter("kind = 'b'").collect()} == {r["name"] for r in ROWS if r["kind"] == "b"}
    assert any("kind = 'b'" in w for w in SEEN)
    assert paged.count(url) == 25
    with pytest.raises(OSError, match="no such field"):
        paged.count(url, "bad")
    with pytest.raises(Exception, match="no geometry"):
        read.option("where", "null").load().collect()


def test_paged_features_of_a_server_with_a_lower_cap(spark, url, monkeypatch):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.PagedFeatures)
    read = spark.read.format("paged_features").option("url", url).option("page", 10).schema("name string, kind string, x double, y double")
    for cap in (1, 4, 9):
        monkeypatch.setitem(CAP, 0, cap)
        assert sorted(r.name for r in read.load().collect()) == sorted(r["name"] for r in ROWS)
    monkeypatch.setitem(CAP, 0, 0)
    with pytest.raises(Exception, match="no more features"):
        read.load().collect()


def test_only_numbers_and_texts_are_pushed():
    import datetime

    from pyspark.sql.datasource import EqualTo, In

    reader = paged._Reader({"url": "u"}, ["d", "n"])
    filters = [EqualTo(("d",), datetime.date(2020, 1, 1)), EqualTo(("n",), True), In(("n",), (1, None)), EqualTo(("n",), 5), In(("n",), ("a'b", 2.5)), EqualTo(("x",), 1.0)]
    assert list(reader.pushFilters(filters)) == [filters[0], filters[1], filters[2], filters[5]]
    assert reader.where == ["1=1", "n = 5", "n IN ('a''b', 2.5)"]


def test_swap_keeps_the_old_table_where_a_rename_fails(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    intake.swap(spark, spark.range(3), target)
    real, calls = intake._rename, []

    def failing(fs, old, new):
        calls.append(str(old))
        if len(calls) == 2:
            raise OSError("no")
        real(fs, old, new)

    monkeypatch.setattr(intake, "_rename", failing)
    with pytest.raises(OSError):
        intake.swap(spark, spark.range(5), target)
    assert spark.read.parquet(target).count() == 3
    monkeypatch.setattr(intake, "_rename", real)
    intake.swap(spark, spark.range(7), target)
    assert spark.read.parquet(target).count() == 7
    fs, at = intake._files(spark, str(tmp_path / "nothing"))
    with pytest.raises(Exception):
        intake._rename(fs, at, intake._files(spark, str(tmp_path / "else"))[1])


def test_a_limit_leaves_out_by_order(spark):
    from landrank.sources import semantic

    model = semantic.load({"model": "m", "dimensions": {"k": {"expr": "k"}}, "measures": {"n": {"expr": "count(*)"}}})
    table = spark.range(300).selectExpr("(id * 7919) % 250 AS k").repartition(7)
    assert [r.k for r in semantic.ask(model, table, ["k"], ["n"]).collect()] == list(range(100))


def test_label_points(spark, tmp_path):
    points = [("iron_works", "a", 500010.0, 4000010.0), ("iron_works", "b", -86.5, 36.1), ("nowhere", "c", 600000.0, 4000010.0)]
    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": {"class_id": k, "name": n}} for k, n, x, y in points]
    (tmp_path / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = labels.read_points(spark, str(tmp_path / "l.geojson"))
    classes = spark.createDataFrame([("iron_works",)], "class_id string")
    found = {tuple(r) for r in labels.problems(got, classes, {"xmin": 5e5, "xmax": 501000, "ymin": 399e4, "ymax": 401e4}).collect()}
    assert found == {("b", "degrees"), ("b", "outside footprint"), ("c", "outside footprint"), ("c", "unknown class")}
    assert {r.positional_confidence_m for r in labels.confidence(got, 32.2).collect()} == {32.2}
    labels.write_geojson(got, str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["properties"]["name"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def fetch(spark, driver, area=None, **params):
    load = {"target": "t"}
    return intake.fetch(spark, intake.Source.parse({"name": "s", "driver": driver, "params": params, "load": load}), area)


def test_paged_driver(spark, url):
    schema, box = "name string, x double, y double", {"xmin": 3.0, "ymin": 0.0, "xmax": 9.5, "ymax": 15.0}
    read = lambda area=None, **more: fetch(spark, "paged_features", area, url=url, schema=schema, page=10, **more)
    assert sorted(r.name for r in read(box).collect()) == ["n3", "n4", "n5", "n6", "n7"]
    assert read(scope="all").count() == 25
    SEEN.clear()
    assert read(box, buffer_m=2).count() == 25 and all(w.endswith("1.0,-2.0,11.5,17.0") for w in SEEN)
    with pytest.raises(ValueError, match="for an area"):
        read()
    with pytest.raises(ValueError, match="needs url"):
        fetch(spark, "paged_features", box, schema=schema)
    with pytest.raises(ValueError, match="no rows"):
        read({k: v + 1e6 for k, v in box.items()})


@pytest.mark.parametrize("tiles", [1, 3])
def test_feature_service(spark, url, tiles):
    box = {"xmin": -87.0, "ymin": 36.0, "xmax": -86.0, "ymax": 37.0}
    read = lambda **more: fetch(spark, "feature_service", box, **({"url": url, "type": "mines", "tiles": tiles, "schema": "name string, ore string, depth int, lon double, lat double"} | more))
    got = sorted(map(tuple, read().collect()))
    assert [r[0] for r in got] == sorted([m[0] for m in MINES] + ["vein"])
    assert {r[0]: r[3:] for r in got if r[0] != "vein"} == {m[0]: m[2:] for m in MINES}
    assert next(r for r in got if r[0] == "vein") == ("vein", "iron", 7, -86.5, 36.5)
    assert read(where_in={"ore": ["lead"]}).count() == 7
    with pytest.raises(ValueError, match="no rows"):
        read(where_in={"ore": ["gold"]})
    with pytest.raises(Exception, match="no such type"):
        read(type="none").collect()
