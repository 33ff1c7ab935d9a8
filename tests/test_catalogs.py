import math

import pytest
from pyspark.sql import functions as F

from landrank.functions import params, projection
from landrank.sources import catalogs, intake, semantic


def source(path, **more):
    return intake.Source.parse({"name": "parts", "driver": "parquet", "params": {"path": str(path)}, "load": {"target": "t", "mode": "upsert", "upsert_key": ["a"]}} | more)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_again_and_again(spark, tmp_path):
    target = str(tmp_path / "out")
    for k, (given, want) in enumerate([([(1, "x")], [(1, "x")]), ([(2, "y")], [(1, "x"), (2, "y")]), ([(1, "z"), (3, "w")], [(1, "z"), (2, "y"), (3, "w")])]):
        spark.createDataFrame(given, "a int, b string").write.parquet(str(tmp_path / f"in{k}"))
        assert rows(intake.run(spark, source(tmp_path / f"in{k}"), target)) == want
        assert rows(spark.read.parquet(target)) == want
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in0", "in1", "in2", "out"]
    spark.createDataFrame([(7, "p"), (7, "q")], "a int, b string").write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="repeated key"):
        intake.run(spark, source(tmp_path / "twice"), target)
    new = spark.createDataFrame([(7, "p", 1), (7, "q", 2)], "a int, b string, at int")
    assert rows(intake.upsert(new.limit(0), new, ["a"], latest="at")) == [(7, "q", 2)]


def test_replace_reads_its_own_target(spark, tmp_path):
    target = str(tmp_path / "t")
    spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").write.parquet(target)
    spec = source(target, transform=[{"filter": "a > 1"}], load={"target": "t", "mode": "replace"})
    assert rows(intake.run(spark, spec, target)) == [(2, "y")]


def test_fetch_cache(spark, tmp_path):
    calls = []

    @intake.driver("counted")
    def counted(spark, given, area):
        calls.append(area)
        return spark.createDataFrame([(given["n"],)] if given["n"] else [], "a int")

    spec = lambda n: intake.Source("c", "counted", intake.Load("t"), {"n": n})
    cache, area = str(tmp_path / "cache"), {"xmin": 1.0}
    for _ in range(2):
        assert rows(intake.fetch(spark, spec(4), area, cache)) == [(4,)]
    assert len(calls) == 1
    intake.fetch(spark, spec(4), {"xmin": 2.0}, cache)
    intake.fetch(spark, spec(4), area, cache, refresh=True)
    assert len(calls) == 3
    for _ in range(2):
        with pytest.raises(ValueError, match="no rows"):
            intake.fetch(spark, spec(0), area, cache)
    assert len(calls) == 5
    del intake.DRIVERS["counted"]


def test_keyed_read(spark, tmp_path):
    spark.createDataFrame([("k1", 0.0, 1.0, 0.0, 1.0), ("k2", 9.0, 9.5, 9.0, 9.5), ("k1", 0.2, 0.3, 0.0, 1.0)], "key string, xmin double, xmax double, ymin double, ymax double").write.parquet(str(tmp_path / "index"))
    spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "key string, v int").write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame([("k1", "yes", "deep"), ("k1", "no", "flat")], "key string, indicator string, kind string").write.parquet(str(tmp_path / "more"))
    given = {"key": "key", "index": str(tmp_path / "index"), "path": str(tmp_path / "rows"), "attributes": [{"path": str(tmp_path / "more"), "only": "indicator = 'yes'"}]}
    area = {"xmin": 0.0, "xmax": 2.0, "ymin": 0.0, "ymax": 2.0}
    assert rows(intake.DRIVERS["keyed"](spark, given, area)) == [("k1", 1, "yes", "deep")]


def test_reproject(spark):
    # Published worked examples: central meridian at the equator, and the CN tower in zone 17.
    df = spark.createDataFrame([(-87.0, 0.0, "m"), (-86.5, 36.1, "n")], "lon double, lat double, name string")
    out = {r.name: r for r in intake.apply(df, [{"reproject": "EPSG:26916"}]).collect()}
    assert out["m"].x == pytest.approx(500000, abs=1e-6) and out["m"].y == pytest.approx(0, abs=1e-6)
    tower = spark.createDataFrame([(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)], "lon double, lat double")
    got = intake.apply(tower, [{"reproject": "EPSG:32617"}]).first()
    assert (got.x, got.y) == (pytest.approx(630084, abs=1), pytest.approx(4833438, abs=1))
    with pytest.raises(ValueError, match="can't project"):
        intake.apply(df, [{"reproject": "EPSG:4326"}])
    with pytest.raises(ValueError, match="no column lon"):
        intake.apply(df.drop("lon"), [{"reproject": "EPSG:26916"}])
    assert projection.zone_of("EPSG:26916") == ("269", 16)


def test_merge_keeps_unlisted_columns(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, t string, n int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 7)], "k int, t string, n int")
    assert sorted(map(tuple, catalogs.merge(old, new, ["k"]).collect()), key=str) == [(1, "a", None), (2, "c", None), (3, "d", 7)]
    assert sorted(map(tuple, catalogs.merge(old, new, ["k"], ["n"]).collect()), key=str) == [(1, "a", None), (2, "b", None), (3, "d", 7)]


def test_partitions_in_place(spark, tmp_path):
    path = str(tmp_path / "p")
    catalogs.write_partitions(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], "aoi int, cls string, z int"), path, ["aoi", "cls"])
    catalogs.write_partitions(spark.createDataFrame([(1, "a", 9)], "aoi int, cls string, z int"), path, ["aoi", "cls"])
    assert sorted((r.aoi, r.cls, r.z) for r in spark.read.parquet(path).collect()) == [(1, "a", 9), (1, "b", 2), (2, "a", 3)]


def test_variants_and_single_features(spark):
    df = spark.createDataFrame([("dem", "", 1), ("dem", "abc", 2), ("slope", "", 3)], "kind string, variant string, id int")
    assert [r.id for r in catalogs.one_variant(df, "slope").collect()] == [3]
    assert [r.id for r in catalogs.one_variant(df, "dem", "abc").collect()] == [2]
    with pytest.raises(ValueError, match="'', 'abc'"):
        catalogs.one_variant(df, "dem")
    assert catalogs.exactly_one(df.filter("id = 3")).count() == 1
    for bad in (df, df.limit(0)):
        with pytest.raises(ValueError, match="exactly one"):
            catalogs.exactly_one(bad)


def test_parameters():
    assert params.resolve({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}
    with pytest.raises(ValueError, match="unknown parameter c; known: a"):
        params.resolve({"a": 1}, {"c": 1})
    assert params.resolve_class("mill", ("a",), {"a": 0, "b": 1}) == {"a": 0}
    with pytest.raises(ValueError, match="mill has no b"):
        params.resolve_class("mill", ("a", "b"), {"a": 0, "b": None})
    assert (params.buffer_m("model", 9), params.buffer_m("detection", 10), params.buffer_m("detection", 40)) == (2000, 50, 80)
    params.check_area(25)
    with pytest.raises(ValueError, match="120,000,000 cells"):
        params.check_area(30)
    params.check_class("mill", "detection", {"mill": "detection"})
    with pytest.raises(ValueError, match="can't be seen"):
        params.check_class("mill", "model", {"mill": "detection"})
    with pytest.raises(ValueError, match="unknown gate"):
        params.gates(mid_cells=1)


def test_gates_that_are_not_set_let_all_pass(spark):
    df = spark.createDataFrame([(9, 2.0, 0.5, 3.0, 0.9), (2, 1.0, 0.0, 1.0, 1.0)], "cells int, elongation double, enclosed double, span double, fill double")
    count = lambda **g: df.filter(params.gates(**g)).count()
    assert (count(), count(min_cells=4), count(max_elongation=None, max_fill=0.95), count(min_enclosed=0.4, max_span=2.0)) == (2, 1, 1, 0)


def test_semantic_models_and_fields(spark):
    model = semantic.load({"model": "m", "dimensions": {"order": {"expr": "stream_order"}}, "measures": {"n": {"expr": "count(*)"}, "top": {"expr": "max(x)"}}})
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (2, 9.0)], "stream_order int, x double")
    assert semantic.ask(model, df, ["order"], ["top"], ["order >= 2"]).collect() == [(2, 9.0)]
    assert [r.order for r in semantic.ask(model, df, ["order"], order_by="order").collect()] == [1, 2]
    with pytest.raises(ValueError, match="unknown field x"):
        semantic.ask(model, df, ["order"], filters=["x > 1"])
    for bad in ({"model": "m", "dimensions": {}, "measures": {}, "extra": 1}, {"model": "m", "dimensions": {}, "measures": {"n": {"expr": "median(x)"}}}):
        with pytest.raises(ValueError):
            semantic.load(bad)
    assert math.isclose(semantic.ask(model, df, measures=["top"]).first().top, 9.0)
    assert semantic.ask(model, df.withColumn("y", F.lit(1)), ["order"]).count() == 2
