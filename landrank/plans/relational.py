"""Intake, upserts, ledger views, JSON parameters, catalogs and the semantic layer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import curves
from ..operators import ranking
from ..sources import fixtures, intake, semantic
from ..sources.fixtures import table
from . import query


@query("SELECT p_partkey AS part_id, p_name AS title, p_size FROM part WHERE p_size >= 10 AND p_brand <> 'Brand#11'")
def intake_transforms(spark, sf_dir):
    steps = [{"select": ["p_partkey", "p_name", "p_size", "p_brand"]}, {"rename": {"p_partkey": "part_id", "p_name": "title"}}, {"filter": "p_size >= 10 and p_brand <> 'Brand#11'"}, {"select": ["part_id", "title", "p_size"]}]
    return intake.apply(table(spark, sf_dir, "part"), steps)


@query("SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(c_name, s_name) AS name, coalesce(c_acctbal, s_acctbal) AS balance FROM supplier FULL JOIN customer ON c_custkey = s_suppkey")
def upsert_latest_wins(spark, sf_dir):
    """Customers loaded over suppliers by key: known keys are replaced, new ones added, others stay."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return intake.upsert(old, new, ["id"])


@query("SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def upsert_actions(spark, sf_dir):
    """What an upsert does with each incoming row."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("known"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(known, "id", "left").select("id", F.when(F.col("known"), "updated").otherwise("inserted").alias("action"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'excluded restricted' WHEN rn > 1 THEN 'excluded duplicate' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'skipped' ELSE 'inserted' END AS action
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 100) ORDER BY c_custkey) AS rn FROM customer)""")
def seed_insert_if_absent_report(spark, sf_dir):
    """Insert by natural key with the reason for every row: restricted, duplicate in the input, already there, inserted."""
    rows = table(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100)).orderBy("c_custkey")))
    there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("there")).distinct()
    action = F.when(F.col("c_acctbal") < 0, "excluded restricted").when(F.col("rn") > 1, "excluded duplicate").when(F.col("there"), "skipped").otherwise("inserted")
    return rows.join(there, "c_custkey", "left").select("c_custkey", action.alias("action"))


@query("SELECT event_type, user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_run_per_operation(spark, sf_dir):
    return ranking.latest(table(spark, sf_dir, "events"), ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT run, max(seq) AS seq, CASE WHEN count(*) FILTER (seq = 1) = 0 THEN 'running' WHEN bool_or(value < 20) FILTER (seq = 1) THEN 'failed' ELSE 'ok' END AS status FROM (SELECT event_id // 2 AS run, event_id % 2 AS seq, value FROM events WHERE event_id % 2 = 0 OR value >= 10) GROUP BY run")
def ledger_latest_state(spark, sf_dir):
    """State of each run from its opening row and, where one was written, its closing row."""
    e = table(spark, sf_dir, "events").filter("event_id % 2 = 0 or value >= 10").select(F.expr("event_id div 2").alias("run"), (F.col("event_id") % 2).alias("seq"), "value")
    last = ranking.latest(e, ["run"], [F.desc("seq")])
    return last.select("run", "seq", F.when(F.col("seq") == 0, "running").when(F.col("value") < 20, "failed").otherwise("ok").alias("status"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_param_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, sha256('brand=' || p_brand || '|size=' || p_size || '|type=' || p_type) AS key FROM part")
def cache_key_sha(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", curves.cache_key({"size": F.col("p_size"), "brand": F.col("p_brand"), "type": F.col("p_type")}).alias("key"))


KINDS = "SELECT user_id AS aoi_id, event_type AS kind, event_id AS asset_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'class_a' ELSE 'class_b' END AS variant FROM events"


@query(f"""SELECT aoi_id, kind, asset_id, variant FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id, kind ORDER BY CASE variant WHEN 'class_a' THEN 0 ELSE 1 END, asset_id) AS rn
FROM ({KINDS}) WHERE variant = 'class_a' OR (variant = '' AND kind <> 'purchase')) WHERE rn = 1""")
def asset_selection(spark, sf_dir):
    """One asset a kind for a class: its own variant first; a class-bound kind never falls back to the plain one."""
    e = table(spark, sf_dir, "events")
    variant = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "class_a").otherwise("class_b")
    assets = e.select(F.col("user_id").alias("aoi_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("asset_id"), variant.alias("variant"))
    fit = assets.filter((F.col("variant") == "class_a") | ((F.col("variant") == "") & (F.col("kind") != "purchase")))
    return ranking.latest(fit, ["aoi_id", "kind"], [F.when(F.col("variant") == "class_a", 0).otherwise(1), F.col("asset_id")])


AOI = semantic.Model("aoi", {"role": "role"}, {"n": ("count", "*"), "width": ("sum", "width"), "widest": ("max", "width")})
FLOW = semantic.Model("flowline", {"order": "stream_order"}, {"n": ("count", "*"), "mean_x": ("mean", "x1")})
ORDERS = semantic.Model("orders", {"status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice"}, {"n": ("count", "*"), "largest": ("max", "o_totalprice")})
RUNS = semantic.Model("derivation", {"operation": "event_type"}, {"n": ("count", "*"), "top": ("max", "value")})
SITES = semantic.Model("site", {"class_id": "class_id", "status": "review_status"}, {"n": ("count", "*"), "worst": ("max", "positional_confidence_m")})


@query("SELECT role, count(*) AS n, sum(xmax - xmin) AS width FROM fx_aoi GROUP BY role")
def semantic_aoi(spark, sf_dir):
    areas = fixtures.areas(spark, sf_dir).withColumn("width", F.col("xmax") - F.col("xmin"))
    return semantic.ask(AOI, areas, ["role"], ["n", "width"])


@query("SELECT stream_order AS \"order\", count(*) AS n, round(avg(x1), 6) AS mean_x FROM fx_line WHERE stream_order >= 2 GROUP BY 1")
def semantic_flowline(spark, sf_dir):
    return semantic.ask(FLOW, fixtures.flowlines(spark, sf_dir), ["order"], ["n", "mean_x"], ["order >= 2"]).withColumn("mean_x", F.round("mean_x", 6))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, max(o_totalprice) AS largest FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8")
def semantic_orders_top(spark, sf_dir):
    return semantic.ask(ORDERS, table(spark, sf_dir, "orders"), ["status", "priority"], ["n", "largest"], ["total > 1000"], order_by="n", descending=True, limit=8)


@query("SELECT count(*) AS n FROM events WHERE event_type != 'view'")
def semantic_runs(spark, sf_dir):
    return semantic.ask(RUNS, table(spark, sf_dir, "events"), filters=["operation != 'view'"])


@query("SELECT class_id, review_status AS status, count(*) AS n, max(positional_confidence_m) AS worst FROM fx_site WHERE review_status = 'confirmed' GROUP BY 1, 2")
def semantic_sites(spark, sf_dir):
    return semantic.ask(SITES, fixtures.sites(spark, sf_dir), ["class_id", "status"], ["n", "worst"], ["status = 'confirmed'"])


@query("SELECT l_orderkey, l_linenumber, least(greatest(round_even(l_extendedprice / 225.0, 0), 1.0)::DOUBLE, 1000000.0) AS probes, coalesce(list_max(list_filter([CAST(x AS INT) FOR x IN regexp_extract_all('survey_' || (1985 + l_orderkey % 40) || '_' || (1990 + l_partkey % 30), '(\\d{4})', 1)], lambda y: y BETWEEN 1991 AND 2099)), 0) AS year FROM lineitem")
def coverage_year(spark, sf_dir):
    """Newest survey year in a project's name, and probes by area."""
    name = F.concat(F.lit("survey_"), (1985 + F.col("l_orderkey") % 40).cast("string"), F.lit("_"), (1990 + F.col("l_partkey") % 30).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.lit(1.0), F.bround(F.col("l_extendedprice") / 225.0)).alias("probes"), curves.newest_year(name).alias("year"))


@query("SELECT n_name, title, rn::INT AS place FROM (SELECT n_name, s_name AS title, row_number() OVER (PARTITION BY n_nationkey ORDER BY CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END, s_acctbal DESC, s_name) AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def candidate_order(spark, sf_dir):
    """Candidates of each area: preferred ones first, then the newest, then by name."""
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    order = Window.partitionBy("n_nationkey").orderBy(F.when(F.col("s_suppkey") % 7 == 0, 0).otherwise(1), F.desc("s_acctbal"), "s_name")
    return both.select("n_name", F.col("s_name").alias("title"), F.row_number().over(order).alias("place"))


@query("SELECT o_orderkey, l.sheet FROM orders JOIN (SELECT l_orderkey, max(l_partkey) AS sheet FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def latest_sheet_join(spark, sf_dir):
    """Attributes reduced to one row a key before they are joined, so that the join can't multiply rows."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_partkey").alias("sheet"))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").join(last, "o_orderkey")
