"""Ranks without a single-partition sort, top-k, latest rows, and the survey budget fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curves
from ..storage import durable

_BUCKETS = 1024


def _ranked(df: DataFrame, column: str, by: list[str], low: float | None, high: float | None) -> DataFrame:
    """(by, column, __n, __below, __all): of each distinct value how often it is there, how many rows are below it, and all rows.

    Rows shrink to counts first. Values fall into buckets of [low, high] in order, of [least, largest] if not given (beyond it
    into the outer ones, which costs balance, not correctness); ranks count within a bucket and add the buckets before.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    if low is None:
        ends = counts.groupBy(*by).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
        counts = counts.join(ends, by) if by else counts.crossJoin(F.broadcast(ends))
        lo, width = F.col("__lo"), F.col("__hi") - F.col("__lo")
    else:
        lo, width = F.lit(low), F.lit(high - low)
    step = F.coalesce(F.floor(F.try_divide((F.col(column) - lo) * _BUCKETS, width)), F.lit(0))
    counts = counts.withColumn("__bucket", F.greatest(F.lit(-1), F.least(F.lit(_BUCKETS), step)))
    ahead = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row a bucket: these windows see about a thousand rows a group, however many cells there are.
    sizes = counts.groupBy(*by, "__bucket").agg(F.sum("__n").alias("__in"))
    offsets = sizes.select(*by, "__bucket", F.coalesce(F.sum("__in").over(ahead), F.lit(0)).alias("__before"), F.sum("__in").over(Window.partitionBy(*by, F.lit(0))).alias("__all"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    return within.join(offsets, [*by, "__bucket"]).select(*by, column, "__n", (F.col("__before") + F.col("__in")).alias("__below"), "__all")


def percentile_rank(df: DataFrame, column: str, out: str, low: float | None = 0.0, high: float | None = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Percentile rank in (0, 100] with average ties, within each group of `by`; null stays null."""
    rank = F.col("__below") + (F.col("__n") + 1.0) / 2.0
    ranked = _ranked(df, column, list(by), low, high).select(*by, column, (rank * 100.0 / F.col("__all")).alias(out))
    return df.join(ranked, [*by, column], "left")


def quantiles(df: DataFrame, column: str, asked: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """One row (a group) of exact quantiles, linear between neighbours: out name -> share. No task holds all values."""
    ranked = _ranked(df, column, list(by), None, None)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__below") <= place) & (place < F.col("__below") + F.col("__n")), F.col(column)))

    ends = []
    for name, p in asked.items():
        h = F.lit(p) * (F.col("__all") - 1)
        ends += [at(F.floor(h)).alias(f"__a_{name}"), at(F.ceil(h)).alias(f"__b_{name}"), F.max(h - F.floor(h)).alias(f"__t_{name}")]
    value = lambda n: F.col(f"__a_{n}") + (F.col(f"__b_{n}") - F.col(f"__a_{n}")) * F.col(f"__t_{n}")
    return ranked.groupBy(*by).agg(*ends).select(*by, *[value(n).alias(n) for n in asked])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def budget_fill(candidates: DataFrame, group: str, budget: float, block: int = 512) -> DataFrame:
    """Greedy itinerary within hours: by value an hour, each candidate that still fits is taken, others are skipped (no stop).

    candidates: (group, id, hours, value), ids once a group; equal rates go by id. Without a group, a value or hours above zero a
    candidate is never taken. A round folds the next `block` candidates of each group that fit into what is left, which Spark cuts
    out before it shuffles; the first of them always fits, so rounds are few and no task sees a whole group.
    """
    pool = candidates.filter(F.col(group).isNotNull() & (F.col("hours") > 0) & F.col("value").isNotNull())
    queue = pool.select(group, (-(F.col("value") / F.col("hours"))).alias("rate"), "id", F.col("hours").cast("double").alias("hours"))
    queue = durable(queue.filter(F.col("hours") <= F.lit(float(budget))))
    item = queue.schema["id"].dataType.simpleString()
    state = queue.select(group).distinct().select(group, F.lit(0.0).alias("spent"), F.lit(0).alias("taken"))
    start = F.struct(F.col("spent"), F.array().cast(f"array<{item}>").alias("ids"))
    take = lambda a, c: F.when(a["spent"] + c["hours"] <= F.lit(float(budget)), F.struct((a["spent"] + c["hours"]).alias("spent"), F.concat(a["ids"], F.array(c["id"])).alias("ids"))).otherwise(a)
    picked = None
    while not queue.isEmpty():
        ahead = first_of_each(queue, [group], [F.asc("rate"), F.asc("id")], block)
        folded = ahead.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rate", "id", "hours"))).alias("q")).join(state, group)
        filled = durable(folded.select(group, "taken", F.element_at("q", -1).alias("last"), F.aggregate("q", start, take).alias("fill")))
        stops = filled.select(group, "taken", F.posexplode("fill.ids").alias("pos", "id")).select(group, "id", (F.col("taken") + F.col("pos") + 1).alias("stop"))
        picked = stops if picked is None else picked.unionByName(stops)
        state = filled.select(group, "fill.spent", (F.col("taken") + F.size("fill.ids")).alias("taken"), "last")
        left = queue.join(state, group).filter((F.struct("rate", "id") > F.struct("last.rate", "last.id")) & (F.col("spent") + F.col("hours") <= F.lit(float(budget))))
        queue, state = durable(left.select(group, "rate", "id", "hours")), state.drop("last")
    if picked is None:
        return candidates.withColumn("stop", F.lit(None).cast("int"))
    return candidates.join(picked, [group, "id"], "left")


def weighted_overlay(cells: DataFrame, features: dict[str, dict]) -> DataFrame:
    """cells with norm_<feature>, score and score_pct; a missing component adds nothing to the score.

    features: name -> {"column", "weight", "method", "params"}; weights are shared out, a zero weight costs nothing, and a
    column that cells lack is an error.
    """
    used = {k: v for k, v in features.items() if v["weight"]}
    missing = [v["column"] for v in used.values() if v["column"] not in cells.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}; there are: {', '.join(cells.columns)}")
    if "burial_risk" in {v["column"] for v in used.values()}:
        raise ValueError("burial_risk is a companion of the score, not a part of it")
    total = float(sum(v["weight"] for v in used.values()))
    out = cells
    for name, v in used.items():
        out = out.withColumn(f"norm_{name}", curves.normalise(v["method"], F.col(v["column"]), **v["params"]))
    score = sum((F.lit(v["weight"] / total) * F.coalesce(F.col(f"norm_{name}"), F.lit(0.0)) for name, v in used.items()), F.lit(0.0))
    # Scores are ranked as the single precision numbers that are stored: what is equal there is a tie.
    ranked = percentile_rank(out.withColumn("score", F.round(score, 9)).withColumn("__single", F.col("score").cast("float")), "__single", "score_pct")
    return ranked.drop("__single")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order; Spark keeps n a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def where_equal(df: DataFrame, **asked: object) -> DataFrame:
    """Rows whose columns have the asked values; what is asked as None is not asked."""
    for column, value in asked.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with its places from 1 in the given order, which must tell rows apart.

    Rows go to ranges of the order, are numbered within them, and add the rows of the ranges before: one row a range.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order)
    return ranged.withColumn("__rn", F.row_number().over(within)).join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__rn")).drop("__part", "__rn", "__before")
