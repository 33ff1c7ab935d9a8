"""Catalog tables: merges by key, replaced partitions, and footprints of what is registered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, key: Sequence[str]) -> None:
    """An error that names a key which df has more than once (one small job)."""
    twice = df.groupBy(*key).count().filter("count > 1").select(*key).head()
    if twice is not None:
        raise ValueError(f"repeated key: {twice.asDict()}")


def merge(old: DataFrame, new: DataFrame, key: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """old with new merged by key, whose values are unique in new: rows of known keys take the `update` columns (None: all)
    from new and keep the others, rows of unknown keys come in whole. One join on the key."""
    known = old.select(*key, F.struct("*").alias("__old"))
    both = known.join(new.select(*key, F.struct("*").alias("__new")), list(key), "full")
    out = []
    for c in old.columns:
        mine, theirs = F.col(f"__old.`{c}`"), F.col(f"__new.`{c}`") if c in new.columns else F.lit(None)
        if c in key:
            out.append(F.col(f"`{c}`"))
        elif c in new.columns and (update is None or c in update):
            out.append(F.when(F.col("__new").isNotNull(), theirs).otherwise(mine).alias(c))
        else:
            out.append(F.when(F.col("__old").isNotNull(), mine).otherwise(theirs).alias(c))
    return both.select(*out)


def replace_partitions(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old without the partitions that new has rows of, and new."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def write_partitions(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """The same in place: only partitions that df has rows of are written over."""
    df.write.partitionBy(*key).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def footprint(cells: DataFrame, by: Sequence[str], resolution: float) -> DataFrame:
    """(by, cells, xmin, ymin, xmax, ymax) of cell centres (easting, northing): their extent and half a cell around it."""
    half = resolution / 2
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), (F.min("easting") - half).alias("xmin"), (F.min("northing") - half).alias("ymin"), (F.max("easting") + half).alias("xmax"), (F.max("northing") + half).alias("ymax")
    )


def one_variant(assets: DataFrame, kind: str, variant: str | None = None) -> DataFrame:
    """Assets of a kind in the asked variant; without one there may be only one variant, else the error names them all."""
    rows = assets.filter(F.col("kind") == kind)
    if variant is not None:
        return rows.filter(F.col("variant") == variant)
    names = sorted(r[0] or "" for r in rows.select("variant").distinct().limit(50).collect())
    if len(names) > 1:
        raise ValueError(f"{kind} has the variants {', '.join(repr(n) for n in names)}; name one")
    return rows


def exactly_one(features: DataFrame) -> DataFrame:
    """features, which must be one row: an area is seeded from one feature."""
    n = features.limit(2).count()
    if n != 1:
        raise ValueError(f"an area needs exactly one feature, there {'are several' if n else 'is none'}")
    return features
