"""Response curves that turn a measurement into a suitability in [0, 1], and smaller scalar formulas.

A missing value stays missing through every curve: least and greatest skip nulls, so each clip is guarded.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c.cast("double")), c)


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def slug(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), " -", "__")


def categorical(c: Column, scores: Mapping[str, float]) -> Column:
    """The score of a phrase by its slug; 0 where it is present but not listed."""
    name = slug(c)
    hit = reduce(lambda out, kv: out.when(name == kv[0], F.lit(float(kv[1]))), list(scores.items())[1:], F.when(name == next(iter(scores)), F.lit(float(next(iter(scores.values()))))))
    return F.when(c.isNotNull(), hit.otherwise(0.0))


def inverse_linear(c: Column, optimum: float, falloff: float) -> Column:
    if falloff <= optimum:
        raise ValueError("falloff must be above optimum")
    return clip01((F.lit(float(falloff)) - present(c)) / F.lit(float(falloff - optimum)))


def threshold_decay(c: Column, full_below: float, zero_above: float) -> Column:
    if zero_above <= full_below:
        raise ValueError("zero_above must be above full_below")
    return clip01((F.lit(float(zero_above)) - present(c)) / F.lit(float(zero_above - full_below)))


def band(c: Column, low: float, high: float, falloff: float) -> Column:
    """1 in [low, high], falling to 0 over `falloff` on either side."""
    if high < low or falloff <= 0:
        raise ValueError("band needs low <= high and a positive falloff")
    x = present(c)
    outside = F.greatest(F.lit(float(low)) - x, x - F.lit(float(high)), F.lit(0.0))
    return F.when(x.isNotNull(), clip01(F.lit(1.0) - outside / F.lit(float(falloff))))


def taper(distance: Column, reach: float) -> Column:
    """1 up to `reach`, 0 from twice of it on."""
    return clip01((F.lit(2.0 * reach) - present(distance)) / F.lit(float(reach)))


#: Name of a method in a weight set -> builder.
METHODS: dict[str, Callable[..., Column]] = {"categorical": categorical, "inverse_linear": inverse_linear, "threshold_decay": threshold_decay, "band": band}


def normalise(method: str, c: Column, **params) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(sorted(METHODS))}")
    return METHODS[method](c, **params)


def cells_from_metres(metres: Column, resolution: float, least: int = 1) -> Column:
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    return F.greatest(F.lit(least).cast("long"), F.bround(metres / F.lit(float(resolution))).cast("long"))


def effort_hours(area_m2: Column, direct: Column) -> Column:
    """Hours of a visit: a direct check, or one probe for each 225 square metres, with half an hour to set up."""
    probes = F.greatest(F.lit(1.0), F.bround(area_m2 / F.lit(225.0)))
    return F.when(direct, F.lit(0.75)).otherwise(probes * F.lit(20.0) / F.lit(60.0)) + F.lit(0.5)


def expected_value(pct: Column, burial: Column) -> Column:
    """Rank above 95, at least 0.1, less what burial hides from a surface visit."""
    return F.greatest(pct - F.lit(95.0), F.lit(0.1)) * (F.lit(1.0) - F.coalesce(burial, F.lit(0.0)) * F.lit(0.75))


def burial_risk(parent_material: Column, flood_freq: Column, flood_scores: Mapping[str, float]) -> Column:
    alluvial = F.when(F.lower(parent_material).contains("alluvi"), 1.0).otherwise(0.0)
    return alluvial * F.coalesce(categorical(flood_freq, flood_scores), F.lit(0.0))


def map_error_m(scale: Column, margin: float) -> Column:
    """Position error of a map at 1 / scale by the 1/50 inch standard, with a margin, to a decimetre."""
    return F.round(scale.cast("double") * F.lit(0.0254 / 50) + F.lit(float(margin)), 1)


def newest_year(c: Column) -> Column:
    """The largest year from 1991 to 2099 among the digits of a name, else 0."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(F.filter(years, lambda y: (y >= 1991) & (y <= 2099))), F.lit(0))


def cache_key(parts: Mapping[str, Column]) -> Column:
    """Digest of named values, in order of their names."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(k + "="), F.coalesce(parts[k].cast("string"), F.lit("null"))) for k in sorted(parts)]), 256)
