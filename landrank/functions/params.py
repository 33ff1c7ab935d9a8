"""Parameters by name: defaults with overrides, and per-class sets that must be complete."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres beyond an area by which each grid is computed before it is cut back.
GRID_BUFFER_M = {"model": 2000.0, "detection": 50.0}
#: Largest area of a detection grid, and its cell.
MOST_KM2, DETECTION_CELL_M = 25.0, 0.5


def resolve(defaults: Mapping[str, Any], overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """defaults with overrides by name; a name that has no default is an error that lists those there are."""
    given = dict(overrides or {})
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown parameter {', '.join(unknown)}; known: {', '.join(sorted(defaults))}")
    return dict(defaults) | given


def resolve_class(name: str, needed: tuple[str, ...], params: Mapping[str, Any]) -> dict[str, Any]:
    """The parameters of a class, all of those needed; what a class lacks has no default."""
    if lacking := [p for p in needed if params.get(p) is None]:
        raise ValueError(f"{name} has no {', '.join(lacking)}")
    return {p: params[p] for p in needed}


def buffer_m(grid: str, search_radius_m: float = 0.0) -> float:
    """How far a grid reaches beyond its area; detection looks at least twice its search radius out."""
    if grid not in GRID_BUFFER_M:
        raise ValueError(f"unknown grid {grid!r}; known: {', '.join(GRID_BUFFER_M)}")
    return max(GRID_BUFFER_M[grid], 2 * search_radius_m) if grid == "detection" else GRID_BUFFER_M[grid]


def check_area(area_km2: float) -> None:
    """An error, with the number of cells, for an area too large for one detection grid."""
    if area_km2 > MOST_KM2:
        raise ValueError(f"{area_km2:.1f} km2 are {area_km2 * 1e6 / DETECTION_CELL_M**2:,.0f} cells; at most {MOST_KM2:g} km2")


def check_class(class_id: str, grid: str, visible: Mapping[str, str]) -> None:
    """An error where a class is asked about on a grid that can't show it. visible: class -> grid, or 'none'."""
    if visible.get(class_id) != grid:
        raise ValueError(f"{class_id} can't be seen on the {grid} grid; known: {', '.join(f'{k}: {v}' for k, v in sorted(visible.items()))}")


def layer_pixels(layers: Column, requested: Column, budget: float) -> Column:
    """Pixels a side for each of a number of layers within a budget of bytes: some 1.3 MB for 1500 pixels, at least 400."""
    allowed = (F.sqrt(F.lit(float(budget)) / layers / F.lit(1.3e6)) * 1500.0).cast("int")
    return F.when(layers <= 0, requested).otherwise(F.greatest(F.lit(400), F.least(requested, allowed)))


def canonical(names: list[str]) -> Column:
    """Columns as JSON without blanks, keys in order."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]))


def variant(names: list[str]) -> Column:
    """Short digest of a set of parameters."""
    return F.substring(F.sha2(canonical(names), 256), 1, 10)


def gates(cells: str = "cells", **limits: float | None) -> Column:
    """Whether a cluster has the shape a class asks for; a gate that is not set lets all pass.

    min_cells, max_cells, min_elongation, max_elongation, min_enclosed, min_span, max_span, min_fill.
    """
    columns = {"cells": cells, "elongation": "elongation", "enclosed": "enclosed", "span": "span", "fill": "fill"}
    out = F.lit(True)
    for name, limit in limits.items():
        side, _, what = name.partition("_")
        if side not in ("min", "max") or what not in columns:
            raise ValueError(f"unknown gate {name}")
        if limit is not None:
            out = out & (F.col(columns[what]) >= limit if side == "min" else F.col(columns[what]) <= limit)
    return out
