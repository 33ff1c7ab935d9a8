"""Planar geometry in metres over plain DOUBLE columns: boxes, points and segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def boxes_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Box against box by xmin, xmax, ymin, ymax: four ranges that reach a Parquet scan."""
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def in_box(x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return (x >= xmin) & (x <= xmax) & (y >= ymin) & (y <= ymax)


def edge_crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray from the point to the right crosses the edge; an odd number over a ring is inside."""
    spans = (y1 > y) != (y2 > y)
    return spans & (x < (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1) + x1)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    squared = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - x1) * dx + (y - y1) * dy) / F.when(squared > 0, squared), F.lit(0.0))))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_cross(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Two segments (x1, y1, x2, y2) that touch or cross, not counting collinear ones."""
    d1 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"])
    d2 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    d3 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"])
    d4 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    return (d1 * d2 <= 0) & (d3 * d4 <= 0) & ~((d1 == 0) & (d2 == 0))


def tile(v: Column, width: float) -> Column:
    return F.floor(v / F.lit(float(width))).cast("long")


def segment_meets_box(x1: Column, y1: Column, x2: Column, y2: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether any point of a segment lies in a box: the parts of it within both pairs of sides have a point in common."""

    def inside(a: Column, b: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        level = F.when(a.between(lo, hi), 0.0).otherwise(2.0), F.when(a.between(lo, hi), 1.0).otherwise(-1.0)
        s, t = (lo - a) / F.when(a != b, b - a), (hi - a) / F.when(a != b, b - a)
        return F.when(a == b, level[0]).otherwise(F.least(s, t)), F.when(a == b, level[1]).otherwise(F.greatest(s, t))

    (xa, xb), (ya, yb) = inside(x1, x2, xmin, xmax), inside(y1, y2, ymin, ymax)
    return F.greatest(F.lit(0.0), xa, ya) <= F.least(F.lit(1.0), xb, yb)


def segment_box_distance(seg: tuple[Column, Column, Column, Column], xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Distance between a segment (x1, y1, x2, y2) and a box, 0 where they meet: else an end of the segment or a corner is nearest."""
    corners = [segment_distance(x, y, *seg) for x in (xmin, xmax) for y in (ymin, ymax)]
    gap = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    ends = [F.sqrt(gap(x, xmin, xmax) ** 2 + gap(y, ymin, ymax) ** 2) for x, y in (seg[:2], seg[2:])]
    return F.when(segment_meets_box(*seg, xmin, ymin, xmax, ymax), F.lit(0.0)).otherwise(F.least(*corners, *ends))


def grown(box: dict[str, Column], by: float) -> dict[str, Column]:
    return {"xmin": box["xmin"] - by, "ymin": box["ymin"] - by, "xmax": box["xmax"] + by, "ymax": box["ymax"] + by}


def moved(box: dict[str, Column], dx: Column, dy: Column) -> dict[str, Column]:
    return {"xmin": box["xmin"] + dx, "ymin": box["ymin"] + dy, "xmax": box["xmax"] + dx, "ymax": box["ymax"] + dy}


def turned(box: dict[str, Column], quarters: Column) -> dict[str, Column]:
    """A box turned by right angles about its centre."""
    odd = F.abs(quarters) % 2 == 1
    cx, cy, w, h = (box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2, box["xmax"] - box["xmin"], box["ymax"] - box["ymin"]
    half_w, half_h = F.when(odd, h).otherwise(w) / 2, F.when(odd, w).otherwise(h) / 2
    return {"xmin": cx - half_w, "ymin": cy - half_h, "xmax": cx + half_w, "ymax": cy + half_h}
