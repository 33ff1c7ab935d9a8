"""Transverse Mercator by the Krueger series, as column arithmetic."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ellipsoids of the two families of zone codes: fixed values (GRS80 for 269xx, WGS84 for 326xx; semi-axis and flattening).
ELLIPSOIDS = {"269": (6378137.0, 1 / 298.257222101), "326": (6378137.0, 1 / 298.257223563)}
SCALE, FALSE_EASTING = 0.9996, 500000.0


def zone_of(crs: str) -> tuple[str, int]:
    """Family and zone of a northern UTM code such as EPSG:26916."""
    m = re.fullmatch(r"EPSG:(269|326)(\d\d)", crs)
    if not m or not 1 <= int(m[2]) <= 60:
        raise ValueError(f"can't project to {crs!r}; known: EPSG:269zz and EPSG:326zz, northern UTM zones")
    return m[1], int(m[2])


def coefficients(flattening: float) -> tuple[float, float, tuple[float, float, float]]:
    """(third flattening, rectifying radius per semi-axis, series terms)."""
    n = flattening / (2 - flattening)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    return n, radius, (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)


def utm(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees, to about a millimetre within a zone."""
    family, zone = zone_of(crs)
    axis, flattening = ELLIPSOIDS[family]
    n, radius, terms = coefficients(flattening)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(float(6 * zone - 183)))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    x, y = eta, xi
    for j, a in enumerate(terms, 1):
        x = x + F.lit(a) * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        y = y + F.lit(a) * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    scale = F.lit(SCALE * axis * radius)
    return FALSE_EASTING + scale * x, scale * y
