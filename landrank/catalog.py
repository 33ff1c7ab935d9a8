"""Registry of the engine's own queries and of the SQL that checks them."""

from __future__ import annotations

from .plans import ORACLE_SQL, QUERIES, catalogs, extras, landforms, nulls, relational, scoring, shapes, terrain, vectors

__all__ = ["ORACLE_SQL", "QUERIES", "catalogs", "extras", "landforms", "nulls", "relational", "scoring", "shapes", "terrain", "vectors"]
