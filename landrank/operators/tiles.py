"""Stencils over raster tiles: a tile and a halo of its neighbours' cells meet in one task, once.

A cell goes to its own tile and to those within `halo` cells of it, so a stencil of any number of offsets is one shuffle of
little more than the cells. Borders of the raster are padded inside the tile, missing cells are NaN.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 512


def stencil(cells: DataFrame, value: str, rows: int, cols: int, halo: int, work: Callable[[np.ndarray], np.ndarray], out: str, kind: str = "double", pad: str = "reflect", tile: int = TILE) -> DataFrame:
    """(row_i, col_i, out) of every cell that is there. work gets a tile with its halo and gives the values of the tile.

    pad: how numpy.pad continues the raster beyond its borders, or 'nan'. A result of NaN is null.
    """
    if halo >= tile:
        raise ValueError("the halo must be narrower than a tile")
    span = lambda c, n: F.explode(F.sequence(F.floor((F.greatest(F.col(c) - halo, F.lit(0))) / tile).cast("int"), F.floor(F.least(F.col(c) + halo, F.lit(n - 1)) / tile).cast("int")))
    dealt = cells.select(F.col("row_i").cast("int").alias("row_i"), F.col("col_i").cast("int").alias("col_i"), F.col(value).cast("double").alias("z"))
    dealt = dealt.withColumn("tr", span("row_i", rows)).withColumn("tc", span("col_i", cols))

    def solve(key, table):
        r, c = table.column("row_i").to_numpy(), table.column("col_i").to_numpy()
        r0, c0 = key[0].as_py() * tile, key[1].as_py() * tile
        r9, c9 = min(r0 + tile, rows), min(c0 + tile, cols)
        top, left, bottom, right = max(r0 - halo, 0), max(c0 - halo, 0), min(r9 + halo, rows), min(c9 + halo, cols)
        grid = np.full((bottom - top, right - left), np.nan)
        grid[r - top, c - left] = table.column("z").to_numpy(zero_copy_only=False)
        beyond = ((halo - (r0 - top), halo - (bottom - r9)), (halo - (c0 - left), halo - (right - c9)))
        grid = np.pad(grid, beyond, constant_values=np.nan) if pad == "nan" else np.pad(grid, beyond, mode=pad)
        got = work(grid)
        own = (r >= r0) & (r < r9) & (c >= c0) & (c < c9)
        found = got[r[own] - r0, c[own] - c0]
        bad = np.isnan(found)
        column = pa.array(np.where(bad, 0, found).astype(np.int32), mask=bad) if kind == "int" else pa.array(found, mask=bad)
        return pa.table([pa.array(r[own]), pa.array(c[own]), column], ["row_i", "col_i", out])

    return dealt.groupBy("tr", "tc").applyInArrow(solve, f"row_i int, col_i int, `{out}` {kind}")


def dealt(cells: DataFrame, columns: dict[str, str], rows: int, cols: int, halo: int, tile: int = TILE) -> DataFrame:
    """(tr, tc, row_i, col_i, names): cells dealt to their own tile and to those within `halo` cells. columns: names and what they hold."""
    span = lambda c, n: F.explode(F.sequence(F.floor((F.greatest(F.col(c) - halo, F.lit(0))) / tile).cast("int"), F.floor(F.least(F.col(c) + halo, F.lit(n - 1)) / tile).cast("int")))
    out = cells.select(F.col("row_i").cast("int").alias("row_i"), F.col("col_i").cast("int").alias("col_i"), *[F.col(c).cast("double").alias(n) for n, c in columns.items()])
    return out.withColumn("tr", span("row_i", rows)).withColumn("tc", span("col_i", cols))


def grids(key, table: pa.Table, names: list[str], rows: int, cols: int, halo: int, tile: int = TILE) -> tuple[int, int, dict[str, np.ndarray]]:
    """(first row, first column, grids of a tile with its halo) of what `dealt` gave it; NaN where there is nothing."""
    r0, c0 = key[0].as_py() * tile, key[1].as_py() * tile
    shape = min(tile, rows - r0) + 2 * halo, min(tile, cols - c0) + 2 * halo
    r, c = table.column("row_i").to_numpy() - r0 + halo, table.column("col_i").to_numpy() - c0 + halo
    out = {}
    for n in names:
        out[n] = np.full(shape, np.nan)
        out[n][r, c] = table.column(n).to_numpy(zero_copy_only=False)
    return r0, c0, out


def seen(grid: np.ndarray, halo: int, dr: int, dc: int) -> np.ndarray:
    """What the cells of a tile see at an offset."""
    h, w = grid.shape[0] - 2 * halo, grid.shape[1] - 2 * halo
    return grid[halo + dr : halo + dr + h, halo + dc : halo + dc + w]
