"""Exact Euclidean distance on a grid to the nearest marked cell, and that cell's value.

The squared distance is separable: first along columns, then along rows, where the distances of the columns are parabolas and their
lower envelope is wanted. A column goes whole to one task and so does a row, many of them at a time, so there are two shuffles
however far the nearest cell is; a task grows with a side of the grid, not with its area. Marked cells alone travel in the first
shuffle, and for each column and band of rows only those that can matter in the second: the ones inside, the last above, the first below.

Equal distances go to the smaller row, then the smaller column. Envelopes are found in whole numbers, so ties are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a task holds at a time; a single row or column may be longer.
TASK_CELLS = 1 << 22
_FAR = 1 << 40


def _envelope(drow: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each row of a band and each column, the column whose marked cell is nearest; -1 where there is none.

    drow: squared distance along the column to its nearest marked cell, _FAR or more if it has none; row: that cell's row.
    All rows of the band walk over the columns together, each with its own stack of parabolas.
    """
    h, w = drow.shape
    stack, start = np.full((h, w), -1), np.zeros((h, w), np.int64)
    top = np.full(h, -1)
    lines = np.arange(h)
    for q in range(w):
        open_ = lines[drow[:, q] < _FAR]
        height = drow[open_, q] + q * q
        begin = np.zeros(len(open_), np.int64)
        going = np.arange(len(open_))
        while len(going):
            at = open_[going]
            going, at = going[top[at] >= 0], at[top[at] >= 0]
            p = stack[at, top[at]]
            over, under = height[going] - drow[at, p] - p * p, 2 * (q - p)
            # The first column where q is nearer, or as near and of a smaller row.
            first = np.where(row[at, q] < row[at, p], -(-over // under), over // under + 1)
            begin[going] = np.maximum(first, 0)
            worse = first <= start[at, top[at]]
            top[at[worse]] -= 1
            begin[going[worse]] = 0
            going = going[worse]
        fits = begin < w
        at = open_[fits]
        top[at] += 1
        stack[at, top[at]], start[at, top[at]] = q, begin[fits]
    out = np.full((h, w), -1)
    place = np.zeros(h, np.int64)
    for c in range(w):
        while True:
            on = (place < top) & (start[lines, np.minimum(place + 1, w - 1)] <= c)
            if not on.any():
                break
            place[on] += 1
        out[:, c] = np.where(top >= 0, stack[lines, place], -1)
    return out


def distance_to_marked(marked: DataFrame, rows: int, cols: int, resolution: float, value: str | None = None) -> DataFrame:
    """(row_i, col_i, dist[, value]) of every cell of the grid; null where no cell is marked.

    marked: (row_i, col_i[, value double]), one row a cell; cells off the grid are left out.
    """
    wide, high = max(1, TASK_CELLS // rows), max(1, TASK_CELLS // cols)
    on = marked.filter(F.col("row_i").between(0, rows - 1) & F.col("col_i").between(0, cols - 1))
    on = on.select(F.col("row_i").cast("int").alias("row_i"), F.col("col_i").cast("int").alias("col_i"), (F.col(value).cast("double") if value else F.lit(0.0)).alias("x"))
    bands = -(-rows // high)

    def columns(key, table):
        row, col, x = (table.column(n).to_numpy(zero_copy_only=False) for n in ("row_i", "col_i", "x"))
        order = np.lexsort((row, col))
        row, col, x = row[order], col[order], x[order]
        same = np.append(col[1:] == col[:-1], False)
        band = row // high
        # A cell matters to its own band, to those after it up to the next cell's, and to those before it from the last cell's on.
        until = np.where(same, np.append(band[1:], 0), bands - 1)
        since = np.where(np.insert(same[:-1], 0, False), np.insert(band[:-1], 0, 0), 0)
        times = until - since + 1
        at = np.repeat(np.arange(len(row)), times)
        to = since[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        return pa.table([pa.array(to.astype(np.int32)), pa.array(row[at]), pa.array(col[at]), pa.array(x[at])], ["band", "row_i", "col_i", "x"])

    near = on.groupBy(F.expr(f"col_i div {wide}")).applyInArrow(columns, "band int, row_i int, col_i int, x double")
    all_bands = on.sparkSession.range(bands).select(F.col("id").cast("int").alias("band"))

    def rows_of(key, left, right):
        band = key[0].as_py()
        r0, r9 = band * high, min(rows, band * high + high)
        row, col, x = (right.column(n).to_numpy(zero_copy_only=False) for n in ("row_i", "col_i", "x"))
        order = np.lexsort((row, col))
        row, col, x = row[order].astype(np.int64), col[order], x[order]
        lines = np.arange(r0, r9)
        nearest = np.full((r9 - r0, cols), -1)
        for i, j in zip(np.searchsorted(col, np.arange(cols)).tolist(), np.searchsorted(col, np.arange(cols), side="right").tolist(), strict=True):
            if i < j:
                after = np.searchsorted(row[i:j], lines)
                above, below = i + np.maximum(after - 1, 0), i + np.minimum(after, j - i - 1)
                nearest[:, col[i]] = np.where(np.abs(row[above] - lines) <= np.abs(row[below] - lines), above, below)
        none = nearest < 0
        at = np.where(none, 0, nearest)
        drow = np.where(none, _FAR, (row[at] - lines[:, None]) ** 2) if len(row) else np.full(nearest.shape, _FAR)
        found = _envelope(drow, row[at] if len(row) else nearest)
        r, c = np.divmod(np.arange(found.size), cols)
        v = found.ravel()
        bad = v < 0
        v = np.where(bad, 0, v)
        dist = np.sqrt(drow[r, v] + (c - v) ** 2.0) * resolution
        picked = x[np.where(bad, 0, nearest[r, v])] if len(row) else np.zeros(len(v))
        return pa.table([pa.array((r + r0).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(dist, mask=bad), pa.array(picked, mask=bad)], ["row_i", "col_i", "dist", "x"])

    out = all_bands.groupBy("band").cogroup(near.groupBy("band")).applyInArrow(rows_of, "row_i int, col_i int, dist double, x double")
    return out.withColumnRenamed("x", value) if value else out.drop("x")
