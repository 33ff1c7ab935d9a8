"""Tables laid out along a curve over tiles, so that a box reads few row groups.

`write` gives each row the Z-order number of the tile that holds its lower left corner, sorts by it and keeps the row's own box beside
it; Parquet's least and greatest values of a row group then tell which part of the map it holds. `read` turns a box into ranges
of tile numbers and into comparisons of the box columns, all of which reach the scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a tile's row or column; a table covers at most 2 ** BITS tiles a side.
BITS = 24
#: Ranges of tile numbers that a box becomes at most; nearest ones are joined beyond that, which reads more and loses nothing.
RANGES = 48
#: Fixed masks that spread 24 bits apart, step by step: shift and what stays.
SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
_BOX = ("box_xmin", "box_ymin", "box_xmax", "box_ymax")


def z_order(col: Column, row: Column) -> Column:
    """Bits of row and col taken in turns: a number that is near for tiles that are near."""

    def apart(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return apart(col).bitwiseOR(F.shiftleft(apart(row), 1))


def z_number(col: int, row: int) -> int:
    return sum((col >> b & 1) << 2 * b | (row >> b & 1) << 2 * b + 1 for b in range(BITS))


def z_ranges(c0: int, r0: int, c9: int, r9: int, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of numbers, both ends included, that hold all tiles of columns c0..c9 and rows r0..r9 and few others.

    Squares of the curve that lie inside are one range each; those on the border are cut in four while there are few.
    """
    found: list[tuple[int, int]] = []
    border = [(0, 0, BITS)]
    while border:
        ahead = []
        for c, r, bits in border:
            side = 1 << bits
            if c > c9 or r > r9 or c + side - 1 < c0 or r + side - 1 < r0:
                continue
            if (c >= c0 and r >= r0 and c + side - 1 <= c9 and r + side - 1 <= r9) or bits == 0:
                first = z_number(c, r)
                found.append((first, first + (1 << 2 * bits) - 1))
            else:
                half = side >> 1
                ahead += [(c + i * half, r + j * half, bits - 1) for j in (0, 1) for i in (0, 1)]
        if len(found) + len(ahead) > 4 * most:
            found += [(z_number(c, r), z_number(c, r) + (1 << 2 * bits) - 1) for c, r, bits in ahead if not (c > c9 or r > r9 or c + (1 << bits) - 1 < c0 or r + (1 << bits) - 1 < r0)]
            ahead = []
        border = ahead
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    while len(joined) > most:
        k = min(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1])
        joined[k - 1 : k + 1] = [(joined[k - 1][0], joined[k][1])]
    return joined


def write(rows: DataFrame, path: str, box: tuple[Column, Column, Column, Column], tile: float, files: int | None = None, group_rows: int = 1 << 20) -> None:
    """Write rows with the tile number `tile_z` and their box (xmin, ymin, xmax, ymax), sorted by tile. What reading needs to know, the corner
    from which tiles count, their width and the largest extent of a row, is kept as a comment of the tile column."""
    boxed = rows.select("*", *[c.cast("double").alias(n) for c, n in zip(box, _BOX, strict=True)])
    about = boxed.agg(F.min("box_xmin").alias("left"), F.min("box_ymin").alias("bottom"), F.max("box_xmin").alias("x9"), F.max("box_ymin").alias("y9"), F.max(F.col("box_xmax") - F.col("box_xmin")).alias("wide"), F.max(F.col("box_ymax") - F.col("box_ymin")).alias("high")).first()
    left, bottom = about["left"] or 0.0, about["bottom"] or 0.0
    if about["left"] is not None and max(about["x9"] - left, about["y9"] - bottom) / tile >= 1 << BITS:
        raise ValueError(f"tiles of {tile} are too small: more than 2 ** {BITS} a side")
    at = lambda c, low: F.floor((F.col(c) - low) / float(tile))
    kept = {"left": left, "bottom": bottom, "tile": float(tile), "wide": about["wide"] or 0.0, "high": about["high"] or 0.0}
    numbered = boxed.withColumn("tile_z", z_order(at("box_xmin", left), at("box_ymin", bottom)).alias("tile_z", metadata={"layout": json.dumps(kept)}))
    dealt = numbered.repartitionByRange(files, "tile_z") if files else numbered.repartitionByRange("tile_z")
    dealt.sortWithinPartitions("tile_z").write.option("compression", "zstd").option("parquet.block.row.count.limit", group_rows).parquet(path)


def ranges_of(layout: dict, xmin: float, ymin: float, xmax: float, ymax: float) -> list[tuple[int, int]]:
    """Ranges of tile numbers in which rows that meet a box may be: a row may begin its own extent before the box."""
    place = lambda v, low: min(max(int((v - low) // layout["tile"]), 0), (1 << BITS) - 1)
    if xmax < layout["left"] or ymax < layout["bottom"]:
        return []
    return z_ranges(place(xmin - layout["wide"], layout["left"]), place(ymin - layout["high"], layout["bottom"]), place(xmax, layout["left"]), place(ymax, layout["bottom"]))


def read(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The rows whose box meets the given one, borders included, without the columns of the layout."""
    table = spark.read.parquet(path)
    layout = json.loads(table.schema["tile_z"].metadata["layout"])
    z = F.col("tile_z")
    some = F.lit(False)
    for a, b in ranges_of(layout, xmin, ymin, xmax, ymax):
        some = some | ((z >= a) & (z <= b))
    meets = (F.col("box_xmin") <= xmax) & (F.col("box_xmax") >= xmin) & (F.col("box_ymin") <= ymax) & (F.col("box_ymax") >= ymin)
    return table.filter(meets & some).drop("tile_z", *_BOX)
