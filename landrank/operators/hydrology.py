"""Flow over a raster whose pits are breached, tile by tile, and sums and ends along flow.

Order of heights: a step between neighbouring cells a and b is as high as the higher of them; equal steps go by the smaller,
then the larger cell number, so no two are equal. Cells flow the steepest way down to the pit of their basin. A basin that
holds no way out spills over its lowest step; what the lowest steps join is one tree over basins with the outside as its root,
where the path to the root stays as low as any path can. Each pit is breached along its tree: the way from the step down to
the pit turns round, and no cell is left higher than what flows through it.

Tiles find their own part of the tree: a set of basins that no other tile touches takes its lowest step at once. What is left
is a graph of sets that meet tile borders, contracted the same way in groups of tiles, then in groups of groups; ways out are
found from the largest group back to the tiles. Neither the tree nor the result depends on the tiles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .raster import WAYS
from .tiles import TILE, dealt, grids, seen

#: Root of the tree: beyond the raster's border and in missing cells.
OUTSIDE = -1
#: Members along a side of a group.
FAN = 8
_STEP = np.array(WAYS)
_PIT = len(WAYS)


# --- trees of lowest steps -------------------------------------------------------------------------------------------

Step = tuple[int, int, float, int, int]


def lowest_tree(nodes: list[int], steps: Iterable[Step], open_nodes: Iterable[int]) -> tuple[dict[int, int], dict[int, list[tuple[int, int, int]]], list[Step]]:
    """(set of each node, steps (to, a, b) of the tree at each node, steps between sets that stay apart).

    steps: (u, v, height, a, b), the lowest first. A step is of the tree if the sets on its sides differ and one of them has no
    open node: all steps out of that set are known here, and this is the lowest. A set is named by its smallest node.
    """
    parent = {OUTSIDE: OUTSIDE} | {n: n for n in nodes}
    open_ = dict.fromkeys(parent, False) | dict.fromkeys(open_nodes, True) | {OUTSIDE: True}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    apart = []
    for u, v, height, a, b in steps:
        x, y = find(u), find(v)
        if x == y:
            continue
        if open_[x] and open_[y]:
            apart.append((u, v, height, a, b))
            continue
        x, y = min(x, y), max(x, y)
        parent[y] = x
        open_[x] = open_[x] or open_[y]
        tree[u].append((v, a, b))
        tree[v].append((u, b, a))
    return {n: find(n) for n in parent}, tree, apart


def leaving(tree: dict[int, list[tuple[int, int, int]]], exits: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The step (a, b) by which each node leaves: those given, and from there and from OUTSIDE back along the tree."""
    leave = dict(exits)
    start = [OUTSIDE, *exits]
    while start:
        for to, a, b in tree.get(start.pop(), ()):
            if to != OUTSIDE and to not in leave:
                leave[to] = (b, a)
                start.append(to)
    return leave


# --- one tile --------------------------------------------------------------------------------------------------------


class TileFlow:
    """Steepest ways of a tile's cells, the last cell of each way inside, and the lowest steps between what ends there."""

    def __init__(self, z: np.ndarray, r0: int, c0: int, cols: int):
        """z: the tile with a halo of one cell, NaN where there is none."""
        here = seen(z, 1, 0, 0)
        h, w = here.shape
        self.r0, self.c0, self.cols, self.shape = r0, c0, cols, (h, w)
        near = np.stack([seen(z, 1, dr, dc) for dr, dc in WAYS])
        drops = np.rint((here - near) / np.hypot(*_STEP.T)[:, None, None] * 1e6)
        drops = np.where(np.isnan(drops), -np.inf, drops)
        self.z, self.there = here.ravel(), ~np.isnan(here).ravel()
        self.way = np.where(drops.max(0) > 0, drops.argmax(0), _PIT).ravel()
        row, col = np.divmod(np.arange(h * w), w)
        self.key = (row + r0) * cols + col + c0
        step = np.vstack([_STEP, [0, 0]])[self.way]
        to_r, to_c = row + step[:, 0], col + step[:, 1]
        inside = (to_r >= 0) & (to_r < h) & (to_c >= 0) & (to_c < w)
        self.down = np.where(inside & (self.way < _PIT), to_r * w + to_c, np.arange(h * w))
        self.last = self.down
        while (self.last[self.last] != self.last).any():
            self.last = self.last[self.last]
        self.leaves = ~inside
        self.to = (to_r + r0) * cols + to_c + c0
        self.border = np.isnan(near).any(0).ravel() & self.there
        self.edge = np.zeros((h, w), bool)
        self.edge[[0, -1]] = self.edge[:, [0, -1]] = True
        self.edge = self.edge.ravel() & self.there
        self._z = z

    def steps(self) -> tuple[np.ndarray, ...]:
        """(u, v, height, a, b): the lowest step between any two ends u and v inside the tile, and from an end to the outside."""
        h, w = self.shape
        n = np.arange(h * w).reshape(h, w)
        pairs = [(n[:, :-1], n[:, 1:]), (n[:-1], n[1:]), (n[:-1, :-1], n[1:, 1:]), (n[:-1, 1:], n[1:, :-1])]
        a, b = (np.concatenate([p[k].ravel() for p in pairs]) for k in (0, 1))
        keep = self.there[a] & self.there[b] & (self.last[a] != self.last[b])
        a, b = a[keep], b[keep]
        swap = self.last[a] > self.last[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.flatnonzero(self.border)
        u, v = np.concatenate([self.last[a], self.last[out]]), np.concatenate([self.last[b], np.full(len(out), OUTSIDE)])
        height = np.concatenate([np.maximum(self.z[a], self.z[b]), self.z[out]])
        a, b = np.concatenate([self.key[a], self.key[out]]), np.concatenate([self.key[b], np.full(len(out), OUTSIDE)])
        order = np.lexsort((np.maximum(a, b), np.minimum(a, b), height, v, u))
        u, v, height, a, b = (x[order] for x in (u, v, height, a, b))
        first = np.ones(len(u), bool)
        first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, height, a, b = (x[first] for x in (u, v, height, a, b))
        order = np.lexsort((np.maximum(a, b), np.minimum(a, b), height))
        return tuple(x[order] for x in (u, v, height, a, b))

    def joined(self) -> tuple[dict[int, int], dict[int, list[tuple[int, int, int]]], list[Step]]:
        """lowest_tree over the ends of this tile; those that a cell of another tile touches are open."""
        return lowest_tree(np.unique(self.last[self.there]).tolist(), zip(*(x.tolist() for x in self.steps()), strict=True), np.unique(self.last[self.shared()]).tolist())

    def shared(self) -> np.ndarray:
        """Cells beside a cell of another tile."""
        at = np.flatnonzero(self.edge)
        h, w = self.shape
        row, col = np.divmod(at, w)
        out = np.zeros(h * w, bool)
        for dr, dc in WAYS:
            r, c = row + dr, col + dc
            beyond = ((r < 0) | (r >= h) | (c < 0) | (c >= w)) & ~np.isnan(self._z[r + 1, c + 1])
            out[at[beyond]] = True
        return out

    def across(self) -> list[tuple[int, float, int, int]]:
        """(end, height, a, b) of the steps to cells of other tiles, of which the other tile has its own; a way down is lower than any step."""
        at = np.flatnonzero(self.edge)
        h, w = self.shape
        row, col = np.divmod(at, w)
        found = []
        for k, (dr, dc) in enumerate(WAYS):
            r, c = row + dr, col + dc
            other = self._z[r + 1, c + 1]
            b = (r + self.r0) * self.cols + c + self.c0
            goes = self.way[at] == k
            keep = ((r < 0) | (r >= h) | (c < 0) | (c >= w)) & ~np.isnan(other)
            height = np.where(goes, -np.inf, np.maximum(self.z[at], other))
            found += list(zip(self.last[at[keep]].tolist(), height[keep].tolist(), self.key[at[keep]].tolist(), b[keep].tolist(), strict=True))
        return found

    def turned(self, exits: list[tuple[int, int]]) -> np.ndarray:
        """Ways after breaching, `_PIT` where a cell leaves the raster. exits: the step (a, b) of each set that meets other tiles."""
        _, tree, _ = self.joined()
        where = lambda a: (a // self.cols - self.r0) * self.shape[1] + a % self.cols - self.c0
        way = self.way.copy()
        leave = leaving(tree, {int(self.last[where(a)]): (a, b) for a, b in exits})
        for end, (a, b) in leave.items():
            i = where(a)
            if b != OUTSIDE and end == i and self.way[i] < _PIT and int(self.to[i]) == b:
                continue
            path = [i]
            while path[-1] != end:
                path.append(int(self.down[path[-1]]))
            for x, y in zip(path, path[1:], strict=False):
                way[y] = (self.way[x] + 4) % 8
            way[i] = _PIT if b == OUTSIDE else WAYS.index((b // self.cols - a // self.cols, b % self.cols - a % self.cols))
        return way


# --- the tree over tiles -----------------------------------------------------------------------------------------------

_ROWS = "u long, v long, height double, a long, b long"
_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())


def _table(rows: list[tuple], n: int = 5, names: tuple[str, ...] = ("u", "v", "height", "a", "b")) -> pa.Table:
    types = [t for c, t in zip(("u", "v", "height", "a", "b"), _TYPES, strict=True) if c in names]
    return pa.table([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * n, types, strict=True)], list(names))


def _joined_group(table: pa.Table) -> tuple:
    """lowest_tree over the sets of a group of tiles, where each cell's set is, and the steps that leave the group.

    Rows: steps between sets (v known) and, from both sides, steps across borders (v null): what has no other side here is open.
    """
    rows = list(zip(*(table.column(c).to_pylist() for c in ("u", "v", "height", "a", "b")), strict=True))
    at = {a: u for u, _, _, a, _ in rows} | {b: v for _, v, _, _, b in rows if v is not None}
    steps, beyond = [], []
    for u, v, height, a, b in rows:
        other = v if v is not None else at.get(b)
        if other is None:
            beyond.append((u, None, height, a, b))
        elif other != u:
            steps.append((u, other, height, a, b))
    steps.sort(key=lambda s: (s[2], min(s[3:]), max(s[3:])))
    return *lowest_tree(sorted(set(at.values()) - {OUTSIDE}), steps, [u for u, *_ in beyond]), at, beyond


def _contracted(key, table):
    sets, _, apart, _, beyond = _joined_group(table)
    return _table([(sets[u], sets[v], h, a, b) for u, v, h, a, b in apart] + [(sets[u], None, h, a, b) for u, _, h, a, b in beyond])


def _expanded(key, left, right):
    """Exits (u, a, b) of a group's sets, from those (in right) of what the group was contracted to."""
    _, tree, _, at, _ = _joined_group(left)
    leave = leaving(tree, {at[a]: (a, b) for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True)})
    return _table([(u, a, b) for u, (a, b) in leave.items()], 3, ("u", "a", "b"))


def _grouped(rows: DataFrame, cols: int, side: int) -> DataFrame:
    """Rows with the group of `side` x `side` cells that holds their cell a."""
    return rows.withColumn("tr", F.expr(f"(a div {cols}) div {side}")).withColumn("tc", F.expr(f"(a % {cols}) div {side}"))


def set_exits(edges: DataFrame, rows: int, cols: int, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """(u, a, b), the step by which each set leaves towards the outside.

    edges: rows as `_joined_group` takes them, of tiles. Groups of fan x fan tiles are contracted, then groups of groups, until one
    holds all; a group's task holds the sets along the borders of its members, so it grows with a side and not with an area. Then
    exits are found from the largest group down. Two shuffles a level, and levels are a logarithm of the tiles.
    """
    levels, side = [edges], tile
    while side < max(rows, cols):
        side *= fan
        levels.append(durable(_grouped(levels[-1], cols, side).groupBy("tr", "tc").applyInArrow(_contracted, _ROWS)))
    exits = levels[-1].select("u", "a", "b").filter("false")
    for level in reversed(levels[:-1]):
        exits = durable(_grouped(level, cols, side).groupBy("tr", "tc").cogroup(_grouped(exits, cols, side).groupBy("tr", "tc")).applyInArrow(_expanded, "u long, a long, b long"))
        side //= fan
    return exits


def _turned(cells: DataFrame, value: str, rows: int, cols: int, tile: int, sums: dict[str, str]) -> DataFrame:
    """A row a tile (`_packed`): the ways of its cells after breaching, z and `sums`, of which cells are 1 each.

    Cells are dealt to tiles once; from then on a tile is a row that holds its grids, and only what lies on borders travels.
    """

    def local(key, table):
        r0, c0, got = grids(key, table, ["z"], rows, cols, 1, tile)
        flow = TileFlow(got["z"], r0, c0, cols)
        sets, _, apart = flow.joined()
        name = {end: OUTSIDE if s == OUTSIDE else int(flow.key[s]) for end, s in sets.items()}
        steps = _table([(name[u], name[v], h, a, b) for u, v, h, a, b in apart] + [(name[e], None, h, a, b) for e, h, a, b in flow.across()])
        return pa.table([*_key(key), pa.array([got["z"].tobytes()], pa.binary()), _listed(dict(zip(steps.column_names, steps.columns, strict=True)))], ["tr", "tc", "z", "steps"])

    dealt_once = dealt(cells, {"z": value}, rows, cols, 1, tile)
    tiles = durable(dealt_once.groupBy("tr", "tc").applyInArrow(local, "tr int, tc int, z binary, steps array<struct<u:bigint,v:bigint,height:double,a:bigint,b:bigint>>"))
    exits = set_exits(tiles.select(F.explode("steps").alias("s")).select("s.*"), rows, cols, tile)
    exits = _grouped(exits, cols, tile).select(F.col("tr").cast("int"), F.col("tc").cast("int"), "a", "b")

    def turn(key, left, right):
        if not left.num_rows:
            return _nothing(["z"], sums)
        r0, c0 = (k.as_py() * tile for k in key)
        z = np.frombuffer(left.column("z")[0].as_py()).reshape(min(tile, rows - r0) + 2, -1)
        flow = TileFlow(z, r0, c0, cols)
        way = flow.turned(list(zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True)))
        found = WayTile(np.where(flow.there, way, -1).reshape(flow.shape), r0, c0, cols)
        return _packed(key, found, {"z": flow.z} | ({"cells": np.ones(len(way))} if "cells" in sums else {}), sums)

    return durable(tiles.select("tr", "tc", "z").groupBy("tr", "tc").cogroup(exits.groupBy("tr", "tc")).applyInArrow(turn, _schema(["z"], sums)))


def breached(cells: DataFrame, value: str, rows: int, cols: int, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, dir, breached): the way of each cell, 0 = north and clockwise, null where it leaves the raster, and its height
    after breaching: no higher than anything that flows through it. Cells beside the border or a missing cell may leave."""
    sums = {"z": "min"}
    coming, _ = _coming(tiles := _turned(cells, value, rows, cols, tile, sums), sums, cols, tile)

    def gather(key, left, right):
        found, got = _gathered_tile(left, right, sums, cols)
        if found is None:
            return _cells(None, {"dir": None, "breached": None})
        way = found.way[found.there].astype(np.int32)
        return _cells(found, {"dir": pa.array(way, mask=way == _PIT), "breached": pa.array(got["z"][found.there])})

    return tiles.groupBy("tr", "tc").cogroup(coming.groupBy("tr", "tc")).applyInArrow(gather, "row_i int, col_i int, dir int, breached double")


def breached_accumulation(cells: DataFrame, value: str, rows: int, cols: int, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, cells): how many cells drain through each cell of the breached surface."""
    return _summed(_turned(cells, value, rows, cols, tile, {"cells": "sum"}), "cells", "cells", "sum", cols, tile)[0]


def breached_above_stream(cells: DataFrame, value: str, rows: int, cols: int, least_cells: int, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, hand) as `height_above_stream` over the breached surface; heights and cells are gathered together."""
    sums = {"z": "min", "cells": "sum"}
    return _above_stream(_turned(cells, value, rows, cols, tile, sums), sums, cols, least_cells, tile)


# --- along flow --------------------------------------------------------------------------------------------------------


def _ends(down: np.ndarray) -> np.ndarray:
    while (down[down] != down).any():
        down = down[down]
    return down


def _gathered(down: np.ndarray, value: np.ndarray, how: np.ufunc) -> np.ndarray:
    """Each value with those of all cells whose way leads through it."""
    total = value.copy()
    moves = down != np.arange(len(down))
    waits = np.bincount(down[moves], minlength=len(down))
    front = np.flatnonzero(waits == 0)
    while len(front):
        front = front[moves[front]]
        how.at(total, down[front], total[front])
        np.subtract.at(waits, down[front], 1)
        front = np.unique(down[front])
        front = front[waits[front] == 0]
    return total


class WayTile:
    """Ways of a tile's cells in a rectangle that holds them, -1 where there is no cell, and where each leads inside."""

    def __init__(self, way: np.ndarray, r0: int, c0: int, cols: int):
        h, w = way.shape
        self.r0, self.c0, self.shape, self.way, self.cols = r0, c0, (h, w), way.astype(np.int8).ravel(), cols
        row, col = np.divmod(np.arange(h * w), w)
        step = np.vstack([_STEP, [0, 0], [0, 0]])[self.way]
        to_r, to_c = row + step[:, 0], col + step[:, 1]
        inside = (to_r >= 0) & (to_r < h) & (to_c >= 0) & (to_c < w)
        self.there = self.way >= 0
        to = np.where(inside, to_r * w + to_c, 0)
        self.down = np.where(inside & self.there[to], to, np.arange(h * w))
        self.last, self.leaves = _ends(self.down), ~inside
        self.row, self.col = row + r0, col + c0
        self.key, self.to = self.row * cols + self.col, (to_r + r0) * cols + to_c + c0
        self.edge = self.there & ((row == 0) | (row == h - 1) | (col == 0) | (col == w - 1))

    def at(self, cell: np.ndarray) -> np.ndarray:
        """Places in the rectangle of cell numbers."""
        return (cell // self.cols - self.r0) * self.shape[1] + cell % self.cols - self.c0

    def border(self, at: np.ndarray, more: dict[str, pa.Array]) -> pa.Array:
        """The cells `at`, where each leaves the tile and, of those that do so themselves, the cell that they go to."""
        last = self.last[at]
        out, goes = pa.array(self.key[last], mask=~self.leaves[last]), pa.array(self.to[at], mask=~self.leaves[at])
        return _listed({"cell": pa.array(self.key[at]), "out": out, "goes": goes} | more)


#: How values gather: inside a tile, and between tiles.
_HOW = {"sum": (np.add, F.sum), "min": (np.minimum, F.min)}


def _listed(columns: dict[str, pa.Array]) -> pa.Array:
    """One row that holds a list of structs."""
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()]
    return pa.ListArray.from_arrays(pa.array([0, len(flat[0])], pa.int32()), pa.StructArray.from_arrays(flat, list(columns)))


def _key(key) -> list[pa.Array]:
    return [pa.array([k.as_py()], pa.int32()) for k in key]


def _schema(kept: Iterable[str], border: Iterable[str]) -> str:
    """What `_packed` gives: grids as bytes, and cells of the border with their values."""
    names = list(dict.fromkeys([*kept, *border]))
    return "tr int, tc int, r0 int, c0 int, w int, way binary, " + "".join(f"`{n}` binary, " for n in names) + "border array<struct<cell:bigint,out:bigint,goes:bigint" + "".join(f",`{n}`:double" for n in border) + ">>"


def _nothing(kept: Iterable[str], border: Iterable[str]) -> pa.Table:
    names = list(dict.fromkeys([*kept, *border]))
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("cell", "out", "goes")] + [(n, pa.float64()) for n in border]))
    fields = [(n, pa.int32()) for n in ("tr", "tc", "r0", "c0", "w")] + [(n, pa.binary()) for n in ("way", *names)] + [("border", kind)]
    return pa.schema(fields).empty_table()


def _packed(key, found: WayTile, grids_: dict[str, np.ndarray], sums: dict[str, str], border: pa.Array | None = None) -> pa.Table:
    """A tile as a row: its rectangle, ways and grids, and the cells of its border whose way leaves it, with what gathers there."""
    if border is None:
        at = np.flatnonzero(found.edge & found.leaves[found.last])
        border = found.border(at, {n: pa.array(_gathered(found.down, grids_[n], _HOW[how][0])[at]) for n, how in sums.items()})
    where = [pa.array([v], pa.int32()) for v in (found.r0, found.c0, found.shape[1])]
    values = [pa.array([v.tobytes()], pa.binary()) for v in (found.way, *grids_.values())]
    return pa.table([*_key(key), *where, *values, border], ["tr", "tc", "r0", "c0", "w", "way", *grids_, "border"])


def _unpacked(table: pa.Table, names: Iterable[str], cols: int) -> tuple[WayTile, dict[str, np.ndarray]]:
    r0, c0, w = (table.column(n)[0].as_py() for n in ("r0", "c0", "w"))
    way = np.frombuffer(table.column("way")[0].as_py(), np.int8).reshape(-1, w)
    return WayTile(way, r0, c0, cols), {n: np.frombuffer(table.column(n)[0].as_py()).copy() for n in names}


def _gathered_tile(left: pa.Table, right: pa.Table, sums: dict[str, str], cols: int, more: Iterable[str] = ()) -> tuple[WayTile | None, dict[str, np.ndarray]]:
    """A tile with what gathers in its cells, of which `right` comes from other tiles."""
    if not left.num_rows:
        return None, {}
    found, got = _unpacked(left, dict.fromkeys([*sums, *more]), cols)
    at = found.at(right.column("goes").to_numpy())
    # A way may lead to where no cell is.
    held = (at >= 0) & (at < len(found.way)) if len(at) else np.zeros(0, bool)
    held[held] = found.key[at[held]] == right.column("goes").to_numpy()[held]
    for n, how in sums.items():
        _HOW[how][0].at(got[n], at[held], right.column(n).to_numpy()[held])
        got[n] = _gathered(found.down, got[n], _HOW[how][0])
    return found, got


def _cells(found: WayTile | None, columns: dict[str, pa.Array | None]) -> pa.Table:
    """A row a cell of the tile."""
    if found is None:
        kinds = {n: pa.int32() if n == "dir" else pa.int64() if n == "end" else pa.float64() for n in columns}
        return pa.schema([("row_i", pa.int32()), ("col_i", pa.int32()), *kinds.items()]).empty_table()
    row, col = (pa.array(v[found.there].astype(np.int32)) for v in (found.row, found.col))
    return pa.table([row, col, *columns.values()], ["row_i", "col_i", *columns])


def _ways_packed(ways: DataFrame, values: dict[str, Column], sums: dict[str, str], cols: int, tile: int, border: Callable[[WayTile], pa.Array] | None = None) -> DataFrame:
    """Tiles as `_packed` of ways in rows (row_i, col_i, dir), a null dir being an end."""

    names = list(values)

    def pack(key, table):
        row, col = (table.column(n).to_numpy() for n in ("row_i", "col_i"))
        r0, c0 = int(row.min()), int(col.min())
        shape = int(row.max()) - r0 + 1, int(col.max()) - c0 + 1
        way = np.full(shape, -1, np.int8)
        way[row - r0, col - c0] = table.column("dir").fill_null(_PIT).to_numpy()
        got = {n: np.full(shape, np.nan) for n in names}
        for n, grid in got.items():
            grid[row - r0, col - c0] = table.column(n).to_numpy(zero_copy_only=False)
        found = WayTile(way, r0, c0, cols)
        return _packed(key, found, {n: g.ravel() for n, g in got.items()}, sums, border and border(found))

    rows = ways.select(F.col("row_i").cast("int").alias("row_i"), F.col("col_i").cast("int").alias("col_i"), F.col("dir").cast("int").alias("dir"), *[c.cast("double").alias(n) for n, c in values.items()])
    rows = rows.withColumn("tr", F.expr(f"cast(row_i div {tile} as int)")).withColumn("tc", F.expr(f"cast(col_i div {tile} as int)"))
    return durable(rows.groupBy("tr", "tc").applyInArrow(pack, _schema(values, sums)))


def _borders(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.explode("border").alias("b")).select("b.*")


def _by_tile(rows: DataFrame, cell: str, cols: int, tile: int) -> DataFrame:
    """Rows with the tile of a cell number."""
    return rows.withColumn("tr", F.expr(f"cast(({cell} div {cols}) div {tile} as int)")).withColumn("tc", F.expr(f"cast(({cell} % {cols}) div {tile} as int)"))


def _coming(tiles: DataFrame, sums: dict[str, str], cols: int, tile: int) -> tuple[DataFrame, int]:
    """((tr, tc, goes, sums), rounds): what comes to each cell from other tiles. The cells where flow leaves a tile form a forest that
    is contracted by doubling, so rounds grow with the logarithm of the tiles on the longest way."""
    edges = _borders(tiles)
    outlets = edges.filter("goes is not null").select("cell", "goes", *sums)
    state = durable(outlets.join(edges.select(F.col("cell").alias("goes"), F.col("out").alias("next")), "goes", "left").select("cell", "next", *sums))
    told = {n: f"more_{n}" for n in sums}
    both = [F.when(F.col(m).isNull(), F.col(n)).otherwise(F.col(n) + F.col(m) if sums[n] == "sum" else F.least(n, m)).alias(n) for n, m in told.items()]
    rounds = 0
    while not state.filter("next is not null").isEmpty():
        more = state.filter("next is not null").groupBy(F.col("next").alias("cell")).agg(*[_HOW[sums[n]][1](n).alias(m) for n, m in told.items()])
        hop = state.select(F.col("cell").alias("next"), F.col("next").alias("after"))
        state = durable(state.join(more, "cell", "left").join(hop, "next", "left").select("cell", F.col("after").alias("next"), *both))
        rounds += 1
    coming = state.join(outlets.select("cell", "goes"), "cell").groupBy("goes").agg(*[_HOW[how][1](n).alias(n) for n, how in sums.items()])
    return _by_tile(coming, "goes", cols, tile), rounds


def _summed(tiles: DataFrame, value: str, named: str, how: str, cols: int, tile: int) -> tuple[DataFrame, int]:
    coming, rounds = _coming(tiles, {value: how}, cols, tile)

    def gather(key, left, right):
        found, got = _gathered_tile(left, right, {value: how}, cols)
        return _cells(found, {named: None if found is None else pa.array(got[value][found.there])})

    return tiles.groupBy("tr", "tc").cogroup(coming.groupBy("tr", "tc")).applyInArrow(gather, f"row_i int, col_i int, `{named}` double"), rounds


def accumulate(ways: DataFrame, value: str, how: str, cols: int, tile: int = TILE) -> tuple[DataFrame, int]:
    """((row_i, col_i, value), rounds): the sum or the least of `value` over each cell and all cells that flow through it.

    ways: (row_i, col_i, dir, value). Tiles gather their own flow, then what comes from other tiles (`_coming`), then once more.
    """
    return _summed(_ways_packed(ways, {"x": F.col(value)}, {"x": how}, cols, tile), "x", value, how, cols, tile)


def _followed(tiles: DataFrame, told: str) -> tuple[DataFrame, int]:
    """((cell, told), rounds): for each cell where a way leaves a tile, what the borders say of the end of its way."""
    edges = _borders(tiles)
    entered = edges.select(F.col("cell").alias("goes"), F.col("out").alias("next"), told)
    state = durable(edges.filter("goes is not null").select("cell", "goes").join(entered, "goes", "left").select("cell", "next", told))
    rounds = 0
    while not state.filter("next is not null").isEmpty():
        hop = state.select(F.col("cell").alias("next"), F.col("next").alias("after"), F.col(told).alias("there"))
        state = durable(state.join(hop, "next", "left").select("cell", F.col("after").alias("next"), F.coalesce(told, "there").alias(told)))
        rounds += 1
    return state.select("cell", told), rounds


def way_ends(ways: DataFrame, cols: int, tile: int = TILE) -> tuple[DataFrame, int]:
    """((row_i, col_i, end_r, end_c), rounds): where each cell's way ends, a null dir being an end.

    Ways are followed inside tiles first; only the cells where they leave a tile are followed further, by doubling.
    """

    def border(found):
        at = np.flatnonzero(found.edge)
        last = found.last[at]
        return found.border(at, {"end": pa.array(found.key[last].astype(float), mask=found.leaves[last])})

    tiles = _ways_packed(ways, {"end": F.lit(None)}, {"end": "min"}, cols, tile, border)
    after, rounds = _followed(tiles, "end")

    def ends(key, left, right):
        if not left.num_rows:
            return _cells(None, {"end": None})
        found, _ = _unpacked(left, (), cols)
        end = found.key.copy()
        known = right.filter(right.column("end").is_valid())
        end[found.at(known.column("cell").to_numpy())] = known.column("end").to_numpy().astype(np.int64)
        return _cells(found, {"end": pa.array(end[found.last][found.there])})

    out = tiles.groupBy("tr", "tc").cogroup(_by_tile(after, "cell", cols, tile).groupBy("tr", "tc")).applyInArrow(ends, "row_i int, col_i int, end long")
    return out.select("row_i", "col_i", F.expr(f"cast(end div {cols} as int)").alias("end_r"), F.expr(f"cast(end % {cols} as int)").alias("end_c")), rounds


def _above_stream(tiles: DataFrame, sums: dict[str, str], cols: int, least_cells: int, tile: int) -> DataFrame:
    """height_above_stream over tiles with heights z and `sums`, cells among them."""
    coming, _ = _coming(tiles, sums, cols, tile)

    def cut(key, left, right):
        """Ways that end at streams, and the heights of streams where ways enter the tile."""
        found, got = _gathered_tile(left, right, sums, cols, ["z"])
        if found is None:
            return _nothing(["z"], ["base"])
        stream = found.there & (got["cells"] >= least_cells)
        found = WayTile(np.where(stream, _PIT, found.way).reshape(found.shape), found.r0, found.c0, cols)
        base = np.where(stream, got["z"], np.nan)
        at = np.flatnonzero(found.edge)
        ends = base[found.last[at]]
        return _packed(key, found, {"z": got["z"], "base": base}, {}, found.border(at, {"base": pa.array(ends, mask=np.isnan(ends))}))

    streams = durable(tiles.drop("border").groupBy("tr", "tc").cogroup(coming.groupBy("tr", "tc")).applyInArrow(cut, _schema(["z"], ["base"])))
    bases, _ = _followed(streams, "base")

    def above(key, left, right):
        if not left.num_rows:
            return _cells(None, {"hand": None})
        found, got = _unpacked(left, ["z", "base"], cols)
        got["base"][found.at(right.column("cell").to_numpy())] = right.column("base").to_numpy(zero_copy_only=False)
        hand = (got["z"] - got["base"][found.last])[found.there]
        return _cells(found, {"hand": pa.array(hand, mask=np.isnan(hand))})

    out = streams.drop("border").groupBy("tr", "tc").cogroup(_by_tile(bases, "cell", cols, tile).groupBy("tr", "tc")).applyInArrow(above, "row_i int, col_i int, hand double")
    return out.withColumn("hand", F.round("hand", 6))


def height_above_stream(ways: DataFrame, heights: DataFrame, value: str, cols: int, least_cells: int, tile: int = TILE) -> DataFrame:
    """(row_i, col_i, hand): height above the stream cell that each cell drains to, a stream being where at least `least_cells`
    drain through; null where a way ends before one. ways: (row_i, col_i, dir); heights: (row_i, col_i, value), NaN as null."""
    z = heights.select(F.col("row_i").cast("int").alias("row_i"), F.col("col_i").cast("int").alias("col_i"), F.col(value).alias("z"))
    both = ways.select("row_i", "col_i", "dir").join(z, ["row_i", "col_i"], "left")
    out = _above_stream(_ways_packed(both, {"z": F.col("z"), "cells": F.lit(1)}, {"cells": "sum"}, cols, tile), {"cells": "sum"}, cols, least_cells, tile)
    return out.join(z.select("row_i", "col_i"), ["row_i", "col_i"], "left_semi")
