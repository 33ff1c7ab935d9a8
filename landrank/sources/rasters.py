"""Rasters as folders of tiled TIFF files: a sink that writes a file a block of tiles, and a data source that reads only the tiles asked for.

    rasters.write(cells, folder, grid, "elev_m", "float32", nodata=-9999.0, epsg=26916)
    spark.dataSource.register(rasters.TiledRaster)
    spark.read.format("tiled_raster").load(folder).filter("x between 500000 and 500500 and y > 3999000")

Rows are (row_i int, col_i int, x double, y double, value double): cells of the whole grid with their centres; cells of no data have
no row. Comparisons of row_i, col_i, x and y with numbers choose tiles before anything of them is read, and Spark tests them
again on rows. A partition is a run of tiles of one file, at most `run` of them, found from the file's table of offsets.

Files are classic little-endian TIFF with square tiles, one sample a pixel, plain or deflated, with the position, projection and
no-data value in the tags that mapping programs read. A block of tiles is written by one task and stays below the format's 4 GB.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.resample import Grid

TILE_CELLS = 256
BLOCK_TILES = 16
#: Fixed values of the format: tags, types of tag values (code: letter of struct), sample kinds (format code: numpy letter), compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 277, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NO_DATA, DESCRIPTION = 33550, 33922, 34735, 42113, 270
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d"}
_FORMATS = {1: "u", 2: "i", 3: "f"}
PLAIN, DEFLATE = 1, 8
#: Keys of the projection directory: model (1 is projected), raster kind (1: a pixel is an area), projected system, its linear unit (9001: metre).
MODEL_KEY, RASTER_KEY, SYSTEM_KEY, UNIT_KEY, METRE = 1024, 1025, 3072, 3076, 9001
_COLUMNS = "row_i int, col_i int, x double, y double, value double"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path; Hadoop's names of stores become those of pyarrow."""
    if uri.startswith("s3a://"):
        uri = "s3" + uri[3:]
    elif uri.startswith("file:/"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# --- one file ----------------------------------------------------------------------------------------------------------


def encode(values: np.ndarray, left: float, top: float, resolution: float, nodata: float | None, epsg: int, tile: int = TILE_CELLS, compression: int = DEFLATE, note: dict | None = None) -> bytes:
    """A TIFF file of a block of cells; what lies beyond the block in its last tiles is no data, or 0."""
    rows, cols = values.shape
    down, across = -(-rows // tile), -(-cols // tile)
    padded = np.full((down * tile, across * tile), 0 if nodata is None else nodata, values.dtype)
    padded[:rows, :cols] = values
    pack = (lambda raw: zlib.compress(raw, 6)) if compression == DEFLATE else (lambda raw: raw)
    tiles = [pack(padded[i * tile : i * tile + tile, j * tile : j * tile + tile].astype(values.dtype.newbyteorder("<")).tobytes()) for i in range(down) for j in range(across)]
    offsets = np.cumsum([8, *map(len, tiles)])[:-1]
    kind = {letter: code for code, letter in _FORMATS.items()}[values.dtype.kind]
    keys = [1, 1, 0, 4, MODEL_KEY, 0, 1, 1, RASTER_KEY, 0, 1, 1, SYSTEM_KEY, 0, 1, epsg, UNIT_KEY, 0, 1, METRE]
    tags = [
        (WIDTH, 4, [cols]), (LENGTH, 4, [rows]), (BITS, 3, [values.dtype.itemsize * 8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (DESCRIPTION, 2, json.dumps(note or {}).encode() + b"\0"),
        (SAMPLES, 3, [1]), (TILE_WIDTH, 3, [tile]), (TILE_LENGTH, 3, [tile]), (TILE_OFFSETS, 4, offsets.tolist()), (TILE_BYTES, 4, list(map(len, tiles))), (SAMPLE_FORMAT, 3, [kind]),
        (PIXEL_SCALE, 12, [resolution, resolution, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, left, top, 0.0]), (GEO_KEYS, 3, keys),
    ]
    if nodata is not None:
        tags.append((NO_DATA, 2, repr(nodata).encode() + b"\0"))
    body = b"".join(tiles)
    start = 8 + len(body) + len(body) % 2
    head = struct.pack("<2sHI", b"II", 42, start)
    more = start + 2 + 12 * len(tags) + 4
    entries, rest = b"", b""
    for tag, type_, value in tags:
        raw = value if type_ == 2 else struct.pack(f"<{len(value)}{_TYPES[type_]}", *value)
        if len(raw) > 4:
            place = struct.pack("<I", more + len(rest))
            rest += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, type_, len(value)) + place
    return head + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + rest


@dataclass
class RasterFile:
    """A file's head: everything but its tiles."""

    path: str
    rows: int
    cols: int
    tile: int
    dtype: np.dtype
    compression: int
    offsets: list[int]
    sizes: list[int]
    left: float
    top: float
    resolution: float
    nodata: float | None
    epsg: int | None
    metres: bool
    note: dict = field(default_factory=dict)

    @classmethod
    def open(cls, path: str) -> RasterFile:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            order, magic, start = struct.unpack("<2sHI", f.read_at(8, 0))
            if order != b"II" or magic != 42:
                raise ValueError(f"{path} is not a little-endian TIFF file")
            (n,) = struct.unpack("<H", f.read_at(2, start))
            tags: dict[int, Any] = {}
            for tag, type_, count, raw in struct.iter_unpack("<HHI4s", f.read_at(12 * n, start + 2)):
                if type_ not in _TYPES:
                    continue
                size = count * struct.calcsize(_TYPES[type_])
                if size > 4:
                    raw = f.read_at(size, struct.unpack("<I", raw)[0])
                tags[tag] = raw[:size].rstrip(b"\0") if type_ == 2 else struct.unpack(f"<{count}{_TYPES[type_]}", raw[:size])
        if missing := [t for t in (WIDTH, LENGTH, TILE_WIDTH, TILE_OFFSETS, TILE_BYTES, PIXEL_SCALE, TIEPOINT) if t not in tags]:
            raise ValueError(f"{path}: no tag {', '.join(map(str, missing))}; this reads tiled rasters with a position")
        if tags.get(SAMPLES, (1,))[0] != 1 or tags.get(COMPRESSION, (PLAIN,))[0] not in (PLAIN, DEFLATE) or tags[TILE_WIDTH] != tags[TILE_LENGTH]:
            raise ValueError(f"{path}: one sample a pixel, square tiles, plain or deflated")
        keys = tags.get(GEO_KEYS, ())
        geo = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
        dtype = np.dtype(f"<{_FORMATS[tags.get(SAMPLE_FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")
        nodata = float(tags[NO_DATA]) if NO_DATA in tags else None
        note = json.loads(tags[DESCRIPTION]) if tags.get(DESCRIPTION, b"").startswith(b"{") else {}
        tie, scale = tags[TIEPOINT], tags[PIXEL_SCALE][0]
        return cls(path, tags[LENGTH][0], tags[WIDTH][0], tags[TILE_WIDTH][0], dtype, tags.get(COMPRESSION, (PLAIN,))[0], list(tags[TILE_OFFSETS]), list(tags[TILE_BYTES]), tie[3] - tie[0] * scale, tie[4] + tie[1] * scale, scale, nodata, geo.get(SYSTEM_KEY), geo.get(UNIT_KEY) == METRE, note)

    def read_tile(self, file, k: int) -> np.ndarray:
        raw = file.read_at(self.sizes[k], self.offsets[k])
        raw = zlib.decompress(raw) if self.compression == DEFLATE else raw
        return np.frombuffer(raw, self.dtype).reshape(self.tile, self.tile)

    @property
    def first_row(self) -> int:
        return int(self.note.get("row", 0))

    @property
    def first_col(self) -> int:
        return int(self.note.get("col", 0))


# --- sink --------------------------------------------------------------------------------------------------------------


def write(cells: DataFrame, folder: str, grid: Grid, value: str, dtype: str = "float32", nodata: float | None = -9999.0, epsg: int = 26916, tile: int = TILE_CELLS, block: int = BLOCK_TILES, compression: int = DEFLATE) -> int:
    """Write cells (row_i, col_i, value) as a folder of files, one a block of block x block tiles; returns how many files.

    Missing and NaN cells become no data; a value that is no data itself, that the type can't hold, or a cell off the grid is an error.
    A file is written under another name and renamed, so a task that runs twice leaves one whole file.
    """
    side, kind = tile * block, np.dtype(dtype)

    def put(key, table):
        r0, c0 = key[0].as_py() * side, key[1].as_py() * side
        rows, cols = min(side, grid.rows - r0), min(side, grid.cols - c0)
        z = table.column("z").to_numpy(zero_copy_only=False)
        keep = ~np.isnan(z)
        if kind.kind != "f" and keep.any() and (z[keep].astype(kind) != z[keep]).any():
            raise ValueError(f"{dtype} can't hold every value of {value}")
        if nodata is not None and (z[keep].astype(kind) == np.array(nodata).astype(kind)).any():
            raise ValueError(f"a cell has the no-data value {nodata}")
        if nodata is None and (not keep.all() or len(z) < rows * cols):
            raise ValueError("there are cells of no data, and no value for them")
        values = np.full((rows, cols), 0 if nodata is None else nodata, kind)
        values[table.column("row_i").to_numpy()[keep] - r0, table.column("col_i").to_numpy()[keep] - c0] = z[keep].astype(kind)
        name = f"r{r0:09d}-c{c0:09d}.tif"
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        raw = encode(values, grid.left + c0 * grid.resolution, grid.top - r0 * grid.resolution, grid.resolution, nodata, epsg, tile, compression, {"row": r0, "col": c0, "rows": grid.rows, "cols": grid.cols})
        own = f"{path}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(raw)
        store.move(own, f"{path}/{name}")
        return pa.table([pa.array([name])], ["name"])

    off = ~(F.col("row_i").between(0, grid.rows - 1) & F.col("col_i").between(0, grid.cols - 1))
    placed = cells.select(F.when(off, F.raise_error(F.lit("a cell is not on the grid"))).otherwise(F.col("row_i")).cast("int").alias("row_i"), F.col("col_i").cast("int").alias("col_i"), F.col(value).cast("double").alias("z"))
    return placed.groupBy(F.expr(f"row_i div {side}"), F.expr(f"col_i div {side}")).applyInArrow(put, "name string").count()


def files(folder: str) -> list[str]:
    """TIFF files of a folder, or the one file itself, by name; names that begin with a dot are not finished."""
    store, path = _store(folder)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [folder]
    found = store.get_file_info(fs.FileSelector(path))
    return sorted(f"{folder.rstrip('/')}/{i.base_name}" for i in found if i.base_name.endswith(".tif") and not i.base_name.startswith("."))


def heads(folder: str) -> list[RasterFile]:
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(RasterFile.open, files(folder)))


# --- source ------------------------------------------------------------------------------------------------------------


class _Run(InputPartition):
    def __init__(self, file: RasterFile, tiles: list[int]):
        super().__init__((file.path, tiles))
        # Only what the run needs travels to its task.
        self.tiles = tiles
        self.file = RasterFile(**{**file.__dict__, "offsets": {k: file.offsets[k] for k in tiles}, "sizes": {k: file.sizes[k] for k in tiles}})


class TiledRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiled_raster"

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.folder, self.run = options["path"], int(options.get("run", 16))
        self.low, self.high = dict.fromkeys(("row_i", "col_i", "x", "y"), -np.inf), dict.fromkeys(("row_i", "col_i", "x", "y"), np.inf)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.low and isinstance(getattr(f, "value", None), (int, float)) and not isinstance(f.value, bool):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], float(f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], float(f.value))
            yield f  # tiles are chosen by it; rows are for Spark

    def chosen(self, file: RasterFile) -> list[int]:
        """Tiles of a file that may hold a wanted cell."""
        res, row, col = file.resolution, file.first_row, file.first_col
        r0 = max(self.low["row_i"] - row, (file.top - self.high["y"]) / res - 0.5, 0)
        r9 = min(self.high["row_i"] - row, (file.top - self.low["y"]) / res - 0.5, file.rows - 1)
        c0 = max(self.low["col_i"] - col, (self.low["x"] - file.left) / res - 0.5, 0)
        c9 = min(self.high["col_i"] - col, (self.high["x"] - file.left) / res - 0.5, file.cols - 1)
        if r0 > r9 + 1e-6 or c0 > c9 + 1e-6:
            return []
        across = -(-file.cols // file.tile)
        span = lambda a, b, n: range(max(0, int(a - 1e-6) // file.tile), min(n - 1, int(b + 1e-6) // file.tile) + 1)
        return [i * across + j for i in span(r0, r9, -(-file.rows // file.tile)) for j in span(c0, c9, across)]

    def partitions(self) -> list[InputPartition]:
        out = []
        for file in heads(self.folder):
            tiles = self.chosen(file)
            out += [_Run(file, tiles[i : i + self.run]) for i in range(0, len(tiles), self.run)]
        return out or [_Run(RasterFile(self.folder, 0, 0, 1, np.dtype("<f4"), PLAIN, [], [], 0.0, 0.0, 1.0, None, None, True), [])]

    def read(self, run: _Run) -> Iterator[pa.RecordBatch]:
        file = run.file
        if not run.tiles:
            return
        across = -(-file.cols // file.tile)
        store, path = _store(file.path)
        with store.open_input_file(path) as source:
            for k in run.tiles:
                i, j = divmod(k, across)
                z = file.read_tile(source, k).astype(float)[: file.rows - i * file.tile, : file.cols - j * file.tile]
                r, c = np.nonzero(~np.isnan(z) & (z != file.nodata if file.nodata is not None else True))
                values = z[r, c]
                r, c = r + i * file.tile, c + j * file.tile
                x, y = file.left + file.resolution * (c + 0.5), file.top - file.resolution * (r + 0.5)
                yield pa.RecordBatch.from_arrays([pa.array((r + file.first_row).astype(np.int32)), pa.array((c + file.first_col).astype(np.int32)), pa.array(x), pa.array(y), pa.array(values)], ["row_i", "col_i", "x", "y", "value"])
