"""A data source for ``.npy`` rasters that cuts each file into byte ranges: ``spark.read.format("npy_tiles")``.

A raster in row order is a header and then its rows, so a band of whole tile rows is one range of the file.  The driver reads
headers only; each task reads its range and cuts it into tiles.  Options: ``path`` (a folder or a file), ``meta`` (JSON with the affine
``transform``), ``tileSize``, ``nodata`` (a number, or ``nan`` for none but NaN), ``rangeBytes``.  Rasters in column order are one range each.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = ("raster_id string, band string, tile_r bigint, tile_c bigint, h int, w int, tile_size int, "
          "values array<float>, affine struct<a: double, b: double, c: double, d: double, e: double, f: double>")


class Band(InputPartition):
    """Rows ``first`` to ``last`` of a raster file."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _header(source) -> tuple[tuple[int, int], bool, np.dtype, int]:
    """Shape, column order, type and first byte of the values."""
    start = io.BytesIO(source.read_at(min(4096, source.size()), 0))
    version = np.lib.format.read_magic(start)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(start)
    if len(shape) != 2 or kind.hasobject:
        raise ValueError("a raster has two axes of numbers")
    return shape, by_column, kind, start.tell()


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("tilesize", options.get("tileSize", 256)))
        self.nodata = float(options.get("nodata", 0.0))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 64 << 20)))
        store, name = _store(options["meta"])
        with store.open_input_file(name) as source:
            self.affine = dict(zip("abcdef", map(float, json.loads(source.read())["transform"][:6]), strict=True))

    def partitions(self) -> list[Band]:
        store, name = _store(self.path)
        found = [store.get_file_info(name)]
        if found[0].type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(name, recursive=True))
        files = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npy"))
        bands = []
        for file in files:
            with store.open_input_file(file) as source:
                (rows, columns), by_column, kind, _ = _header(source)
            step = max(self.range_bytes // max(columns * kind.itemsize * self.size, 1), 1) * self.size if not by_column else max(rows, 1)
            bands += [Band(file, first, min(first + step, rows)) for first in range(0, rows, step)]
        return bands

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as source:
            (rows, columns), by_column, kind, start = _header(source)
            if by_column:
                grid = np.frombuffer(source.read_at(rows * columns * kind.itemsize, start), kind).reshape((rows, columns), order="F")
            else:
                line = columns * kind.itemsize
                held = source.read_at((partition.last - partition.first) * line, start + partition.first * line)
                grid = np.frombuffer(held, kind).reshape(-1, columns)
        name = partition.path.rsplit("/", 1)[-1][:-len(".npy")]
        raster_id, _, band = name.rpartition("_")
        size = self.size
        for r in range(0, len(grid), size):
            for c in range(0, columns, size):
                block = grid[r:r + size, c:c + size].astype(np.float32)
                flat = block.ravel()
                values = pa.array(flat, mask=~np.isfinite(flat) | (flat == np.float32(self.nodata)))
                yield pa.RecordBatch.from_pydict({
                    "raster_id": [raster_id], "band": [band], "tile_r": [(partition.first + r) // size], "tile_c": [c // size],
                    "h": pa.array([block.shape[0]], pa.int32()), "w": pa.array([block.shape[1]], pa.int32()),
                    "tile_size": pa.array([size], pa.int32()), "values": pa.ListArray.from_arrays([0, len(flat)], values), "affine": [self.affine]})


class NpyTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyTiles)
