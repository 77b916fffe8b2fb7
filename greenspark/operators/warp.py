"""Warping tiled rasters onto a grid in another reference system, and mosaics of scenes on one grid.

Each source tile, with a halo of one pixel, is outlined in the target system to find the target tiles it can reach; a target tile then
meets exactly the source tiles around it.  The centres of its pixels are taken back to source pixels by the exact formulas, as column
expressions; only the bilinear lookup runs on arrays.  A group holds neighbouring target tiles of ``GROUP_PIXELS`` a side together and
the source tiles below them, so its size follows from the ratio of the pixel sizes, not from the raster.

NULL and NaN are nodata: the weights of missing neighbours are shared out among the others, and a pixel without any is NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenspark.functions import crs
from greenspark.operators.lineage import cut

#: Points per side of the outline of a source tile.
OUTLINE = 16
#: Pixels per side of the target tiles that are looked up together; a larger tile is a group of its own.
GROUP_PIXELS = 256
#: Sums of one place that are added at once; its scenes are dealt to as many.
SCENES_AT_ONCE = 64
_KEYS = ["raster_id", "band", "tile_r", "tile_c"]
_OUT = "raster_id string, band string, tile_r int, tile_c int, values array<double>"


def _outline(first_x: Column, last_x: Column, first_y: Column, last_y: Column) -> Column:
    """Points along the four sides of a box."""
    steps = F.sequence(F.lit(0), F.lit(OUTLINE))

    def side(ax, ay, bx, by):
        return F.transform(steps, lambda s: F.struct((ax + (bx - ax) * s / OUTLINE).alias("x"), (ay + (by - ay) * s / OUTLINE).alias("y")))

    return F.concat(side(first_x, first_y, last_x, first_y), side(last_x, first_y, last_x, last_y),
                    side(last_x, last_y, first_x, last_y), side(first_x, last_y, first_x, first_y))


def _reached(tiles: DataFrame, source: int, target: int, grid: tuple[float, float, float, float], size: int) -> DataFrame:
    """(source tile, target tile) for all that can share a pixel."""
    x0, dx, y0, dy = grid
    a = F.col("affine")

    def at(scale: str, offset: str, index: str, extent: str) -> tuple[Column, Column]:
        first = F.col(index) * F.col("tile_size")
        return a[scale] * (first - 1) + a[offset], a[scale] * (first + F.col(extent) + 1) + a[offset]

    outline = F.transform(_outline(*at("a", "c", "tile_c", "w"), *at("e", "f", "tile_r", "h")),
                          lambda p: crs.transform_pair(p["x"], p["y"], source, target))
    placed = tiles.select(*_KEYS, "affine", F.explode(F.array(outline)).alias("_o"))
    columns = F.transform("_o", lambda p: (p["x"] - x0) / dx)
    rows = F.transform("_o", lambda p: (p["y"] - y0) / dy)

    def spanned(values: Column) -> Column:
        return F.sequence(F.floor((F.array_min(values) - 1) / size).cast("int"), F.floor((F.array_max(values) + 1) / size).cast("int"))

    return (placed.withColumn("_r", F.explode(spanned(rows))).withColumn("_c", F.explode(spanned(columns)))
            .select(*_KEYS, "affine", "_r", "_c"))


def _looked_up(size: int):
    """Bilinear values of neighbouring target tiles from the source tiles around them."""
    def numbers(lists: pa.ChunkedArray) -> np.ndarray:
        return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def group(key, target: pa.Table, source: pa.Table) -> pa.Table:
        kept = np.empty(0, int)
        if target.num_rows and source.num_rows:
            place = {c: source[c].to_numpy() for c in ("tile_r", "tile_c", "tile_size", "h", "w")}
            from_r, from_c = place["tile_r"] * place["tile_size"], place["tile_c"] * place["tile_size"]
            first_r, first_c = from_r.min(), from_c.min()
            n_r, n_c = (from_r + place["h"]).max() - first_r, (from_c + place["w"]).max() - first_c
            window = np.full((n_r, n_c), np.nan)
            held, at = numbers(source["values"]), 0
            for r, c, h, w in zip(from_r - first_r, from_c - first_c, place["h"], place["w"], strict=True):
                window[r:r + h, c:c + w] = held[at:at + h * w].reshape(h, w)
                at += h * w
            u, v = numbers(target["us"]), numbers(target["vs"])
            left, upper = np.floor(u), np.floor(v)
            total, weight = np.zeros(len(u)), np.zeros(len(u))
            for dr in (0, 1):
                for dc in (0, 1):
                    w = (1 - np.abs(u - left - dc)) * (1 - np.abs(v - upper - dr))
                    r, c = upper + dr - first_r, left + dc - first_c
                    inside = np.flatnonzero((w > 0) & (r >= 0) & (r < n_r) & (c >= 0) & (c < n_c))
                    value = window[r[inside].astype(int), c[inside].astype(int)]
                    known = ~np.isnan(value)
                    inside, value = inside[known], value[known]
                    total[inside] += w[inside] * value
                    weight[inside] += w[inside]
            weight = weight.reshape(-1, size * size)
            kept = np.flatnonzero(weight.any(axis=1))
            values = np.divide(total.reshape(weight.shape), weight, out=np.full(weight.shape, np.nan), where=weight > 0)[kept].ravel()
        some = target.take(kept)
        lists = pa.ListArray.from_arrays(np.arange(len(kept) + 1, dtype=np.int32) * (size * size), values if len(kept) else np.empty(0))
        return pa.table({"raster_id": some["raster_id"], "band": some["band"], "tile_r": some["_r"], "tile_c": some["_c"], "values": lists})

    return group


def _as_tiles(arrays: DataFrame, grid: tuple[float, float, float, float], size: int) -> DataFrame:
    x0, dx, y0, dy = grid
    side = F.lit(size)
    affine = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", (dx, 0, x0, 0, dy, y0), strict=True)])
    return arrays.select(*_KEYS, side.alias("h"), side.alias("w"), side.alias("tile_size"), affine.alias("affine"),
                         F.transform("values", lambda v: F.when(~F.isnan(v), v)).alias("values"))


def warp(tiles: DataFrame, source: int, target: int, grid: tuple[float, float, float, float], size: int = 256) -> DataFrame:
    """Tiles of ``size`` pixels on ``grid`` (x of the origin, pixel width, y of the origin, pixel height) of EPSG ``target``.

    ``tiles(raster_id, band, tile_r, tile_c, h, w, tile_size, affine, values)`` of EPSG ``source``, with axes along the map's.
    """
    x0, dx, y0, dy = grid
    pairs = cut(_reached(tiles, source, target, grid, size))
    a = F.col("affine")
    column, row = F.col("_c") * size, F.col("_r") * size

    def back(i: Column) -> Column:
        x, y = x0 + dx * (column + i % size + 0.5), y0 + dy * (row + F.floor(i / size) + 0.5)
        return crs.transform_pair(x, y, target, source)

    # few bytes, but much work for each row: not to be gathered into few tasks
    n_tasks = max(tiles.sparkSession.sparkContext.defaultParallelism, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = (pairs.select("raster_id", "band", "affine", "_r", "_c").distinct().repartition(n_tasks)
             .withColumn("_p", F.explode(F.array(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), back))))
             .select("raster_id", "band", "_r", "_c", F.transform("_p", lambda p: (p["x"] - a["c"]) / a["a"] - 0.5).alias("us"),
                     F.transform("_p", lambda p: (p["y"] - a["f"]) / a["e"] - 0.5).alias("vs")))
    side = max(GROUP_PIXELS // size, 1)
    group = [F.floor(F.col(c) / side).cast("int").alias(f"{c}_group") for c in ("_r", "_c")]
    around = (pairs.select(*_KEYS, *group).distinct().hint("merge").join(tiles.select(*_KEYS, "h", "w", "tile_size", "values"), _KEYS)
              .withColumnsRenamed({"raster_id": "s_raster", "band": "s_band"}))
    made = (asked.withColumns({"_r_group": group[0], "_c_group": group[1]}).groupBy("raster_id", "band", "_r_group", "_c_group")
            .cogroup(around.groupBy("s_raster", "s_band", "_r_group", "_c_group")).applyInArrow(_looked_up(size), _OUT))
    return _as_tiles(made, grid, size)


def mosaic(tiles: DataFrame, grid: tuple[float, float, float, float], size: int = 256, name: str = "mosaic") -> DataFrame:
    """Mean of the valid values of all rasters on one grid, tile by tile."""
    places = ["band", "tile_r", "tile_c"]
    known = F.transform("values", lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(1.0))
    filled = F.transform("values", lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))
    none = F.array_repeat(F.lit(0.0), size * size)

    def added(parts: DataFrame, *by: str) -> DataFrame:
        def plus(sums: Column, part: Column) -> Column:
            return F.struct(*[F.zip_with(sums[c], part[c], lambda a, b: a + b).alias(c) for c in ("total", "n")])

        gathered = parts.groupBy(*by).agg(F.collect_list(F.struct("total", "n")).alias("_parts"))
        whole = F.aggregate("_parts", F.struct(none.alias("total"), none.alias("n")), plus)
        return gathered.select(*by, F.explode(F.array(whole)).alias("_sums")).select(*by, "_sums.*")

    dealt = tiles.select(*places, F.pmod(F.xxhash64("raster_id"), F.lit(SCENES_AT_ONCE)).alias("_deal"), filled.alias("total"), known.alias("n"))
    sums = added(added(dealt, *places, "_deal"), *places)
    mean = F.zip_with("total", "n", lambda t, k: F.when(k > 0, t / k).otherwise(float("nan")))
    return _as_tiles(sums.select(F.lit(name).alias("raster_id"), *places, mean.alias("values")), grid, size)
