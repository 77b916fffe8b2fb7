"""Raster operators on pixel tables ``(row, col, value ...)`` and tile tables.

Pixels are rows with integer keys; a tile is one row with ``h * w`` values in row order.  Only
operators that look at other pixels shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenspark.operators.ordering import quantiles


def explode_tiles(tiles: DataFrame, value: str = "value") -> DataFrame:
    """Tile table to pixels; the pixel centre follows from the affine of the raster."""
    px = (tiles.select("raster_id", "band", "tile_r", "tile_c", "h", "w", "tile_size", "affine",
                       F.posexplode("values").alias("_i", value))
          .withColumn("row", F.col("tile_r") * F.col("tile_size") + F.expr("_i div w"))
          .withColumn("col", F.col("tile_c") * F.col("tile_size") + F.col("_i") % F.col("w")))
    a, c, r = F.col("affine"), F.col("col") + 0.5, F.col("row") + 0.5
    return px.select("raster_id", "band", "row", "col",
                     (a["a"] * c + a["b"] * r + a["c"]).alias("x"), (a["d"] * c + a["e"] * r + a["f"]).alias("y"), value)


_TILE = "tile_r int, tile_c int, values array<double>"


def tile_table(pixels: DataFrame, value: str, tile_size: int, affine: tuple[float, ...], raster_id: str = "raster", band: str = "band") -> DataFrame:
    """Pixels ``(row, col, value)`` of one raster as full tiles; pixels that are not there are NULL.

    Pixels are sorted by tile, so a task fills one tile after the other; of pixels in one place the largest value counts.
    """
    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, values = None, None
        for batch in batches:
            keys, at, v = batch[["tile_r", "tile_c"]].to_numpy(), batch["_at"].to_numpy(), batch["_v"].to_numpy()
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1) if len(keys) else []
            done = []
            for first, last in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                if tuple(keys[first]) != key:
                    if key is not None:
                        done.append((*key, values))
                    key, values = tuple(keys[first]), np.full(tile_size * tile_size, np.nan)
                values[at[first:last]] = v[first:last]
            yield pd.DataFrame(done, columns=["tile_r", "tile_c", "values"])
        if key is not None:
            yield pd.DataFrame([(*key, values)], columns=["tile_r", "tile_c", "values"])

    single = pixels.groupBy("row", "col").agg(F.max(value).alias("_v")).where("_v is not null")
    placed = single.select(F.floor(F.col("row") / tile_size).cast("int").alias("tile_r"), F.floor(F.col("col") / tile_size).cast("int").alias("tile_c"),
                           (F.pmod("row", F.lit(tile_size)) * tile_size + F.pmod("col", F.lit(tile_size))).cast("int").alias("_at"),
                           F.col("_v").cast("double").alias("_v"))
    tiles = placed.repartition("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c").mapInPandas(filled, _TILE)
    side = F.lit(tile_size)
    names = ("a", "b", "c", "d", "e", "f")
    return tiles.select(
        F.lit(raster_id).alias("raster_id"), F.lit(band).alias("band"), "tile_r", "tile_c", side.alias("h"), side.alias("w"), side.alias("tile_size"),
        F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, affine, strict=True)]).alias("affine"),
        F.transform("values", lambda v: F.when(~F.isnan(v), v)).alias("values"))


def mosaic_mean(obs: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Per pixel mean over scenes of the valid (positive) values of each band.

    Rounding to 12 decimals removes the dependence on the order of summation, so that a rerun
    task, or another partitioning, gives the same pixel and later thresholds the same mask.
    """
    return obs.groupBy(*keys).agg(*[F.round(F.avg(F.when(F.col(b) > 0, F.col(b))), 12).alias(b) for b in bands])


def band_coverage(obs: DataFrame, bands: list[str]) -> DataFrame:
    """One row per band: share of pixels with data, smallest and largest value."""
    stats = []
    for b in bands:
        v = F.when(F.col(b) > 0, F.col(b))
        stats.append(F.struct(F.lit(b).alias("band"), F.avg(v.isNotNull().cast("double")).alias("coverage"),
                              F.min(v).alias("min_value"), F.max(v).alias("max_value")))
    return obs.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def yearly_composite(obs: DataFrame, keys: list[str], value: str, scene: str) -> DataFrame:
    """Median over scenes and number of scenes per key; exact for popular keys too."""
    valid = obs.where(F.col(value).isNotNull())
    medians = quantiles(valid, keys, value, {f"{value}_median": 0.5})
    scenes = valid.groupBy(*keys, scene).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_scenes"))
    return medians.hint("merge").join(scenes, keys)


def season(obs: DataFrame, date: str, first_month: int = 6, last_month: int = 8) -> DataFrame:
    return obs.where(F.month(date).between(first_month, last_month))


def change(early: DataFrame, late: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Late minus early for pixels valid in both dates."""
    e = early.select(*keys, F.col(value).alias("_early"))
    return (late.select(*keys, F.col(value).alias("_late")).hint("merge").join(e, keys)
            .select(*keys, F.col("_early").alias("early"), F.col("_late").alias("late"),
                    (F.col("_late") - F.col("_early")).alias("delta")))


def pyramid(pixels: DataFrame, value: str, levels: int = 6, keys: list[str] | None = None) -> DataFrame:
    """Overview levels 1..levels: mean of the valid base pixels below each cell.

    Every pixel adds to one cell per level with a map-side sum and count, so all levels come out
    of one shuffle.
    """
    keys = keys or []
    lifted = pixels.where(F.col(value).isNotNull()).select(
        *keys, "row", "col", value, F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"))
    factor = F.pow(F.lit(2.0), F.col("level"))
    return lifted.groupBy(*keys, "level", F.floor(F.col("row") / factor).alias("row"),
                          F.floor(F.col("col") / factor).alias("col")).agg(
        F.avg(value).alias(value), F.count(F.lit(1)).alias("n_pixels"))


def focal_std(pixels: DataFrame, value: str, radius: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Population standard deviation in a square window around each valid pixel, within each raster of ``keys``.

    Each pixel sends its value to the windows it belongs to and the sums meet in one shuffle.
    """
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"))
                        for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)])
    keys = keys or []
    valid = pixels.where(F.col(value).isNotNull())
    sent = valid.select(*keys, "row", "col", value, F.explode(offsets).alias("o"))
    here = (F.col("o.r") == 0) & (F.col("o.c") == 0)
    return (sent.groupBy(*keys, (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))
            .agg(F.stddev_pop(value).alias("texture"), F.count(F.lit(1)).alias("n_window"),
                 F.max(here).alias("_centre"))
            .where("_centre").drop("_centre"))


def resample(pixels: DataFrame, value: str, size: float, new_size: float, shift_x: float = 0.0,
             shift_y: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Bilinear resampling, nodata aware, of each raster of ``keys``.

    Source pixel centres are at ``(col + 0.5) * size``; target centres at
    ``(col + 0.5) * new_size + shift``.  Target cells come from the source cells they touch, so no
    target grid is enumerated; weights of missing neighbours are redistributed.
    """
    span = int(size // new_size) + 2
    px, py = (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size
    reach = F.sequence(F.lit(-span), F.lit(span))
    near_c = F.floor((px - shift_x) / new_size)
    near_r = F.floor((py - shift_y) / new_size)
    keys = keys or []
    sent = (pixels.where(F.col(value).isNotNull()).select(*keys, value, px.alias("_px"), py.alias("_py"),
                                                          near_c.alias("_nc"), near_r.alias("_nr"))
            .withColumn("_dc", F.explode(reach)).withColumn("_dr", F.explode(reach))
            .withColumn("col", F.col("_nc") + F.col("_dc")).withColumn("row", F.col("_nr") + F.col("_dr")))
    tx = (F.col("col") + 0.5) * new_size + shift_x
    ty = (F.col("row") + 0.5) * new_size + shift_y
    wx, wy = 1 - F.abs(tx - F.col("_px")) / size, 1 - F.abs(ty - F.col("_py")) / size
    weighted = sent.withColumn("_w", wx * wy).where((wx > 0) & (wy > 0))
    return (weighted.groupBy(*keys, "row", "col")
            .agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value), F.sum("_w").alias("weight")))


def resample_grid(grid: DataFrame, pixels: DataFrame, value: str, size: float, to_source, keys: list[str] | None = None) -> DataFrame:
    """Bilinear resampling of each raster of ``keys`` onto an explicit grid ``(row, col, x, y)`` in another reference system."""
    sx, sy = to_source(F.col("x"), F.col("y"))
    at = grid.select("row", "col", (sx / size - 0.5).alias("_u"), (sy / size - 0.5).alias("_v"))
    corners = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])
    asked = (at.withColumn("_o", F.explode(corners))
             .withColumn("_sc", F.floor("_u") + F.col("_o.c")).withColumn("_sr", F.floor("_v") + F.col("_o.r"))
             .withColumn("_w", (1 - F.abs(F.col("_u") - F.col("_sc"))) * (1 - F.abs(F.col("_v") - F.col("_sr"))))
             .where("_w > 0"))
    keys = keys or []
    source = pixels.where(F.col(value).isNotNull()).select(*keys, F.col("row").alias("_sr"), F.col("col").alias("_sc"), value)
    return (asked.hint("merge").join(source, ["_sr", "_sc"]).groupBy(*keys, "row", "col")
            .agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value), F.sum("_w").alias("weight")))


def share(condition: Column) -> Column:
    """Mean of a condition over rows where it is known."""
    return F.avg(condition.cast("int"))
