"""Zonal statistics: pixels whose centre lies in a polygon, aggregated per polygon.

``pixels_in_areas`` joins pixel rows.  ``tile_zonal_stats`` works on whole tiles: boxes of tiles and polygons are joined first; a tile
that no edge comes near is inside or outside as a whole and gives its own sums, which are made once and without moving a pixel; only the
tiles on an outline travel, once each, to meet the polygons that cut them and are cut along scan lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenspark.functions import geometry as G

from greenspark.functions import spectral as S
from greenspark.operators import spatial
from greenspark.operators.lineage import cut
from greenspark.operators.ordering import quantiles
from greenspark.operators.raster import share


def pixels_in_areas(pixels: DataFrame, areas: DataFrame, key: str = "area_code") -> DataFrame:
    """Clip: each pixel (with ``x``, ``y``) joined to the areas that contain its centre.

    Multipolygons are joined part by part, which keeps boxes tight; the parts are disjoint.
    """
    shaped = spatial.part_shapes(areas, [key], "_edges", "_box")
    return spatial.point_join(pixels, shaped, "x", "y", "_edges", "_box").drop("_edges", "_box")


def zonal_stats(clipped: DataFrame, value: str, key: str = "area_code") -> DataFrame:
    """All moments in one aggregation; NULL pixels count as uncovered."""
    v = F.col(value)
    return clipped.groupBy(key).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))


def change_props(clipped: DataFrame, delta: str, key: str = "area_code") -> DataFrame:
    """Mean change and shares of pixels that became greener and greyer (valid in both dates)."""
    d = F.col(delta)
    return clipped.groupBy(key).agg(
        F.avg(d).alias("mean_delta_ndvi"), share(d > 0).alias("prop_greener"), share(d < 0).alias("prop_greyer"),
        F.count(d).alias("n_valid"))


def change_uncertainty(clipped: DataFrame, delta: str, key: str = "area_code") -> DataFrame:
    """Standard error of the mean change per area."""
    d = F.col(delta)
    return clipped.groupBy(key).agg(
        F.avg(d).alias("mean_delta_ndvi"), F.stddev_samp(d).alias("sd_delta"), F.count(d).alias("n_valid"),
        (F.stddev_samp(d) / F.sqrt(F.nullif(F.count(d), F.lit(0)))).alias("se_delta"))


def spectral_props(clipped: DataFrame, key: str = "area_code") -> DataFrame:
    """Spread, deciles, water, bare soil and canopy shares per area from the four bands."""
    b = {c: F.col(c) for c in ("B03", "B04", "B08")}
    px = clipped.withColumn("_ndvi", S.ndvi(b["B08"], b["B04"])).withColumn("_ndwi", S.ndwi(b["B03"], b["B08"]))
    shares = px.groupBy(key).agg(
        F.stddev_pop("_ndvi").alias("ndvi_std"), share(F.col("_ndwi") > 0.2).alias("prop_water"),
        share(S.bare_soil(b["B04"], b["B08"])).alias("prop_bare_soil"),
        share(F.col("_ndvi") > 0.6).alias("canopy_share"))
    tails = quantiles(px, [key], "_ndvi", {"ndvi_p10": 0.1, "ndvi_p90": 0.9})
    return shares.hint("merge").join(tails, key, "left")


TILE_KEYS = ["raster_id", "band", "tile_r", "tile_c"]
#: Polygons that are cut out of one copy of a tile; a tile below more of them is sent several times.
POLYGONS_PER_TILE = 256
_PARTIAL = "n bigint, total double, spread double, low double, high double"


def _tile_boxes(tiles: DataFrame) -> DataFrame:
    """Keys and box of every tile of rasters whose axes are those of the map."""
    a = F.col("affine")
    straight = F.when((a["b"] == 0) & (a["d"] == 0), True).otherwise(F.raise_error(F.lit("tiles of a turned raster")).cast("boolean"))

    def at(scale, offset, index, size):
        first = F.col(index) * F.col("tile_size")
        return a[scale] * first + a[offset], a[scale] * (first + F.col(size)) + a[offset]

    (xa, xb), (ya, yb) = at("a", "c", "tile_c", "w"), at("e", "f", "tile_r", "h")
    box = G.box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))
    return tiles.where(straight).select(*TILE_KEYS, box.alias("_tbox"))


def _tile_sums(tiles: DataFrame) -> DataFrame:
    """n, total, spread (squared distance from the tile's mean), low and high of the valid pixels of every tile."""
    valid = F.filter("values", lambda v: v.isNotNull() & ~F.isnan(v))
    zero = F.lit(0.0)
    sized = tiles.select(*TILE_KEYS, valid.alias("_v")).withColumn("n", F.size("_v").cast("bigint")).withColumn(
        "total", F.aggregate("_v", zero, lambda s, v: s + v))
    mean = F.try_divide("total", F.col("n").cast("double"))
    return sized.select(*TILE_KEYS, "n", "total", F.aggregate("_v", zero, lambda s, v: s + (v - mean) * (v - mean)).alias("spread"),
                        F.array_min("_v").alias("low"), F.array_max("_v").alias("high"))


def scan_line_mask(edges: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which pixel centres (ys x xs, xs ascending) lie in the polygon with these edges: left ends of spans count, right ends do not."""
    x1, y1, x2, y2 = edges.T
    edge, row = np.nonzero((y1[:, None] > ys) != (y2[:, None] > ys))
    at = x1[edge] + (x2[edge] - x1[edge]) * ((ys[row] - y1[edge]) / (y2[edge] - y1[edge]))
    order = np.lexsort((at, row))
    column, row = np.searchsorted(xs, at[order], "left"), row[order]
    turns = np.zeros((len(ys), len(xs) + 1), np.int32)
    np.add.at(turns, (row, column), 1)  # crossings of a row come in pairs
    return np.cumsum(turns, axis=1)[:, :-1] % 2 == 1


def _cut_tiles(key_type: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tile in batch.itertuples(index=False):
                values = np.array(tile.values, float).reshape(tile.h, tile.w)
                a, c, e, f = tile.scale_x, tile.x0, tile.scale_y, tile.y0
                xs = a * (tile.tile_c * tile.tile_size + np.arange(tile.w) + 0.5) + c
                ys = e * (tile.tile_r * tile.tile_size + np.arange(tile.h) + 0.5) + f
                if a < 0:
                    xs, values = xs[::-1], values[:, ::-1]
                known = ~np.isnan(values)
                for key, flat in zip(tile.keys, tile.outlines, strict=True):
                    held = values[scan_line_mask(np.asarray(flat, float).reshape(-1, 4), xs, ys) & known]
                    if len(held):
                        out.append((tile.raster_id, tile.band, key, len(held), held.sum(), ((held - held.mean()) ** 2).sum(), held.min(), held.max()))
            yield pd.DataFrame(out, columns=["raster_id", "band", "key", *[c.split()[0] for c in _PARTIAL.split(", ")]])

    return rows, f"raster_id string, band string, key {key_type}, {_PARTIAL}"


def tile_zonal_stats(tiles: DataFrame, areas: DataFrame, key: str = "area_code") -> DataFrame:
    """n, mean, std, min and max of the valid pixels of each raster band in each area.

    ``tiles(raster_id, band, tile_r, tile_c, h, w, tile_size, affine, values)``; NULL and NaN values are nodata.
    """
    shaped = spatial.part_shapes(areas.select(F.col(key).alias("_key"), "geom"), ["_key"], "_edges", "_box")
    pairs = spatial.box_join(_tile_boxes(tiles), shaped, "_tbox", "_box")
    t = F.col("_tbox")
    # rows of pixels meet no other edges, and those to the right of the tile turn nothing in it
    beside = F.filter("_edges", lambda e: (F.least(e["y1"], e["y2"]) <= t["ymax"]) & (F.greatest(e["y1"], e["y2"]) >= t["ymin"]))
    near = F.exists("_beside", lambda e: (F.least(e["x1"], e["x2"]) <= t["xmax"]) & (F.greatest(e["x1"], e["x2"]) >= t["xmin"]))
    level = spatial.once(pairs, "_beside", beside).drop("_edges")
    met = cut(spatial.once(level, "_near", near).select(
        *TILE_KEYS, "_key", "_near", F.when(F.col("_near"), F.filter("_beside", lambda e: F.least(e["x1"], e["x2"]) <= t["xmax"])).alias("_edges"),
        F.when(~F.col("_near"), G.contains_xy(F.col("_beside"), (t["xmin"] + t["xmax"]) / 2, (t["ymin"] + t["ymax"]) / 2)).alias("_in")))
    whole = met.where("_in").select(*TILE_KEYS, "_key").hint("merge").join(_tile_sums(tiles), TILE_KEYS).where("n > 0").select(
        "raster_id", "band", F.col("_key").alias("key"), "n", "total", "spread", "low", "high")
    outline = F.flatten(F.transform("_edges", lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])))
    edged = met.where("_near").select(*TILE_KEYS, "_key", outline.alias("_flat"))
    crowd = edged.groupBy(*TILE_KEYS).agg(F.ceil(F.count(F.lit(1)) / POLYGONS_PER_TILE).alias("_copies"))
    dealt = edged.hint("merge").join(crowd, TILE_KEYS).withColumn("_copy", F.pmod(F.xxhash64("_key", "_flat"), F.col("_copies")))
    lists = dealt.groupBy(*TILE_KEYS, "_copy").agg(F.collect_list(F.struct("_key", "_flat")).alias("_p")).select(
        *TILE_KEYS, F.col("_p._key").alias("keys"), F.col("_p._flat").alias("outlines"))
    a = F.col("affine")
    travelling = tiles.select(*TILE_KEYS, "h", "w", "tile_size", a["a"].alias("scale_x"), a["c"].alias("x0"), a["e"].alias("scale_y"),
                              a["f"].alias("y0"), "values").hint("merge").join(lists, TILE_KEYS)
    cutter, form = _cut_tiles(dict(shaped.dtypes)["_key"])
    partial = whole.unionByName(travelling.mapInPandas(cutter, form))
    n, mean = F.sum("n"), F.sum("total") / F.sum("n")
    own = F.col("total") / F.col("n")
    # the spread around the common mean from the spreads around the tiles' means
    spread = F.sum("spread") + F.sum(F.col("total") * own) - F.sum("total") * mean
    return partial.groupBy("raster_id", "band", F.col("key").alias(key)).agg(
        n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0)) / n).alias("std"), F.min("low").alias("min"), F.max("high").alias("max"))
