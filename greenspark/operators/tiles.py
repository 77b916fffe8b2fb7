"""Hexagon and web-map tile coverings of areas, one row per (cell or tile, area)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenspark.functions import crs
from greenspark.functions import geometry as G
from greenspark.functions import hexgrid as H
from greenspark.operators import spatial


def polygon_cells(areas: DataFrame, res: int, key: str = "area_code", attributes: list[str] | None = None) -> DataFrame:
    """Hexagons whose centre lies in an area; a contested cell goes to the smallest key.

    Candidates are the axial coordinates over the box of each part, so work follows the area covered.
    """
    attributes = attributes or []
    s = H.EDGE_M[res]
    shaped = spatial.part_shapes(areas, [key, *attributes], "_edges", "_box")
    b = F.col("_box")
    rows = shaped.withColumn("_r", F.explode(F.sequence(F.floor(b["ymin"] / (1.5 * s)), F.ceil(b["ymax"] / (1.5 * s)))))
    width = s * math.sqrt(3)
    candidates = rows.withColumn("_q", F.explode(F.sequence(
        F.floor(b["xmin"] / width - F.col("_r") / 2), F.ceil(b["xmax"] / width - F.col("_r") / 2))))
    cell = H.pack(F.col("_q"), F.col("_r"), res)
    x, y = s * math.sqrt(3) * (F.col("_q") + F.col("_r") / 2), s * 1.5 * F.col("_r")
    inside = (candidates.withColumn("cell", cell).withColumn("cx", x).withColumn("cy", y)
              .where(F.col("cx").between(b["xmin"], b["xmax"]) & F.col("cy").between(b["ymin"], b["ymax"]))
              .where(G.contains_xy(F.col("_edges"), F.col("cx"), F.col("cy"))))
    winner = F.min(F.struct(key, "cx", "cy", *attributes)).alias("w")
    return inside.groupBy("cell").agg(winner).select("cell", "w.*")


def cell_values(pixels: DataFrame, res: int, values: list[str]) -> DataFrame:
    """Mean of each value column over the pixels of a hexagon."""
    return (pixels.groupBy(H.hex_cell(F.col("x"), F.col("y"), res).alias("cell"))
            .agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_pixels")))


def tile_cover(areas: DataFrame, epsg: int, zooms: range, fields: list[str]) -> DataFrame:
    """Web-Mercator tiles (z, x, y) that the box of each area touches, with the wanted existing fields."""
    kept = [c for c in fields if c in areas.columns]
    b = F.col("_box")
    boxed = spatial.once(areas, "_merc", crs.transform_geometry(F.col("geom"), epsg, 3857))
    boxed = spatial.once(boxed, "_box", G.bbox(F.col("_merc"))).select(*kept, "_box")
    zoomed = boxed.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    half = math.pi * crs.MERCATOR_RADIUS
    n = F.pow(F.lit(2.0), F.col("z"))

    def index(value):
        return F.greatest(F.lit(0), F.least((n - 1).cast("bigint"), F.floor(value / (2 * half) * n)))

    return (zoomed.withColumn("x", F.explode(F.sequence(index(b["xmin"] + half), index(b["xmax"] + half))))
            .withColumn("y", F.explode(F.sequence(index(half - b["ymax"]), index(half - b["ymin"]))))
            .select("z", "x", "y", *kept))
