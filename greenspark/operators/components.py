"""Connected components of a graph and of raster masks, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenspark.operators.lineage import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) replace every edge by
    edges to a local minimum.  They need grouped minima and equi-joins only, so a node with very
    many neighbours is never gathered in one place.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").hint("merge").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.hint("merge").join(floor, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
                 .unionByName(floor.select("hi", F.col("m").alias("lo")).where("hi <> lo")).distinct())
        pairs = cut(small)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def mask_patches(mask: DataFrame, pixel_m: float, keys: list[str] | None = None) -> DataFrame:
    """4-connected patches of ``mask(row, col)``, within each raster of ``keys``: pixel count, square metres and pixel box."""
    keys = keys or []
    place = F.col("row") * F.lit(1 << 31).cast("bigint") + F.col("col")
    here = mask.select(*keys, "row", "col", (F.struct(*keys, place.alias("place")) if keys else place).alias("node")).distinct()
    right = here.select(*keys, "row", (F.col("col") - 1).alias("col"), F.col("node").alias("other"))
    below = here.select(*keys, (F.col("row") - 1).alias("row"), "col", F.col("node").alias("other"))
    links = here.hint("merge").join(right.unionByName(below), [*keys, "row", "col"]).select(F.col("node").alias("a"), F.col("other").alias("b"))
    labels = connected_components(links)
    named = here.hint("merge").join(labels, "node", "left").withColumn("patch", F.coalesce("component", "node"))
    if keys:
        named = named.withColumn("patch", F.col("patch.place"))
    return named.groupBy(*keys, "patch").agg(
        F.count(F.lit(1)).alias("n_pixels"), (F.count(F.lit(1)) * (pixel_m * pixel_m)).alias("m2"),
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def mask_outline(labelled: DataFrame, pixel_m: float, keys: list[str] | None = None) -> DataFrame:
    """Boundary edges of labelled pixels ``(patch, row, col)`` in metres, ready for ring stitching, within each raster of ``keys``.

    A pixel side is on the outline when the pixel across it has another label or none.
    """
    x0, y0 = F.col("col") * pixel_m, F.col("row") * pixel_m
    x1, y1 = (F.col("col") + 1) * pixel_m, (F.col("row") + 1) * pixel_m

    def side(ax, ay, bx, by, dr, dc):
        return F.struct(ax.cast("double").alias("x1"), ay.cast("double").alias("y1"), bx.cast("double").alias("x2"),
                        by.cast("double").alias("y2"), (F.col("row") + dr).alias("nr"), (F.col("col") + dc).alias("nc"))

    keys = [*(keys or []), "patch"]
    sides = labelled.select(*keys, F.inline(F.array(
        side(x0, y0, x1, y0, -1, 0), side(x1, y0, x1, y1, 0, 1), side(x1, y1, x0, y1, 1, 0), side(x0, y1, x0, y0, 0, -1))))
    across = labelled.select(*keys, F.col("row").alias("nr"), F.col("col").alias("nc"))
    return sides.hint("merge").join(across, [*keys, "nr", "nc"], "left_anti").select(*keys, "x1", "y1", "x2", "y2")
