"""Nearest polygon for every point, without a distance limit.

A ladder of grid cells, from ``FINEST`` to one that spans the whole extent, holds one corner of some polygon each.  On its
way up the ladder a point meets such corners; the closest one bounds the distance of its nearest polygon, so where polygons are dense
the bound is small.  Candidates are the polygons whose box lies within the bound of the point itself, found by boxes alone;
outlines join last, and exact distances decide.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenspark.functions import geometry as G
from greenspark.operators import spatial
from greenspark.operators.lineage import cut

FINEST = 0  # 1 m


def nearest(points: DataFrame, point_id: str, x: str, y: str, polygons: DataFrame, polygon_id: str,
            edges: str, box: str, out_id: str, out_distance: str, finest: int = FINEST) -> DataFrame:
    """(point_id, out_id, out_distance); ties go to the smallest polygon id."""
    # read five times below, and often the end of a long plan
    shapes = cut(polygons.select(F.col(polygon_id).alias("_pid"), F.col(edges).alias("_edges"), F.col(box).alias("_box")).where("_box is not null"))
    px, py = F.col(x), F.col(y)
    extent = (points.select(px.alias("xmin"), py.alias("ymin"), px.alias("xmax"), py.alias("ymax"))
              .unionByName(shapes.select("_box.*").select("xmin", "ymin", "xmax", "ymax"))
              .agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first())
    if extent[0] is None:
        raise ValueError("nearest needs at least one point and one polygon with coordinates")
    x0, y0 = extent[0], extent[1]
    top = max(finest + 1, math.ceil(math.log2(max(extent[2] - x0, extent[3] - y0) + 1)) + 1)
    ladder = F.explode(F.array(*[F.lit(level) for level in range(finest, top + 1)]))
    side = F.pow(F.lit(2.0), F.col("_level"))

    def cells(df: DataFrame, cx: str, cy: str) -> DataFrame:
        return df.withColumn("_level", ladder).withColumn("_lx", F.floor((F.col(cx) - x0) / side)).withColumn("_ly", F.floor((F.col(cy) - y0) / side))

    corner = F.col("_edges")[0]
    corners = shapes.select(corner["x1"].alias("_rx"), corner["y1"].alias("_ry"))
    reps = cells(corners, "_rx", "_ry").groupBy("_level", "_lx", "_ly").agg(F.min(F.struct("_rx", "_ry")).alias("_rep"))
    placed = points.select(point_id, px.cast("double").alias("_px"), py.cast("double").alias("_py")).where("_px is not null and _py is not null")
    far = F.hypot(F.col("_px") - F.col("_rep._rx"), F.col("_py") - F.col("_rep._ry"))
    bounds = (cells(placed, "_px", "_py").hint("merge").join(reps, ["_level", "_lx", "_ly"])
              .groupBy(point_id, "_px", "_py").agg((F.min(far) * (1 + 1e-12)).alias("_bound")))
    here = G.box(F.col("_px"), F.col("_py"), F.col("_px"), F.col("_py"))
    reached = cut(bounds.withColumn("_reach", spatial.grow(here, F.col("_bound"))))
    met = (spatial.box_join(reached, shapes.select("_pid", "_box"), "_reach", "_box")
           .where(G.box_distance(here, F.col("_box")) <= F.col("_bound")).select(point_id, "_px", "_py", "_pid"))
    best = F.min(F.struct(G.distance_xy(F.col("_edges"), F.col("_px"), F.col("_py")).alias("d"), F.col("_pid").alias("id")))
    return (met.hint("merge").join(shapes.select("_pid", "_edges"), "_pid").groupBy(point_id).agg(best.alias("_best"))
            .select(point_id, F.col("_best.id").alias(out_id), F.col("_best.d").alias(out_distance)))
