"""Spatial joins as equi-joins on a multi-level grid.

A box lives on the level whose cell side is the power of two at or above its longer side, so
it covers at most four cells there, however large it is.  A pair meets on the level of its
coarser member: each side is placed in its own cells and, for the levels that occur on the
other side, in the coarser cells above it.  Cells therefore shrink with the polygons in them,
and the candidates stay proportional to the true pairs.  The role in the join key keeps two
guests of a coarse cell from meeting there.  A pair found in several cells is kept in the one
that holds the lower-left corner of the common box, so no ``distinct`` is needed.

Popular cells are split by the adaptive skew join, which cuts either side of an inner join.
Joins of tables that grow are hinted as merge joins here and in the other operators: outlines are
computed from narrow, well compressed columns, so the size Spark estimates for them is far too low
and it would otherwise collect and broadcast a whole side through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenspark.functions import geometry as G
from greenspark.functions import kernels as K

_CELL = ["_role", "_level", "_cx", "_cy"]
_LEFT_VISITS, _RIGHT_VISITS = 0, 1
BROADCAST_BYTES = 64 << 20


def grow(box: Column, margin: Column) -> Column:
    return G.box(box["xmin"] - margin, box["ymin"] - margin, box["xmax"] + margin, box["ymax"] + margin)


def _own_level(box: Column) -> Column:
    side = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"], F.lit(1e-3))
    return F.ceil(F.log2(side)).cast("int")


def box_levels(df: DataFrame, box: str) -> list[int]:
    """Levels that occur on a side: some dozens of integers, whatever the table."""
    rows = df.where(F.col(box).isNotNull()).select(_own_level(F.col(box)).alias("l")).distinct().collect()
    return sorted(r.l for r in rows)


def _place(df: DataFrame, box: str, visits: list[tuple[int, int]], keep: Column) -> DataFrame:
    """One row per cell the box covers on each wanted (role, level)."""
    b, side = F.col(box), F.pow(F.lit(2.0), F.col("_level"))
    wanted = F.array(*[F.struct(F.lit(r).alias("_role"), F.lit(l).alias("_level")) for r, l in visits])
    return (df.where(b.isNotNull()).select("*", F.inline(wanted)).where(keep)
            .withColumn("_cx", F.explode(F.sequence(F.floor(b["xmin"] / side), F.floor(b["xmax"] / side))))
            .withColumn("_cy", F.explode(F.sequence(F.floor(b["ymin"] / side), F.floor(b["ymax"] / side)))))


def box_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str,
             left_levels: list[int] | None = None, right_levels: list[int] | None = None) -> DataFrame:
    """Every pair whose closed boxes overlap, once.  Column names must not clash.

    Levels are looked up when they are not given; a superset of the true levels is fine.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides of the spatial join: {sorted(clash)}")
    left_levels = box_levels(left, left_box) if left_levels is None else left_levels
    right_levels = box_levels(right, right_box) if right_levels is None else right_levels
    if not left_levels or not right_levels:
        return left.join(right, F.lit(False))
    up = [(_LEFT_VISITS, l) for l in right_levels if l >= left_levels[0]]
    down = [(_RIGHT_VISITS, l) for l in left_levels if l > right_levels[0]]
    lb, rb = F.col(left_box), F.col(right_box)
    level, visiting = F.col("_level"), F.col("_role") == _LEFT_VISITS
    placed_left = _place(left, left_box, up + down,
                         F.when(visiting, level >= _own_level(lb)).otherwise(level == _own_level(lb)))
    placed_right = _place(right, right_box, up + down,
                          F.when(visiting, level == _own_level(rb)).otherwise(level > _own_level(rb)))
    side = F.pow(F.lit(2.0), level)
    return (placed_left.hint("merge").join(placed_right, _CELL)
            .where(G.boxes_meet(lb, rb)
                   & (F.floor(F.greatest(lb["xmin"], rb["xmin"]) / side) == F.col("_cx"))
                   & (F.floor(F.greatest(lb["ymin"], rb["ymin"]) / side) == F.col("_cy")))
            .drop(*_CELL))


def intersects_join(left: DataFrame, right: DataFrame, left_edges: str, right_edges: str,
                    left_box: str, right_box: str) -> DataFrame:
    """Pairs of polygons that share at least one point."""
    return (box_join(left, right, left_box, right_box)
            .where(K.intersects(F.col(left_edges), F.col(right_edges))))


def overlap_join(left: DataFrame, right: DataFrame, left_edges: str, right_edges: str,
                 left_box: str, right_box: str, out: str = "overlap_m2") -> DataFrame:
    """Pairs with positive common area, and that area, computed once."""
    return (box_join(left, right, left_box, right_box)
            .withColumn(out, K.overlap_area(F.col(left_edges), F.col(right_edges)))
            .where(F.col(out) > 0))


def within_distance_join(left: DataFrame, right: DataFrame, left_edges: str, right_edges: str,
                         left_box: str, right_box: str, radius: float, out: str = "gap_m", exact: bool = True) -> DataFrame:
    """Pairs of polygons at most ``radius`` apart, with their distance.

    Without ``exact`` the distance of pairs whose boxes are apart and whose first corners are within the radius, so that they
    belong, is given as that of their boxes (above zero, at most the true one); only the other pairs go through the kernel.
    """
    grown = left.withColumn("_reach", grow(F.col(left_box), F.lit(float(radius))))
    near = (box_join(grown, right, "_reach", right_box).drop("_reach")
            .withColumn("_apart", G.box_distance(F.col(left_box), F.col(right_box))).where(F.col("_apart") <= radius))
    a, b = F.get(left_edges, F.lit(0)), F.get(right_edges, F.lit(0))
    sure = F.lit(False) if exact else (F.col("_apart") > 0) & (F.hypot(a["x1"] - b["x1"], a["y1"] - b["y1"]) <= radius)
    asked = near.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    gap = K.gap(*[F.when(~F.col("_sure"), F.col(edges)) for edges in (left_edges, right_edges)])
    return (asked.withColumn(out, F.when(F.col("_sure"), F.col("_apart")).otherwise(gap))
            .where(F.col(out) <= radius).drop("_apart", "_sure"))


def point_join(pts: DataFrame, polygons: DataFrame, x: str, y: str, edges: str, box: str) -> DataFrame:
    """Points with the polygons that contain them (half-open, see ``contains_xy``).

    A point sits in one cell per level that occurs among the polygons, so no pair repeats.  The
    pass that looks up the levels also measures the polygons: their cells are broadcast when they
    provably fit, otherwise both sides are shuffled by cell and popular cells are split there.
    """
    px, py, b = F.col(x), F.col(y), F.col(box)
    found = (polygons.where(b.isNotNull()).groupBy(_own_level(b).alias("l"))
             .agg(F.sum(F.size(edges)).alias("edges"), F.count(F.lit(1)).alias("n")).collect())
    if not found:
        return pts.join(polygons, F.lit(False))
    levels = sorted(r.l for r in found)
    # at most four cells per polygon, 32 bytes per edge, 512 for the row around them
    fits = sum(4 * (32 * r.edges + 512 * r.n) for r in found) <= BROADCAST_BYTES
    side = F.pow(F.lit(2.0), F.col("_level"))
    placed = (pts.withColumn("_level", F.explode(F.array(*[F.lit(l) for l in levels])))
              .withColumn("_cx", F.floor(px / side)).withColumn("_cy", F.floor(py / side)))
    cells = _place(polygons, box, [(0, l) for l in levels], F.col("_level") == _own_level(b)).drop("_role")
    met = placed.join(F.broadcast(cells), _CELL[1:]) if fits else placed.hint("merge").join(cells, _CELL[1:])
    return (met
            .where(px.between(b["xmin"], b["xmax"]) & py.between(b["ymin"], b["ymax"]))
            .where(G.contains_xy(F.col(edges), px, py))
            .drop(*_CELL))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections must not evaluate again.

    The optimizer copies expressions into every filter it pushes through a projection; it
    does not look through a generator, and exploding a one-element array keeps the rows as they are.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def with_shape(df: DataFrame, geom: str, edges: str = "edges", box: str = "box") -> DataFrame:
    """Add the edge list and bounding box of a geometry column once, for reuse by joins."""
    return once(once(df, edges, G.edges(F.col(geom))), box, G.edges_bbox(F.col(edges)))


def part_shapes(df: DataFrame, keys: list[str], edges: str, box: str, geom: str = "geom") -> DataFrame:
    """``keys`` with edges and box of every polygon part, so scattered multipolygons join by small boxes.

    Rings may run either way; shells are turned counter-clockwise here, as the kernels need them.
    """
    parts = df.select(*keys, F.explode(G.normalise(F.col(geom))).alias("_part"))
    return with_shape(parts.withColumn("_part", F.array("_part")), "_part", edges, box).drop("_part")
