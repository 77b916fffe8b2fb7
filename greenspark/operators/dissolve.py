"""Union of tilings: shared sides cancel, the rest is the outline.

Sides cancel piece by piece, so in a tiling with T-junctions (a corner in the middle of a neighbour's side) they are first
cut at the corners that lie on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenspark.functions import geometry as G
from greenspark.operators.lineage import cut
from greenspark.operators.spatial import box_join


def split_at_corners(edges: DataFrame, groups: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Edges ``(groups, x1, y1, x2, y2)`` cut at the corners of their group that lie on them.

    Corners and edges meet in grid cells of the size of the edge.  A corner cuts an edge if it is within ``tolerance`` of it and away
    from its ends; corners within ``tolerance`` of each other must be equal.
    """
    named = cut(edges.select(*groups, "x1", "y1", "x2", "y2").withColumn("_edge", F.monotonically_increasing_id()))
    margin = F.lit(tolerance)
    boxed = named.withColumn("_ebox", G.box(F.least("x1", "x2") - margin, F.least("y1", "y2") - margin,
                                            F.greatest("x1", "x2") + margin, F.greatest("y1", "y2") + margin))
    corners = edges.select(*[F.col(g).alias(f"_c_{g}") for g in groups], F.col("x1").alias("_px"), F.col("y1").alias("_py")).distinct()
    corners = corners.withColumn("_pbox", G.box(F.col("_px"), F.col("_py"), F.col("_px"), F.col("_py")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.hypot(dx, dy)
    along = ((F.col("_px") - F.col("x1")) * dx + (F.col("_py") - F.col("y1")) * dy) / length
    away = F.abs((F.col("_px") - F.col("x1")) * dy - (F.col("_py") - F.col("y1")) * dx) / length
    met = box_join(boxed, corners, "_ebox", "_pbox")
    for g in groups:
        met = met.where(F.col(g).eqNullSafe(F.col(f"_c_{g}")))
    on = met.where((away <= tolerance) & (along > tolerance) & (along < length - tolerance))
    cuts = on.groupBy("_edge").agg(F.array_sort(F.collect_set(F.struct(along.alias("at"), F.col("_px").alias("x"), F.col("_py").alias("y")))).alias("_cuts"))
    inner = F.coalesce(F.transform("_cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), F.array().cast("array<struct<x:double,y:double>>"))
    chain = F.concat(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))), inner,
                     F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    return (named.hint("merge").join(cuts, "_edge", "left").select(*groups, F.explode(G.ring_edges(chain)).alias("_e"))
            .select(*groups, "_e.x1", "_e.y1", "_e.x2", "_e.y2"))


def dissolved_edges(areas: DataFrame, groups: list[str], geom: str = "geom", t_junctions: bool = False) -> DataFrame:
    """Directed outline edges per group; ``t_junctions`` cuts sides at foreign corners first.

    A side used in both directions lies between two areas of the group.  Counting it with its
    sign needs one aggregation with map-side combine, whatever the size of a group.  The edge
    table is a complete description of the union: area, centroid, containment and overlap work on it.
    """
    rows = areas.select(*groups, F.explode(G.edges(F.col(geom))).alias("e")).select(*groups, "e.*")
    if t_junctions:
        rows = split_at_corners(rows, groups)
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))

    def low_first(a, b):
        return F.when(forward, F.col(a)).otherwise(F.col(b))

    net = (rows.select(*groups, low_first("x1", "x2").alias("ax"), low_first("y1", "y2").alias("ay"),
                       low_first("x2", "x1").alias("bx"), low_first("y2", "y1").alias("by"),
                       F.when(forward, 1).otherwise(-1).alias("dir"))
           .groupBy(*groups, "ax", "ay", "bx", "by").agg(F.sum("dir").alias("net")).where("net <> 0"))
    ahead = F.col("net") > 0

    def directed(a, b):
        return F.when(ahead, F.col(a)).otherwise(F.col(b))

    return net.select(*groups, directed("ax", "bx").alias("x1"), directed("ay", "by").alias("y1"),
                      directed("bx", "ax").alias("x2"), directed("by", "ay").alias("y2"))


def _looked_up(asked: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with the one row of ``there`` per key, as a union and a grouping; few rows may ask for one key.

    The size Spark estimates for a join is the product of both sides.  Joined with itself round after round, a table gets an
    estimate with twice the digits each time, until planning with these numbers takes far longer than the work.
    """
    mine, theirs = ([c for c in df.columns if c not in keys] for df in (asked, there))
    both = asked.select(*keys, F.struct(*mine).alias("_asked")).unionByName(
        there.select(*keys, F.struct(*theirs).alias("_there")), allowMissingColumns=True)
    met = both.groupBy(*keys).agg(F.collect_list("_asked").alias("_asked"), F.first("_there", ignorenulls=True).alias("_there"))
    return met.where("_there is not null").select(*keys, F.explode("_asked").alias("_asked"), "_there").select(*keys, "_asked.*", "_there.*")


def dissolved_rings(areas: DataFrame, groups: list[str], geom: str = "geom", t_junctions: bool = False) -> DataFrame:
    """One closed ring per row, stitched from the outline edges by pointer doubling.

    Every edge points to the edge that starts where it ends (the sharpest right turn where four
    edges meet, which keeps touching rings apart).  In each round an edge learns the smallest
    edge id within twice the distance, so a ring of n edges is done after log2(n) joins.
    """
    edges = dissolved_edges(areas, groups, geom, t_junctions)
    heading = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    named = edges.select(*groups, "x1", "y1", "x2", "y2", heading.alias("heading"),
                         F.concat_ws(",", "x1", "y1", "x2", "y2").alias("id"))
    after = named.select(*groups, F.col("x1").alias("x2"), F.col("y1").alias("y2"),
                         F.col("heading").alias("next_heading"), F.col("id").alias("next"))
    turn = F.pmod(F.col("next_heading") - F.col("heading") + F.lit(3 * 3.141592653589793), F.lit(2 * 3.141592653589793))
    links = cut(named.hint("merge").join(after, [*groups, "x2", "y2"])
                .groupBy(*groups, "id", "x1", "y1", "x2", "y2").agg(F.min_by("next", turn).alias("next")))
    state = links.select(*groups, "id", F.col("next").alias("far"), F.least("id", "next").alias("low"))
    while True:
        there = state.select(*groups, F.col("id").alias("far"), F.col("far").alias("far2"), F.col("low").alias("low2"))
        doubled = cut(_looked_up(state, there, [*groups, "far"])
                      .select(*groups, "id", F.col("far2").alias("far"), F.least("low", "low2").alias("low"),
                              (F.col("low2") < F.col("low")).alias("changed")))
        state = doubled.drop("changed")
        if not doubled.where("changed").limit(1).count():
            break
    # distance from the smallest edge: doubling again, now along the ring from its start
    order = links.hint("merge").join(state.select(*groups, "id", F.col("low").alias("ring")), [*groups, "id"])
    walk = order.select(*groups, "ring", "id", F.col("next").alias("jump"), F.lit(1).cast("bigint").alias("steps"))
    walk = walk.withColumn("at_start", F.col("jump") == F.col("ring"))
    while True:
        there = walk.select(*groups, F.col("id").alias("jump"), F.col("jump").alias("jump2"),
                            F.col("steps").alias("steps2"), F.col("at_start").alias("start2"))
        # edges at their start stay as they are; each of the others points to an edge of its own
        further = _looked_up(walk.where(~F.col("at_start")), there, [*groups, "jump"]).select(
            *groups, "ring", "id", F.col("jump2").alias("jump"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("start2").alias("at_start"))
        walk = cut(walk.where("at_start").select(*further.columns).unionByName(further))
        if not walk.where(~F.col("at_start")).limit(1).count():
            break
    placed = order.hint("merge").join(walk.select(*groups, "id", "steps"), [*groups, "id"])
    pts = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("steps", "x1", "y1")))),
                      lambda s: F.struct(s["x1"].alias("x"), s["y1"].alias("y")))
    ring = F.concat(pts, F.slice(pts, 1, 1))
    return (placed.groupBy(*groups, "ring").agg(ring.alias("points"))
            .select(*groups, "points", (F.size("points") - 1).alias("n_points"),
                    G.edges_area(G.ring_edges(F.col("points"))).alias("area_m2")))
