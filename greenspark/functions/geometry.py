"""Planar geometry as Spark column expressions.

A geometry is ``array<array<array<struct<x,y>>>>``: parts, rings of a part (shell first),
closed point lists.  ``normalise`` orients shells counter-clockwise and holes clockwise, so
every measure is one signed sum over directed edges and holes need no special case.  The
edge list, ``array<struct<x1,y1,x2,y2>>``, is what the measures, joins and kernels consume.

All coordinates are metres in a projected reference system; see ``greenspark.functions.crs``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOM_TYPE = "array<array<array<struct<x:double,y:double>>>>"
EDGES_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
COMPILED_EDGES = 8
BOX_TYPE = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def point(x, y) -> Column:
    return F.struct(F.col(x).cast("double").alias("x") if isinstance(x, str) else x.cast("double").alias("x"),
                    F.col(y).cast("double").alias("y") if isinstance(y, str) else y.cast("double").alias("y"))


def polygon(points: list[tuple[Column, Column]]) -> Column:
    """One-part, one-ring polygon through the given corner columns; the ring is closed here."""
    ring = [point(x, y) for x, y in points]
    return F.array(F.array(F.array(*ring, ring[0])))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.cast("double").alias("xmin"), ymin.cast("double").alias("ymin"),
                    xmax.cast("double").alias("xmax"), ymax.cast("double").alias("ymax"))


def _given(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it; NULL stays NULL inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def points(geom: Column) -> Column:
    return F.flatten(F.flatten(geom))


def bbox(geom: Column) -> Column:
    """Bounding box, NULL for a NULL or empty geometry."""
    pts = points(geom)
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.when(F.size(pts) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def edges_bbox(edges: Column) -> Column:
    """Bounding box of closed rings given as edges."""
    xs, ys = F.transform(edges, lambda e: e["x1"]), F.transform(edges, lambda e: e["y1"])
    return F.when(F.size(edges) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def ring_edges(ring: Column) -> Column:
    def joined(points):
        n = F.greatest(F.size(points) - 1, F.lit(0))
        return F.zip_with(
            F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n),
            lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))

    return _given(ring, joined)


def edges(geom: Column) -> Column:
    """Directed edges of every ring of every part."""
    return F.flatten(F.transform(F.flatten(geom), ring_edges))


def _signed_sum(edge_list: Column, term) -> Column:
    return F.aggregate(edge_list, F.lit(0.0), lambda acc, e: acc + term(e))


def edges_area(edge_list: Column) -> Column:
    """Shoelace area in trapezoid form, relative to the first vertex to keep the terms small."""
    def measured(known):
        total = _given(F.get(known, F.lit(0))["y1"], lambda y0: _signed_sum(
            known, lambda e: (e["x1"] - e["x2"]) * ((e["y1"] - y0) + (e["y2"] - y0))))
        return F.when(F.size(known) > 0, total / 2)

    return _given(edge_list, measured)


def area(geom: Column) -> Column:
    """Area of a normalised geometry in square metres; holes subtract."""
    return edges_area(edges(geom))


def perimeter(geom: Column) -> Column:
    return _signed_sum(edges(geom), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def edges_centroid(edge_list: Column) -> Column:
    """Area-weighted centroid; NULL when the area is zero."""
    def measured(known):
        return _given(F.get(known, F.lit(0)), lambda first: _centroid_from(known, first["x1"], first["y1"]))

    return _given(edge_list, measured)


def _centroid_from(edge_list: Column, x0: Column, y0: Column) -> Column:
    def step(acc, e):
        ax, ay, bx, by = e["x1"] - x0, e["y1"] - y0, e["x2"] - x0, e["y2"] - y0
        return _given(ax * by - bx * ay, lambda cross: F.struct(
            (acc["a"] + cross).alias("a"), (acc["x"] + (ax + bx) * cross).alias("x"), (acc["y"] + (ay + by) * cross).alias("y")))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(
        edge_list, zero, step,
        lambda m: F.when(m["a"] != 0, F.struct((x0 + F.try_divide(m["x"], 3 * m["a"])).alias("x"),
                                               (y0 + F.try_divide(m["y"], 3 * m["a"])).alias("y"))))


def centroid(geom: Column) -> Column:
    return edges_centroid(edges(geom))


def contains_xy(edge_list: Column, px: Column, py: Column) -> Column:
    """Even-odd test with half-open edges: in a gap-free tiling a point falls in one area only."""
    def crosses(e):
        lhs, rhs = (px - e["x1"]) * (e["y2"] - e["y1"]), (e["x2"] - e["x1"]) * (py - e["y1"])
        strictly_left = F.when(e["y2"] > e["y1"], lhs < rhs).otherwise(lhs > rhs)
        return ((e["y1"] > py) != (e["y2"] > py)) & strictly_left
    # short rings, the usual case, are written out so that the test is compiled
    few = F.lit(0)
    for i in range(COMPILED_EDGES):
        few = few + F.when(crosses(F.get(edge_list, F.lit(i))), 1).otherwise(0)
    hits = F.when(F.size(edge_list) <= COMPILED_EDGES, few).otherwise(F.size(F.filter(edge_list, crosses)))
    return hits % 2 == 1


def distance_xy(edge_list: Column, px: Column, py: Column) -> Column:
    """Distance from a point to a polygon: 0 inside, else to the nearest edge."""
    def to_edge(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length2 = F.greatest(dx * dx + dy * dy, F.lit(1e-30))
        t = ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / length2
        return _given(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), lambda at: F.hypot(px - e["x1"] - at * dx, py - e["y1"] - at * dy))
    return (F.when(contains_xy(edge_list, px, py), F.lit(0.0))
            .otherwise(F.array_min(F.transform(edge_list, to_edge))))


def box_distance(a: Column, b: Column) -> Column:
    """Distance between two boxes: a lower bound of the distance between their contents."""
    dx = F.greatest(a["xmin"] - b["xmax"], b["xmin"] - a["xmax"], F.lit(0.0))
    dy = F.greatest(a["ymin"] - b["ymax"], b["ymin"] - a["ymax"], F.lit(0.0))
    return F.hypot(dx, dy)


def boxes_meet(a: Column, b: Column) -> Column:
    """Closed overlap of two boxes: four range comparisons."""
    return ((a["xmax"] >= b["xmin"]) & (a["xmin"] <= b["xmax"])
            & (a["ymax"] >= b["ymin"]) & (a["ymin"] <= b["ymax"]))


def _clean_ring(ring: Column) -> Column:
    """Drop repeated points and close the ring."""
    kept = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    return _given(kept, lambda known: F.when(F.element_at(known, 1) == F.element_at(known, -1), known).otherwise(
        F.concat(known, F.slice(known, 1, 1))))


def normalise(geom: Column) -> Column:
    """Closed rings without repeats or zero area; shell counter-clockwise, holes clockwise.

    Crossing rings stay as they are: see ``greenspark.functions.repair``.
    """
    def orient(ring, i):
        signed = edges_area(ring_edges(ring))
        return F.when((signed > 0) == (i == 0), ring).otherwise(F.reverse(ring))

    def clean_part(part):
        rings = F.filter(F.transform(part, _clean_ring),
                         lambda r: F.coalesce(edges_area(ring_edges(r)) != 0, F.lit(False)))
        return F.transform(rings, orient)

    return F.filter(F.transform(geom, clean_part), lambda part: F.size(part) > 0)


def geom_type(geom: Column) -> Column:
    """'Polygon', 'MultiPolygon', or NULL when nothing is left."""
    return F.when(F.size(geom) == 1, "Polygon").when(F.size(geom) > 1, "MultiPolygon")
