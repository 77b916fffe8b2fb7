"""Arrow kernels on pairs of edge lists.

Spark partitions the candidate pairs; inside a task numpy evaluates a whole Arrow batch of
pairs at once.  All kernels walk the same edge x edge expansion, cut into blocks of bounded
size so one pair of very detailed polygons cannot exhaust memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

BLOCK = 1 << 20  # edge pairs evaluated at once


class EdgeLists:
    """Column view of one Arrow batch of edge lists."""

    def __init__(self, lists: pa.Array):
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = lists.flatten()
        self.x1, self.y1, self.x2, self.y2 = (
            flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.rows = len(lengths)
        self.valid = np.asarray(lists.is_valid())

    def take(self, keep: np.ndarray) -> "EdgeLists":
        out = object.__new__(EdgeLists)
        out.x1, out.y1, out.x2, out.y2 = self.x1[keep], self.y1[keep], self.x2[keep], self.y2[keep]
        out.row, out.rows, out.valid = self.row[keep], self.rows, self.valid
        out.offsets = np.concatenate([[0], np.cumsum(np.bincount(out.row, minlength=self.rows))])
        return out

    def box(self):
        """Per-row min and max of x and y; empty rows get an inverted box."""
        lo_x, lo_y = np.full(self.rows, np.inf), np.full(self.rows, np.inf)
        hi_x, hi_y = -lo_x, -lo_y
        filled = np.flatnonzero(np.diff(self.offsets))
        if len(filled):
            at = self.offsets[filled]
            lo_x[filled], hi_x[filled] = np.minimum.reduceat(self.x1, at), np.maximum.reduceat(self.x1, at)
            lo_y[filled], hi_y[filled] = np.minimum.reduceat(self.y1, at), np.maximum.reduceat(self.y1, at)
        return lo_x, lo_y, hi_x, hi_y


def _edge_pairs(a: EdgeLists, b: EdgeLists):
    """Yield index arrays (ia, ib) over all edge pairs that belong to the same row."""
    counts = np.diff(b.offsets)[a.row]
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        part = counts[start:stop]
        total = int(part.sum())
        if total:
            ia = np.repeat(np.arange(start, stop), part)
            within = np.arange(total) - np.repeat(np.cumsum(part) - part, part)
            yield ia, b.offsets[a.row[ia]] + within
        start = stop


def _y_at(e: EdgeLists, i: np.ndarray, x: np.ndarray) -> np.ndarray:
    return e.y1[i] + (e.y2[i] - e.y1[i]) * ((x - e.x1[i]) / (e.x2[i] - e.x1[i]))


def _overlap(a: EdgeLists, b: EdgeLists) -> np.ndarray:
    """Area of A and B.

    A region with oriented rings is the signed sum of the strips below its edges, so the area
    shared by two regions is the signed sum, over edge pairs, of the integral of the lower of
    the two edges above a common base line.  It needs no clipping and holds for holes and
    concave rings.
    """
    ax0, ay0, ax1, _ = a.box()
    bx0, by0, bx1, _ = b.box()
    lo, hi = np.maximum(ax0, bx0), np.minimum(ax1, bx1)
    base = np.minimum(ay0, by0)
    a, b = (e.take((e.x1 != e.x2) & (np.maximum(e.x1, e.x2) > lo[e.row]) & (np.minimum(e.x1, e.x2) < hi[e.row]))
            for e in (a, b))
    out = np.zeros(a.rows)
    for ia, ib in _edge_pairs(a, b):
        left = np.maximum(np.minimum(a.x1[ia], a.x2[ia]), np.minimum(b.x1[ib], b.x2[ib]))
        right = np.minimum(np.maximum(a.x1[ia], a.x2[ia]), np.maximum(b.x1[ib], b.x2[ib]))
        keep = right > left
        ia, ib, left, right = ia[keep], ib[keep], left[keep], right[keep]
        row = a.row[ia]
        al, ar, bl, br = _y_at(a, ia, left), _y_at(a, ia, right), _y_at(b, ib, left), _y_at(b, ib, right)
        dl, dr = al - bl, ar - br
        crossing = dl * dr < 0
        t = np.where(crossing, dl / np.where(crossing, dl - dr, 1.0), 0.0)
        low_l, low_r = np.minimum(al, bl), np.minimum(ar, br)
        middle = np.where(crossing, al + t * (ar - al), low_l)
        integral = (right - left) * (t * (low_l + middle) + (1 - t) * (middle + low_r)) / 2
        integral -= (right - left) * base[row]
        sign = np.sign(a.x2[ia] - a.x1[ia]) * np.sign(b.x2[ib] - b.x1[ib])
        out += np.bincount(row, weights=sign * integral, minlength=a.rows)
    return np.maximum(out, 0.0)


def _inside(pts: EdgeLists, poly: EdgeLists) -> np.ndarray:
    """For each start vertex of ``pts``: is it inside ``poly`` of the same row?"""
    crossings = np.zeros(len(pts.x1), dtype=np.int64)
    for ia, ib in _edge_pairs(pts, poly):
        px, py = pts.x1[ia], pts.y1[ia]
        y1, y2, x1, x2 = poly.y1[ib], poly.y2[ib], poly.x1[ib], poly.x2[ib]
        lhs, rhs = (px - x1) * (y2 - y1), (x2 - x1) * (py - y1)
        hit = ((y1 > py) != (y2 > py)) & np.where(y2 > y1, lhs < rhs, lhs > rhs)
        crossings += np.bincount(ia[hit], minlength=len(crossings))
    return crossings % 2 == 1


def _boundaries_meet(a: EdgeLists, b: EdgeLists) -> np.ndarray:
    """Do the boundaries share at least one point? Closed test, collinear overlap included."""
    out = np.zeros(a.rows, dtype=bool)
    boxes = a.box(), b.box()
    lo_x, lo_y = (np.maximum(boxes[0][k], boxes[1][k]) for k in (0, 1))
    hi_x, hi_y = (np.minimum(boxes[0][k], boxes[1][k]) for k in (2, 3))
    a, b = (e.take((np.maximum(e.x1, e.x2) >= lo_x[e.row]) & (np.minimum(e.x1, e.x2) <= hi_x[e.row])
                   & (np.maximum(e.y1, e.y2) >= lo_y[e.row]) & (np.minimum(e.y1, e.y2) <= hi_y[e.row]))
            for e in (a, b))

    def side(px, py, qx, qy, rx, ry):
        return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))

    for ia, ib in _edge_pairs(a, b):
        p, q = (a.x1[ia], a.y1[ia]), (a.x2[ia], a.y2[ia])
        r, s = (b.x1[ib], b.y1[ib]), (b.x2[ib], b.y2[ib])
        near = ((np.maximum(p[0], q[0]) >= np.minimum(r[0], s[0])) & (np.maximum(r[0], s[0]) >= np.minimum(p[0], q[0]))
                & (np.maximum(p[1], q[1]) >= np.minimum(r[1], s[1])) & (np.maximum(r[1], s[1]) >= np.minimum(p[1], q[1])))
        meet = near & (side(*p, *q, *r) * side(*p, *q, *s) <= 0) & (side(*r, *s, *p) * side(*r, *s, *q) <= 0)
        out[a.row[ia[meet]]] = True
    return out


def _intersects(a: EdgeLists, b: EdgeLists) -> np.ndarray:
    out = _boundaries_meet(a, b)
    for pts, poly in ((a, b), (b, a)):
        open_rows = ~out[pts.row]
        inside = _inside(pts.take(open_rows), poly)
        out[pts.row[open_rows][inside]] = True
    return out


def _gap(a: EdgeLists, b: EdgeLists) -> np.ndarray:
    """Smallest distance between two polygons; 0 when they share a point."""
    best = np.full(a.rows, np.inf)
    for pts, segs in ((a, b), (b, a)):
        for ia, ib in _edge_pairs(pts, segs):
            dx, dy = segs.x2[ib] - segs.x1[ib], segs.y2[ib] - segs.y1[ib]
            vx, vy = pts.x1[ia] - segs.x1[ib], pts.y1[ia] - segs.y1[ib]
            t = np.clip((vx * dx + vy * dy) / np.maximum(dx * dx + dy * dy, 1e-30), 0.0, 1.0)
            dist = np.hypot(vx - t * dx, vy - t * dy)
            row = pts.row[ia]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            best[row[first]] = np.minimum(best[row[first]], np.minimum.reduceat(dist, first))
    boxes = a.box(), b.box()
    overlap = np.ones(a.rows, dtype=bool)
    for low, high in ((0, 2), (1, 3)):
        overlap &= (boxes[0][high] >= boxes[1][low]) & (boxes[1][high] >= boxes[0][low])
    best[_intersects(a.take(overlap[a.row]), b.take(overlap[b.row]))] = 0.0
    return best


def _result(values: np.ndarray, a: EdgeLists, b: EdgeLists, kind: pa.DataType) -> pa.Array:
    empty = ~(a.valid & b.valid) | (np.diff(a.offsets) == 0) | (np.diff(b.offsets) == 0)
    return pa.array(values, type=kind, mask=empty)


@F.arrow_udf(DoubleType())
def overlap_area(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = EdgeLists(left), EdgeLists(right)
    return _result(_overlap(a, b), a, b, pa.float64())


@F.arrow_udf(BooleanType())
def intersects(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = EdgeLists(left), EdgeLists(right)
    return _result(_intersects(a, b), a, b, pa.bool_())


@F.arrow_udf(BooleanType())
def boundaries_meet(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = EdgeLists(left), EdgeLists(right)
    return _result(_boundaries_meet(a, b), a, b, pa.bool_())


@F.arrow_udf(DoubleType())
def gap(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = EdgeLists(left), EdgeLists(right)
    return _result(_gap(a, b), a, b, pa.float64())


@F.arrow_udf(BooleanType())
def touches(left: pa.Array, right: pa.Array) -> pa.Array:
    """Boundaries meet while the interiors share no area (relative to the smaller polygon)."""
    a, b = EdgeLists(left), EdgeLists(right)
    meet = _boundaries_meet(a, b)
    shared = _overlap(a, b)

    def size(e):
        return np.abs(np.bincount(e.row, weights=(e.x1 - e.x2) * (e.y1 + e.y2) / 2, minlength=e.rows))

    return _result(meet & (shared <= 1e-9 * np.minimum(size(a), size(b))), a, b, pa.bool_())


@F.arrow_udf(BooleanType())
def is_simple(edges: pa.Array) -> pa.Array:
    """False when two edges of a geometry cross properly, as in a figure of eight."""
    e = EdgeLists(edges)
    crossed = np.zeros(e.rows, dtype=bool)
    for ia, ib in _edge_pairs(e, e):
        half = ia < ib
        ia, ib = ia[half], ib[half]

        def side(k, x, y):
            return np.sign((e.x2[k] - e.x1[k]) * (y - e.y1[k]) - (e.y2[k] - e.y1[k]) * (x - e.x1[k]))

        hit = ((side(ia, e.x1[ib], e.y1[ib]) * side(ia, e.x2[ib], e.y2[ib]) < 0)
               & (side(ib, e.x1[ia], e.y1[ia]) * side(ib, e.x2[ia], e.y2[ia]) < 0))
        crossed[e.row[ia[hit]]] = True
    return _result(~crossed, e, e, pa.bool_())
