"""Validity and repair of polygons with crossing, overlapping or degenerate rings.

A whole Arrow batch is tested at once by a sweep over the x ranges of its edges; only the geometries that fail are taken
apart.  Repair: edges are cut where they cross or touch (noding, again until nothing meets but at ends), equal pieces
are merged with the sum of their directions, and the winding number on both sides of each piece is counted from the
pieces above it.  Pieces with inside on one side only are the new outline; rings are walked with the inside to the left and
cut apart where they touch themselves, and each hole goes to the smallest shell around it.

What is inside: by ``even_odd`` the points below an odd number of pieces, so ground under two holes, or two overlapping parts,
changes twice; by ``nonzero`` those in more shells than holes, where in a ring is what it winds around at all.

Defined results: NULL stays NULL; points without finite coordinates are left out; rings without area vanish, a geometry
without any has no parts; a valid geometry is returned as it came.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructType

_POINT = StructType().add("x", DoubleType()).add("y", DoubleType())
_GEOM = ArrayType(ArrayType(ArrayType(_POINT)))
BLOCK = 1 << 20  # pairs of edges looked at together
#: Cut points are rounded to this part of the largest coordinate; nearer points are the same.
RELATIVE_GRID = 2.0 ** -44


def interval_pairs(group: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Yield (i, j) over all pairs of one group whose closed intervals [low, high] meet, each pair once, in bounded blocks."""
    if not len(low):
        return
    ranks = np.unique(np.concatenate([low, high]))
    key_low = group * np.int64(len(ranks)) + np.searchsorted(ranks, low)
    key_high = group * np.int64(len(ranks)) + np.searchsorted(ranks, high)
    order = np.argsort(key_low, kind="stable")
    counts = np.searchsorted(key_low[order], key_high[order], "right") - np.arange(1, len(order) + 1)
    ends = np.cumsum(counts)
    start = 0
    while start < len(order):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        part = counts[start:stop]
        first = np.repeat(np.arange(start, stop), part)
        within = np.arange(len(first)) - np.repeat(np.cumsum(part) - part, part)
        yield order[first], order[first + 1 + within]
        start = stop


class Rings:
    """Edges of a batch of geometries: closed rings without repeated points, with their place in ring, part and geometry."""

    def __init__(self, geoms: pa.Array):
        if isinstance(geoms, pa.ChunkedArray):
            geoms = geoms.combine_chunks()

        # an empty child list may come without an offset buffer, which Arrow's own functions do not survive
        def sizes(lists):
            return np.asarray(lists.value_lengths().fill_null(0)) if len(lists) else np.empty(0, int)

        def inner(lists):
            return lists.flatten() if len(lists) else pa.array([], lists.type.value_type)

        self.n = len(geoms)
        parts = inner(geoms)
        rings = inner(parts)
        points = inner(rings)
        part_geom = np.repeat(np.arange(self.n), sizes(geoms))
        ring_part = np.repeat(np.arange(len(parts)), sizes(parts))
        self.ring_geom = part_geom[ring_part] if len(ring_part) else np.empty(0, int)
        self.ring_part = ring_part
        self.is_shell = np.append(True, ring_part[1:] != ring_part[:-1])[:len(ring_part)]
        ring = np.repeat(np.arange(len(rings)), sizes(rings))
        x, y = (points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
        known = np.isfinite(x) & np.isfinite(y)
        ring, x, y = ring[known], x[known], y[known]
        last = np.append(ring[1:] != ring[:-1], True)[:len(ring)]
        first = np.append(True, last[:-1])[:len(ring)]
        following = np.arange(1, len(ring) + 1)
        following[last] = np.flatnonzero(first)
        moves = (x != x[following]) | (y != y[following]) if len(ring) else np.empty(0, bool)
        self.x1, self.y1, self.x2, self.y2 = x[moves], y[moves], x[following][moves], y[following][moves]
        self.ring = ring[moves]
        self.geom = self.ring_geom[self.ring] if len(self.ring) else np.empty(0, int)
        place = np.append(True, self.ring[1:] != self.ring[:-1])[:len(self.ring)]
        starts = np.flatnonzero(place)
        self.next = np.arange(1, len(self.ring) + 1)
        if len(starts):
            self.next[np.append(starts[1:], len(self.ring)) - 1] = starts
        self.edges_of = np.bincount(self.ring, minlength=len(rings))


def _side(px, py, qx, qy, rx, ry):
    return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))


def invalid(r: Rings) -> np.ndarray:
    """Per geometry: do edges meet other than as neighbours, or is a ring degenerate or not where its role puts it?"""
    out = np.zeros(r.n, bool)
    out[r.ring_geom[r.edges_of < 3]] = True
    for i, j in interval_pairs(r.geom, np.minimum(r.x1, r.x2), np.maximum(r.x1, r.x2)):
        near = (np.minimum(r.y1[i], r.y2[i]) <= np.maximum(r.y1[j], r.y2[j])) & (np.minimum(r.y1[j], r.y2[j]) <= np.maximum(r.y1[i], r.y2[i]))
        i, j = i[near], j[near]
        p, q, s, t = (r.x1[i], r.y1[i]), (r.x2[i], r.y2[i]), (r.x1[j], r.y1[j]), (r.x2[j], r.y2[j])
        meet = (_side(*p, *q, *s) * _side(*p, *q, *t) <= 0) & (_side(*s, *t, *p) * _side(*s, *t, *q) <= 0)
        neighbours = (r.next[i] == j) | (r.next[j] == i)
        dx1, dy1, dx2, dy2 = q[0] - p[0], q[1] - p[1], t[0] - s[0], t[1] - s[1]
        back = (dx1 * dy2 - dy1 * dx2 == 0) & (dx1 * dx2 + dy1 * dy2 < 0)
        out[r.geom[i[meet & (~neighbours | back)]]] = True
    _misplaced(r, out)
    return out


def _misplaced(r: Rings, out: np.ndarray) -> None:
    """Flag geometries where a shell lies in an odd number of rings, or a hole in an even number or outside its own shell."""
    several = np.bincount(r.ring_geom, minlength=r.n) > 1
    rings = np.flatnonzero(several[r.ring_geom] & (r.edges_of > 0)) if len(r.ring_geom) else np.empty(0, int)
    if not len(rings):
        return
    starts = np.concatenate([[0], np.cumsum(r.edges_of)[:-1]])
    px, py = r.x1[starts[rings]], r.y1[starts[rings]]
    first = np.minimum.reduceat(np.minimum(r.x1, r.x2), starts[r.edges_of > 0])
    final = np.maximum.reduceat(np.maximum(r.x1, r.x2), starts[r.edges_of > 0])
    low, high = np.full(len(r.edges_of), np.inf), np.full(len(r.edges_of), -np.inf)
    low[r.edges_of > 0], high[r.edges_of > 0] = first, final
    around = np.zeros(len(rings), int)
    own = np.zeros(len(rings), bool)
    for a, b in interval_pairs(r.ring_geom[rings], low[rings], high[rings]):
        for point, outer in ((a, b), (b, a)):
            counts = r.edges_of[rings[outer]]
            pair = np.repeat(np.arange(len(point)), counts)
            at = starts[rings[outer]][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
            x, y = px[point][pair], py[point][pair]
            over = (r.y1[at] > y) != (r.y2[at] > y)
            left, right = (x - r.x1[at]) * (r.y2[at] - r.y1[at]), (r.x2[at] - r.x1[at]) * (y - r.y1[at])
            hit = over & np.where(r.y2[at] > r.y1[at], left < right, left > right)
            holds = np.bincount(pair[hit], minlength=len(point)) % 2 == 1
            np.add.at(around, point[holds], 1)
            inner, shell = rings[point], rings[outer]
            own[point[holds & r.is_shell[shell] & (r.ring_part[inner] == r.ring_part[shell])]] = True
    wrong = np.where(r.is_shell[rings], around % 2 == 1, (around % 2 == 0) | ~own)
    out[r.ring_geom[rings[wrong]]] = True


def _outline(edges: np.ndarray, group: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Directed pieces of each group, with the inside to the left and the outside to the right, see ``_sides`` for ``rule``; and their groups.

    Points are rounded to a grid; where rounding leaves a crossing that is neither cut nor closed, that group takes a coarser grid.
    """
    if not len(edges):
        return edges, group
    largest = np.zeros(group.max() + 1)
    np.maximum.at(largest, group, np.abs(edges).max(axis=1))
    grid = RELATIVE_GRID * 2.0 ** np.ceil(np.log2(np.maximum(largest, 1e-300)))
    found, groups = [], []
    while len(edges):
        size = grid[group][:, None]
        snapped = np.round(edges / size) * size
        long = (snapped[:, 0] != snapped[:, 2]) | (snapped[:, 1] != snapped[:, 3])
        again, noded, own = _cut_rounds(snapped[long], group[long], grid)
        outline, own = _sides(noded, own, rule)
        starts, ends = (np.lexsort((outline[:, k + 1], outline[:, k], own)) for k in (0, 2))
        apart = (outline[starts, :2] != outline[ends, 2:]).any(axis=1)
        again[own[starts[apart]]] = True
        found.append(outline[~again[own]])
        groups.append(own[~again[own]])
        grid[again] *= 16
        edges, group = edges[again[group]], group[again[group]]
    found, groups = np.concatenate(found), np.concatenate(groups)
    order = np.argsort(groups, kind="stable")
    return found[order], groups[order]


def _cut_rounds(edges: np.ndarray, group: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of each group cut until nothing meets but at ends: (groups where that does not come to an end, edges, their groups)."""
    unfinished = np.zeros(len(grid), bool)
    done, done_group = [], []
    for _ in range(40):
        x1, y1, x2, y2 = edges.T
        size = grid[group]
        owner, where_x, where_y = [], [], []

        def cut(k, x, y):
            """Cut edge k at a point that is not one of its ends."""
            free = (np.hypot(x - x1[k], y - y1[k]) > size[k]) & (np.hypot(x - x2[k], y - y2[k]) > size[k])
            owner.append(k[free])
            where_x.append(x[free])
            where_y.append(y[free])

        for i, j in interval_pairs(group, np.minimum(x1, x2) - size, np.maximum(x1, x2) + size):
            near = ((np.minimum(y1[i], y2[i]) - size[i] <= np.maximum(y1[j], y2[j])) & (np.minimum(y1[j], y2[j]) - size[j] <= np.maximum(y1[i], y2[i])))
            i, j = i[near], j[near]
            touched = np.zeros(len(i), bool)
            for a, b in ((i, j), (j, i)):
                dx, dy = x2[b] - x1[b], y2[b] - y1[b]
                length2 = dx * dx + dy * dy
                for px, py in ((x1[a], y1[a]), (x2[a], y2[a])):
                    t = ((px - x1[b]) * dx + (py - y1[b]) * dy) / length2
                    gap = np.abs((px - x1[b]) * dy - (py - y1[b]) * dx) / np.sqrt(length2)
                    on = (gap <= size[b]) & (t > 0) & (t < 1)
                    touched |= on | (np.hypot(px - x1[b], py - y1[b]) <= size[b]) | (np.hypot(px - x2[b], py - y2[b]) <= size[b])
                    cut(b[on], px[on], py[on])
            i, j = i[~touched], j[~touched]
            crossing = ((_side(x1[i], y1[i], x2[i], y2[i], x1[j], y1[j]) * _side(x1[i], y1[i], x2[i], y2[i], x2[j], y2[j]) < 0)
                        & (_side(x1[j], y1[j], x2[j], y2[j], x1[i], y1[i]) * _side(x1[j], y1[j], x2[j], y2[j], x2[i], y2[i]) < 0))
            i, j = i[crossing], j[crossing]
            dx1, dy1, dx2, dy2 = x2[i] - x1[i], y2[i] - y1[i], x2[j] - x1[j], y2[j] - y1[j]
            t = ((x1[j] - x1[i]) * dy2 - (y1[j] - y1[i]) * dx2) / (dx1 * dy2 - dy1 * dx2)
            x, y = np.round((x1[i] + t * dx1) / size[i]) * size[i], np.round((y1[i] + t * dy1) / size[i]) * size[i]
            cut(i, x, y)
            cut(j, x, y)
        owner, x, y = (np.concatenate(v) if v else np.empty(0) for v in (owner, where_x, where_y))
        owner = owner.astype(int)
        unfinished[:] = False
        unfinished[group[owner]] = True
        going = unfinished[group]
        done.append(edges[~going])
        done_group.append(group[~going])
        if not len(owner):
            edges, group = edges[going], group[going]
            break
        t = (x - x1[owner]) * (x2[owner] - x1[owner]) + (y - y1[owner]) * (y2[owner] - y1[owner])
        order = np.lexsort((t, owner))
        owner, x, y = owner[order], x[order], y[order]
        whole = going.copy()
        whole[owner] = False
        opens, closes = np.append(True, owner[1:] != owner[:-1]), np.append(owner[1:] != owner[:-1], True)
        from_x, from_y = np.where(opens, x1[owner], np.roll(x, 1)), np.where(opens, y1[owner], np.roll(y, 1))
        pieces = np.column_stack([from_x, from_y, x, y])
        tails = np.column_stack([x[closes], y[closes], x2[owner[closes]], y2[owner[closes]]])
        edges, group = np.concatenate([edges[whole], pieces, tails]), np.concatenate([group[whole], group[owner], group[owner[closes]]])
        long = (edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])
        edges, group = edges[long], group[long]
    return unfinished, np.concatenate([*done, edges]), np.concatenate([*done_group, group])


def _stabbed(group: np.ndarray, low: np.ndarray, high: np.ndarray, points: np.ndarray):
    """(interval, point) for every point in a closed interval of its group."""
    ranks = np.unique(np.concatenate([low, high, points]))
    key_low, key_high, key = (group * np.int64(len(ranks)) + np.searchsorted(ranks, v) for v in (low, high, points))
    order = np.argsort(key, kind="stable")
    first, last = np.searchsorted(key[order], key_low, "left"), np.searchsorted(key[order], key_high, "right")
    counts = last - first
    owner = np.repeat(np.arange(len(low)), counts)
    return owner, order[np.repeat(first, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)]


def _sides(edges: np.ndarray, group: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Noded pieces of each group that have inside on one side only, directed so that it lies to the left; and their groups.

    ``rule``: "odd" (below an odd number of pieces), "around" (wound around at all) or "left" (more often to the left of pieces).
    """
    if not len(edges):
        return edges, group
    forward = (edges[:, 0] < edges[:, 2]) | ((edges[:, 0] == edges[:, 2]) & (edges[:, 1] < edges[:, 3]))
    sorted_ = np.where(forward[:, None], edges, edges[:, [2, 3, 0, 1]])
    order = np.lexsort((*sorted_.T[::-1], group))
    sorted_, group, forward = sorted_[order], group[order], forward[order]
    fresh = np.append(True, (group[1:] != group[:-1]) | (sorted_[1:] != sorted_[:-1]).any(axis=1))
    which = np.cumsum(fresh) - 1
    pieces, group = sorted_[fresh], group[fresh]
    turns = np.bincount(which, weights=np.where(forward, 1, -1), minlength=len(pieces)).astype(int)
    layers = np.bincount(which, minlength=len(pieces))
    amount = layers if rule == "odd" else turns
    x1, y1, x2, y2 = pieces.T
    upright = x1 == x2
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    above = np.zeros(len(pieces), int)  # pieces above the middle; for an upright piece: right of it
    left = np.zeros(len(pieces), int)
    j, k = _stabbed(group, x1, x2, mx)
    keep = (j != k) & ~upright[j]
    j, k = j[keep], k[keep]
    over = y1[j] + (y2[j] - y1[j]) * ((mx[k] - x1[j]) / (x2[j] - x1[j])) > my[k]
    j, k = j[over], k[over]
    np.add.at(above, k[mx[k] < x2[j]], amount[j[mx[k] < x2[j]]])
    np.add.at(left, k[x1[j] < mx[k]], amount[j[x1[j] < mx[k]]])

    def inside(count):
        # a piece to the right above a point is a turn clockwise
        return count % 2 == 1 if rule == "odd" else count != 0 if rule == "around" else count < 0

    left_in = inside(np.where(upright, left, above))
    right_in = inside(np.where(upright, above, above + amount))
    border = left_in != right_in
    return np.where(left_in[border, None], pieces[border], pieces[border][:, [2, 3, 0, 1]]), group[border]


def _signed_area(ring: list[tuple[float, float]]) -> float:
    x, y = np.array(ring).T
    x, y = x - x[0], y - y[0]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def _walked(outline: np.ndarray) -> list[list[tuple[float, float]]]:
    """Simple closed rings from directed pieces: at a crowded point the sharpest turn to the left stays on one face."""
    ends = [((ax, ay), (bx, by)) for ax, ay, bx, by in outline.tolist()]
    leaving: dict[tuple[float, float], list[int]] = {}
    for k, (start, _) in enumerate(ends):
        leaving.setdefault(start, []).append(k)
    following = []
    for came, at in ends:
        ways = leaving[at]
        if len(ways) > 1:
            back = np.arctan2(came[1] - at[1], came[0] - at[0])
            turns = [(back - np.arctan2(ends[w][1][1] - at[1], ends[w][1][0] - at[0])) % (2 * np.pi) for w in ways]
            following.append(ways.pop(int(np.argmin(turns))))
        else:
            following.append(ways.pop())
    rings, used = [], [False] * len(ends)
    for k in range(len(ends)):
        path: list[tuple[float, float]] = []
        places: dict[tuple[float, float], int] = {}
        while not used[k]:
            used[k] = True
            point = ends[k][0]
            if point in places:  # the ring touches itself: cut the loop off
                begin = places[point]
                rings.append(path[begin:] + [point])
                for p in path[begin:]:
                    del places[p]
                del path[begin:]
            places[point] = len(path)
            path.append(point)
            k = following[k]
        if path:
            rings.append(path + path[:1])
    return rings


def _parts(outline: np.ndarray) -> list[list[list[tuple[float, float]]]]:
    """Parts of the area of an outline: a shell counter-clockwise, then its holes clockwise."""
    rings = [(ring, _signed_area(ring)) for ring in _walked(outline)]
    found = [r for r, a in sorted(rings, key=lambda ring: ring[1]) if a > 0]
    parts = [[ring] for ring in found]
    if len(found) == len(rings):
        return parts
    bounds = [np.array(ring).T for ring in found]
    for hole in (r for r, a in rings if a < 0):
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        for part, (sx, sy) in zip(parts, bounds, strict=True):
            over = (sy[:-1] > y) != (sy[1:] > y)
            cross = (x - sx[:-1]) * (sy[1:] - sy[:-1]) - (sx[1:] - sx[:-1]) * (y - sy[:-1])
            if np.count_nonzero(over & np.where(sy[1:] > sy[:-1], cross < 0, cross > 0)) % 2:
                part.append(hole)
                break
    return parts


def repaired(edges: np.ndarray, ring: np.ndarray, geom: np.ndarray, is_shell: np.ndarray, even_odd: bool = True) -> dict[int, list]:
    """Parts of each geometry with an area, from the edges of its rings (``ring``, ``geom`` and ``is_shell`` say of each edge where it belongs).

    The edges of all geometries are cut and counted together; no edge meets one of another geometry.
    """
    if not even_odd:
        _, first, ring = np.unique(ring, return_index=True, return_inverse=True)
        edges, ring = _outline(edges, ring.ravel(), "around")
        geom, is_shell = geom[first][ring], is_shell[first][ring]
        edges = np.where(is_shell[:, None], edges, edges[:, [2, 3, 0, 1]])
    outline, geom = _outline(edges, geom, "odd" if even_odd else "left")
    cuts = np.flatnonzero(np.diff(geom, prepend=-1, append=-1)).tolist()
    return {int(geom[a]): _parts(outline[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)}


def _lists(fixed: list, kind: pa.DataType) -> pa.Array:
    """Geometries given as parts of rings of (x, y), as an Arrow array of ``kind``."""
    def offsets(lists):
        return pa.array(np.concatenate([[0], np.cumsum([len(v) for v in lists], dtype=np.int64)]).astype(np.int32))

    parts = list(chain.from_iterable(fixed))
    rings = list(chain.from_iterable(parts))
    xy = np.array(list(chain.from_iterable(rings)), float).reshape(-1, 2)
    part, ring = kind.value_type, kind.value_type.value_type
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(ring.value_type))
    return pa.ListArray.from_arrays(offsets(fixed), pa.ListArray.from_arrays(
        offsets(parts), pa.ListArray.from_arrays(offsets(rings), points, type=ring), type=part), type=kind)


def _make_valid(geoms: pa.Array, even_odd: bool) -> pa.Array:
    if isinstance(geoms, pa.ChunkedArray):
        geoms = geoms.combine_chunks()
    r = Rings(geoms)
    wrong = np.flatnonzero(invalid(r))
    if not len(wrong):
        return geoms
    fixed = []
    weight = np.cumsum(np.bincount(r.geom, minlength=r.n)[wrong].astype(float) ** 2)
    start = 0
    while start < len(wrong):  # so many geometries that the pairs of their edges stay within a block
        stop = max(start + 1, int(np.searchsorted(weight, (weight[start - 1] if start else 0) + BLOCK, "right")))
        taken = np.zeros(r.n, bool)
        taken[wrong[start:stop]] = True
        k = np.flatnonzero(taken[r.geom])
        found = repaired(np.column_stack([r.x1[k], r.y1[k], r.x2[k], r.y2[k]]), r.ring[k], r.geom[k], r.is_shell[r.ring[k]], even_odd)
        fixed += [found.get(g, []) for g in wrong[start:stop].tolist()]
        start = stop
    place = np.arange(len(geoms))
    place[wrong] = len(geoms) + np.arange(len(wrong))
    return pa.concat_arrays([geoms, _lists(fixed, geoms.type)]).take(pa.array(place))


@F.arrow_udf(_GEOM)
def make_valid(geom: pa.Array) -> pa.Array:
    """The geometry with crossings, spikes and overlaps resolved by the even-odd rule."""
    return _make_valid(geom, True)


@F.arrow_udf(_GEOM)
def make_valid_nonzero(geom: pa.Array) -> pa.Array:
    """As ``make_valid``, but inside is what lies in more shells than holes."""
    return _make_valid(geom, False)


@F.arrow_udf(BooleanType())
def is_valid(geom: pa.Array) -> pa.Array:
    """Rings are simple, touch nothing and lie where their role puts them; NULL for NULL."""
    return pa.array(~invalid(Rings(geom)), mask=~np.asarray(geom.is_valid()))
