"""Pointy-top hexagonal grid in the projected plane, in axial coordinates.

Edge lengths follow the average hexagon edges of the H3 resolutions 6 to 9, but the cells are
this grid's own and not compatible with H3 ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_M = {6: 3724.532667, 7: 1406.475763, 8: 531.414010, 9: 200.786148}
_OFFSET = 1 << 28


def hex_axial(x: Column, y: Column, res: int) -> tuple[Column, Column]:
    """Axial (q, r) of the hexagon that holds a point, by cube rounding."""
    s = EDGE_M[res]
    q, r = (math.sqrt(3) / 3 * x - y / 3) / s, (2.0 / 3.0 * y) / s
    t = -q - r
    rq, rr, rt = F.rint(q), F.rint(r), F.rint(t)
    dq, dr, dt = F.abs(rq - q), F.abs(rr - r), F.abs(rt - t)
    out_q = F.when((dq > dr) & (dq > dt), -rr - rt).otherwise(rq)
    out_r = F.when(~((dq > dr) & (dq > dt)) & (dr > dt), -rq - rt).otherwise(rr)
    return out_q.cast("bigint"), out_r.cast("bigint")


def pack(q: Column, r: Column, res: int) -> Column:
    return F.lit(res << 58).cast("bigint") + (q + _OFFSET) * F.lit(1 << 29).cast("bigint") + (r + _OFFSET)


def hex_cell(x: Column, y: Column, res: int) -> Column:
    """BIGINT cell id of a point."""
    return pack(*hex_axial(x, y, res), res)


def unpack(cell: Column) -> tuple[Column, Column]:
    mask = F.lit((1 << 29) - 1).cast("bigint")
    return F.shiftright(cell, 29).bitwiseAND(mask) - _OFFSET, cell.bitwiseAND(mask) - _OFFSET


def hex_centre(cell: Column, res: int) -> tuple[Column, Column]:
    q, r = unpack(cell)
    s = EDGE_M[res]
    return s * math.sqrt(3) * (q + r / 2), s * 1.5 * r


def hex_parent(cell: Column, res: int, parent_res: int) -> Column:
    """Coarser cell that holds the centre of a cell."""
    return hex_cell(*hex_centre(cell, res), parent_res)
