"""Area of a union of overlapping polygons.

Work is cut into (area, tile) pieces.  A feature enters a tile as its edges clipped to the tile,
so features that look alike there are kept once, and a tile fully below one feature needs no
sweep.  Crowded tiles are split again, each by its own number of features.  What is left in a
tile is swept in slabs between its critical abscissae, where all edges are straight and uncrossed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from greenspark.functions import geometry as G
from greenspark.functions import kernels as K
from greenspark.functions.kernels import EdgeLists
from greenspark.operators import spatial
from greenspark.operators.lineage import cut

FEATURES_PER_TILE = 16
CROWDED = 4 * FEATURES_PER_TILE
MAX_SPLITS = 8
_TILE = ["tx0", "ty0", "tx1", "ty1"]


def _clip(edges: Column) -> Column:
    """Edges cut to the x range of the tile.  Those above it are dropped, those below lie on its floor.

    Vertical edges bound no ground and are dropped.  The order is made canonical for comparison.
    """
    def clamp(x):
        return F.greatest(F.col("tx0"), F.least(F.col("tx1"), x))

    def cut_edge(e):
        slope = (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        xa, xb = clamp(e["x1"]), clamp(e["x2"])
        ya, yb = e["y1"] + slope * (xa - e["x1"]), e["y1"] + slope * (xb - e["x1"])
        low = F.greatest(ya, yb) <= F.col("ty0")
        return F.struct(xa.alias("x1"), F.when(low, F.col("ty0")).otherwise(ya).alias("y1"),
                        xb.alias("x2"), F.when(low, F.col("ty0")).otherwise(yb).alias("y2"))

    near = F.filter(edges, lambda e: (e["x1"] != e["x2"]) & (F.greatest(e["x1"], e["x2"]) > F.col("tx0"))
                    & (F.least(e["x1"], e["x2"]) < F.col("tx1")))
    return F.array_sort(F.filter(F.transform(near, cut_edge), lambda e: F.least(e["y1"], e["y2"]) < F.col("ty1")))


def _state(clipped: Column) -> Column:
    """How a feature with these clipped edges lies in the tile: 'crosses', 'covers' or 'outside'."""
    def bounds_inside(e):
        def within(x):
            return (x > F.col("tx0")) & (x < F.col("tx1"))
        return (F.greatest(e["y1"], e["y2"]) > F.col("ty0")) | within(e["x1"]) | within(e["x2"])

    depth = F.aggregate(clipped, F.lit(0.0), lambda acc, e: acc + F.signum(e["x2"] - e["x1"]))
    return F.when(F.exists(clipped, bounds_inside), "crosses").when(depth > 0, "covers").otherwise("outside")


def _split(pieces: DataFrame, keys: list[str], per_tile: int) -> DataFrame:
    """Cut each crowded tile into k x k, k from its own number of features."""
    sizes = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    grid = pieces.hint("merge").join(sizes, keys).withColumn(
        "_k", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n") / per_tile))).cast("int"))
    w, h = (F.col("tx1") - F.col("tx0")) / F.col("_k"), (F.col("ty1") - F.col("ty0")) / F.col("_k")
    last = F.col("_k") - 1

    def span(low, high, origin, step):
        a = F.greatest(F.lit(0), F.least(last, F.floor((low - F.col(origin)) / step).cast("int")))
        b = F.greatest(F.lit(0), F.least(last, F.floor((high - F.col(origin)) / step).cast("int")))
        return F.sequence(a, b)

    tiles = (grid.withColumn("_i", F.explode(span(F.col("g_box.xmin"), F.col("g_box.xmax"), "tx0", w)))
             .withColumn("_j", F.explode(span(F.col("g_box.ymin"), F.col("g_box.ymax"), "ty0", h))))
    x0, y0 = F.col("tx0") + F.col("_i") * w, F.col("ty0") + F.col("_j") * h
    x1 = F.when(F.col("_i") == last, F.col("tx1")).otherwise(F.col("tx0") + (F.col("_i") + 1) * w)
    y1 = F.when(F.col("_j") == last, F.col("ty1")).otherwise(F.col("ty0") + (F.col("_j") + 1) * h)
    kept = [c for c in pieces.columns if c not in _TILE]
    return tiles.select(*kept, x0.alias("tx0"), y0.alias("ty0"), x1.alias("tx1"), y1.alias("ty1"))


def _swept_area(x1, y1, x2, y2, is_area, tx0, ty0, tx1, ty1) -> float:
    """Area of (union of features) and (area polygon) inside one tile."""
    lo, hi = np.minimum(x1, x2), np.maximum(x1, x2)
    keep = hi > lo
    x1, y1, x2, y2, is_area, lo, hi = (v[keep] for v in (x1, y1, x2, y2, is_area, lo, hi))
    slope = (y2 - y1) / (x2 - x1)
    at0 = y1 - slope * (x1 - tx0)  # ordinate at the left side of the tile
    xs = [lo, hi, np.array([tx0, tx1])]
    with np.errstate(divide="ignore", invalid="ignore"):
        for level in (ty0, ty1):
            xs.append(tx0 + (level - at0) / slope)
        for start in range(0, len(lo), 512):  # crossings, in blocks
            part = slice(start, start + 512)
            meet = tx0 + (at0[None, :] - at0[part, None]) / (slope[part, None] - slope[None, :])
            ok = (meet > np.maximum(lo[part, None], lo[None, :])) & (meet < np.minimum(hi[part, None], hi[None, :]))
            xs.append(meet[ok])
    xs = np.concatenate(xs)
    xs = np.unique(xs[np.isfinite(xs) & (xs >= tx0) & (xs <= tx1)])
    mid, width = (xs[1:] + xs[:-1]) / 2, np.diff(xs)
    # a last, inactive edge stands for the upper side of the tile
    lo, hi, at0, slope = (np.append(v, v0) for v, v0 in ((lo, np.inf), (hi, -np.inf), (at0, ty1), (slope, 0.0)))
    turn, is_area = np.append(np.sign(x2 - x1), 0.0), np.append(is_area, False)
    total = 0.0
    step = max(1, (1 << 21) // max(len(lo), 1))
    for start in range(0, len(mid), step):
        m, w = mid[start:start + step], width[start:start + step]
        active = (lo[None, :] < m[:, None]) & (m[:, None] < hi[None, :])
        y = np.where(active, np.clip(at0 + slope * (m[:, None] - tx0), ty0, ty1), ty1)
        order = np.argsort(y, axis=1, kind="stable")
        y = np.take_along_axis(y, order, axis=1)
        sign = np.take_along_axis(np.where(active, turn, 0.0), order, axis=1)
        mine = np.take_along_axis(np.broadcast_to(is_area, y.shape), order, axis=1)
        depth_a = np.cumsum(np.where(mine, sign, 0.0), axis=1)[:, :-1]
        depth_g = np.cumsum(np.where(mine, 0.0, sign), axis=1)[:, :-1]
        total += float((w[:, None] * np.diff(y, axis=1) * ((depth_a > 0) & (depth_g > 0))).sum())
    return total


@F.arrow_udf(DoubleType())
def swept_area(area_edges: pa.Array, feature_edges: pa.Array, tx0: pa.Array, ty0: pa.Array, tx1: pa.Array,
               ty1: pa.Array) -> pa.Array:
    """Per tile: ground of the area polygon below at least one feature."""
    a, g = EdgeLists(area_edges), EdgeLists(feature_edges)
    bounds = np.column_stack([t.to_numpy(zero_copy_only=False) for t in (tx0, ty0, tx1, ty1)])
    out = np.zeros(a.rows)
    for i in range(a.rows):
        mine, theirs = slice(a.offsets[i], a.offsets[i + 1]), slice(g.offsets[i], g.offsets[i + 1])
        joined = [np.concatenate([getattr(a, c)[mine], getattr(g, c)[theirs]]) for c in ("x1", "y1", "x2", "y2")]
        is_area = np.arange(len(joined[0])) < mine.stop - mine.start
        out[i] = _swept_area(*joined, is_area, *bounds[i])
    return pa.array(out)


def union_area(areas: DataFrame, features: DataFrame, key: str, out: str) -> DataFrame:
    """Ground of each ``key`` below at least one feature.

    ``areas`` has ``geom`` and may have several disjoint rows per key; ``features`` has
    ``g_edges`` and ``g_box``.
    """
    shaped = spatial.part_shapes(areas, [key], "a_edges", "a_box")
    pairs = spatial.box_join(shaped, features.select("g_edges", "g_box"), "a_box", "g_box")
    piece_key = [key, "a_box", *_TILE]
    pieces = cut(pairs.select(key, "a_edges", "a_box", "g_edges", "g_box", F.col("a_box.xmin").alias("tx0"),
                              F.col("a_box.ymin").alias("ty0"), F.col("a_box.xmax").alias("tx1"),
                              F.col("a_box.ymax").alias("ty1")))
    covered = None
    for _ in range(MAX_SPLITS):
        split = _split(pieces, piece_key, FEATURES_PER_TILE).withColumnRenamed("g_edges", "_whole")
        local = spatial.once(spatial.once(split, "g_edges", _clip(F.col("_whole"))).drop("_whole"),
                             "_state", _state(F.col("g_edges")))
        placed = cut(local.where(F.col("_state") != "outside").dropDuplicates([*piece_key, "g_edges"]))
        full = placed.where(F.col("_state") == "covers").groupBy(*piece_key).agg(F.first("a_edges").alias("a_edges"))
        covered = full if covered is None else covered.unionByName(full)
        open_pieces = placed.where(F.col("_state") == "crosses").drop("_state").hint("merge").join(
            full.select(*piece_key), piece_key, "left_anti")
        largest = open_pieces.groupBy(*piece_key).count().agg(F.max("count")).first()[0] or 0
        pieces = open_pieces
        if largest <= CROWDED:
            break
        pieces = cut(open_pieces)

    tile_ring = G.edges(G.rectangle(*[F.col(c) for c in _TILE]))
    full_ground = covered.select(key, K.overlap_area(F.col("a_edges"), tile_ring).alias("m2"))
    # splitting has bounded what one tile gathers here
    tiles = pieces.groupBy(*piece_key).agg(F.flatten(F.collect_list("g_edges")).alias("g"), F.first("a_edges").alias("a_edges"))
    swept = tiles.select(key, swept_area(_clip(F.col("a_edges")), F.col("g"), *_TILE).alias("m2"))
    return full_ground.unionByName(swept).groupBy(key).agg(F.sum("m2").alias(out))


def box_union_area(boxes: DataFrame, keys: list[str], box: str, out: str) -> DataFrame:
    """Area of a union of boxes per key, by relational coordinate compression."""
    b = boxes.select(*keys, f"{box}.*").distinct()
    xs = b.select(*keys, F.explode(F.array("xmin", "xmax")).alias("x0")).distinct()
    slabs = xs.withColumn("x1", F.lead("x0").over(Window.partitionBy(*keys).orderBy("x0"))).where("x1 is not null")
    inside = slabs.hint("merge").join(b, keys).where((F.col("xmin") <= F.col("x0")) & (F.col("xmax") >= F.col("x1")))
    slab = Window.partitionBy(*keys, "x0").orderBy("ymin", "ymax")
    reach = F.coalesce(F.max("ymax").over(slab.rowsBetween(Window.unboundedPreceding, -1)), F.col("ymin"))
    gain = F.greatest(F.lit(0.0), F.col("ymax") - F.greatest(F.col("ymin"), reach))
    return (inside.withColumn("_gain", gain * (F.col("x1") - F.col("x0")))
            .groupBy(*keys).agg(F.sum("_gain").alias(out)))
