"""Repair, dissolve, contiguity and exact clips: polygons that are invalid, overlap or meet in T-junctions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as T
from greenspark.functions import geometry as G
from greenspark.functions.repair import is_valid, make_valid, make_valid_nonzero
from greenspark.operators.lineage import cut
from greenspark.operators import contiguity, dissolve, quality, raster, spatial, zonal


def _damaged(spark, sf):
    """One polygon per part: sound, bow-tie, spike, or with two overlapping holes."""
    k = F.col("p_partkey")
    x0, y0, w, h = (7919 * k) % 39000, 20 * k + (104729 * k) % 1000, 5 * (10 + (31 * k) % 160), 5 * (10 + (17 * k) % 160)
    x1, y1 = x0 + w, y0 + h

    def ring(*points):
        pts = [G.point(x, y) for x, y in points]
        return F.array(*pts, pts[0])

    def square(a, b):
        return ring(*[(x0 + w * i / 5, y0 + h * j / 5) for i, j in ((a, a), (b, a), (b, b), (a, b))])

    shell = ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    shape = (F.when(k % 4 == 0, F.array(shell)).when(k % 4 == 1, F.array(ring((x0, y0), (x1, y1), (x1, y0), (x0, y1))))
             .when(k % 4 == 2, F.array(ring((x0, y0), (x1, y0), (x1 + 50, y0), (x1, y0), (x1, y1), (x0, y1))))
             .otherwise(F.array(shell, square(1, 3), square(2, 4))))
    return T.read(spark, sf, "part").select(k.alias("part_key"), (k % 4).alias("kind"), F.array(shape).alias("geom"))


DAMAGED_SQL = """
d AS (SELECT p_partkey AS part_key, p_partkey % 4 AS kind,
             CAST(5 * (10 + (31 * p_partkey) % 160) AS DOUBLE) * (5 * (10 + (17 * p_partkey) % 160)) AS m2 FROM part)"""


def repaired_areas(spark, sf):
    def m2(geom):
        return F.round(G.area(G.normalise(geom)), 4)

    fixed = _damaged(spark, sf).withColumn("even_odd", make_valid("geom")).withColumn("nonzero", make_valid_nonzero("geom"))
    return fixed.select("part_key", is_valid("geom").alias("was_valid"), is_valid(make_valid("even_odd")).alias("now_valid"),
                        m2(F.col("even_odd")).alias("m2"), m2(F.col("nonzero")).alias("m2_nonzero"),
                        F.when(F.col("kind") < 3, F.size("even_odd")).alias("n_parts"))


REPAIRED_AREAS_SQL = f"""
WITH {DAMAGED_SQL}
SELECT part_key, kind = 0 AS was_valid, kind < 3 AND kind <> 1 AS now_valid,
       round(m2 * CASE kind WHEN 1 THEN 0.5::DOUBLE WHEN 3 THEN 0.76::DOUBLE ELSE 1 END, 4) AS m2,
       round(m2 * CASE kind WHEN 1 THEN 0.5::DOUBLE WHEN 3 THEN 0.72::DOUBLE ELSE 1 END, 4) AS m2_nonzero,
       CASE WHEN kind < 3 THEN CASE kind WHEN 1 THEN 2 ELSE 1 END END AS n_parts FROM d"""


def repair_counts(spark, sf):
    return quality.repair_counts(_damaged(spark, sf), ["kind"]).select("kind", "n", "n_invalid", "n_empty", F.round("m2_after", 2).alias("m2_after"))


REPAIR_COUNTS_SQL = f"""
WITH {DAMAGED_SQL}
SELECT kind, count(*) AS n, count(*) FILTER (WHERE kind > 0) AS n_invalid, 0::BIGINT AS n_empty,
       round(sum(m2 * CASE kind WHEN 1 THEN 0.5::DOUBLE WHEN 3 THEN 0.76::DOUBLE ELSE 1 END), 2) AS m2_after FROM d GROUP BY 1"""


def _bricks(spark, sf):
    """A running bond: every other course is shifted by half a brick, so corners lie on the sides of the next course."""
    k = F.col("c_custkey")
    j = F.expr("c_custkey div 40")
    x0, y0 = 1000 * (k % 40) + 500 * (j % 2), 1000 * j
    return T.read(spark, sf, "customer").select(k.alias("area_code"), F.expr("c_custkey div 160").alias("block"),
                                                G.rectangle(x0, y0, x0 + 1000, y0 + 1000).alias("geom"))


BRICKS_SQL = """
b AS (SELECT c_custkey AS area_code, c_custkey // 160 AS block, 1000 * (c_custkey % 40) + 500 * ((c_custkey // 40) % 2) AS x0,
             1000 * (c_custkey // 40) AS y0 FROM customer)"""


def dissolved_bricks(spark, sf):
    outline = dissolve.dissolved_edges(_bricks(spark, sf), ["block"], t_junctions=True)
    return outline.groupBy("block").agg(
        (F.sum((F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2"))) / 2).alias("m2"),
        F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("outline_m"))


DISSOLVED_BRICKS_SQL = f"""
WITH {BRICKS_SQL},
halves AS (SELECT block, x0 + 500 * s AS x, y0 AS y FROM b, range(2) t(s)),
sides AS (SELECT h.*, dx, dy FROM halves h, (VALUES (500, 0), (-500, 0), (0, 1000), (0, -1000)) v(dx, dy)
          WHERE NOT EXISTS (SELECT 1 FROM halves o WHERE o.block = h.block AND o.x = h.x + dx AND o.y = h.y + dy))
SELECT block, m2, outline_m FROM (SELECT block, CAST(1000000 * count(*) AS DOUBLE) AS m2 FROM b GROUP BY 1)
JOIN (SELECT block, CAST(sum(CASE WHEN dx <> 0 THEN 1000 ELSE 500 END) AS DOUBLE) AS outline_m FROM sides GROUP BY 1) USING (block)"""


def brick_neighbours(spark, sf):
    return contiguity.queen(_bricks(spark, sf)).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("dst_sum"))


BRICK_NEIGHBOURS_SQL = f"""
WITH {BRICKS_SQL}
SELECT a.area_code AS src, count(*) AS n, CAST(sum(o.area_code) AS BIGINT) AS dst_sum FROM b a JOIN b o
  ON a.area_code <> o.area_code AND abs(a.x0 - o.x0) <= 1000 AND abs(a.y0 - o.y0) <= 1000 GROUP BY 1"""


def _blocks(spark, sf):
    """Rectangles on a coarse grid: many share a side, many overlap."""
    k = F.col("p_partkey")
    x0, y0 = 100 * ((7919 * k) % 390), 100 * F.expr("(20 * p_partkey + (104729 * p_partkey) % 1000) div 100")
    return T.read(spark, sf, "part").select(k.alias("area_code"), G.rectangle(
        x0, y0, x0 + 100 * (1 + (31 * k) % 8), y0 + 100 * (1 + (17 * k) % 8)).alias("geom"))


BLOCKS_SQL = """
b AS (SELECT p_partkey AS area_code, 100 * ((7919 * p_partkey) % 390) AS x0, 100 * ((20 * p_partkey + (104729 * p_partkey) % 1000) // 100) AS y0,
             100 * ((7919 * p_partkey) % 390) + 100 * (1 + (31 * p_partkey) % 8) AS x1,
             100 * ((20 * p_partkey + (104729 * p_partkey) % 1000) // 100) + 100 * (1 + (17 * p_partkey) % 8) AS y1 FROM part)"""


def block_neighbours(spark, sf):
    return contiguity.queen(_blocks(spark, sf)).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("dst_sum"))


BLOCK_NEIGHBOURS_SQL = f"""
WITH {BLOCKS_SQL}
SELECT a.area_code AS src, count(*) AS n, CAST(sum(o.area_code) AS BIGINT) AS dst_sum FROM b a JOIN b o
  ON a.area_code <> o.area_code AND a.x0 <= o.x1 AND o.x0 <= a.x1 AND a.y0 <= o.y1 AND o.y0 <= a.y1
  AND NOT (a.x0 < o.x1 AND o.x0 < a.x1 AND a.y0 < o.y1 AND o.y0 < a.y1) GROUP BY 1"""


def city_clip(spark, sf):
    """Features that meet the ground of each city exactly, boundaries included."""
    cities = spatial.part_shapes(T.area(spark, sf, shear=0.25), ["borough"], "c_edges", "c_box")
    features = spatial.part_shapes(T.green_features(spark, sf), ["id"], "f_edges", "f_box")
    return (spatial.intersects_join(cities, features, "c_edges", "f_edges", "c_box", "f_box")
            .select("borough", "id").distinct().groupBy("borough").agg(F.count(F.lit(1)).alias("n_features")))


CITY_CLIP_SQL = f"""
WITH {T.AREA_SQL}, {T.GREEN_SQL}
SELECT borough, count(DISTINCT id) AS n_features FROM area JOIN green ON y0 <= gy1 AND gy0 <= y1
  AND x0 + CAST(0.25 AS DOUBLE) * greatest(y0, gy0) <= gx1 AND gx0 <= x1 + CAST(0.25 AS DOUBLE) * least(y1, gy1) GROUP BY 1"""


def _tiles(spark, sf):
    """Mean red reflectance on a grid of 50 m in tiles of 8 x 8 pixels."""
    pixels = T.with_pixel(T.pixel_obs(spark, sf).select("x", "y", "B04"), 50.0).groupBy("row", "col").agg(F.round(F.avg("B04"), 9).alias("v"))
    return cut(raster.tile_table(pixels, "v", 8, (50.0, 0.0, 0.0, 0.0, 50.0, 0.0), band="B04"))


def _dense(geom, pieces):
    """The same outline with every side in ``pieces`` pieces."""
    def split(ring):
        steps = F.sequence(F.lit(0), F.lit(pieces - 1))
        return F.concat(F.flatten(F.transform(G.ring_edges(ring), lambda e: F.transform(steps, lambda s: F.struct(
            (e["x1"] + (e["x2"] - e["x1"]) * s / pieces).alias("x"), (e["y1"] + (e["y2"] - e["y1"]) * s / pieces).alias("y"))))), F.slice(ring, 1, 1))

    return F.transform(geom, lambda part: F.transform(part, split))


def _tile_zonal(pieces):
    def query(spark, sf):
        areas = T.area(spark, sf, shear=0.25)
        areas = areas.select("area_code", (_dense(F.col("geom"), pieces) if pieces > 1 else F.col("geom")).alias("geom"))
        return zonal.tile_zonal_stats(_tiles(spark, sf), areas).select("area_code", "n", *[F.round(c, 10).alias(c) for c in ("mean", "std", "min", "max")])

    return query


TILE_ZONAL_SQL = f"""
WITH {T.AREA_SQL}, {T.PIXEL_SQL},
cell AS (SELECT CAST(floor(x / 50) AS BIGINT) AS c, CAST(floor(y / 50) AS BIGINT) AS r, round(avg(B04), 9) AS v FROM obs GROUP BY 1, 2),
px2 AS (SELECT (c + 0.5::DOUBLE) * 50 AS px, (r + 0.5::DOUBLE) * 50 AS py, v FROM cell WHERE v IS NOT NULL)
SELECT area_code, count(v) AS n, round(avg(v), 10) AS mean, round(stddev_pop(v), 10) AS std, round(min(v), 10) AS min, round(max(v), 10) AS max
FROM px2 JOIN area ON px - 0.25::DOUBLE * py >= x0 AND px - 0.25::DOUBLE * py < x1 AND py >= y0 AND py < y1 GROUP BY 1"""


CHECKS = {
    "tile_zonal": (_tile_zonal(1), TILE_ZONAL_SQL),
    "tile_zonal_long_rings": (_tile_zonal(25), TILE_ZONAL_SQL),
    "repaired_areas": (repaired_areas, REPAIRED_AREAS_SQL),
    "repair_counts": (repair_counts, REPAIR_COUNTS_SQL),
    "dissolved_bricks": (dissolved_bricks, DISSOLVED_BRICKS_SQL),
    "brick_neighbours": (brick_neighbours, BRICK_NEIGHBOURS_SQL),
    "block_neighbours": (block_neighbours, BLOCK_NEIGHBOURS_SQL),
    "city_clip": (city_clip, CITY_CLIP_SQL),
}
