"""Green polygons: shares, access, selection, dissolve."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as T
from greenspark.functions import geometry as G
from greenspark.operators import green, spatial
from greenspark.operators.dissolve import dissolved_edges, dissolved_rings
from greenspark.operators.nearest import nearest
from greenspark.operators.zonal import pixels_in_areas
from greenspark.functions.spectral import ndvi


def green_share(spark, sf):
    return (green.green_share(T.area(spark, sf), T.unified_green(spark, sf), "borough")
            .select("borough", F.round("green_m2_gross", 3).alias("green_m2_gross"),
                    F.round("area_m2", 3).alias("area_m2"), F.round("green_share", 9).alias("green_share")))


OVERLAP_SQL = """
ov AS (
  SELECT a.area_code, a.borough, a.population, a.x0, a.x1, a.y0, a.y1, g.*,
         greatest(a.x0, gx0) AS cx0, least(a.x1, gx1) AS cx1, greatest(a.y0, gy0) AS cy0, least(a.y1, gy1) AS cy1
  FROM area a JOIN green g ON gx0 < a.x1 AND gx1 > a.x0 AND gy0 < a.y1 AND gy1 > a.y0
)"""

GREEN_SHARE_SQL = f"""
WITH {T.AREA_SQL}, {T.GREEN_SQL}, {OVERLAP_SQL},
sizes AS (SELECT borough, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area_m2 FROM area GROUP BY 1),
m AS (SELECT borough, CAST(sum((cx1 - cx0) * (cy1 - cy0)) AS DOUBLE) AS m2 FROM ov GROUP BY 1)
SELECT borough, round(m2, 3) AS green_m2_gross, round(area_m2, 3) AS area_m2,
       round(m2 / nullif(area_m2, 0), 9) AS green_share
FROM m JOIN sizes USING (borough)"""


def green_share_dissolved(spark, sf):
    return (green.green_share_dissolved(T.area(spark, sf), T.unified_green(spark, sf), "borough")
            .select("borough", F.round("green_m2_dissolved", 3).alias("green_m2_dissolved"),
                    F.round("area_m2", 3).alias("area_m2"), F.round("green_share", 9).alias("green_share")))


GREEN_SHARE_DISSOLVED_SQL = f"""
WITH {T.AREA_SQL}, {T.GREEN_SQL}, {OVERLAP_SQL},
xs AS (SELECT area_code, cx0 AS sx0 FROM ov UNION SELECT area_code, cx1 FROM ov),
slabs AS (SELECT area_code, sx0, lead(sx0) OVER (PARTITION BY area_code ORDER BY sx0) AS sx1 FROM xs),
runs AS (
  SELECT o.borough, s.area_code, s.sx0, s.sx1, o.cy0, o.cy1,
         max(o.cy1) OVER (PARTITION BY s.area_code, s.sx0 ORDER BY o.cy0, o.cy1, o.id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM slabs s JOIN ov o ON o.area_code = s.area_code AND o.cx0 <= s.sx0 AND o.cx1 >= s.sx1
),
m AS (SELECT borough, CAST(sum((sx1 - sx0) * greatest(0, cy1 - greatest(cy0, coalesce(top, cy0)))) AS DOUBLE) AS m2
      FROM runs GROUP BY 1),
sizes AS (SELECT borough, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area_m2 FROM area GROUP BY 1)
SELECT borough, round(m2, 3) AS green_m2_dissolved, round(area_m2, 3) AS area_m2,
       round(m2 / nullif(area_m2, 0), 9) AS green_share
FROM m JOIN sizes USING (borough)"""


def angst(spark, sf):
    return (green.angst(T.area(spark, sf), T.unified_green(spark, sf))
            .select("area_code", "population",
                    F.round("dist_to_public_green_2ha_m", 4).alias("dist_to_public_green_2ha_m"),
                    F.round("public_green_m2", 3).alias("public_green_m2"),
                    F.round("public_green_per_capita_m2", 6).alias("public_green_per_capita_m2")))


ANGST_SQL = f"""
WITH {T.AREA_SQL}, {T.GREEN_SQL},
big AS (SELECT * FROM green WHERE access_class = 'public' AND (gx1 - gx0) * (gy1 - gy0) >= 20000),
pairs AS (
  SELECT a.area_code,
         sqrt(CAST(greatest(gx0 - a.x1, a.x0 - gx1, 0) AS DOUBLE) ** 2
              + CAST(greatest(gy0 - a.y1, a.y0 - gy1, 0) AS DOUBLE) ** 2) AS gap,
         sqrt(greatest(gx0 - (a.x0 + a.x1) / 2.0, (a.x0 + a.x1) / 2.0 - gx1, 0) ** 2
              + greatest(gy0 - (a.y0 + a.y1) / 2.0, (a.y0 + a.y1) / 2.0 - gy1, 0) ** 2) AS d,
         greatest(0, least(a.x1, gx1) - greatest(a.x0, gx0)) * greatest(0, least(a.y1, gy1) - greatest(a.y0, gy0)) AS m2
  FROM area a JOIN big ON gx0 <= a.x1 + 5000 AND gx1 >= a.x0 - 5000 AND gy0 <= a.y1 + 5000 AND gy1 >= a.y0 - 5000
),
m AS (SELECT area_code, min(d) AS d, CAST(sum(m2) AS DOUBLE) AS m2 FROM pairs WHERE gap <= 5000 GROUP BY 1)
SELECT area_code, population, round(d, 4) AS dist_to_public_green_2ha_m, round(coalesce(m2, 0), 3) AS public_green_m2,
       round(coalesce(m2, 0) / nullif(population, 0), 6) AS public_green_per_capita_m2
FROM area LEFT JOIN m USING (area_code)"""


def angst_population(spark, sf):
    return (green.access_population(T.area(spark, sf).select("area_code", "borough", "population", "geom"),
                                    T.unified_green(spark, sf), "borough")
            .select("borough", "population", F.round("pop_share_300m_2ha", 9).alias("pop_share_300m_2ha"),
                    F.round("pop_share_400m_any", 9).alias("pop_share_400m_any")))


CENTRE_DISTANCE = """sqrt(greatest(gx0 - cx, cx - gx1, 0) ** 2 + greatest(gy0 - cy, cy - gy1, 0) ** 2)"""

ANGST_POPULATION_SQL = f"""
WITH {T.AREA_SQL}, {T.GREEN_SQL},
c AS (SELECT *, CAST((x0 + x1) / 2.0 AS DOUBLE) AS cx, CAST((y0 + y1) / 2.0 AS DOUBLE) AS cy FROM area),
flags AS (
  SELECT c.area_code, c.borough, c.population,
         coalesce(bool_or(id IS NOT NULL AND (gx1 - gx0) * (gy1 - gy0) >= 20000 AND {CENTRE_DISTANCE} <= 300), false)
           AS f300,
         coalesce(bool_or(id IS NOT NULL AND {CENTRE_DISTANCE} <= 400), false) AS f400
  FROM c LEFT JOIN (SELECT * FROM green WHERE access_class = 'public') g
    ON gx0 <= cx + 400 AND gx1 >= cx - 400 AND gy0 <= cy + 400 AND gy1 >= cy - 400
  GROUP BY 1, 2, 3
)
SELECT borough, CAST(sum(population) AS BIGINT) AS population,
       round(CAST(sum(CASE WHEN f300 THEN population ELSE 0 END) AS DOUBLE) / sum(population), 9) AS pop_share_300m_2ha,
       round(CAST(sum(CASE WHEN f400 THEN population ELSE 0 END) AS DOUBLE) / sum(population), 9) AS pop_share_400m_any
FROM flags GROUP BY 1"""


def nearest_green(spark, sf):
    centres = (T.area(spark, sf).select("area_code", G.centroid(F.col("geom")).alias("c"))
               .select("area_code", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")))
    return (nearest(centres, "area_code", "cx", "cy", T.unified_green(spark, sf), "id", "g_edges", "g_box",
                    "green_id", "dist_to_park_m")
            .select("area_code", F.round("dist_to_park_m", 4).alias("dist_to_park_m")))


NEAREST_GREEN_SQL = f"""
WITH {T.AREA_SQL}, {T.GREEN_SQL},
c AS (SELECT *, CAST((x0 + x1) / 2.0 AS DOUBLE) AS cx, CAST((y0 + y1) / 2.0 AS DOUBLE) AS cy FROM area)
SELECT area_code, round(min({CENTRE_DISTANCE}), 4) AS dist_to_park_m FROM c, green GROUP BY 1"""


def bbox_filter(spark, sf):
    features = T.green_features(spark, sf)
    return (features.where(F.col("subtype").isin(green.LAND_USE_KINDS)
                           & green.in_bounds(F.col("bbox"), 5000.0, 2000.0, 25000.0, 30000.0))
            .select("id", F.col("subtype").alias("kind"), "name", F.col("bbox.xmin").alias("xmin"),
                    F.col("bbox.ymax").alias("ymax")))


BBOX_FILTER_SQL = f"""
WITH {T.GREEN_SQL}
SELECT id, kind, name, CAST(gx0 AS DOUBLE) AS xmin, CAST(gy1 AS DOUBLE) AS ymax FROM green
WHERE kind NOT IN ('tree', 'shrub', 'wetland') AND gx1 >= 5000 AND gx0 <= 25000 AND gy1 >= 2000 AND gy0 <= 30000"""


def access_class_union(spark, sf):
    return (T.unified_green(spark, sf).groupBy("source", "kind", "access_class", G.geom_type(F.col("geom")).alias("shape"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(G.edges_area(F.col("g_edges"))), 3).alias("m2")))


# A land-cover kind counts only when it is one of the four; 'grass' occurs in both sources.
ACCESS_CLASS_UNION_SQL = f"""
WITH {T.GREEN_SQL}
SELECT source, kind, access_class, 'Polygon' AS shape, count(*) AS n,
       round(CAST(sum((gx1 - gx0) * (gy1 - gy0)) AS DOUBLE), 3) AS m2
FROM green GROUP BY 1, 2, 3"""


def greenspace_functions(spark, sf):
    names = F.array(*[F.lit(n) for n in (*green.GREENSPACE_FUNCTIONS, "Golf Course", "Cemetery")])
    sites = T.read(spark, sf, "part").select(
        F.col("p_partkey").alias("site"), F.col("p_brand").alias("brand"),
        F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("function"))
    kept = sites.where(F.col("function").isin(green.GREENSPACE_FUNCTIONS))
    wanted = [c for c in ("function", "brand", "not_there") if c in kept.columns]
    return kept.select(*wanted).groupBy(*wanted).agg(F.count(F.lit(1)).alias("n"))


GREENSPACE_FUNCTIONS_SQL = """
SELECT (['Public Park Or Garden', 'Play Space', 'Playing Field', 'Allotments Or Community Growing Spaces'])[
         CAST(p_partkey % 6 AS INTEGER) + 1] AS function, p_brand AS brand, count(*) AS n
FROM part WHERE p_partkey % 6 < 4 GROUP BY 1, 2"""


def semi_filter(spark, sf):
    with_green = green.overlap_weights(T.area(spark, sf), T.unified_green(spark, sf)).select("area_code").distinct()
    return (T.area(spark, sf).hint("merge").join(with_green, "area_code", "left_semi")
            .where(~F.col("area_name").startswith("CHINA")).select("area_code", "area_name"))


SEMI_FILTER_SQL = f"""
WITH {T.AREA_SQL}, {T.GREEN_SQL}, {OVERLAP_SQL}
SELECT area_code, area_name FROM area
WHERE area_code IN (SELECT area_code FROM ov) AND area_name NOT LIKE 'CHINA%'"""


def overlap_weights(spark, sf):
    return (green.overlap_weights(T.area(spark, sf), T.unified_green(spark, sf))
            .select("id", "area_code", F.round("weight", 9).alias("weight")))


OVERLAP_WEIGHTS_SQL = f"""
WITH {T.AREA_SQL}, {T.GREEN_SQL}, {OVERLAP_SQL}
SELECT id, area_code, round(CAST((cx1 - cx0) * (cy1 - cy0) AS DOUBLE) / ((gx1 - gx0) * (gy1 - gy0)), 9) AS weight FROM ov"""


def city_extent(spark, sf):
    shaped = spatial.with_shape(T.area(spark, sf), "geom")
    b = F.col("box")
    return shaped.agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"),
                      F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"),
                      F.round(F.sum(G.edges_area(F.col("edges"))), 3).alias("m2"), F.count(F.lit(1)).alias("n"))


CITY_EXTENT_SQL = f"""
WITH {T.AREA_SQL}
SELECT CAST(min(x0) AS DOUBLE) AS xmin, CAST(min(y0) AS DOUBLE) AS ymin, CAST(max(x1) AS DOUBLE) AS xmax,
       CAST(max(y1) AS DOUBLE) AS ymax, round(CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE), 3) AS m2, count(*) AS n
FROM area"""


def dissolve_city(spark, sf):
    """Outline per borough: length of the boundary and enclosed area, from uncancelled edges."""
    outline = dissolved_edges(T.area(spark, sf), ["borough"])
    return (outline.groupBy("borough").agg(
        F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 3).alias("perimeter_m"),
        F.round(F.sum((F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2")) / 2), 3).alias("area_m2")))


DISSOLVE_CITY_SQL = f"""
WITH {T.AREA_SQL},
inner_sides AS (
  SELECT a.borough, CAST(sum(CASE WHEN b.gj = a.gj THEN a.y1 - a.y0 ELSE a.x1 - a.x0 END) AS BIGINT) AS shared
  FROM area a JOIN area b ON a.borough = b.borough
   AND ((b.gj = a.gj AND abs(b.gi - a.gi) = 1) OR (b.gi = a.gi AND abs(b.gj - a.gj) = 1))
  GROUP BY 1
),
total AS (SELECT borough, CAST(sum(2 * (x1 - x0) + 2 * (y1 - y0)) AS BIGINT) AS around,
                 CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS m2 FROM area GROUP BY 1)
SELECT borough, round(CAST(around - coalesce(shared, 0) AS DOUBLE), 3) AS perimeter_m, round(m2, 3) AS area_m2
FROM total LEFT JOIN inner_sides USING (borough)"""


def dissolve_rings(spark, sf):
    """Stitched outline of the whole tiling: one row per ring."""
    rings = dissolved_rings(T.area(spark, sf).withColumn("city", F.lit("city")), ["city"])
    return rings.select("city", F.col("n_points").cast("bigint").alias("n_points"),
                        F.round("area_m2", 3).alias("area_m2"))


# Key k sits in cell (k % 40, k // 40), so the tiling is a block of full rows, possibly with a ragged first and
# last row; each boundary vertex of a cell side appears once.
DISSOLVE_RINGS_SQL = f"""
WITH {T.AREA_SQL},
sides AS (
  SELECT x0 AS ax, y0 AS ay, x1 AS bx, y0 AS b_y FROM area UNION ALL SELECT x1, y0, x1, y1 FROM area
  UNION ALL SELECT x1, y1, x0, y1 FROM area UNION ALL SELECT x0, y1, x0, y0 FROM area
),
outline AS (SELECT s.* FROM sides s WHERE NOT EXISTS (
  SELECT 1 FROM sides o WHERE o.ax = s.bx AND o.ay = s.b_y AND o.bx = s.ax AND o.b_y = s.ay))
SELECT 'city' AS city, (SELECT count(*) FROM outline) AS n_points,
       (SELECT round(CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE), 3) FROM area) AS area_m2"""


def residential_ndvi(spark, sf):
    """Vegetation inside private (restricted) land-use polygons, and their ground, per area."""
    private = T.unified_green(spark, sf).where(F.col("access_class") == "restricted").select("id", "geom", "kind")
    px = T.pixel_obs(spark, sf).select("x", "y", ndvi(F.col("B08"), F.col("B04")).alias("ndvi"))
    return (pixels_in_areas(px, private, "id").hint("merge").join(private.select("id", "kind"), "id").groupBy("kind")
            .agg(F.round(F.avg("ndvi"), 9).alias("private_ndvi"), F.count("ndvi").alias("n")))


RESIDENTIAL_NDVI_SQL = f"""
WITH {T.GREEN_SQL}, {T.PIXEL_SQL}
SELECT kind, round(avg(ndvi), 9) AS private_ndvi, count(ndvi) AS n
FROM green JOIN px ON x BETWEEN gx0 AND gx1 AND y BETWEEN gy0 AND gy1
WHERE access_class = 'restricted' GROUP BY 1"""


CHECKS = {
    "green_share": (green_share, GREEN_SHARE_SQL),
    "green_share_dissolved": (green_share_dissolved, GREEN_SHARE_DISSOLVED_SQL),
    "angst": (angst, ANGST_SQL),
    "angst_population": (angst_population, ANGST_POPULATION_SQL),
    "nearest_green": (nearest_green, NEAREST_GREEN_SQL),
    "bbox_filter": (bbox_filter, BBOX_FILTER_SQL),
    "access_class_union": (access_class_union, ACCESS_CLASS_UNION_SQL),
    "greenspace_functions": (greenspace_functions, GREENSPACE_FUNCTIONS_SQL),
    "semi_filter": (semi_filter, SEMI_FILTER_SQL),
    "overlap_weights": (overlap_weights, OVERLAP_WEIGHTS_SQL),
    "city_extent": (city_extent, CITY_EXTENT_SQL),
    "dissolve_city": (dissolve_city, DISSOLVE_CITY_SQL),
    "dissolve_rings": (dissolve_rings, DISSOLVE_RINGS_SQL),
    "residential_ndvi": (residential_ndvi, RESIDENTIAL_NDVI_SQL),
}
