"""Band arithmetic, mosaics, composites, zonal statistics and raster neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as T
from greenspark.functions import spectral as S
from greenspark.operators import clusters, components, raster, scenes, zonal
from greenspark.functions import geometry as G

BANDS = ["B02", "B03", "B04", "B08"]


def _b(name):
    return F.col(name)


def _ndvi():
    return S.ndvi(_b("B08"), _b("B04"))


def ndvi_pixels(spark, sf):
    return T.pixel_obs(spark, sf).select(
        "obs_order", "obs_part", "x", "y", F.round(_ndvi(), 9).alias("ndvi"),
        F.round(S.ndvi(_b("B08"), _b("B04"), zero_fill=True), 9).alias("ndvi_filled"))


NDVI_PIXELS_SQL = f"""
WITH {T.PIXEL_SQL}
SELECT obs_order, obs_part, x, y, round(ndvi, 9) AS ndvi, round(ndvi, 9) AS ndvi_filled FROM px"""


def ndwi(spark, sf):
    px = T.pixel_obs(spark, sf).withColumn("ndwi", S.ndwi(_b("B03"), _b("B08")))
    return px.groupBy("year").agg(F.round(F.avg("ndwi"), 9).alias("ndwi"), F.round(F.min("ndwi"), 9).alias("low"),
                                  F.round(F.max("ndwi"), 9).alias("high"), F.count("ndwi").alias("n"))


NDWI_SQL = f"""
WITH {T.PIXEL_SQL}, q AS (SELECT year, CASE WHEN B03 + B08 > 0 THEN (B03 - B08) / (B03 + B08) END AS v FROM obs)
SELECT year, round(avg(v), 9) AS ndwi, round(min(v), 9) AS low, round(max(v), 9) AS high, count(v) AS n FROM q GROUP BY 1"""


def bsi(spark, sf):
    """Bare-soil index with digital numbers scaled on the fly; B03 stands in for the short-wave band."""
    dn = T.pixel_obs(spark, sf).select("year", *[F.round(_b(b) * 10000).alias(b) for b in BANDS])
    px = dn.select("year", *[S.reflectance(_b(b)).alias(b) for b in BANDS])
    value = S.bsi(_b("B03"), _b("B04"), _b("B08"), _b("B02"))
    return px.select("year", value.alias("v"), S.bare_soil(_b("B04"), _b("B08")).alias("bare")).groupBy("year").agg(
        F.round(F.avg("v"), 9).alias("bsi"), F.count("v").alias("n"), F.round(raster.share(F.col("bare")), 9).alias("bare_share"))


BSI_SQL = f"""
WITH {T.PIXEL_SQL}
SELECT year, round(avg(((B03 + B04) - (B08 + B02)) / (B03 + B04 + B08 + B02)), 9) AS bsi, count(B08) AS n,
       round(avg((B04 > B08 AND B08 < 0.2)::INT), 9) AS bare_share FROM obs GROUP BY 1"""


def true_colour(spark, sf):
    px = T.pixel_obs(spark, sf).withColumn("c", S.true_colour(_b("B04"), _b("B03"), _b("B02")))
    return px.groupBy("year").agg(*[F.round(F.avg(f"c.{c}"), 9).alias(c) for c in "rgb"],
                                  F.count_if(F.col("c.r") >= 0.3).alias("bright"))


TRUE_COLOUR_SQL = f"""
WITH {T.PIXEL_SQL}
SELECT year, round(avg(least(1, greatest(0, B04 * 3)) + 0 * B04), 9) AS r, round(avg(least(1, greatest(0, B03 * 3)) + 0 * B03), 9) AS g,
       round(avg(least(1, greatest(0, B02 * 3)) + 0 * B02), 9) AS b, count(*) FILTER (WHERE least(1, B04 * 3) >= 0.3 AND B04 IS NOT NULL) AS bright
FROM obs GROUP BY 1"""


def mosaic(spark, sf, where=None):
    obs = T.with_pixel(T.pixel_obs(spark, sf))
    return raster.mosaic_mean(obs if where is None else obs.where(where), ["row", "col"], BANDS)


def mosaic_mean(spark, sf):
    return mosaic(spark, sf).select("row", "col", *[F.round(b, 9).alias(b) for b in BANDS])


MOSAIC_SQL = T.PIXEL_SQL + """, mosaic AS (
  SELECT "row", col, round(avg(B02) FILTER (WHERE B02 > 0), 12) AS B02, round(avg(B03) FILTER (WHERE B03 > 0), 12) AS B03,
         round(avg(B04) FILTER (WHERE B04 > 0), 12) AS B04, round(avg(B08) FILTER (WHERE B08 > 0), 12) AS B08
  FROM px GROUP BY 1, 2
), mndvi AS (SELECT "row", col, CASE WHEN B08 + B04 > 0 THEN (B08 - B04) / (B08 + B04) END AS ndvi FROM mosaic)"""

MOSAIC_MEAN_SQL = f"""
WITH {MOSAIC_SQL}
SELECT "row", col, round(B02, 9) AS B02, round(B03, 9) AS B03, round(B04, 9) AS B04, round(B08, 9) AS B08 FROM mosaic"""


def mosaic_ndvi(spark, sf):
    return mosaic(spark, sf).select("row", "col", _ndvi().alias("ndvi"))


def band_coverage(spark, sf):
    return raster.band_coverage(T.pixel_obs(spark, sf), BANDS).select("band", F.round("coverage", 9).alias("coverage"), "min_value", "max_value")


BAND_COVERAGE_SQL = f"WITH {T.PIXEL_SQL} " + " UNION ALL ".join(
    f"SELECT '{b}' AS band, round(avg(({b} IS NOT NULL AND {b} > 0)::INT), 9) AS coverage, min({b}) FILTER (WHERE {b} > 0) AS min_value, "
    f"max({b}) FILTER (WHERE {b} > 0) AS max_value FROM obs" for b in BANDS)


def raster_threshold(spark, sf):
    """Canopy mask computed on tile arrays: band algebra, comparison, count per tile."""
    size = 16
    px = mosaic(spark, sf)
    tiles = px.groupBy(F.floor(F.col("row") / size).alias("tile_r"), F.floor(F.col("col") / size).alias("tile_c")).agg(
        F.array_sort(F.collect_list(F.struct("row", "col", "B04", "B08"))).alias("p"))
    red, nir = F.transform("p", lambda s: s["B04"]), F.transform("p", lambda s: s["B08"])
    index = S.tile_divide(S.tile_subtract(nir, red), S.tile_add(nir, red))
    return tiles.withColumn("mask", S.tile_at_least(index, 0.6)).select(
        "tile_r", "tile_c", F.size("mask").cast("bigint").alias("n"),
        F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("canopy"))


RASTER_THRESHOLD_SQL = f"""
WITH {MOSAIC_SQL}
SELECT "row" // 16 AS tile_r, col // 16 AS tile_c, count(*) AS n,
       count(*) FILTER (WHERE (B08 - B04) / nullif(B08 + B04, 0) >= 0.6) AS canopy FROM mosaic GROUP BY 1, 2"""


def canopy_share(spark, sf):
    px = T.pixel_obs(spark, sf).withColumn("ndvi", _ndvi())
    return px.groupBy("scene").agg(F.round(raster.share(F.col("ndvi") > 0.6), 9).alias("canopy_share"))


CANOPY_SHARE_SQL = f"WITH {T.PIXEL_SQL} SELECT scene, round(avg((ndvi > 0.6)::INT), 9) AS canopy_share FROM px GROUP BY 1"


def year_median(spark, sf):
    obs = T.with_pixel(T.pixel_obs(spark, sf)).withColumn("ndvi", _ndvi())
    summer = raster.season(obs, "scene")
    return raster.yearly_composite(summer, ["row", "col", "year"], "ndvi", "scene").withColumn("ndvi_median", F.round("ndvi_median", 10))


YEAR_MEDIAN_SQL = f"""
WITH {T.PIXEL_SQL}
SELECT "row", col, year, round(median(ndvi), 10) AS ndvi_median, count(DISTINCT scene) AS n_scenes
FROM px WHERE ndvi IS NOT NULL AND month(scene) BETWEEN 6 AND 8 GROUP BY 1, 2, 3"""


def _change(spark, sf):
    early = mosaic(spark, sf, "year <= 1996").select("row", "col", _ndvi().alias("ndvi"))
    late = mosaic(spark, sf, "year >= 1997").select("row", "col", _ndvi().alias("ndvi"))
    return raster.change(early, late, ["row", "col"], "ndvi")


def ndvi_delta(spark, sf):
    return _change(spark, sf).select("row", "col", *[F.round(c, 9).alias(c) for c in ("early", "late", "delta")])


CHANGE_SQL = T.PIXEL_SQL + """, two AS (
  SELECT "row", col, round(avg(B04) FILTER (WHERE year <= 1996), 12) AS r0, round(avg(B08) FILTER (WHERE year <= 1996), 12) AS n0,
         round(avg(B04) FILTER (WHERE year >= 1997), 12) AS r1, round(avg(B08) FILTER (WHERE year >= 1997), 12) AS n1,
         count(*) FILTER (WHERE year <= 1996) AS c0, count(*) FILTER (WHERE year >= 1997) AS c1
  FROM px GROUP BY 1, 2
), change AS (
  SELECT "row", col, (n0 - r0) / (n0 + r0) AS early, (n1 - r1) / (n1 + r1) AS late,
         (n1 - r1) / (n1 + r1) - (n0 - r0) / (n0 + r0) AS delta FROM two WHERE c0 > 0 AND c1 > 0
)"""
NDVI_DELTA_SQL = f'WITH {CHANGE_SQL} SELECT "row", col, round(early, 9) AS early, round(late, 9) AS late, round(delta, 9) AS delta FROM change'


def zonal_stats(spark, sf):
    """Observations against sheared areas: the general point-in-polygon kernel on non-rectangles."""
    px = T.pixel_obs(spark, sf).select("x", "y", _ndvi().alias("ndvi"))
    clipped = zonal.pixels_in_areas(px, T.area(spark, sf, shear=0.25))
    return zonal.zonal_stats(clipped, "ndvi").select("area_code", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max")])


ZONAL_STATS_SQL = f"""
WITH {T.AREA_SQL}, {T.PIXEL_SQL}
SELECT area_code, count(ndvi) AS n, round(avg(ndvi), 9) AS mean, round(stddev_pop(ndvi), 9) AS std, round(min(ndvi), 9) AS min, round(max(ndvi), 9) AS max
FROM area JOIN px ON px.y >= y0 AND px.y < y1 AND px.x - 0.25 * px.y >= x0 AND px.x - 0.25 * px.y < x1 GROUP BY 1"""


def _clipped_change(spark, sf):
    centres = _change(spark, sf).select("*", ((F.col("col") + 0.5) * 500).alias("x"), ((F.col("row") + 0.5) * 500).alias("y"))
    return zonal.pixels_in_areas(centres, T.area(spark, sf))


CLIPPED_CHANGE_SQL = f"""{T.AREA_SQL}, {CHANGE_SQL}, clipped AS (
  SELECT area_code, change.* FROM area JOIN change ON (col + 0.5) * 500 >= x0 AND (col + 0.5) * 500 < x1 AND ("row" + 0.5) * 500 >= y0 AND ("row" + 0.5) * 500 < y1)"""


def zonal_delta_props(spark, sf):
    return zonal.change_props(_clipped_change(spark, sf), "delta").select(
        "area_code", "n_valid", *[F.round(c, 9).alias(c) for c in ("mean_delta_ndvi", "prop_greener", "prop_greyer")])


ZONAL_DELTA_SQL = f"""
WITH {CLIPPED_CHANGE_SQL}
SELECT area_code, count(delta) AS n_valid, round(avg(delta), 9) AS mean_delta_ndvi, round(avg((delta > 0)::INT), 9) AS prop_greener,
       round(avg((delta < 0)::INT), 9) AS prop_greyer FROM clipped GROUP BY 1"""


def change_uncertainty(spark, sf):
    return zonal.change_uncertainty(_clipped_change(spark, sf), "delta").select(
        "area_code", "n_valid", *[F.round(c, 9).alias(c) for c in ("mean_delta_ndvi", "sd_delta", "se_delta")])


CHANGE_UNCERTAINTY_SQL = f"""
WITH {CLIPPED_CHANGE_SQL}
SELECT area_code, count(delta) AS n_valid, round(avg(delta), 9) AS mean_delta_ndvi, round(stddev_samp(delta), 9) AS sd_delta,
       round(stddev_samp(delta) / sqrt(nullif(count(delta), 0)), 9) AS se_delta FROM clipped GROUP BY 1"""

SPECTRAL_COLS = ["ndvi_std", "prop_water", "prop_bare_soil", "canopy_share", "ndvi_p10", "ndvi_p90"]


def spectral_props(spark, sf):
    px = T.pixel_obs(spark, sf).select("x", "y", "B03", "B04", "B08")
    return zonal.spectral_props(zonal.pixels_in_areas(px, T.area(spark, sf))).select(
        "area_code", *[F.round(c, 10).alias(c) for c in SPECTRAL_COLS])


SPECTRAL_PROPS_SQL = f"""
WITH {T.AREA_SQL}, {T.PIXEL_SQL},
c AS (SELECT area_code, px.*, (B03 - B08) / (B03 + B08) AS ndwi FROM area JOIN px ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)
SELECT area_code, round(stddev_pop(ndvi), 10) AS ndvi_std, round(avg((ndwi > 0.2)::INT), 10) AS prop_water,
       round(avg((B04 > B08 AND B08 < 0.2)::INT), 10) AS prop_bare_soil, round(avg((ndvi > 0.6)::INT), 10) AS canopy_share,
       round(quantile_cont(ndvi, 0.1), 10) AS ndvi_p10, round(quantile_cont(ndvi, 0.9), 10) AS ndvi_p90
FROM c GROUP BY 1"""


def focal_texture(spark, sf):
    return raster.focal_std(mosaic_ndvi(spark, sf), "ndvi").select("row", "col", F.round("texture", 8).alias("texture"), "n_window")


FOCAL_SQL = f"""
WITH {MOSAIC_SQL}
SELECT a."row", a.col, round(stddev_pop(b.ndvi), 8) AS texture, count(*) AS n_window
FROM mndvi a JOIN mndvi b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
WHERE a.ndvi IS NOT NULL AND b.ndvi IS NOT NULL GROUP BY 1, 2"""


def pyramid(spark, sf):
    return raster.pyramid(mosaic_ndvi(spark, sf), "ndvi").select(
        F.col("level").cast("bigint").alias("level"), "row", "col", F.round("ndvi", 9).alias("ndvi"), "n_pixels")


PYRAMID_SQL = f"""
WITH {MOSAIC_SQL}
SELECT level, CAST(floor("row" / 2 ** level) AS BIGINT) AS "row", CAST(floor(col / 2 ** level) AS BIGINT) AS col, round(avg(ndvi), 9) AS ndvi, count(*) AS n_pixels
FROM mndvi, range(1, 7) t(level) WHERE ndvi IS NOT NULL GROUP BY 1, 2, 3"""


def resample(spark, sf):
    return raster.resample(mosaic_ndvi(spark, sf), "ndvi", 500.0, 500.0, 100.0, 150.0).select(
        "row", "col", F.round("ndvi", 9).alias("ndvi"), F.round("weight", 8).alias("weight"))


RESAMPLE_SQL = f"""
WITH {MOSAIC_SQL},
o AS (SELECT * FROM (VALUES (0, 0, 0.8::DOUBLE * 0.7), (0, 1, 0.2::DOUBLE * 0.7), (1, 0, 0.8::DOUBLE * 0.3), (1, 1, 0.2::DOUBLE * 0.3)) t(dr, dc, wt))
SELECT "row" - dr AS "row", col - dc AS col, round(sum(wt * ndvi) / sum(wt), 9) AS ndvi, round(sum(wt), 8) AS weight
FROM mndvi, o WHERE ndvi IS NOT NULL GROUP BY 1, 2"""


def canopy_patches(spark, sf):
    mask = mosaic_ndvi(spark, sf).where("ndvi >= 0.55").select("row", "col")
    return components.mask_patches(mask, 500.0)


CANOPY_PATCHES_SQL = f"""
WITH RECURSIVE {MOSAIC_SQL},
m AS (SELECT "row" * 2147483648 + col AS node, "row", col FROM mndvi WHERE ndvi >= 0.55),
e AS (SELECT a.node AS a, b.node AS b FROM m a JOIN m b ON abs(a."row" - b."row") + abs(a.col - b.col) = 1),
reach(node, root) AS (SELECT node, node FROM m UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node WHERE reach.root < e.b),
lab AS (SELECT node, min(root) AS patch FROM reach GROUP BY 1)
SELECT patch, count(*) AS n_pixels, CAST(count(*) * 250000 AS DOUBLE) AS m2, min("row") AS row0, max("row") AS row1, min(col) AS col0, max(col) AS col1
FROM lab JOIN m USING (node) GROUP BY 1"""

CENTRES = [[0.04, 0.05, 0.03, 0.15], [0.05, 0.06, 0.08, 0.20], [0.06, 0.07, 0.05, 0.30], [0.07, 0.08, 0.10, 0.35],
           [0.08, 0.09, 0.06, 0.45], [0.09, 0.10, 0.09, 0.50]]


def _assigned(spark, sf):
    obs = T.pixel_obs(spark, sf)
    return clusters.assign(obs, CENTRES)


ASSIGN_SQL = T.PIXEL_SQL + ", asg AS (SELECT *, CASE WHEN B08 IS NOT NULL THEN list_position(ds, list_min(ds)) - 1 END AS cluster FROM (SELECT *, [" + ", ".join(
    f"(B02 - {c[0]}::DOUBLE) * (B02 - {c[0]}::DOUBLE) + (B03 - {c[1]}::DOUBLE) * (B03 - {c[1]}::DOUBLE) + (B04 - {c[2]}::DOUBLE) * (B04 - {c[2]}::DOUBLE) + (B08 - {c[3]}::DOUBLE) * (B08 - {c[3]}::DOUBLE)"
    for c in CENTRES) + "] AS ds FROM obs))"


def kmeans_assign(spark, sf):
    return _assigned(spark, sf).groupBy("year", "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("B08"), 9).alias("nir"))


KMEANS_ASSIGN_SQL = f"WITH {ASSIGN_SQL} SELECT year, CAST(cluster AS INTEGER) AS cluster, count(*) AS n, round(avg(B08), 9) AS nir FROM asg GROUP BY 1, 2"


def kmeans_fit(spark, sf):
    centres = clusters.fit_centres(T.pixel_obs(spark, sf))
    return clusters.assign(T.pixel_obs(spark, sf), centres).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(b).alias(b) for b in BANDS])


def _labelled_areas(spark, sf):
    px = _assigned(spark, sf).select("x", "y", "cluster")
    return zonal.pixels_in_areas(px, T.area(spark, sf))


LABELLED_SQL = f"{T.AREA_SQL}, {ASSIGN_SQL}, la AS (SELECT area_code, cluster FROM area JOIN asg ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 WHERE cluster IS NOT NULL)"


def modal_cluster(spark, sf):
    return clusters.modal_cluster(_labelled_areas(spark, sf), "area_code")


MODAL_SQL = f"""
WITH {LABELLED_SQL}
SELECT area_code, CAST(cluster AS INTEGER) AS modal_cluster, n AS n_modal FROM (
  SELECT area_code, cluster, count(*) AS n, row_number() OVER (PARTITION BY area_code ORDER BY count(*) DESC, cluster) AS k FROM la GROUP BY 1, 2) WHERE k = 1"""


def cluster_mix(spark, sf):
    return clusters.cluster_mix(_labelled_areas(spark, sf), "area_code", 6).select(
        "area_code", *[F.round(f"share_{i}", 9).alias(f"share_{i}") for i in range(6)])


CLUSTER_MIX_SQL = f"WITH {LABELLED_SQL} SELECT area_code, " + ", ".join(
    f"round(avg((cluster = {i})::INT), 9) AS share_{i}" for i in range(6)) + " FROM la GROUP BY 1"

TARGET = (0.0, 0.0, 40000.0, 1000.0)


def _items(spark, sf):
    t = F.col("user_id") % 6
    return T.read(spark, sf, "events").select(
        "event_id", "event_type", (F.col("ts") + F.expr("interval 152 days")).alias("datetime"), F.col("event_id").alias("id"),
        F.get_json_object("props", "$.k").cast("double").alias("cloud"),
        G.box(7000 * t, F.lit(0.0), 7000 * t + 8000, F.lit(1000.0)).alias("box"))


def scene_scores(spark, sf):
    return scenes.date_scores(_items(spark, sf), TARGET).select(
        "date", F.col("year").cast("bigint").alias("year"), "n_scenes", *[F.round(c, 9).alias(c) for c in ("coverage", "avg_cloud", "score")])


SCORES_SQL = """
it AS (SELECT CAST(ts + INTERVAL 152 DAY AS DATE) AS date, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS cloud, user_id % 6 AS t FROM events),
ok AS (SELECT * FROM it WHERE cloud < 15 AND month(date) BETWEEN 6 AND 8),
tl AS (SELECT DISTINCT date, 7000 * t AS a, least(40000, 7000 * t + 8000) AS b FROM ok),
un AS (SELECT date, a, b, max(b) OVER (PARTITION BY date ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM tl),
cv AS (SELECT date, CAST(sum(greatest(0, b - greatest(a, coalesce(top, a)))) AS DOUBLE) / 40000 AS coverage FROM un GROUP BY 1),
cl AS (SELECT date, CAST(year(date) AS BIGINT) AS year, count(*) AS n_scenes, avg(cloud) AS avg_cloud FROM ok GROUP BY 1, 2),
sc AS (SELECT date, year, n_scenes, coverage, avg_cloud, coverage - avg_cloud / 100 AS score FROM cl JOIN cv USING (date))"""
SCENE_SCORES_SQL = f"""WITH {SCORES_SQL}
SELECT date, year, n_scenes, round(coverage, 9) AS coverage, round(avg_cloud, 9) AS avg_cloud, round(score, 9) AS score FROM sc"""


def best_scene_date(spark, sf):
    """Asked for 2025: nothing there, so the year before answers."""
    return scenes.best_date(scenes.date_scores(_items(spark, sf), TARGET), 2025).select("date", "n_scenes", F.round("score", 9).alias("score"))


BEST_SCENE_SQL = f"WITH {SCORES_SQL} SELECT date, n_scenes, round(score, 9) AS score FROM sc ORDER BY score DESC, date LIMIT 1"

CHECKS = {
    "ndvi_pixels": (ndvi_pixels, NDVI_PIXELS_SQL),
    "ndwi": (ndwi, NDWI_SQL),
    "bsi": (bsi, BSI_SQL),
    "true_colour": (true_colour, TRUE_COLOUR_SQL),
    "mosaic_mean": (mosaic_mean, MOSAIC_MEAN_SQL),
    "band_coverage": (band_coverage, BAND_COVERAGE_SQL),
    "raster_threshold": (raster_threshold, RASTER_THRESHOLD_SQL),
    "canopy_share": (canopy_share, CANOPY_SHARE_SQL),
    "year_median": (year_median, YEAR_MEDIAN_SQL),
    "ndvi_delta": (ndvi_delta, NDVI_DELTA_SQL),
    "zonal_stats": (zonal_stats, ZONAL_STATS_SQL),
    "zonal_delta_props": (zonal_delta_props, ZONAL_DELTA_SQL),
    "change_uncertainty": (change_uncertainty, CHANGE_UNCERTAINTY_SQL),
    "spectral_props": (spectral_props, SPECTRAL_PROPS_SQL),
    "focal_texture": (focal_texture, FOCAL_SQL),
    "pyramid": (pyramid, PYRAMID_SQL),
    "resample": (resample, RESAMPLE_SQL),
    "canopy_patches": (canopy_patches, CANOPY_PATCHES_SQL),
    "kmeans_assign": (kmeans_assign, KMEANS_ASSIGN_SQL),
    "kmeans_fit": (kmeans_fit, None),
    "modal_cluster": (modal_cluster, MODAL_SQL),
    "cluster_mix": (cluster_mix, CLUSTER_MIX_SQL),
    "scene_scores": (scene_scores, SCENE_SCORES_SQL),
    "best_scene_date": (best_scene_date, BEST_SCENE_SQL),
}
