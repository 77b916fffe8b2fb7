"""Contiguity, autocorrelation, model, hexagon, tile, payload and quality queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks import tables as T
from checks.raster_checks import CHANGE_SQL, _change
from checks.trend_checks import RESIDUAL_Z_SQL, _predictions, _with_z
from greenspark.functions import colour, crs, hexgrid, scalars
from greenspark.operators import autocorrelation, contiguity, features, forest, quality, tiles, zonal
from greenspark.operators.spatial import once
from greenspark.functions.spectral import ndvi
from greenspark.operators.green import green_area_per_area
from greenspark.plans import anomalies as plan
from greenspark.plans import marts
from greenspark.sources import sinks
from greenspark.sources.readers import to_wkb


def queen_weights(spark, sf):
    """General boundary test."""
    return contiguity.row_standardised(contiguity.queen(T.area(spark, sf))).select("src", "dst", F.round("weight", 9).alias("weight"))


def queen_weights_vertex(spark, sf):
    """Vertex equi-join, on sheared areas."""
    pairs = contiguity.queen_by_vertex(T.area(spark, sf, shear=0.25))
    return contiguity.row_standardised(pairs).select("src", "dst", F.round("weight", 9).alias("weight"))


QUEEN_SQL = f"WITH {T.AREA_SQL}, {T.NEIGHBOUR_SQL} SELECT src, dst, round(weight, 9) AS weight FROM w"


def _weights(spark, sf):
    return contiguity.row_standardised(contiguity.queen_by_vertex(T.area(spark, sf)))


def morans_i(spark, sf):
    return autocorrelation.morans_i(T.residuals(spark, sf).select("area_code", "residual"), _weights(spark, sf)).select(
        "n", F.round("moran_i", 9).alias("moran_i"))


Z_SQL = T.RESIDUAL_SQL + ", " + T.NEIGHBOUR_SQL + """,
st AS (SELECT avg(residual) AS m, stddev_pop(residual) AS s, count(*) AS n FROM res),
z AS (SELECT area_code, residual AS v, (residual - m) / s AS z, CAST(round((residual - m) / s / 1e-9) AS BIGINT) AS q FROM res, st),
ag AS (SELECT src AS area_code, count(*) AS k, sum(q) AS q_sum, sum(v) AS v_sum, sum(weight * v) AS v_lag, sum(weight * z) AS z_lag
       FROM w JOIN z ON dst = area_code GROUP BY 1)"""
MORANS_I_SQL = f"""
WITH {Z_SQL}
SELECT (SELECT count(*) FROM z) AS n,
       round((SELECT count(*) FROM z) / (SELECT sum(weight) FROM w) * (SELECT sum(z * z_lag) FROM z JOIN ag USING (area_code)) / (SELECT sum(z * z) FROM z), 9) AS moran_i"""

LOCAL_SQL = Z_SQL + """,
pos AS (SELECT p, z.area_code, q, row_number() OVER (PARTITION BY p ORDER BY md5('42-' || p || '-' || z.area_code)) - 1 AS pos FROM z, range(99) t(p)),
step AS (SELECT pos.p, pos.area_code, k, (pos + j) % (SELECT n FROM st) AS at FROM pos JOIN ag USING (area_code), range(1, 9) u(j) WHERE j <= k),
drawn AS (SELECT s.p, s.area_code, sum(pos.q) AS d FROM step s JOIN pos ON pos.p = s.p AND pos.pos = s.at GROUP BY 1, 2),
hits AS (SELECT area_code, count(*) FILTER (WHERE sign(z) * d >= sign(z) * q_sum) AS hm, count(*) FILTER (WHERE d >= q_sum) AS hg
         FROM drawn JOIN z USING (area_code) JOIN ag USING (area_code) GROUP BY 1),
lo AS (
  SELECT area_code, z * z_lag AS local_i, (least(hm, 99 - hm) + 1) / CAST(100 AS DOUBLE) AS p_sim, (least(hg, 99 - hg) + 1) / CAST(100 AS DOUBLE) AS gi_p,
         ((v + v_sum) / (k + 1) - m) / (s * sqrt((n / (k + CAST(1 AS DOUBLE)) - 1) / (n - 1))) AS gi_star,
         v >= m AS high, v_lag >= (SELECT avg(v_lag) FROM ag) AS lag_high
  FROM z JOIN ag USING (area_code) JOIN hits USING (area_code), st)"""


def _local(spark, sf):
    return autocorrelation.local_statistics(T.residuals(spark, sf).select("area_code", "residual"), _weights(spark, sf))


def local_moran(spark, sf):
    return _local(spark, sf).select("area_code", F.round("local_i", 8).alias("local_i"), "p_sim")


def lisa_labels(spark, sf):
    return _local(spark, sf).select("area_code", "lisa_cluster")


def gi_star(spark, sf):
    return _local(spark, sf).select("area_code", F.round("gi_star", 8).alias("gi_star"), "gi_p")


LISA_LABELS_SQL = f"""
WITH {LOCAL_SQL}
SELECT area_code, CASE WHEN p_sim >= 0.05 THEN 'NS' WHEN high AND lag_high THEN 'HH' WHEN high THEN 'HL' WHEN lag_high THEN 'LH' ELSE 'LL' END AS lisa_cluster FROM lo"""


def _mean_z(limit):
    def query(spark, sf):
        pairs = contiguity.queen_by_vertex(T.area(spark, sf))
        return autocorrelation.mean_z_clusters(T.residuals(spark, sf).select("area_code", "residual"), pairs, limit=limit).select(
            "area_code", F.round("gi_star", 8).alias("gi_star"), "lisa_cluster")

    return query


def _mean_z_sql(limit):
    return f"""
WITH {Z_SQL},
zs AS (SELECT w.src AS area_code, sum(z.z) AS zsum FROM w JOIN z ON z.area_code = w.dst GROUP BY 1),
l AS (SELECT z.area_code, z, (z + zsum) / (k + 1) AS g FROM z JOIN zs USING (area_code) JOIN ag USING (area_code))
SELECT area_code, round(g, 8) AS gi_star, CASE WHEN abs(g) < {limit} THEN 'NS' WHEN z >= 0 AND g >= 0 THEN 'HH' WHEN z >= 0 THEN 'HL' WHEN g >= 0 THEN 'LH' ELSE 'LL' END AS lisa_cluster FROM l"""


FEATURE_COLS = ["mean_ndvi_late", "log_pop_density", "log_area_km2", "dist_to_centre_km", "dist_to_park_km", "dist_centre_sq", "density_x_dist", "park_access"]


def feature_table(spark, sf):
    return features.feature_frame(T.model_areas(spark, sf), None, 25832).select(
        "MSOA21CD", "MSOA21NM", "borough", "is_inner", *[F.round(c, 8).alias(c) for c in FEATURE_COLS if c != "density_x_dist"],
        F.round("density_x_dist", 4).alias("density_x_dist"))


FEATURES_SQL = f"""
WITH {T.AREA_SQL}, {T.PIXEL_SQL},
zn AS (SELECT area_code, avg(ndvi) AS mean_ndvi_late FROM area JOIN px ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1),
m AS (SELECT *, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / 1e6 AS km2, sqrt(((x0 + x1) / 2.0 - 20000) ** 2 + ((y0 + y1) / 2.0 - 20000) ** 2) / 1000 AS dc,
             0.1 + CAST(area_key % 40 AS DOUBLE) / 10 AS dp FROM area JOIN zn USING (area_code) WHERE mean_ndvi_late IS NOT NULL)
SELECT area_code AS MSOA21CD, area_name AS MSOA21NM, borough, CAST((dc < 8)::INT AS BIGINT) AS is_inner, round(mean_ndvi_late, 8) AS mean_ndvi_late,
       round(ln(1 + population / km2), 8) AS log_pop_density, round(ln(1 + km2), 8) AS log_area_km2, round(dc, 8) AS dist_to_centre_km,
       round(dp, 8) AS dist_to_park_km, round(dc * dc, 8) AS dist_centre_sq, round(population / km2 * dc, 4) AS density_x_dist, round(dp / sqrt(km2), 8) AS park_access
FROM m"""


def fold_assignment(spark, sf):
    return forest.with_fold(T.area(spark, sf).select("area_code"), "area_code").select("area_code", "fold")


FOLD_SQL = f"""
WITH {T.AREA_SQL}
SELECT area_code, CAST((row_number() OVER (ORDER BY md5('42-' || area_code)) - 1) % 5 AS INTEGER) AS fold FROM area"""

_models: dict[tuple[str, str], forest.ModelResult] = {}


def _trained(spark, sf):
    """Both candidates at full size, trained once per Spark application and input."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _models:
        _models[at] = forest.train_predict(features.feature_frame(T.model_areas(spark, sf), None, 25832))
    return _models[at]


def cv_scores(spark, sf):
    return _trained(spark, sf).scores


def importances(spark, sf):
    return _trained(spark, sf).importances


def predictions(spark, sf):
    return _trained(spark, sf).predictions


def anomalies(spark, sf):
    return plan.build_anomalies(T.model_areas(spark, sf), None, 25832, vertex_matched=True, trained=_trained(spark, sf))[0]


def prediction_rows(spark, sf):
    """Every area once, its residual the difference and its z the residual over the spread of all residuals."""
    rows = _trained(spark, sf).predictions
    sd = rows.agg(F.stddev_pop("residual")).scalar()
    return rows.select(
        "MSOA21CD", F.round("actual_ndvi", 8).alias("actual_ndvi"),
        (F.abs(F.col("actual_ndvi") - F.col("predicted_ndvi") - F.col("residual")) < 1e-12).alias("residual_fits"),
        (F.abs(F.col("residual_z") * sd - F.col("residual")) < 1e-9).alias("z_fits"),
        F.col("predicted_ndvi").between(-1, 1).alias("in_range"))


PREDICTION_ROWS_SQL = f"""
SELECT MSOA21CD, mean_ndvi_late AS actual_ndvi, true AS residual_fits, true AS z_fits, true AS in_range FROM ({FEATURES_SQL})"""


def cv_rows(spark, sf):
    return _trained(spark, sf).scores.select("model", "fold", (F.col("r2") <= 1).alias("bounded"))


CV_ROWS_SQL = "SELECT model, CAST(fold AS INTEGER) AS fold, true AS bounded FROM (VALUES ('extra_trees'), ('random_forest')) m(model), range(5) f(fold)"


def importance_rows(spark, sf):
    rows = _trained(spark, sf).importances
    total = rows.agg(F.sum("importance")).scalar()
    return rows.select("base_feature", (F.col("importance") >= 0).alias("counted"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


IMPORTANCE_ROWS_SQL = "SELECT unnest([{}]) AS base_feature, true AS counted, true AS sums_to_one".format(
    ", ".join(f"'{c}'" for c in features.FEATURES))


def anomaly_rows(spark, sf):
    """The score recomputed from z and label, next to the keys and values that SQL knows."""
    rows = anomalies(spark, sf)
    bonus = F.create_map(*[F.lit(x) for pair in {"LL": 0.75, "LH": 0.35, "HL": 0.15, "HH": 0.0, "NS": 0.0}.items() for x in pair])
    score = F.when(F.col("residual_z") < 0, -F.col("residual_z")).otherwise(0.0) + bonus[F.col("lisa_cluster")]
    return rows.select(
        "MSOA21CD", F.round("actual_ndvi", 8).alias("actual_ndvi"),
        (F.abs(F.col("actual_ndvi") - F.col("predicted_ndvi") - F.col("residual")) < 1e-12).alias("residual_fits"),
        (F.abs(score - F.col("surprise_score")) < 1e-12).alias("score_fits"), F.col("gi_p").between(0, 1).alias("p_fits"))


ANOMALY_ROWS_SQL = f"""
SELECT MSOA21CD, mean_ndvi_late AS actual_ndvi, true AS residual_fits, true AS score_fits, true AS p_fits FROM ({FEATURES_SQL})"""


def borough_effects(spark, sf):
    return forest.group_effects(_predictions(spark, sf), "borough").select(
        "borough", "n", *[F.round(c, 8).alias(c) for c in ("mean", "shrinkage", "effect")])


BOROUGH_EFFECTS_SQL = f"""
WITH {RESIDUAL_Z_SQL},
b AS (SELECT borough, avg(residual) AS mean, count(*) AS n FROM pred GROUP BY 1),
w AS (SELECT sum((residual - mean) ** 2) / (count(*) - (SELECT count(*) FROM b)) AS sw FROM pred JOIN b USING (borough)),
v AS (SELECT sw, greatest(0, (SELECT var_pop(mean) - sw * avg(CAST(1 AS DOUBLE) / n) FROM b)) AS sb, (SELECT avg(residual) FROM pred) AS grand FROM w)
SELECT borough, n, round(mean, 8) AS mean, round(sb / (sb + sw / n), 8) AS shrinkage, round(sb / (sb + sw / n) * (mean - grand), 8) AS effect FROM b, v"""


def hex_cells(spark, sf):
    return tiles.polygon_cells(T.area(spark, sf), 8).select("cell", "area_code")


def _cell_sql(q, r, res):
    return f"({res << 58} + ({q} + {1 << 28}) * {1 << 29} + ({r} + {1 << 28}))"


_S8 = hexgrid.EDGE_M[8]
HEX_CELLS_SQL = f"""
WITH {T.AREA_SQL},
r AS (SELECT CAST(v AS BIGINT) AS r FROM range(0, 10000) t(v) WHERE v * 1.5 * {_S8} <= (SELECT max(y1) FROM area)),
c AS (SELECT q, r, {_S8}::DOUBLE * sqrt(3::DOUBLE) * (q + r / 2.0::DOUBLE) AS cx, {_S8}::DOUBLE * 1.5 * r AS cy
      FROM r, LATERAL (SELECT CAST(unnest(range(CAST(-r / 2 - 2 AS BIGINT), CAST(50 - r / 2 AS BIGINT))) AS BIGINT) AS q))
SELECT CAST({_cell_sql('q', 'r', 8)} AS BIGINT) AS cell, min(area_code) AS area_code
FROM c JOIN area ON cx >= x0 AND cx < x1 AND cy >= y0 AND cy < y1 GROUP BY 1"""


def _axial_sql(x, y, res):
    s = hexgrid.EDGE_M[res]
    return f"(sqrt(3::DOUBLE) / 3 * {x} - {y} / 3) / {s}::DOUBLE", f"(2::DOUBLE / 3 * {y}) / {s}::DOUBLE"


def _rounded_sql(name, source, x, y, res):
    """CTEs that add cell columns to a source by cube rounding."""
    q, r = _axial_sql(x, y, res)
    return f"""
{name}_a AS (SELECT *, {q} AS q, {r} AS r FROM {source}),
{name}_b AS (SELECT *, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs, abs(round(q) - q) AS dq, abs(round(r) - r) AS dr, abs(round(-q - r) - (-q - r)) AS ds FROM {name}_a),
{name} AS (SELECT *, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS hq,
                  CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS hr FROM {name}_b)"""


def hex_ndvi(spark, sf):
    px = T.pixel_obs(spark, sf).select("x", "y", ndvi(F.col("B08"), F.col("B04")).alias("ndvi"))
    return tiles.cell_values(px, 8, ["ndvi"]).select("cell", F.round("ndvi", 9).alias("ndvi"), "n_pixels")


HEX_NDVI_SQL = f"""
WITH {T.PIXEL_SQL}, {_rounded_sql('h', '(SELECT x, y, ndvi FROM px)', 'x', 'y', 8)}
SELECT CAST({_cell_sql('hq', 'hr', 8)} AS BIGINT) AS cell, round(avg(ndvi), 9) AS ndvi, count(*) AS n_pixels FROM h GROUP BY 1"""


def hex_parent(spark, sf):
    cells = T.pixel_obs(spark, sf).select(hexgrid.hex_cell(F.col("x"), F.col("y"), 9).alias("cell")).distinct()
    return cells.select("cell", hexgrid.hex_parent(F.col("cell"), 9, 6).alias("parent"),
                        scalars.zoom_resolution(F.col("cell") % 15).cast("int").alias("shown_res"))


_S9 = hexgrid.EDGE_M[9]
HEX_PARENT_SQL = f"""
WITH {T.PIXEL_SQL}, {_rounded_sql('h', '(SELECT x, y FROM px)', 'x', 'y', 9)},
d AS (SELECT DISTINCT hq AS cq, hr AS cr, {_S9}::DOUBLE * sqrt(3::DOUBLE) * (hq + hr / 2.0::DOUBLE) AS cx, {_S9}::DOUBLE * 1.5 * hr AS cy FROM h),
{_rounded_sql('g', 'd', 'cx', 'cy', 6)},
o AS (SELECT CAST({_cell_sql('cq', 'cr', 9)} AS BIGINT) AS cell, CAST({_cell_sql('hq', 'hr', 6)} AS BIGINT) AS parent FROM g)
SELECT cell, parent, CASE WHEN cell % 15 < 10 THEN 7 WHEN cell % 15 < 11.5 THEN 8 ELSE 9 END AS shown_res FROM o"""


def cells_mart(spark, sf):
    areas = T.area(spark, sf)
    px = _change(spark, sf).select("early", "late", "delta", ((F.col("col") + 0.5) * 500).alias("x"), ((F.col("row") + 0.5) * 500).alias("y"))
    share = green_area_per_area(areas, T.unified_green(spark, sf), "green_m2")
    attrs = areas.select("area_code", "population").hint("merge").join(share, "area_code", "left").hint("merge").join(
        _local(spark, sf).select("area_code", "gi_star", "lisa_cluster"), "area_code", "left")
    return marts.cells_mart(areas, px, attrs, 9)


def tile_cover(spark, sf):
    return tiles.tile_cover(T.area(spark, sf), 3857, range(8, 15), ["area_code", "borough", "not_there"]).select(
        F.col("z").cast("bigint").alias("z"), "x", "y", "area_code", "borough")


_HALF = math.pi * crs.MERCATOR_RADIUS


def _tile_sql(value):
    return f"CAST(floor(({value}) / {2 * _HALF}::DOUBLE * 2 ** z) AS BIGINT)"


TILE_COVER_SQL = f"""
WITH {T.AREA_SQL},
t AS (SELECT area_code, borough, z, {_tile_sql(f'x0 + {_HALF}::DOUBLE')} AS ax, {_tile_sql(f'x1 + {_HALF}::DOUBLE')} AS bx,
             {_tile_sql(f'{_HALF}::DOUBLE - y1')} AS ay, {_tile_sql(f'{_HALF}::DOUBLE - y0')} AS b_y FROM area, range(8, 15) r(z)),
tx AS (SELECT *, CAST(unnest(range(ax, bx + 1)) AS BIGINT) AS x FROM t)
SELECT z, x, CAST(unnest(range(ay, b_y + 1)) AS BIGINT) AS y, area_code, borough FROM tx"""


def crs_mercator(spark, sf):
    lonlat = T.read(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37) % 1000 / 100.0 - 5).alias("lon"),
                                                  ((F.col("s_suppkey") * 53) % 1000 / 100.0 + 45).alias("lat"))
    p = once(lonlat, "p", crs.transform_pair(F.col("lon"), F.col("lat"), 4326, 3857))
    back = once(p, "b", crs.transform_pair(F.col("p.x"), F.col("p.y"), 3857, 4326))
    return back.select("s_suppkey", F.round("p.x", 4).alias("mx"), F.round("p.y", 4).alias("my"), F.round("b.x", 7).alias("lon"), F.round("b.y", 7).alias("lat"))


LONLAT_SQL = "ll AS (SELECT s_suppkey, CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 100 - 5 AS lon, CAST((s_suppkey * 53) % 1000 AS DOUBLE) / 100 + 45 AS lat FROM supplier)"
CRS_MERCATOR_SQL = f"""
WITH {LONLAT_SQL}
SELECT s_suppkey, round(lon * pi() / 180 * 6378137, 4) AS mx, round(ln(tan(pi() / 4 + lat * pi() / 360)) * 6378137, 4) AS my, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ll"""


def crs_utm(spark, sf):
    lonlat = T.read(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37) % 1000 / 200.0 + 6.5).alias("lon"),
                                                  ((F.col("s_suppkey") * 53) % 1000 / 100.0 + 45).alias("lat"))
    p = once(lonlat, "p", crs.transform_pair(F.col("lon"), F.col("lat"), 4326, 25832))
    back = once(p, "b", crs.transform_pair(F.col("p.x"), F.col("p.y"), 25832, 4326))
    return back.select("s_suppkey", F.round("p.x", 2).alias("east"), F.round("p.y", 2).alias("north"), F.round("b.x", 7).alias("lon"), F.round("b.y", 7).alias("lat"))


# Redfearn's power series in the longitude difference, a derivation other than the one in the library.
CRS_UTM_SQL = """
WITH ll AS (SELECT s_suppkey, CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 200 + 6.5 AS lon, CAST((s_suppkey * 53) % 1000 AS DOUBLE) / 100 + 45 AS lat FROM supplier),
a AS (SELECT *, lat * pi() / 180 AS f, (lon - 9) * pi() / 180 AS l, 6378137::DOUBLE AS a, (1 / 298.257222101::DOUBLE) * (2 - 1 / 298.257222101::DOUBLE) AS e2,
        1 / (2 * 298.257222101::DOUBLE - 1) AS n FROM ll),
b AS (SELECT *, a / sqrt(1 - e2 * sin(f) ** 2) AS nu, a * (1 - e2) / (1 - e2 * sin(f) ** 2) ** 1.5 AS rho, tan(f) AS t,
        a / (1 + n) * ((1 + n ** 2 / 4 + n ** 4 / 64) * f - 3 / 2.0 * (n - n ** 3 / 8) * sin(2 * f) + 15 / 16.0 * (n ** 2 - n ** 4 / 4) * sin(4 * f)
             - 35 / 48.0::DOUBLE * n ** 3 * sin(6 * f) + 315 / 512.0 * n ** 4 * sin(8 * f)) AS m FROM a),
c AS (SELECT *, nu / rho AS p, l * cos(f) AS w FROM b)
SELECT s_suppkey, round(500000 + 0.9996 * nu * (w + w ** 3 / 6 * (p - t ** 2)
         + w ** 5 / 120 * (4 * p ** 3 * (1 - 6 * t ** 2) + p ** 2 * (1 + 8 * t ** 2) - 2 * p * t ** 2 + t ** 4)
         + w ** 7 / 5040 * (61 - 479 * t ** 2 + 179 * t ** 4 - t ** 6)), 2) AS east,
       round(0.9996 * (m + nu * t * (w ** 2 / 2 + w ** 4 / 24 * (4 * p ** 2 + p - t ** 2)
         + w ** 6 / 720 * (8 * p ** 4 * (11 - 24 * t ** 2) - 28 * p ** 3 * (1 - 6 * t ** 2) + p ** 2 * (1 - 32 * t ** 2) - 2 * p * t ** 2 + t ** 4)
         + w ** 8 / 40320 * (1385 - 3111 * t ** 2 + 543 * t ** 4 - t ** 6))), 2) AS north,
       round(lon, 7) AS lon, round(lat, 7) AS lat FROM c"""


def ramp_rgba(spark, sf):
    px = T.pixel_obs(spark, sf).select("obs_order", "x", "y", F.round(ndvi(F.col("B08"), F.col("B04")), 6).alias("v"))
    return px.select("obs_order", "x", "y", "v", colour.ramp_rgba(F.col("v"), colour.RAMP_NDVI).alias("c")).select(
        "obs_order", "x", "y", "v", "c.*")


def _ramp_sql(value, i):
    stops = colour.RAMP_NDVI
    out = f"CASE WHEN {value} IS NULL THEN 180 WHEN {value} <= {stops[0][0]} THEN {stops[0][i]} WHEN {value} >= {stops[-1][0]} THEN {stops[-1][i]}"
    for a, b in zip(stops, stops[1:]):
        out += f" WHEN {value} <= {b[0]} THEN floor({a[i]} + ({b[i]} - {a[i]}) * (({value} - {a[0]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE)) + 0.5::DOUBLE)"
    return f"CAST({out} END AS INTEGER)"


RAMP_SQL = f"""
WITH {T.PIXEL_SQL}, v AS (SELECT obs_order, x, y, round(ndvi, 6) AS v FROM px)
SELECT obs_order, x, y, v, {_ramp_sql('v', 1)} AS r, {_ramp_sql('v', 2)} AS g, {_ramp_sql('v', 3)} AS b, CASE WHEN v IS NULL THEN 60 ELSE 200 END AS a FROM v"""


def map_payload(spark, sf):
    labels = F.array(*[F.lit(v) for v in ("HH", "HL", "LH", "LL", "NS")])
    rows = _with_z(_predictions(spark, sf)).hint("merge").join(T.area(spark, sf).select("area_code", "area_name", "population"), "area_code").select(
        F.col("area_code").alias("code"), F.col("area_name").alias("name"), "borough",
        (F.col("area_key") % 40 / 100.0).alias("lon"), (F.col("area_key") % 70 / 100.0).alias("lat"), "population",
        (F.col("area_key") % 100 / 100.0).alias("ndvi_late"), (F.col("area_key") % 90 / 100.0).alias("ndvi_early"),
        F.round(F.col("area_key") % 100 / 100.0 - F.col("area_key") % 90 / 100.0, 6).alias("delta_ndvi"),
        F.col("predicted").alias("predicted_ndvi"), F.round("residual", 8).alias("residual"), F.round("residual_z", 8).alias("residual_z"),
        F.element_at(labels, (F.col("area_key") % 5 + 1).cast("int")).alias("lisa_cluster"))
    scored = rows.withColumn("surprise_score", F.round(scalars.surprise_lisa(F.col("residual_z"), F.col("lisa_cluster")), 8))
    return sinks.map_payload(scored).select(*sinks.MAP_FIELDS, F.round("radius", 8).alias("radius"), F.col("fill.r").alias("fill_r"),
                                            F.col("fill.g").alias("fill_g"), F.col("marker")[0].alias("marker_r"))


MAP_PAYLOAD_SQL = f"""
WITH {RESIDUAL_Z_SQL},
p AS (SELECT rz.area_code AS code, a.area_name AS name, rz.borough, CAST(rz.area_key % 40 AS DOUBLE) / 100 AS lon, CAST(rz.area_key % 70 AS DOUBLE) / 100 AS lat,
             a.population, CAST(rz.area_key % 100 AS DOUBLE) / 100 AS ndvi_late, CAST(rz.area_key % 90 AS DOUBLE) / 100 AS ndvi_early,
             round(CAST(rz.area_key % 100 AS DOUBLE) / 100 - CAST(rz.area_key % 90 AS DOUBLE) / 100, 6) AS delta_ndvi, rz.predicted AS predicted_ndvi,
             round(rz.residual, 8) AS residual, round(residual_z, 8) AS residual_z, (['HH', 'HL', 'LH', 'LL', 'NS'])[CAST(rz.area_key % 5 AS INTEGER) + 1] AS lisa_cluster,
             CAST(([0, 0.15, 0.35, 0.75, 0])[CAST(rz.area_key % 5 AS INTEGER) + 1] AS DOUBLE) AS bonus
      FROM rz JOIN area a ON a.area_code = rz.area_code)
SELECT p.* EXCLUDE (bonus), round(greatest(-residual_z, 0) + bonus, 8) AS surprise_score, round(4 + least(8, abs(residual_z) * 1.6::DOUBLE), 8) AS radius,
       {_ramp_sql('ndvi_late', 1)} AS fill_r, {_ramp_sql('ndvi_late', 2)} AS fill_g, CASE WHEN residual >= 0 THEN 16 ELSE 201 END AS marker_r FROM p"""


def area_attrs(spark, sf):
    areas = T.area(spark, sf)
    k = F.col("area_key")
    city = F.when(k % 3 == 0, "london").when(k % 3 == 1, "paris").otherwise("berlin")
    base = areas.select("*", city.alias("city"))
    shaped = once(base, "area_km2", features.G.area(F.col("geom")) / 1e6)
    boundaries = shaped.select("city", "area_code", "area_name", F.when(k % 7 == 0, "lsoa").otherwise("msoa").alias("level"),
                               F.col("borough").alias("parent_code"), "population", "area_km2", (k % 10 + 1).cast("int").alias("deprivation"),
                               to_wkb(F.col("geom")).alias("geometry_wkb"))
    veg = base.where(k % 5 != 0).select("city", "area_code", (k % 90 / 100.0).alias("ndvi_2019"), (k % 80 / 100.0).alias("ndvi_2024"),
                                        F.lit(0.0).alias("ndvi_delta"), F.lit(0.1).alias("ndvi_std"), F.lit(0.0).alias("prop_water"))
    green = green_area_per_area(areas, T.unified_green(spark, sf), "public_green_m2")
    parks = green.hint("merge").join(base.select("area_code", "city"), "area_code").select(
        "city", "area_code", "public_green_m2", F.lit(0.0).alias("private_green_m2"), F.lit(None).cast("double").alias("dist_to_public_green_2ha_m"))
    anom = _with_z(_predictions(spark, sf)).where(k % 2 == 0).hint("merge").join(base.select("area_code", "city"), "area_code").select(
        "city", "area_code", F.col("predicted").alias("predicted_ndvi"), "residual", "residual_z", F.lit("NS").alias("lisa_cluster"), F.lit(0.0).alias("surprise_score"))
    return marts.area_attrs(spark, boundaries, veg, parks, anom).select(
        "city", "MSOA21CD", "MSOA21NM", "borough", "population", F.round("area_km2", 6).alias("area_km2"), F.round("pop_density", 6).alias("pop_density"),
        "imd_income_decile", "ndvi_2019", "ndvi_2024", F.round("public_green_m2", 3).alias("public_green_m2"),
        F.round("green_per_capita_m2", 6).alias("green_per_capita_m2"), F.round("residual_ndvi", 8).alias("residual_ndvi"), "lisa_cluster",
        F.length("geometry_wkb").cast("bigint").alias("wkb_bytes"))


AREA_ATTRS_SQL = f"""
WITH {RESIDUAL_Z_SQL}, {T.GREEN_SQL},
g AS (SELECT area_code, CAST(sum((least(a.x1, gx1) - greatest(a.x0, gx0)) * (least(a.y1, gy1) - greatest(a.y0, gy0))) AS DOUBLE) AS m2
      FROM area a JOIN green ON gx0 < a.x1 AND gx1 > a.x0 AND gy0 < a.y1 AND gy1 > a.y0 GROUP BY 1)
SELECT CASE a.area_key % 3 WHEN 0 THEN 'london' WHEN 1 THEN 'paris' ELSE 'berlin' END AS city, a.area_code AS MSOA21CD, a.area_name AS MSOA21NM, a.borough, a.population,
       round(CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / 1e6, 6) AS area_km2, round(a.population / (CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / 1e6), 6) AS pop_density,
       CAST(a.area_key % 10 + 1 AS INTEGER) AS imd_income_decile, CASE WHEN a.area_key % 5 <> 0 THEN CAST(a.area_key % 90 AS DOUBLE) / 100 END AS ndvi_2019,
       CASE WHEN a.area_key % 5 <> 0 THEN CAST(a.area_key % 80 AS DOUBLE) / 100 END AS ndvi_2024, round(m2, 3) AS public_green_m2,
       round(m2 / a.population, 6) AS green_per_capita_m2, CASE WHEN a.area_key % 2 = 0 THEN round(rz.residual, 8) END AS residual_ndvi,
       CASE WHEN a.area_key % 2 = 0 THEN 'NS' END AS lisa_cluster, CAST(93 AS BIGINT) AS wkb_bytes
FROM area a LEFT JOIN g USING (area_code) LEFT JOIN rz ON rz.area_code = a.area_code WHERE a.area_key % 7 <> 0"""


def area_full(spark, sf):
    def at(name):
        return _change(spark, sf).select("row", "col", ((F.col("col") + 0.5) * 500).alias("x"), ((F.col("row") + 0.5) * 500).alias("y"), F.col(name).alias("ndvi"))
    cols = ["mean_ndvi_early", "mean_ndvi_late", "mean_delta_ndvi", "prop_greener", "prop_greyer"]
    return marts.area_full(T.area(spark, sf), at("early"), at("late")).select("area_code", "population", *[F.round(c, 8).alias(c) for c in cols])


AREA_FULL_SQL = f"""
WITH {T.AREA_SQL}, {CHANGE_SQL}
SELECT area_code, population, round(avg(early), 8) AS mean_ndvi_early, round(avg(late), 8) AS mean_ndvi_late, round(avg(delta), 8) AS mean_delta_ndvi,
       round(avg((delta > 0)::INT), 8) AS prop_greener, round(avg((delta < 0)::INT), 8) AS prop_greyer
FROM area LEFT JOIN change ON (col + 0.5) * 500 >= x0 AND (col + 0.5) * 500 < x1 AND ("row" + 0.5) * 500 >= y0 AND ("row" + 0.5) * 500 < y1 GROUP BY 1, 2"""


def null_audit(spark, sf):
    return quality.null_audit(T.pixel_obs(spark, sf).select("x", "scene", "B04", "B08")).select(
        "column_name", "n_null", "n_rows", F.round("null_share", 9).alias("null_share"))


NULL_AUDIT_SQL = f"WITH {T.PIXEL_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, count(*) AS n_rows, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 9) AS null_share FROM obs"
    for c in ("x", "scene", "B04", "B08"))


def pack_checks(spark, sf):
    stats = zonal.zonal_stats(zonal.pixels_in_areas(T.pixel_obs(spark, sf).select("x", "y", "B04"), T.area(spark, sf)), "B04")
    areas = T.area(spark, sf).hint("merge").join(stats.select("area_code", F.col("mean").alias("mean_delta_ndvi")), "area_code", "left")
    green = quality.violations(T.unified_green(spark, sf), quality.GREEN_CONTRACT).select("check", (F.col("violations") == 0).alias("passed"))
    return quality.pack_checks(areas, "mean_delta_ndvi").unionByName(green)


PACK_CHECKS_SQL = f"""
WITH {T.AREA_SQL}, {T.PIXEL_SQL}, {T.GREEN_SQL},
c AS (SELECT area_code, population, count(B04) AS n FROM area LEFT JOIN px ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2)
SELECT 'more than 900 areas' AS check, count(*) > 900 AS passed FROM c UNION ALL SELECT 'area codes unique', count(DISTINCT area_code) = count(*) FROM c
UNION ALL SELECT 'has change column', true UNION ALL SELECT 'population mostly present', count(population) > 0.95 * count(*) FROM c
UNION ALL SELECT 'under 5% missing coverage', count(*) FILTER (WHERE n = 0) < 0.05 * count(*) FROM c
UNION ALL SELECT 'not_null:id', bool_and(id IS NOT NULL) FROM green UNION ALL SELECT 'accepted:access_class', bool_and(access_class IN ('public', 'restricted', 'cover')) FROM green
UNION ALL SELECT 'non_empty', count(*) > 0 FROM green"""


def manifest_hash(spark, sf):
    return sinks.run_manifest(spark, {"areas": T.area(spark, sf), "series": T.cell_year(spark, sf), "features": T.green_features(spark, sf)}, "2026-04-15.0", "1")


CHECKS = {
    "queen_weights": (queen_weights, QUEEN_SQL),
    "queen_weights_vertex": (queen_weights_vertex, QUEEN_SQL),
    "morans_i": (morans_i, MORANS_I_SQL),
    "local_moran": (local_moran, f"WITH {LOCAL_SQL} SELECT area_code, round(local_i, 8) AS local_i, p_sim FROM lo"),
    "lisa_labels": (lisa_labels, LISA_LABELS_SQL),
    "gi_star": (gi_star, f"WITH {LOCAL_SQL} SELECT area_code, round(gi_star, 8) AS gi_star, gi_p FROM lo"),
    "lisa_mean_z": (_mean_z(0.5), _mean_z_sql(0.5)),
    "lisa_mean_z_196": (_mean_z(1.96), _mean_z_sql(1.96)),
    "features": (feature_table, FEATURES_SQL),
    "fold_assignment": (fold_assignment, FOLD_SQL),
    "borough_effects": (borough_effects, BOROUGH_EFFECTS_SQL),
    "hex_cells": (hex_cells, HEX_CELLS_SQL),
    "hex_ndvi": (hex_ndvi, HEX_NDVI_SQL),
    "hex_parent": (hex_parent, HEX_PARENT_SQL),
    "cells_mart": (cells_mart, None),
    "tile_cover": (tile_cover, TILE_COVER_SQL),
    "crs_mercator": (crs_mercator, CRS_MERCATOR_SQL),
    "crs_utm": (crs_utm, CRS_UTM_SQL),
    "ramp_rgba": (ramp_rgba, RAMP_SQL),
    "map_payload": (map_payload, MAP_PAYLOAD_SQL),
    "area_attrs": (area_attrs, AREA_ATTRS_SQL),
    "area_full": (area_full, AREA_FULL_SQL),
    "null_audit": (null_audit, NULL_AUDIT_SQL),
    "pack_checks": (pack_checks, PACK_CHECKS_SQL),
    "manifest_hash": (manifest_hash, None),
}

# Full-size training takes longest: these come last.
MODEL_CHECKS = {
    "prediction_rows": (prediction_rows, PREDICTION_ROWS_SQL),
    "cv_rows": (cv_rows, CV_ROWS_SQL),
    "importance_rows": (importance_rows, IMPORTANCE_ROWS_SQL),
    "anomaly_rows": (anomaly_rows, ANOMALY_ROWS_SQL),
    "cv_scores": (cv_scores, None),
    "importances": (importances, None),
    "predictions": (predictions, None),
    "anomalies": (anomalies, None),
}
