"""Equity, surprise, trend and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as T
from greenspark.functions import scalars
from greenspark.operators import equity, trend
from greenspark.operators.ordering import with_rank

LSOA_TAIL_SQL = f"""{T.GREEN_SQL},
pub AS (
  SELECT a.area_code, CAST(sum((least(a.x1, gx1) - greatest(a.x0, gx0)) * (least(a.y1, gy1) - greatest(a.y0, gy0))) AS DOUBLE) AS m2
  FROM area a JOIN green ON gx0 < a.x1 AND gx1 > a.x0 AND gy0 < a.y1 AND gy1 > a.y0
  WHERE access_class = 'public' GROUP BY 1
),
lsoa AS (
  SELECT area.area_code, area_name, borough, population, coalesce(m2, 0) AS public_green_m2,
         CAST(ntile(10) OVER (ORDER BY acctbal, area.area_code) AS INTEGER) AS imd_income_decile,
         coalesce(m2, 0) / population AS green_per_capita_m2,
         CAST(area_key % 101 AS DOUBLE) / 100 AS prop_pop_within_400m_public_green,
         area_key % 3 = 0 AS angst_compliant_2ha_300m
  FROM area LEFT JOIN pub USING (area_code)
)"""
LSOA_SQL = f"{T.AREA_SQL}, {LSOA_TAIL_SQL}"


def borough_equity(spark, sf):
    return equity.borough_equity(T.lsoa(spark, sf)).select(
        "borough", "imd_income_decile", "lsoa_count", "pop_total", F.round("green_total_m2", 3).alias("green_total_m2"),
        F.round("green_per_capita_m2", 6).alias("green_per_capita_m2"),
        F.round("access_400m_share", 9).alias("access_400m_share"),
        F.round("angst_compliant_share", 9).alias("angst_compliant_share"))


BOROUGH_EQUITY_SQL = f"""
WITH {LSOA_SQL}
SELECT borough, imd_income_decile, count(*) AS lsoa_count, CAST(sum(population) AS BIGINT) AS pop_total,
       round(sum(public_green_m2), 3) AS green_total_m2,
       round(sum(public_green_m2) / nullif(sum(population), 0), 6) AS green_per_capita_m2,
       round(avg(prop_pop_within_400m_public_green), 9) AS access_400m_share,
       round(avg(angst_compliant_2ha_300m::INT), 9) AS angst_compliant_share
FROM lsoa GROUP BY 1, 2"""


def equity_summary(spark, sf):
    return equity.equity_summary(T.lsoa(spark, sf)).select(
        F.round("pearson_r", 9).alias("pearson_r"), F.round("slope", 9).alias("slope"),
        F.round("r2", 9).alias("r2"), "n_lsoas")


EQUITY_SUMMARY_SQL = f"""
WITH {LSOA_SQL}
SELECT round(corr(imd_income_decile, green_per_capita_m2), 9) AS pearson_r,
       round(regr_slope(green_per_capita_m2, imd_income_decile), 9) AS slope,
       round(regr_r2(green_per_capita_m2, imd_income_decile), 9) AS r2, count(*) AS n_lsoas FROM lsoa"""


def equity_spearman(spark, sf):
    return (equity.spearman(T.lsoa(spark, sf), "imd_income_decile", "green_per_capita_m2")
            .select(F.round("spearman_r", 9).alias("spearman_r"), "n"))


EQUITY_SPEARMAN_SQL = f"""
WITH {LSOA_SQL},
r AS (SELECT rank() OVER (ORDER BY imd_income_decile) + (count(*) OVER (PARTITION BY imd_income_decile) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY green_per_capita_m2) + (count(*) OVER (PARTITION BY green_per_capita_m2) - 1) / 2.0 AS ry
      FROM lsoa)
SELECT round(corr(rx, ry), 9) AS spearman_r, count(*) AS n FROM r"""


def _predictions(spark, sf):
    """Residual frame with a fixed prediction per area."""
    return (T.residuals(spark, sf).withColumn("predicted", (F.col("area_key") % 50) / 10)
            .select("area_code", "borough", "area_key", F.col("residual").alias("actual"), "predicted",
                    (F.col("residual") - F.col("predicted")).alias("residual")))


def _with_z(df):
    sd = df.agg(scalars.std_or_one(F.col("residual"))).scalar()
    return df.withColumn("residual_z", F.col("residual") / sd)


RESIDUAL_Z_SQL = f"""{T.RESIDUAL_SQL},
pred AS (SELECT area_code, borough, area_key, residual AS actual, CAST(area_key % 50 AS DOUBLE) / 10 AS predicted,
                residual - CAST(area_key % 50 AS DOUBLE) / 10 AS residual FROM res),
rz AS (SELECT *, residual / CASE WHEN (SELECT stddev_pop(residual) FROM pred) = 0 THEN 1
                                 ELSE (SELECT stddev_pop(residual) FROM pred) END AS residual_z FROM pred)"""


def residual_z(spark, sf):
    return _with_z(_predictions(spark, sf)).select(
        "area_code", F.round("residual", 8).alias("residual"), F.round("residual_z", 9).alias("residual_z"))


def surprise_equity(spark, sf):
    lsoa = T.lsoa(spark, sf).select("area_code", "green_per_capita_m2", "angst_compliant_2ha_300m")
    anomalies = _with_z(_predictions(spark, sf)).select("area_code", "residual", "residual_z")
    areas = T.area(spark, sf).select("area_code", "area_name")
    return equity.area_surprise(anomalies, areas, lsoa.where("green_per_capita_m2 > 0")).select(
        "area_code", "area_name", F.round("residual", 8).alias("residual"),
        F.round("green_per_capita_m2", 6).alias("green_per_capita_m2"), F.round("surprise_score", 6).alias("surprise_score")
    ).orderBy(F.desc_nulls_last("surprise_score"), "area_code")


SURPRISE_EQUITY_SQL = f"""
WITH {RESIDUAL_Z_SQL}, {LSOA_TAIL_SQL}
SELECT rz.area_code, a.area_name, round(rz.residual, 8) AS residual, round(l.green_per_capita_m2, 6) AS green_per_capita_m2,
       round(-rz.residual_z + 1 - (l.angst_compliant_2ha_300m::INT), 6) AS surprise_score
FROM rz JOIN area a USING (area_code)
LEFT JOIN (SELECT * FROM lsoa WHERE green_per_capita_m2 > 0) l ON l.area_code = rz.area_code"""


def surprise_lisa(spark, sf):
    labels = F.array(*[F.lit(v) for v in ("HH", "HL", "LH", "LL", "NS")])
    df = _with_z(_predictions(spark, sf)).withColumn(
        "lisa_cluster", F.element_at(labels, (F.col("area_key") % 5 + 1).cast("int")))
    return df.select("area_code", "lisa_cluster", F.round(
        scalars.surprise_lisa(F.col("residual_z"), F.col("lisa_cluster")), 6).alias("surprise_score"))


SURPRISE_LISA_SQL = f"""
WITH {RESIDUAL_Z_SQL}
SELECT area_code, (['HH', 'HL', 'LH', 'LL', 'NS'])[CAST(area_key % 5 AS INTEGER) + 1] AS lisa_cluster,
       round(greatest(-residual_z, 0) + ([0, 0.15, 0.35, 0.75, 0])[CAST(area_key % 5 AS INTEGER) + 1], 6) AS surprise_score
FROM rz"""


def cell_yoy_rolling(spark, sf):
    return trend.yoy_rolling(T.cell_year(spark, sf)).select(
        "cell", "year", F.round("ndvi_median", 9).alias("ndvi_median"), "n_scenes",
        F.round("yoy_delta", 12).alias("yoy_delta"), F.round("ndvi_3yr_mean", 12).alias("ndvi_3yr_mean"))


CELL_YOY_SQL = f"""
WITH {T.CELL_YEAR_SQL}
SELECT cell, year, round(ndvi_median, 9) AS ndvi_median, n_scenes,
       round(ndvi_median - lag(ndvi_median) OVER (PARTITION BY cell ORDER BY year), 12) AS yoy_delta,
       round(avg(ndvi_median) OVER (PARTITION BY cell ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 12) AS ndvi_3yr_mean
FROM cell_year"""


def _rounded_trend(df):
    return df.select("cell", F.round("slope_per_year", 12).alias("slope_per_year"), F.round("r2", 9).alias("r2"),
                     "n_years", F.round("ndvi_min", 9).alias("ndvi_min"), F.round("ndvi_max", 9).alias("ndvi_max"))


def cell_trend(spark, sf):
    return _rounded_trend(trend.cell_trend(T.cell_year(spark, sf)))


def cell_trend_short(spark, sf):
    """Well observed cell years only, so the minimum of five years drops cells."""
    return _rounded_trend(trend.cell_trend(T.cell_year(spark, sf).where("n_scenes >= 16")))


CELL_TREND_SQL = f"""
WITH {T.CELL_YEAR_SQL}
SELECT cell, round(regr_slope(ndvi_median, year), 12) AS slope_per_year, round(regr_r2(ndvi_median, year), 9) AS r2,
       count(*) AS n_years, round(min(ndvi_median), 9) AS ndvi_min, round(max(ndvi_median), 9) AS ndvi_max
FROM cell_year WHERE true GROUP BY 1 HAVING count(*) >= 5"""


def area_trend(spark, sf):
    areas = T.area(spark, sf).select("area_code")
    return trend.area_trend(trend.cell_trend(T.cell_year(spark, sf)), T.cell_lookup(spark, sf), areas).select(
        "area_code", F.round("mean_slope", 12).alias("mean_slope"), F.round("slope_sd", 12).alias("slope_sd"),
        F.round("mean_r2", 9).alias("mean_r2"))


AREA_TREND_SQL = f"""
WITH {T.CELL_YEAR_SQL}, {T.AREA_SQL}, {T.CELL_LOOKUP_SQL},
t AS (SELECT cell, regr_slope(ndvi_median, year) AS slope, regr_r2(ndvi_median, year) AS r2
      FROM cell_year GROUP BY 1 HAVING count(*) >= 5)
SELECT area_code, round(avg(slope), 12) AS mean_slope, round(stddev(slope), 12) AS slope_sd, round(avg(r2), 9) AS mean_r2
FROM t JOIN cell_lookup USING (cell) JOIN area USING (area_code) GROUP BY 1"""


def sen_mk(spark, sf):
    return trend.sen_mann_kendall(T.cell_year(spark, sf)).select(
        "cell", "n_years", F.round("sen_slope", 7).alias("sen_slope"), "mk_s",
        F.round("mk_z", 7).alias("mk_z"), F.round("mk_p", 7).alias("mk_p"))


SEN_MK_SQL = f"""
WITH {T.CELL_YEAR_SQL},
pairs AS (
  SELECT a.cell, (b.ndvi_median - a.ndvi_median) / (b.year - a.year) AS slope, sign(b.ndvi_median - a.ndvi_median) AS s
  FROM cell_year a JOIN cell_year b ON a.cell = b.cell AND b.year > a.year
),
ps AS (SELECT cell, median(slope) AS sen, CAST(sum(s) AS DOUBLE) AS mk_s FROM pairs GROUP BY 1),
tie AS (SELECT cell, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties
        FROM (SELECT cell, ndvi_median, count(*) AS t FROM cell_year GROUP BY 1, 2) GROUP BY 1),
z AS (
  SELECT cell, CAST(n AS BIGINT) AS n_years, sen, mk_s,
         CASE WHEN mk_s = 0 THEN 0 ELSE (mk_s - sign(mk_s)) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0) END AS mk_z
  FROM ps JOIN tie USING (cell)
),
t AS (SELECT *, abs(mk_z) / sqrt(2.0) AS x, 1 / (1 + CAST(0.3275911 AS DOUBLE) * abs(mk_z) / sqrt(2.0)) AS t FROM z)
SELECT cell, n_years, round(sen, 7) AS sen_slope, mk_s, round(mk_z, 7) AS mk_z,
       round(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x), 7) AS mk_p
FROM t"""


def _changes(spark, sf):
    """Early (to 1997) and late vegetation per area key, through the trend table's cells."""
    k = F.col("area_key")
    return _with_z(_predictions(spark, sf)).select(
        "area_code", "borough", "residual_z", ((k * 13) % 97 / 100).alias("ndvi_early"), ((k * 29) % 89 / 100).alias("ndvi_late"),
        F.round((k * 29) % 89 / 100 - (k * 13) % 97 / 100, 6).alias("delta"))


CHANGES_SQL = f"""{RESIDUAL_Z_SQL},
ch AS (SELECT area_code, borough, residual_z, CAST((area_key * 13) % 97 AS DOUBLE) / 100 AS ndvi_early,
              CAST((area_key * 29) % 89 AS DOUBLE) / 100 AS ndvi_late,
              round(CAST((area_key * 29) % 89 AS DOUBLE) / 100 - CAST((area_key * 13) % 97 AS DOUBLE) / 100, 6) AS delta FROM rz)"""


def percentile_norm(spark, sf):
    return with_rank(_changes(spark, sf), ["borough"], "delta", rank="rank_in_borough", percent_rank="pr").select(
        "area_code", "borough", "rank_in_borough", F.round("pr", 9).alias("percent_rank"))


PERCENTILE_NORM_SQL = f"""
WITH {CHANGES_SQL}
SELECT area_code, borough, rank() OVER (PARTITION BY borough ORDER BY delta) AS rank_in_borough,
       round(percent_rank() OVER (PARTITION BY borough ORDER BY delta), 9) AS percent_rank FROM ch"""


def leaderboard(spark, sf):
    rounded = _changes(spark, sf)
    return equity.leaderboard(rounded).select(
        "borough", F.round("mean_delta", 9).alias("mean_delta"), "n_anomalies", "gain_rank", "loss_rank", "anomaly_rank")


LEADERBOARD_SQL = f"""
WITH {CHANGES_SQL},
b AS (SELECT borough, avg(delta) AS mean_delta, count(*) FILTER (WHERE abs(residual_z) >= 2) AS n_anomalies FROM ch GROUP BY 1)
SELECT borough, round(mean_delta, 9) AS mean_delta, n_anomalies, rank() OVER (ORDER BY mean_delta DESC) AS gain_rank,
       rank() OVER (ORDER BY mean_delta) AS loss_rank, rank() OVER (ORDER BY n_anomalies DESC) AS anomaly_rank FROM b"""


def top_n(spark, sf):
    ch = _changes(spark, sf)
    lists = [("greenest", "ndvi_late", 3, False), ("lowest", "ndvi_late", 3, True),
             ("declines", "delta", 3, True), ("gains", "delta", 24, False)]
    out = None
    for name, field, n, ascending in lists:
        part = equity.top_n(ch, field, n, "area_code", ascending).select(
            F.lit(name).alias("list"), "area_code", F.col(field).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


TOP_N_SQL = f"""
WITH {CHANGES_SQL}
(SELECT 'greenest' AS list, area_code, ndvi_late AS value FROM ch ORDER BY ndvi_late DESC, area_code LIMIT 3)
UNION ALL (SELECT 'lowest', area_code, ndvi_late FROM ch ORDER BY ndvi_late, area_code LIMIT 3)
UNION ALL (SELECT 'declines', area_code, delta FROM ch ORDER BY delta, area_code LIMIT 3)
UNION ALL (SELECT 'gains', area_code, delta FROM ch ORDER BY delta DESC, area_code LIMIT 24)"""


def global_summary(spark, sf):
    cols = ["mean_late", "mean_early", "mean_delta", "neg_share"]
    return equity.global_summary(_changes(spark, sf)).select(
        "total", "boroughs", *[F.round(c, 9).alias(c) for c in cols])


GLOBAL_SUMMARY_SQL = f"""
WITH {CHANGES_SQL}
SELECT count(*) AS total, count(DISTINCT borough) AS boroughs, round(avg(ndvi_late), 9) AS mean_late,
       round(avg(ndvi_early), 9) AS mean_early, round(avg(delta), 9) AS mean_delta,
       round(CAST(count(*) FILTER (WHERE delta < 0) AS DOUBLE) / count(*), 9) AS neg_share FROM ch"""


CHECKS = {
    "borough_equity": (borough_equity, BOROUGH_EQUITY_SQL),
    "equity_summary": (equity_summary, EQUITY_SUMMARY_SQL),
    "equity_spearman": (equity_spearman, EQUITY_SPEARMAN_SQL),
    "residual_z": (residual_z, f"WITH {RESIDUAL_Z_SQL} SELECT area_code, round(residual, 8) AS residual, "
                               "round(residual_z, 9) AS residual_z FROM rz"),
    "surprise_equity": (surprise_equity, SURPRISE_EQUITY_SQL),
    "surprise_lisa": (surprise_lisa, SURPRISE_LISA_SQL),
    "cell_yoy_rolling": (cell_yoy_rolling, CELL_YOY_SQL),
    "cell_trend": (cell_trend, CELL_TREND_SQL),
    "cell_trend_short": (cell_trend_short, CELL_TREND_SQL.replace("WHERE true", "WHERE n_scenes >= 16")),
    "area_trend": (area_trend, AREA_TREND_SQL),
    "sen_mk": (sen_mk, SEN_MK_SQL),
    "percentile_norm": (percentile_norm, PERCENTILE_NORM_SQL),
    "leaderboard": (leaderboard, LEADERBOARD_SQL),
    "top_n": (top_n, TOP_N_SQL),
    "global_summary": (global_summary, GLOBAL_SUMMARY_SQL),
}
