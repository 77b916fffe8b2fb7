"""Greenness against population and income deprivation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenspark.functions.scalars import safe_corr, safe_divide, surprise_equity
from greenspark.operators.ordering import row_numbers, with_rank


def with_decile(df: DataFrame, score: str, key: str, out: str, tiles: int = 10) -> DataFrame:
    """Even-sized classes by score (ties by key), for sources that ship a score only."""
    numbered = row_numbers(df.select(score, key), [score, key], "_row").select(key, "_row")
    total = df.select(F.count(F.lit(1))).scalar()
    size, extra = F.floor(total / tiles), total % tiles
    head = extra * (size + 1)
    tile = F.when(F.col("_row") <= head, F.floor((F.col("_row") - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor(F.try_divide(F.col("_row") - 1 - head, size)) + 1)
    return df.hint("merge").join(numbered.select(key, tile.cast("int").alias(out)), key)


def borough_equity(lsoa: DataFrame) -> DataFrame:
    """Population, green area and access per borough and income decile."""
    return (lsoa.groupBy("borough", "imd_income_decile").agg(
        F.count(F.lit(1)).alias("lsoa_count"), F.sum("population").alias("pop_total"),
        F.sum("public_green_m2").alias("green_total_m2"),
        safe_divide(F.sum("public_green_m2"), F.sum("population")).alias("green_per_capita_m2"),
        F.avg("prop_pop_within_400m_public_green").alias("access_400m_share"),
        F.avg(F.col("angst_compliant_2ha_300m").cast("int")).alias("angst_compliant_share")))


def equity_summary(lsoa: DataFrame) -> DataFrame:
    """One row: correlation and regression of green per head on income decile."""
    x, y = F.col("imd_income_decile").cast("double"), F.col("green_per_capita_m2")
    return lsoa.agg(safe_corr(x, y).alias("pearson_r"), F.regr_slope(y, x).alias("slope"),
                    F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n_lsoas"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation of average ranks over rows where both values are known."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = with_rank(with_rank(both, [], x, average_rank="_rx"), [], y, average_rank="_ry")
    return ranked.agg(safe_corr(F.col("_rx"), F.col("_ry")).alias("spearman_r"), F.count(F.lit(1)).alias("n"))


def area_surprise(anomalies: DataFrame, areas: DataFrame, lsoa: DataFrame, key: str = "area_code") -> DataFrame:
    """Residuals and access per area with their composite score; areas without access data keep a NULL score."""
    access = lsoa.groupBy(key).agg(
        F.avg("green_per_capita_m2").alias("green_per_capita_m2"),
        F.avg(F.col("angst_compliant_2ha_300m").cast("int")).alias("angst_compliant_share"))
    return (anomalies.hint("merge").join(areas, key).hint("merge").join(access, key, "left")
            .withColumn("surprise_score", surprise_equity(F.col("residual_z"), F.col("angst_compliant_share"))))


def top_n(df: DataFrame, field: str, n: int, key: str, ascending: bool = False) -> DataFrame:
    """First n rows by field; ties by key, missing values last."""
    order = F.col(field).asc_nulls_last() if ascending else F.col(field).desc_nulls_last()
    return df.orderBy(order, F.col(key)).limit(n)


def leaderboard(areas: DataFrame, group: str = "borough") -> DataFrame:
    """Groups ranked by gain, by loss and by number of anomalies."""
    totals = areas.groupBy(group).agg(
        F.avg("delta").alias("mean_delta"), F.count_if(F.abs(F.col("residual_z")) >= 2).cast("bigint").alias("n_anomalies"))
    ranked = with_rank(totals, [], "mean_delta", descending=True, rank="gain_rank")
    ranked = with_rank(ranked, [], "mean_delta", rank="loss_rank")
    return with_rank(ranked, [], "n_anomalies", descending=True, rank="anomaly_rank")


def global_summary(areas: DataFrame) -> DataFrame:
    """One row: areas, boroughs, mean vegetation early and late, mean change, share that declined."""
    return areas.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("borough").alias("boroughs"),
        F.avg("ndvi_late").alias("mean_late"), F.avg("ndvi_early").alias("mean_early"),
        F.avg("delta").alias("mean_delta"),
        safe_divide(F.count_if(F.col("delta") < 0), F.count(F.lit(1))).alias("neg_share"))
