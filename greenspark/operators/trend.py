"""Cell-by-year vegetation trends.  A cell has one row per year, so its series is short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greenspark.functions.scalars import erfc


def yoy_rolling(series: DataFrame, cell: str = "cell") -> DataFrame:
    """Change against the previous row and mean of up to three rows; a missing year is skipped over."""
    by_year = Window.partitionBy(cell).orderBy("year")
    return series.select(
        "*", (F.col("ndvi_median") - F.lag("ndvi_median").over(by_year)).alias("yoy_delta"),
        F.avg("ndvi_median").over(by_year.rowsBetween(-2, 0)).alias("ndvi_3yr_mean"))


def cell_trend(series: DataFrame, min_years: int = 5, cell: str = "cell") -> DataFrame:
    """Least-squares slope per cell with enough years."""
    return (series.groupBy(cell).agg(
        F.regr_slope("ndvi_median", "year").alias("slope_per_year"), F.regr_r2("ndvi_median", "year").alias("r2"),
        F.count(F.lit(1)).alias("n_years"), F.min("ndvi_median").alias("ndvi_min"), F.max("ndvi_median").alias("ndvi_max"))
        .where(F.col("n_years") >= min_years))


def area_trend(trend: DataFrame, lookup: DataFrame, areas: DataFrame, cell: str = "cell", key: str = "area_code") -> DataFrame:
    """Mean and spread of the cell slopes per area."""
    return (trend.hint("merge").join(lookup.select(cell, key), cell).hint("merge").join(areas.select(key), key)
            .groupBy(key).agg(F.avg("slope_per_year").alias("mean_slope"),
                              F.stddev_samp("slope_per_year").alias("slope_sd"), F.avg("r2").alias("mean_r2")))


def sen_mann_kendall(series: DataFrame, cell: str = "cell") -> DataFrame:
    """Sen's slope and the Mann-Kendall test with tie correction.

    The pairs of years stay inside the row of their cell: its array holds one entry per year.
    """
    rows = series.where(F.col("ndvi_median").isNotNull()).groupBy(cell).agg(
        F.array_sort(F.collect_list(F.struct(F.col("year"), F.col("ndvi_median").alias("v")))).alias("s"))
    s = F.col("s")

    def later(f):
        return F.flatten(F.transform(s, lambda a, i: F.transform(
            F.slice(s, i + 2, F.greatest(F.size(s) - i - 1, F.lit(0))), lambda b: f(a, b))))

    rows = rows.select(
        cell, F.size(s).cast("bigint").alias("n_years"),
        F.array_sort(later(lambda a, b: (b["v"] - a["v"]) / (b["year"] - a["year"]))).alias("slopes"),
        F.aggregate(later(lambda a, b: F.signum(b["v"] - a["v"])), F.lit(0.0), lambda x, y: x + y).alias("mk_s"),
        F.aggregate(s, F.lit(0).cast("bigint"), lambda acc, a: acc + (
            (F.size(F.filter(s, lambda b: b["v"] == a["v"])) - 1)
            * (2 * F.size(F.filter(s, lambda b: b["v"] == a["v"])) + 5))).alias("ties"))
    n, m = F.col("n_years"), F.size("slopes")
    middle = (F.get("slopes", F.floor((m - 1) / 2).cast("int")) + F.get("slopes", F.floor(m / 2).cast("int"))) / 2
    variance = (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18.0
    z = F.when(F.col("mk_s") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("mk_s") - F.signum("mk_s"), F.sqrt(F.greatest(variance, F.lit(0.0)))))
    return (rows.where(m > 0).select(cell, "n_years", middle.alias("sen_slope"), "mk_s", z.alias("mk_z"))
            .withColumn("mk_p", erfc(F.abs(F.col("mk_z")) / F.sqrt(F.lit(2.0)))))
