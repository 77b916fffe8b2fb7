"""Scalar expressions shared by the marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extra surprise per cluster label, visible marker geometry and colours.
CLUSTER_BONUS = {"LL": 0.75, "LH": 0.35, "HL": 0.15, "HH": 0.0, "NS": 0.0}
MARKER_GREENER = [16, 122, 87, 230]
MARKER_GREYER = [201, 30, 30, 230]


def borough_from_name(name: Column) -> Column:
    """'Hackney 023' -> 'Hackney': drop a trailing number with an optional letter."""
    return F.trim(F.regexp_replace(name, r"\s*\d+[A-Z]?$", ""))


def safe_divide(a: Column, b: Column) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def to_number(value: Column) -> Column:
    """Text to double; what is not a number becomes NULL."""
    return value.try_cast("double")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(F.when(y.isNotNull(), x))
                                                    * F.stddev_pop(F.when(x.isNotNull(), y)), F.lit(0.0)))


def std_or_one(x: Column) -> Column:
    """Population standard deviation, 1 where it is zero, missing or not finite."""
    sd = F.stddev_pop(x)
    return F.when(sd.isNull() | F.isnan(sd) | (sd == 0) | (sd == float("inf")), 1.0).otherwise(sd)


def surprise_equity(residual_z: Column, angst_share: Column) -> Column:
    """Greyer than predicted plus deficit in access to large green space."""
    return -residual_z + (1.0 - F.when(angst_share.isNotNull(), F.least(angst_share, F.lit(1.0))))


def surprise_lisa(residual_z: Column, cluster: Column) -> Column:
    """Greyer than predicted plus a bonus for the spatial cluster the area sits in."""
    bonus = F.lit(0.0)
    for label, value in CLUSTER_BONUS.items():
        bonus = F.when(cluster == label, F.lit(value)).otherwise(bonus)
    return F.greatest(-residual_z, F.lit(0.0)) + bonus


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def marker_radius(residual_z: Column) -> Column:
    return 4 + F.least(F.lit(8.0), F.abs(residual_z) * 1.6)


def marker_colour(residual: Column) -> Column:
    return F.when(residual >= 0, F.array(*[F.lit(v) for v in MARKER_GREENER])).otherwise(
        F.array(*[F.lit(v) for v in MARKER_GREYER]))


def zoom_resolution(zoom: Column) -> Column:
    """Hex resolution for a map zoom."""
    return F.when(zoom < 10, 7).when(zoom < 11.5, 8).otherwise(9)
