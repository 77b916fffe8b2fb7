"""Band arithmetic on pixel columns and on tile arrays.  NULL is nodata, 0.0 is a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFLECTANCE_SCALE = 0.0001  # fixed value: Sentinel-2 digital numbers to reflectance


def _ratio(a: Column, b: Column, zero_fill: bool) -> Column:
    value = F.when(a + b > 0, (a - b) / (a + b))
    return F.coalesce(value, F.when((a + b).isNotNull(), F.lit(0.0))) if zero_fill else value


def ndvi(nir: Column, red: Column, zero_fill: bool = False) -> Column:
    """Vegetation index; a denominator of zero or less is nodata (0.0 with ``zero_fill``)."""
    return _ratio(nir, red, zero_fill)


def ndwi(green: Column, nir: Column, zero_fill: bool = False) -> Column:
    return _ratio(green, nir, zero_fill)


def bsi(swir: Column, red: Column, nir: Column, blue: Column) -> Column:
    """Bare-soil index; ``swir`` is B11."""
    return _ratio(swir + red, nir + blue, False)


def bare_soil(red: Column, nir: Column) -> Column:
    """Proxy without a short-wave band: red above near infrared and a dark near infrared."""
    return (red > nir) & (nir < 0.2)


def reflectance(dn: Column) -> Column:
    return dn * REFLECTANCE_SCALE


def true_colour(red: Column, green: Column, blue: Column, gain: float = 3.0) -> Column:
    """Gain and clip to [0, 1]."""
    def clip(c):
        return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c * gain)))
    return F.struct(clip(red).alias("r"), clip(green).alias("g"), clip(blue).alias("b"))


def tile_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def tile_subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def tile_divide(a: Column, b: Column) -> Column:
    """A zero divisor is nodata."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def tile_ndvi(nir: Column, red: Column) -> Column:
    return F.zip_with(nir, red, lambda n, r: ndvi(n, r))


def tile_at_least(values: Column, threshold: float) -> Column:
    return F.transform(values, lambda v: v >= threshold)
