"""Piecewise-linear colour ramps as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (stop, red, green, blue) of the vegetation ramp and the change ramp.
RAMP_NDVI = [
    (0.0, 165, 0, 38), (0.15, 215, 48, 39), (0.25, 244, 109, 67), (0.35, 253, 174, 97), (0.45, 254, 224, 144),
    (0.55, 217, 239, 139), (0.65, 166, 217, 106), (0.75, 102, 189, 99), (0.85, 26, 152, 80),
]
RAMP_DELTA = [
    (-0.25, 103, 0, 31), (-0.15, 178, 24, 43), (-0.08, 214, 96, 77), (-0.03, 244, 165, 130), (0.0, 247, 247, 247),
    (0.03, 146, 197, 222), (0.08, 67, 147, 195), (0.15, 33, 102, 172), (0.25, 5, 48, 97),
]
NO_DATA = (180, 180, 180, 60)


def ramp_rgba(value: Column, ramp: list[tuple], alpha: int = 200) -> Column:
    """struct<r,g,b,a>: clamped outside the ramp, grey for a missing value."""
    def channel(i):
        out = F.when(value.isNull() | F.isnan(value), F.lit(NO_DATA[i - 1]))
        out = out.when(value <= ramp[0][0], F.lit(ramp[0][i]))
        for low, high in zip(ramp, ramp[1:]):
            share = (value - low[0]) / (high[0] - low[0])
            out = out.when(value <= high[0], F.floor(low[i] + (high[i] - low[i]) * share + 0.5).cast("int"))
        return out.otherwise(F.lit(ramp[-1][i]))

    opacity = F.when(value.isNull() | F.isnan(value), F.lit(NO_DATA[3])).otherwise(F.lit(alpha))
    return F.struct(channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"), opacity.alias("a"))
