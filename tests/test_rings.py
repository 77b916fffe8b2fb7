"""Long rings: planning must not grow with the rounds of doubling."""

import pytest

from conftest import box_geom
from greenspark.functions import geometry as G
from greenspark.operators import dissolve


def test_size_estimate_of_a_long_ring_stays_small(spark):
    strip = spark.createDataFrame([("g", box_geom(i, 0, i + 1, 1)) for i in range(40)], f"k string, geom {G.GEOM_TYPE}")
    rings = dissolve.dissolved_rings(strip, ["k"])
    estimate = rings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert estimate.bit_length() < 4000
    ring, = rings.collect()
    assert (ring.n_points, ring.area_m2) == (82, pytest.approx(40.0))
