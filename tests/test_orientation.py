"""Areas whose rings run clockwise, and pixels seen on one date or in two cities."""

import pytest

from greenspark.operators import green
from greenspark.plans import marts
from conftest import ring_geom

FORM = "array<array<array<struct<x:double,y:double>>>>"
SQUARE = [(0, 0), (200, 0), (200, 200), (0, 200)]


@pytest.mark.parametrize("ring", [SQUARE, SQUARE[::-1]])
def test_shares_do_not_depend_on_orientation(spark, ring):
    areas = spark.createDataFrame([("A", "b", 10, ring_geom(ring))], f"area_code string, borough string, population bigint, geom {FORM}")
    park = [("p", "park", ring_geom([(0, 0), (0, 100), (100, 100), (100, 0)]))]
    raw = spark.createDataFrame(park, f"id string, kind string, geom {FORM}")
    greens = green.unify(raw, raw.limit(0))
    assert green.green_share(areas, greens, "borough").first().green_share == pytest.approx(0.25)
    assert green.green_share_dissolved(areas, greens, "borough").first().green_share == pytest.approx(0.25)
    assert green.overlap_weights(areas, greens).first().weight == pytest.approx(1.0)


def test_area_full_takes_each_date_and_city_on_its_own(spark):
    ring = [(0, 0), (20, 0), (20, 20), (0, 20)]
    areas = spark.createDataFrame([("A", ring_geom(ring))], f"area_code string, geom {FORM}")
    pixel = "city string, row int, col int, x double, y double, ndvi double"
    early = spark.createDataFrame([("l", 0, 0, 5.0, 5.0, 0.1), ("l", 0, 1, 15.0, 5.0, 0.5)], pixel)
    late = spark.createDataFrame([("l", 0, 0, 5.0, 5.0, 0.2), ("far", 0, 1, 915.0, 905.0, 0.8)], pixel)
    got = marts.area_full(areas, early, late).first()
    assert got.mean_ndvi_early == pytest.approx(0.3) and got.mean_ndvi_late == pytest.approx(0.2)
    assert got.mean_delta_ndvi == pytest.approx(0.1) and got.prop_greener == 1.0
