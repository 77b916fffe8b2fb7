"""Joins of tables that grow go through a shuffle: none collects a side on the driver, however small Spark estimates it."""

from conftest import box_geom
from greenspark.functions import geometry as G
from greenspark.operators import contiguity, green, spatial


def _stored(spark, path, key):
    """Boxes in a small file, whose size Spark knows."""
    rows = [(f"{key}{i}", box_geom(10 * i, 0, 10 * i + 10, 10)) for i in range(3)]
    spark.createDataFrame(rows, f"{key} string, geom {G.GEOM_TYPE}").write.parquet(f"{path}/{key}")
    return spark.read.parquet(f"{path}/{key}")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_outlines_are_broadcast(spark, tmp_path):
    areas = _stored(spark, tmp_path, "area_code")
    greens = spatial.with_shape(_stored(spark, tmp_path, "id"), "geom", "g_edges", "g_box")
    weights = green.overlap_weights(areas, greens)
    assert "Broadcast" not in _plan(weights)
    assert {(r.id, r.area_code, r.weight) for r in weights.collect()} == {(f"id{i}", f"area_code{i}", 1.0) for i in range(3)}

    neighbours = contiguity.row_standardised(contiguity.queen_by_vertex(areas))
    assert "Broadcast" not in _plan(neighbours)
    assert sorted(r.weight for r in neighbours.collect()) == [0.5, 0.5, 1.0, 1.0]
