import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import box_geom
from greenspark.functions import geometry as G
from greenspark.operators import components, quality, raster
from greenspark.operators.raster import explode_tiles, resample_grid
from greenspark.sources import cities, footers, npy, readers, sinks


def test_geojson_polygons_and_multipolygons(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]
    features = [
        {"type": "Feature", "properties": {"MSOA21CD": "E1", "n": 3}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"MSOA21CD": "E2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"type": "Feature", "properties": {"MSOA21CD": "E3"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "page1.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = {r.MSOA21CD: r for r in readers.geojson_features(spark, str(tmp_path), {"MSOA21CD": "string", "n": "int"}).select(
        "MSOA21CD", "n", "geometry_type", G.area(F.col("geom")).alias("a")).collect()}
    assert rows["E1"].a == 2.0 and rows["E1"].n == 3 and rows["E2"].a == 4.0 and rows["E3"].a is None


@pytest.mark.parametrize("header, want", [
    (" geography code ,name,Observation", 10), ("mnemonic,first,last", 20)])
def test_census_columns_are_discovered(spark, tmp_path, header, want):
    (tmp_path / "ts001.csv").write_text(header + "\nE02000001,5,10\nE01000009,5,11\nE02000002,7,x\n" if want == 10 else
                                        header + "\nE02000001,5,20\nE02000002,7,21\nW02000001,x,22\n")
    rows = {r.area_code: r.population for r in readers.census_counts(spark, str(tmp_path / "ts001.csv")).collect()}
    assert set(rows) == {"E02000001", "E02000002"} and rows["E02000001"] == want
    assert rows["E02000002"] == (None if want == 10 else 21)


def test_scene_items_and_assets(spark, tmp_path):
    item = {"id": "s1", "properties": {"datetime": "2024-06-03T10:00:00Z", "eo:cloud_cover": 4.5, "s2:mgrs_tile": "30UXC"},
            "bbox": [0, 1, 2, 3], "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 1], [2, 3], [0, 1]]]},
            "assets": {"B04": {"href": "a"}, "B08": {"href": "b"}}}
    (tmp_path / "items.json").write_text(json.dumps(item) + "\n")
    items = readers.scene_items(spark, str(tmp_path / "items.json"))
    row = items.first()
    assert row.cloud == 4.5 and row.tile == "30UXC" and row.box.ymax == 3.0
    assert {(r.band, r.href) for r in readers.scene_assets(items).collect()} == {("B04", "a"), ("B08", "b")}
    assert items.select(G.area(G.normalise(F.col("footprint")))).first()[0] == 2.0


def test_scene_collections(spark, tmp_path):
    features = [{"id": f"s{k}", "properties": {"datetime": "2024-06-03T10:00:00Z", "eo:cloud_cover": k}, "bbox": [0, 1, 2, 3], "assets": {}} for k in range(3)]
    both = {"type": "FeatureCollection", "features": features}
    (tmp_path / "lines.json").write_text(json.dumps(both) + "\n" + json.dumps(features[0] | {"id": "own"}) + "\n")
    (tmp_path / "indented.json").write_text(json.dumps(both, indent=2))
    assert sorted(r.id for r in readers.scene_items(spark, str(tmp_path / "lines.json")).collect()) == ["own", "s0", "s1", "s2"]
    assert {(r.id, r.cloud, r.footprint) for r in readers.scene_items(spark, str(tmp_path / "indented.json"), indented=True).collect()} == {
        ("s0", 0.0, None), ("s1", 1.0, None), ("s2", 2.0, None)}


def test_npy_tiles_and_pixels(spark, tmp_path):
    grid = np.arange(12, dtype=np.float32).reshape(3, 4)
    grid[1, 1] = np.nan
    np.save(tmp_path / "late_B04.npy", grid)
    (tmp_path / "meta.json").write_text(json.dumps({"transform": [20, 0, 1000, 0, -20, 5000]}))
    tiles = readers.npy_tiles(spark, str(tmp_path), str(tmp_path / "meta.json"), tile_size=2)
    assert tiles.count() == 4
    px = {(r.row, r.col): r for r in explode_tiles(tiles).collect()}
    assert len(px) == 12 and px[2, 3].value == 11.0 and px[1, 1].value is None and px[0, 0].value is None
    assert (px[2, 3].x, px[2, 3].y, px[2, 3].band) == (1070.0, 4950.0, "B04")


def test_npy_source_reads_byte_ranges(spark, tmp_path):
    npy.register(spark)
    rng = np.random.default_rng(1)
    grids = {"late_B04": rng.random((50, 7)).astype("f4"), "late_B08": rng.integers(0, 9, (33, 20)).astype("i2"), "early_B04": np.asfortranarray(rng.random((9, 5)))}
    for name, grid in grids.items():
        np.save(tmp_path / f"{name}.npy", grid)
    (tmp_path / "meta.json").write_text(json.dumps({"transform": [20, 0, 1000, 0, -20, 5000]}))
    source = spark.read.format("npy_tiles").options(meta=str(tmp_path / "meta.json"), tileSize=4, rangeBytes=200)
    tiles = source.load(str(tmp_path))
    assert tiles.rdd.getNumPartitions() > 15  # one file in many tasks
    whole = readers.npy_tiles(spark, str(tmp_path), str(tmp_path / "meta.json"), tile_size=4)
    keys = ["raster_id", "band", "tile_r", "tile_c"]
    rows = [sorted((tuple(r[k] for k in keys), r.h, r.w, r["values"], r.affine) for r in t.collect()) for t in (tiles, whole)]
    assert rows[0] == rows[1] and len(rows[0]) == 13 * 2 + 9 * 5 + 3 * 2
    assert source.options(nodata="nan").load(str(tmp_path / "late_B08.npy")).where("exists(values, v -> v = 0)").count() > 0
    np.save(tmp_path / "bad_B01.npy", np.zeros(3))
    with pytest.raises(Exception, match="two axes"):
        source.load(str(tmp_path / "bad_B01.npy")).count()


def test_row_groups_are_as_wanted(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    sinks.write_sorted(df, str(tmp_path / "sorted"), ["k"], rows_per_group=1500, files=2)
    audit = footers.group_audit(spark.read.parquet(str(tmp_path / "sorted")), "k", "bigint", 1500).collect()
    assert len(audit) == 2 and sum(r.n_rows for r in audit) == 20_000 and all(r.n_large == r.out_of_order == 0 and r.n_groups > 5 for r in audit)
    df.coalesce(1).write.option("parquet.block.row.count.limit", 4000).parquet(str(tmp_path / "mixed"))
    row, = footers.group_audit(spark.read.parquet(str(tmp_path / "mixed")), "k", "bigint", 1500).collect()
    assert row.n_large >= 4 and row.out_of_order > 0
    groups = footers.row_groups(spark.read.parquet(str(tmp_path / "sorted")), "k").orderBy("file", "row_group").collect()
    assert min(int(g.low) for g in groups) == 0 and max(int(g.high) for g in groups) == 19_999


def test_raster_keys_keep_rasters_apart(spark):
    cells = [(c, r, k, float(r * k + len(c))) for c in ("x", "yy") for r in range(4) for k in range(4) if (r + k) % 3 or c == "x"]
    both = spark.createDataFrame(cells, "city string, row int, col int, v double")
    for run in (lambda t, keys: raster.focal_std(t, "v", keys=keys), lambda t, keys: raster.resample(t, "v", 10.0, 10.0, 3.0, 4.0, keys=keys),
                lambda t, keys: components.mask_patches(t, 10.0, keys=keys)):
        apart = [("x", *r) for r in run(both.where("city = 'x'"), None).collect()] + [("yy", *r) for r in run(both.where("city = 'yy'"), None).collect()]
        assert sorted(map(repr, (tuple(r) for r in run(both, ["city"]).collect()))) == sorted(map(repr, apart))
    labelled = both.withColumn("patch", F.lit(1))
    assert components.mask_outline(labelled, 1.0, ["city"]).where("city = 'x'").count() == 16


def test_resample_onto_another_grid(spark):
    px = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "row int, col int, v double")
    grid = spark.createDataFrame([(0, 0, 100.0, 200.0)], "row int, col int, x double, y double")
    out = resample_grid(grid, px, "v", 10.0, lambda x, y: (x - 80.0, y - 180.0)).first()
    assert out.v == pytest.approx(10 * 1.5 + 1.5) and out.weight == pytest.approx(1.0)


def test_sorted_sink_and_audit(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v"))
    path = str(tmp_path / "sorted")
    sinks.write_sorted(df, path, ["k"], rows_per_file=200)
    back = spark.read.parquet(path)
    audit = quality.order_audit(back, ["k"]).collect()
    assert back.count() == 1000 and len(audit) >= 5 and all(r.out_of_order == 0 and r.n_rows <= 200 for r in audit)


def test_one_city_run_leaves_the_others(spark, tmp_path):
    path = str(tmp_path)
    both = spark.createDataFrame([("london", 1), ("paris", 2)], "city string, v int")
    sinks.publish(both, "t", "gold", path)
    sinks.publish(both.where("city = 'london'").withColumn("v", F.lit(9)), "t", "gold", path)
    assert {(r.city, r.v) for r in spark.read.parquet(f"{path}/gold/t").collect()} == {("london", 9), ("paris", 2)}
    sinks.publish(both, "t_view", "bronze")
    sinks.publish(both, "t", "silver", path)
    assert spark.table("t_view").count() == spark.read.parquet(f"{path}/silver/t").count() == 2


def test_metrics_json_has_no_nan(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], (float("-inf"), "a"))],
                               "moran_i double, scores array<double>, s struct<v: double, n: string>")
    assert json.loads(sinks.metrics_json(df).first()[0]) == {"moran_i": None, "scores": [1.0, None], "s": {"v": None, "n": "a"}}


def test_city_table_and_adapters(spark, tmp_path):
    table = {r.city: r for r in cities.city_table(spark).collect()}
    assert len(table["london"].borough_names) == 33 and table["berlin"].epsg == 25832 and table["paris"].epsg == 2154
    raw = spark.createDataFrame([("E1", "Camden 001", "7", box_geom(0, 0, 1, 1))], f"c string, n string, p string, geom {G.GEOM_TYPE}")
    out = cities.run_adapter("named_areas", raw, city="london", level="msoa", code="c", name="n", population="p")
    assert out.first().population == 7 and out.columns[0] == "city"
    with pytest.raises(ValueError):
        cities.run_adapter("unknown")
    manifest = pytest.importorskip("yaml").safe_dump({"slug": "x", "epsg": 3857})
    (tmp_path / "x.yaml").write_text(manifest)
    assert cities.load_manifest(str(tmp_path / "x.yaml"))["epsg"] == 3857


def test_partition_pruned_release_scan(spark, tmp_path):
    spark.range(3).selectExpr("id", "'grass' as subtype").write.parquet(f"{tmp_path}/r1/theme=base/type=land_cover")
    spark.range(5).selectExpr("id", "'park' as class", "'x' as name").write.parquet(f"{tmp_path}/r1/theme=land_use/type=land_use")
    df = readers.released_features(spark, str(tmp_path), "r1", "land_use", "land_use")
    assert df.columns == ["id", "class", "name", "theme", "type"]
    assert df.where("class = 'park' and theme = 'land_use'").count() == 5
    assert len(df.inputFiles()) > 0 and all("type=land_use" in f for f in df.inputFiles())


def test_contracts(spark):
    good = spark.createDataFrame([("1", "park", "public")], "id string, kind string, access_class string")
    assert quality.validate(good, quality.GREEN_CONTRACT) is good
    bad = good.unionByName(spark.createDataFrame([(None, "park", "secret")], good.schema))
    with pytest.raises(ValueError, match="access_class"):
        quality.validate(bad, quality.GREEN_CONTRACT)
    with pytest.raises(ValueError, match="non_empty"):
        quality.validate(good.limit(0), quality.GREEN_CONTRACT)
    with pytest.raises(ValueError, match="missing"):
        quality.validate(good.drop("kind"), quality.GREEN_CONTRACT)
    pixels = spark.createDataFrame([(0, 0, 0.5, 0.4), (1, 1, None, None)], "row int, col int, late double, early double")
    assert all(r.passed for r in quality.raster_checks(pixels, "late", 2, 2, "early").collect())
    assert not all(r.passed for r in quality.raster_checks(pixels, "late", 1, 2, "early").collect())
