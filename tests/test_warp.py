"""Warps, mosaics, scan lines and the nearest search against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import box_geom, ring_geom
from greenspark.functions import crs
from greenspark.functions import geometry as G
from greenspark.operators import raster, spatial, warp, zonal
from greenspark.operators.nearest import nearest


def tiles_of(spark, cells, size, affine, name="a"):
    pixels = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, v double")
    return raster.tile_table(pixels, "v", size, affine, raster_id=name)


def pixels_of(tiles):
    return {(r.row, r.col): r.v for r in raster.explode_tiles(tiles, "v").where("v is not null").collect()}


def test_bilinear_lookup_across_tiles_and_nodata(spark):
    rnd = random.Random(2)
    cells = {(r, c): rnd.random() for r in range(-3, 9) for c in range(-2, 11) if (r * 7 + c) % 5}
    grid = (-23.0, 8.0, 97.0, -9.0)
    want = {}
    for r in range(-10, 40):
        for c in range(-10, 40):
            u, v = (grid[0] + grid[1] * (c + 0.5)) / 10 - 0.5, (100 - (grid[2] + grid[3] * (r + 0.5))) / 10 - 0.5
            parts = [(w, cells[a, b]) for a in (math.floor(v), math.floor(v) + 1) for b in (math.floor(u), math.floor(u) + 1)
                     if (w := (1 - abs(u - b)) * (1 - abs(v - a))) > 0 and (a, b) in cells]
            if parts:
                want[r, c] = sum(w * x for w, x in parts) / sum(w for w, _ in parts)
    for source_size, size in ((4, 5), (16, 4)):
        got = pixels_of(warp.warp(tiles_of(spark, cells, source_size, (10.0, 0.0, 0.0, 0.0, -10.0, 100.0)), 25832, 25832, grid, size))
        assert got == pytest.approx(want)


def test_mosaic_of_many_scenes(spark, monkeypatch):
    monkeypatch.setattr(warp, "SCENES_AT_ONCE", 2)
    scenes = [{(r, c): float(k + r) for r in range(3) for c in range(3) if (r + c + k) % 3} for k in range(5)]
    tiles = None
    for k, cells in enumerate(scenes):
        one = tiles_of(spark, cells, 2, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), f"s{k}")
        tiles = one if tiles is None else tiles.unionByName(one)
    got = pixels_of(warp.mosaic(tiles, (0.0, 1.0, 0.0, 1.0), 2))
    want = {p: np.mean([s[p] for s in scenes if p in s]) for p in {p for s in scenes for p in s}}
    assert got == pytest.approx(want)
    assert warp.mosaic(tiles.limit(0), (0.0, 1.0, 0.0, 1.0), 2).count() == 0


def test_neighbouring_target_tiles_are_looked_up_together(spark, monkeypatch):
    rnd = random.Random(7)
    tiles = tiles_of(spark, {(r, c): rnd.random() for r in range(20) for c in range(30) if (r + c) % 7}, 8, (100.0, 0.0, 500000.0, 0.0, -100.0, 5600000.0))
    grid, found = (1001875.0, 60.0, 6535000.0, -60.0), []
    for pixels in (1, 12, 256):  # tile by tile, some together, all in one group
        monkeypatch.setattr(warp, "GROUP_PIXELS", pixels)
        found.append(pixels_of(warp.warp(tiles, 25832, 3857, grid, 4)))
    assert len(found[0]) > 300 and found[1] == found[0] == found[2]


def test_projections_evaluate_their_parts_once(spark):
    for source, target in ((3857, 25832), (25832, 3857), (27700, 25832)):
        there = spark.range(1).select(crs.transform_pair(F.col("id") + 1.0, F.col("id") + 2.0, source, target))
        assert there._jdf.queryExecution().analyzed().toString().lower().count("atanh(") < 15


def test_scan_lines_equal_the_point_test():
    rnd = random.Random(5)
    for _ in range(200):
        ring = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(rnd.randrange(3, 9))]
        edges = np.array([[*ring[k], *ring[(k + 1) % len(ring)]] for k in range(len(ring))], float)
        xs, ys = np.arange(20) + 0.5, np.arange(20) + 0.5
        mask = zonal.scan_line_mask(edges, xs, ys)
        for r, y in enumerate(ys):
            for c, x in enumerate(xs):
                hits = sum(((y1 > y) != (y2 > y)) and x < x1 + (x2 - x1) * ((y - y1) / (y2 - y1)) for x1, y1, x2, y2 in edges)
                assert mask[r, c] == (hits % 2 == 1)


def test_tile_statistics_equal_pixels(spark):
    rnd = random.Random(6)
    cells = {(r, c): rnd.random() for r in range(40) for c in range(40) if rnd.random() < 0.9}
    shapes = [("a", box_geom(33, 20, 310, 333)), ("b", ring_geom([(10, 10), (390, 40), (200, 380)])), ("c", ring_geom([(0, 0), (400, 0), (400, 400), (0, 400)],
              [(90, 90), (90, 310), (310, 310), (310, 90)])), ("far", box_geom(900, 900, 950, 950))]
    areas = spark.createDataFrame(shapes, f"area_code string, geom {G.GEOM_TYPE}")
    tiles = tiles_of(spark, cells, 8, (10.0, 0.0, 0.0, 0.0, -10.0, 400.0))
    got = {r.area_code: (r.n, r.mean, r.std, r.min, r.max) for r in zonal.tile_zonal_stats(tiles, areas).collect()}
    pixels = raster.explode_tiles(tiles, "v").where("v is not null")
    want = {r.area_code: (r.n, r.mean, r["std"], r["min"], r["max"]) for r in zonal.zonal_stats(zonal.pixels_in_areas(pixels, areas), "v").collect()}
    assert set(got) == {"a", "b", "c"} and all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(Exception, match="turned"):
        zonal.tile_zonal_stats(tiles_of(spark, cells, 8, (10.0, 1.0, 0.0, 0.0, -10.0, 400.0)), areas).collect()


def test_tiles_travel_with_the_edges_beside_them(spark, monkeypatch):
    n = 60
    ring = [(200 + 150 * math.cos(2 * math.pi * k / n), 200 + 150 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    areas = spark.createDataFrame([("round", ring_geom(ring))], f"area_code string, geom {G.GEOM_TYPE}")
    tiles = tiles_of(spark, {(r, c): (r * 40 + c) / 1600 for r in range(40) for c in range(40)}, 8, (10.0, 0.0, 0.0, 0.0, -10.0, 400.0))
    held = []
    original = zonal.cut
    monkeypatch.setattr(zonal, "cut", lambda df: held.append(original(df)) or held[-1])
    got = zonal.tile_zonal_stats(tiles, areas).collect()
    pixels = raster.explode_tiles(tiles, "v").where("v is not null")
    want = zonal.zonal_stats(zonal.pixels_in_areas(pixels, areas), "v").collect()
    assert [(r.n, r.min, r.max) for r in got] == [(r.n, r.min, r.max) for r in want]
    assert got[0].mean == pytest.approx(want[0]["mean"]) and got[0]["std"] == pytest.approx(want[0]["std"])
    sizes = [len(r["_edges"]) for r in held[0].where("_edges is not null").collect()]
    assert sizes and max(sizes) < 0.7 * n  # not the whole outline with every tile


def test_nearest_in_a_crowded_place(spark):
    rnd = random.Random(7)
    boxes = [(f"p{k:04d}", 1000 + rnd.random() * 3, 1000 + rnd.random() * 3, 0.02) for k in range(600)]
    boxes += [("far", -40_000.0, 9_000.0, 500.0), ("wide", 990.0, 2_000.0, 3_000.0)]
    points = [(k, 1000 + rnd.random() * 3, 1000 + rnd.random() * 3) for k in range(300)] + [(900, -39_900.0, 9_100.0), (901, 60_000.0, -5_000.0)]
    shapes = spatial.with_shape(spark.createDataFrame([(i, box_geom(x, y, x + s, y + s)) for i, x, y, s in boxes], f"id string, geom {G.GEOM_TYPE}"), "geom")
    table = spark.createDataFrame(points + [(None, 0.0, 0.0), (902, None, 1.0)], "p int, x double, y double")
    got = {r.p: (r.g, r.d) for r in nearest(table, "p", "x", "y", shapes, "id", "edges", "box", "g", "d").collect()}
    for p, x, y in points:
        want = min((math.hypot(max(bx - x, x - bx - s, 0), max(by - y, y - by - s, 0)), i) for i, bx, by, s in boxes)
        assert got[p][1] == pytest.approx(want[0]) and (want[0] == 0 or got[p][0] == want[1])
    assert 902 not in got and len(got) == len(points) + 1
