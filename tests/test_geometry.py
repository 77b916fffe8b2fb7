import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import box_geom, ring_geom
from greenspark.functions import crs
from greenspark.functions import geometry as G
from greenspark.functions import kernels as K
from greenspark.operators import contiguity, dissolve, spatial
from greenspark.operators.coverage import box_union_area, union_area
from greenspark.operators.nearest import nearest
from greenspark.sources.readers import from_wkb, to_wkb

U_SHAPE = ring_geom([(0, 0), (6, 0), (6, 5), (4, 5), (4, 2), (2, 2), (2, 5), (0, 5)])
HOLED = ring_geom([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)])


def frame(spark, rows, names="id string, geom " + G.GEOM_TYPE):
    return spark.createDataFrame(rows, names)


def pair(spark, a, b, kernel):
    df = spark.createDataFrame([(a, b)], f"a {G.GEOM_TYPE}, b {G.GEOM_TYPE}")
    clean = spatial.once(spatial.once(df, "ca", G.normalise(F.col("a"))), "cb", G.normalise(F.col("b")))
    shaped = spatial.with_shape(spatial.with_shape(clean, "ca", "ea", "ba"), "cb", "eb", "bb")
    return shaped.select(kernel("ea", "eb").alias("v")).first().v


def test_area_centroid_and_holes(spark):
    rows = [("u", U_SHAPE), ("h", HOLED), ("m", box_geom(0, 0, 1, 1) + box_geom(3, 0, 4, 1)), ("n", None)]
    got = {r.id: r for r in frame(spark, rows).select(
        "id", G.area(G.normalise(F.col("geom"))).alias("a"), G.centroid(G.normalise(F.col("geom"))).alias("c")).collect()}
    assert got["u"].a == 24.0 and got["h"].a == 12.0 and got["m"].a == 2.0 and got["n"].a is None
    assert (got["h"].c.x, got["h"].c.y) == (2.0, 2.0) and (got["m"].c.x, got["m"].c.y) == (2.0, 0.5)


def test_normalise_is_invariant_to_ring_order_and_repeats(spark):
    ring = [(0, 0), (6, 0), (6, 5), (4, 5), (4, 2), (2, 2), (2, 5), (0, 5)]
    variants = [ring, ring[::-1], ring[3:] + ring[:3], [p for p in ring for _ in range(2)]]
    areas = [r.a for r in frame(spark, [(str(i), ring_geom(v)) for i, v in enumerate(variants)]).select(
        G.area(G.normalise(F.col("geom"))).alias("a")).collect()]
    assert areas == [24.0] * 4
    flat = frame(spark, [("z", ring_geom([(0, 0), (1, 1), (2, 2)]))]).select(F.size(G.normalise(F.col("geom"))).alias("n"))
    assert flat.first().n == 0


def test_overlap_with_concave_and_holed_shapes(spark):
    assert pair(spark, U_SHAPE, box_geom(0, 3, 6, 5), K.overlap_area) == pytest.approx(8.0)
    assert pair(spark, HOLED, box_geom(0, 0, 2, 2), K.overlap_area) == pytest.approx(3.0)
    assert pair(spark, HOLED, box_geom(1.5, 1.5, 2.5, 2.5), K.overlap_area) == pytest.approx(0.0)
    diamond = ring_geom([(2, -1), (5, 2), (2, 5), (-1, 2)])
    assert pair(spark, box_geom(0, 0, 4, 4), diamond, K.overlap_area) == pytest.approx(18 - 4 * 1.0)
    far = 5e5
    moved = [[[{"x": p["x"] + far, "y": p["y"] + far} for p in ring] for ring in part] for part in U_SHAPE]
    assert pair(spark, moved, box_geom(far, far + 3, far + 6, far + 5), K.overlap_area) == pytest.approx(8.0)


def test_overlap_of_stars_against_sampling(spark):
    rng = random.Random(5)

    def star(cx):
        return [(cx + (5 + 4 * rng.random()) * math.cos(t * math.pi / 30), (5 + 4 * rng.random()) * math.sin(t * math.pi / 30))
                for t in range(60)]

    def inside(ring, x, y):
        hits = 0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            hits += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return hits % 2

    a, b = star(0), star(3)
    shared = sum(inside(a, x, y) and inside(b, x, y)
                 for x, y in ((rng.uniform(-10, 14), rng.uniform(-10, 10)) for _ in range(40000))) / 40000 * 480
    assert pair(spark, ring_geom(a), ring_geom(b), K.overlap_area) == pytest.approx(shared, rel=0.03)


def test_intersects_touches_gap(spark):
    a = box_geom(0, 0, 2, 2)
    assert pair(spark, a, box_geom(2, 2, 3, 3), K.intersects) and pair(spark, a, box_geom(2, 2, 3, 3), K.touches)
    assert pair(spark, a, box_geom(0.5, 0.5, 1, 1), K.intersects) and not pair(spark, a, box_geom(0.5, 0.5, 1, 1), K.touches)
    assert not pair(spark, HOLED, box_geom(1.5, 1.5, 2.5, 2.5), K.intersects)
    assert pair(spark, HOLED, box_geom(1.5, 1.5, 2.5, 2.5), K.gap) == pytest.approx(0.5)
    assert pair(spark, a, box_geom(5, 6, 7, 7), K.gap) == pytest.approx(5.0)
    assert pair(spark, a, box_geom(-1, -1, 3, 3), K.gap) == 0.0


def test_simple_flag(spark):
    rows = [("ok", U_SHAPE), ("eight", ring_geom([(0, 0), (2, 2), (2, 0), (0, 2)]))]
    got = {r.id: r.s for r in frame(spark, rows).select("id", K.is_simple(G.edges(F.col("geom"))).alias("s")).collect()}
    assert got == {"ok": True, "eight": False}


def test_point_rules_on_shared_sides(spark):
    df = spark.createDataFrame([(box_geom(0, 0, 1, 1), box_geom(1, 0, 2, 1))], f"a {G.GEOM_TYPE}, b {G.GEOM_TYPE}")
    row = df.select(G.contains_xy(G.edges(F.col("a")), F.lit(1.0), F.lit(0.5)).alias("a"),
                    G.contains_xy(G.edges(F.col("b")), F.lit(1.0), F.lit(0.5)).alias("b"),
                    G.distance_xy(G.edges(F.col("a")), F.lit(4.0), F.lit(5.0)).alias("d")).first()
    assert (row.a, row.b, row.d) == (False, True, 5.0)


def brute_pairs(left, right):
    return sorted((i, j) for i, a in left for j, b in right
                  if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3])


def test_box_join_mixed_sizes_against_brute_force(spark):
    rng = random.Random(1)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, s = rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice([0, 1, 16, 64, 700])
            out.append((i, (x, y, x + s * rng.random(), y + s)))
        return out + [(n, (0.0, 0.0, 64.0, 64.0)), (n + 1, (64.0, 64.0, 128.0, 128.0))]

    left, right = boxes(80), boxes(60)
    kind = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    l = spark.createDataFrame(left, f"i int, lb {kind}")
    r = spark.createDataFrame(right, f"j int, rb {kind}")
    got = sorted((x.i, x.j) for x in spatial.box_join(l, r, "lb", "rb").select("i", "j").collect())
    assert got == brute_pairs(left, right)


def test_nearest_reaches_a_far_point(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1e6, 1e6), ("c", 12.0, 5.0)], "p string, x double, y double")
    polys = spatial.with_shape(frame(spark, [("k", box_geom(10, 0, 20, 10)), ("m", box_geom(-5, 30, 5, 40))]), "geom")
    got = {r.p: (r.g, r.d) for r in nearest(pts, "p", "x", "y", polys, "id", "edges", "box", "g", "d").collect()}
    assert got["a"] == ("k", 10.0) and got["c"] == ("k", 0.0)
    assert got["b"][0] == "m" and got["b"][1] == pytest.approx(math.hypot(1e6 - 5, 1e6 - 40))


def test_union_area_of_crossing_shapes_copies_and_stacks(spark):
    areas = spark.createDataFrame([("A", box_geom(0, 0, 10, 10))], f"k string, geom {G.GEOM_TYPE}")
    shapes = [box_geom(0, 0, 4, 4), box_geom(0, 0, 4, 4), box_geom(2, 2, 6, 6), ring_geom([(6, 6), (9, 6), (6, 9)]),
              box_geom(-5, 8, 1, 20)]
    shapes += [box_geom(7, 1, 7.5 + i / 400, 2) for i in range(200)]  # near copies on one spot
    feats = spatial.with_shape(frame(spark, [(str(i), s) for i, s in enumerate(shapes)]), "geom", "g_edges", "g_box")
    got = union_area(areas, feats, "k", "m2").first().m2
    assert got == pytest.approx(16 + 12 + 4.5 + 2 + (0.5 + 199 / 400))


def test_box_union_area(spark):
    rows = [("d", (0.0, 0.0, 4.0, 2.0)), ("d", (2.0, 1.0, 6.0, 3.0)), ("d", (2.0, 1.0, 6.0, 3.0)), ("e", (0.0, 0.0, 1.0, 1.0))]
    df = spark.createDataFrame(rows, "k string, b struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    assert {r.k: r.m for r in box_union_area(df, ["k"], "b", "m").collect()} == {"d": 14.0, "e": 1.0}


def test_queen_sees_t_junctions(spark):
    rows = [("a", box_geom(0, 0, 2, 1)), ("b", box_geom(0, 1, 1, 2)), ("c", box_geom(0.5, -1, 1.5, 0)), ("d", box_geom(9, 9, 10, 10))]
    df = spark.createDataFrame(rows, f"area_code string, geom {G.GEOM_TYPE}")
    general = {(r.src, r.dst) for r in contiguity.queen(df).collect()}
    assert general == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
    assert ("a", "c") not in {(r.src, r.dst) for r in contiguity.queen_by_vertex(df).collect()}


def test_dissolve_keeps_holes_and_parts(spark):
    cells = [("g", box_geom(i, j, i + 1, j + 1)) for i in range(3) for j in range(3) if (i, j) != (1, 1)] + [("g", box_geom(8, 8, 9, 9))]
    df = spark.createDataFrame(cells, f"k string, geom {G.GEOM_TYPE}")
    rings = sorted((r.n_points, r.area_m2) for r in dissolve.dissolved_rings(df, ["k"]).collect())
    assert rings == [(4, -1.0), (4, 1.0), (12, 9.0)]


def test_wkb_round_trip(spark):
    rows = [("u", U_SHAPE), ("h", HOLED), ("m", box_geom(0, 0, 1, 1) + box_geom(3, 0, 4, 1)), ("n", None)]
    df = frame(spark, rows)
    back = df.select("id", "geom", from_wkb(to_wkb(F.col("geom"))).alias("again"))
    assert all(r.geom == r.again for r in back.collect())


def test_reference_systems(spark):
    one = spark.range(1)
    e, n = crs._to_transverse(F.lit(1 + 43 / 60 + 4.5177 / 3600), F.lit(52 + 39 / 60 + 27.2531 / 3600), 27700)
    row = one.select(e.alias("e"), n.alias("n")).first()
    assert row.e == pytest.approx(651409.903, abs=0.01) and row.n == pytest.approx(313177.270, abs=0.01)
    for epsg, lon, lat in ((27700, -0.1276, 51.5074), (25832, 13.405, 52.52), (2154, 2.3522, 48.8566), (3857, -0.1, 51.5)):
        p = one.select(crs.transform_pair(F.lit(lon), F.lit(lat), 4326, epsg).alias("p"))
        q = p.select("p", crs.transform_pair(F.col("p.x"), F.col("p.y"), epsg, 4326).alias("q")).first()
        assert q.q.x == pytest.approx(lon, abs=2e-6) and q.q.y == pytest.approx(lat, abs=2e-6)
    x, y = crs.from_lonlat(F.lit(3.0), F.lit(46.5), 2154)
    row = one.select(x.alias("x"), y.alias("y")).first()
    assert (row.x, row.y) == (pytest.approx(700000, abs=1e-6), pytest.approx(6600000, abs=1e-3))
    cx, cy = crs.from_lonlat(F.lit(-0.1276), F.lit(51.5074), 27700)
    row = one.select(cx.alias("x"), cy.alias("y")).first()
    assert row.x == pytest.approx(530030, abs=30) and row.y == pytest.approx(180380, abs=30)
    with pytest.raises(ValueError):
        crs.require_projected(4326)


def test_measures_evaluate_their_geometry_once(spark):
    square = spark.range(1).select(G.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("geom"))
    for measure in (G.area, G.centroid):
        plan = square.select(measure(G.normalise(F.col("geom"))))._jdf.queryExecution().analyzed().toString()
        assert plan.count("reverse(") <= 2  # the geometry stands in the measure once, not once per edge and use
    assert square.select(G.area(G.normalise(F.col("geom")))).first()[0] == 1.0
