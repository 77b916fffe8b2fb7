"""Polygon repair against areas summed slab by slab, and T-junction tilings."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import box_geom
from greenspark.functions import geometry as G
from greenspark.functions import repair
from greenspark.operators import dissolve, quality

TYPE = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def geoms(*shapes):
    return pa.array([None if s is None else [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in s] for s in shapes], TYPE)


def plain(geom):
    return [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in geom.as_py()]


def total(parts):
    return sum(repair._signed_area(ring) for part in parts for ring in part)


def slab_area(rings, even_odd):
    """Area of (sign, ring) pairs: in each slab between crossings the edges do not cross, so widths at its middle are exact."""
    edges = [(r[i], r[(i + 1) % len(r)], q) for q, (_, r) in enumerate(rings) for i in range(len(r)) if r[i] != r[(i + 1) % len(r)]]
    levels = {p[1] for e in edges for p in e[:2]}
    for i in range(len(edges)):
        for j in range(i):
            (a, b, _), (c, d, _) = edges[i], edges[j]
            across = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if across:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / across
                u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / across
                if 0 <= t <= 1 and 0 <= u <= 1:
                    levels.add(a[1] + t * (b[1] - a[1]))
    levels, out = sorted(levels), 0.0
    for low, high in zip(levels, levels[1:]):
        middle = (low + high) / 2
        hits = sorted((a[0] + (b[0] - a[0]) * (middle - a[1]) / (b[1] - a[1]), 1 if b[1] > a[1] else -1, q)
                      for a, b, q in edges if (a[1] > middle) != (b[1] > middle))
        turns, n = [0] * len(rings), 0
        for (x, d, q), (x2, _, _) in zip(hits, hits[1:]):
            turns[q] += d
            n += 1
            if n % 2 if even_odd else sum(s for (s, _), w in zip(rings, turns) if w) > 0:
                out += (x2 - x) * (high - low)
    return out


def test_random_shapes_keep_their_area():
    rnd = random.Random(11)
    for _ in range(400):
        k = rnd.choice([6, 10, 30, 1000])
        shape, rings = [], []
        for _ in range(rnd.randrange(1, 3)):
            part = [[(rnd.randrange(k), rnd.randrange(k)) for _ in range(rnd.randrange(3, 9))] for _ in range(rnd.randrange(1, 4))]
            shape.append(part)
            rings += [(1 if h == 0 else -1, r) for h, r in enumerate(part)]
        given = geoms(shape)
        bad = repair.invalid(repair.Rings(given))[0]
        for even_odd in (True, False):
            out = repair._make_valid(given, even_odd)
            if not bad:
                assert out.equals(given)
                continue
            parts = plain(out[0])
            assert total(parts) == pytest.approx(slab_area(rings, even_odd), abs=1e-6 * k * k)
            for part in parts:
                assert repair._signed_area(part[0]) > 0 and all(repair._signed_area(h) < 0 for h in part[1:])
                assert all(r[0] == r[-1] and len(set(r)) == len(r) - 1 >= 3 for r in part)


def test_known_shapes():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (1, 3), (3, 3), (3, 1)]
    shapes = geoms([[square]], [[square, hole]], [[[(0, 0), (4, 4), (4, 0), (0, 4)]]], [[[(0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 4)]]],
                   [[square, [(5, 5), (6, 5), (6, 6)]]], [[square], [[(1, 1), (2, 1), (2, 2)]]], [[square], [[(4, 0), (8, 0), (8, 4), (4, 4)]]],
                   [[[(0, 0), (1, 1)]]], [], None, [[]], [[square, hole], [[(1.5, 1.5), (2, 1.5), (2, 2)]]], [[[(0, 0), (float("nan"), 1), (4, 0), (4, 4)]]])
    bad = repair.invalid(repair.Rings(shapes))
    assert bad.tolist() == [False, False, True, True, True, True, True, True, False, False, False, False, False]


def test_columns_and_counts(spark):
    bow = [[[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 4.0, "y": 0.0}, {"x": 0.0, "y": 4.0}]]]
    flat = [[[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 4.0}]]]
    rows = spark.createDataFrame([(1, box_geom(0, 0, 2, 2)), (2, bow), (3, flat), (4, None), (5, [])], f"k int, geom {G.GEOM_TYPE}")
    got = {r.k: (r.ok, r.m2) for r in 
           rows.select("k", repair.is_valid("geom").alias("ok"), repair.make_valid("geom").alias("fixed")).select("k", "ok", G.area(F.col("fixed")).alias("m2")).collect()}
    assert got == {1: (True, 4.0), 2: (False, 8.0), 3: (False, None), 4: (None, None), 5: (True, None)}
    counts = quality.repair_counts(rows, []).first()
    assert (counts.n, counts.n_invalid, counts.m2_after) == (5, 2, 12.0)


def test_t_junctions_cancel(spark):
    shapes = spark.createDataFrame([("a", box_geom(0, 0, 4, 2)), ("a", box_geom(0, 2, 1, 4)), ("a", box_geom(1, 2, 4, 4)), (None, box_geom(2, 0, 3, 1))],
                                   f"grp string, geom {G.GEOM_TYPE}")
    with_cuts = dissolve.dissolved_edges(shapes, ["grp"], t_junctions=True)
    length = {r.grp: r.m for r in with_cuts.groupBy("grp").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("m")).collect()}
    assert length == {"a": 16.0, None: 4.0}
    ring, = dissolve.dissolved_rings(shapes.where("grp = 'a'"), ["grp"], t_junctions=True).collect()
    assert ring.area_m2 == 16.0
    assert dissolve.dissolved_edges(shapes.limit(0), ["grp"], t_junctions=True).count() == 0


def test_a_batch_is_repaired_together(monkeypatch):
    import pyarrow as pa

    from greenspark.functions import repair

    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    def closed(x, *points):
        return [{"x": float(x + px), "y": float(py)} for px, py in [*points, points[0]]]

    shapes = [[[closed(k, (0, 0), (2, 1 + k % 3), (2, 0), (0, 1 + k % 3))],
               [closed(k, (0, 4), (4, 4), (4, 4 + k), (0, 4 + k)), closed(k, (1, 5), (3, 5), (3, 9), (1, 9))]] for k in range(300)]
    alone = [repair._make_valid(pa.array([shape], kind), even_odd).to_pylist()[0] for shape in shapes[:40] for even_odd in (True, False)]
    calls, sides = [], repair._sides
    monkeypatch.setattr(repair, "_sides", lambda *a: calls.append(1) or sides(*a))
    together = [repair._make_valid(pa.array(shapes, kind), even_odd).to_pylist() for even_odd in (True, False)]
    assert alone == [rows[k] for k in range(40) for rows in together]
    assert len(calls) < 20  # not one round or more per geometry
