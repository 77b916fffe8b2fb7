import random
import statistics

import pytest
from pyspark.sql import functions as F

from greenspark.functions import colour, scalars
from greenspark.operators import components, equity, ordering, raster, trend


def test_ranks_and_quantiles_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "cold", float(rng.choice([1, 1, 1, 2, 3, 5, 8, rng.random()]))) for i in range(600)] + [("one", 4.0), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ordering.quantiles(df, ["g"], "v", {"med": 0.5, "p10": 0.1}).collect()}
    for g in ("hot", "cold", "one"):
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g].med == pytest.approx(statistics.median(values))
        at = (len(values) - 1) * 0.1
        low = values[int(at)]
        high = values[min(int(at) + 1, len(values) - 1)]
        assert got[g].p10 == pytest.approx(low + (high - low) * (at - int(at)))
    ranked = ordering.with_rank(df, ["g"], "v", rank="r", percent_rank="p", average_rank="a").collect()
    assert len(ranked) == len(rows)
    for row in ranked:
        if row.v is None:
            assert row.r is None
            continue
        same = [v for k, v in rows if k == row.g and v is not None]
        below, equal = sum(v < row.v for v in same), sum(v == row.v for v in same)
        assert row.r == below + 1 and row.a == below + (equal + 1) / 2
        assert row.p == pytest.approx(below / (len(same) - 1) if len(same) > 1 else 0.0)


def test_row_numbers_and_deciles(spark):
    df = spark.createDataFrame([(f"k{i:03d}", float(i % 7)) for i in range(103)], "k string, s double")
    order = [r.k for r in ordering.row_numbers(df, ["s", "k"]).orderBy("row_no").collect()]
    assert order == [r.k for r in sorted(df.collect(), key=lambda r: (r.s, r.k))]
    sizes = sorted(r["count"] for r in equity.with_decile(df, "s", "k", "d").groupBy("d").count().collect())
    assert sizes == [10] * 7 + [11] * 3
    few = equity.with_decile(df.limit(4), "s", "k", "d")
    assert sorted(r.d for r in few.collect()) == [1, 2, 3, 4]


def test_hash_order_is_a_permutation_per_group(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("g"), F.lit(2).cast("bigint").alias("w"))
    rows = ordering.hash_order(df, "k", F.lit("s-"), ["g"], 1, "r", "w", "b").collect()
    for g in (0, 1):
        mine = sorted((x.r, x.b) for x in rows if x.g == g)
        assert mine == [(i, 2 * i) for i in range(250)]


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(300, i) for i in range(301, 340)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


def test_mask_patches_and_outline(spark):
    cells = [(0, 0), (0, 1), (1, 1), (3, 3), (4, 4)]
    mask = spark.createDataFrame(cells, "row bigint, col bigint")
    assert sorted(r.n_pixels for r in components.mask_patches(mask, 10.0).collect()) == [1, 1, 3]
    outline = components.mask_outline(mask.withColumn("patch", F.lit(1)), 10.0)
    area = outline.agg(F.sum((F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2")) / 2)).first()[0]
    assert area == 500.0


def test_trend_edges(spark):
    rows = [("c", 2000 + i, v) for i, v in enumerate([1.0, 1.0, 1.0])] + [("u", 2000 + i, float(i)) for i in range(9)] + [("s", 2001, 1.0)]
    df = spark.createDataFrame(rows, "cell string, year bigint, ndvi_median double")
    got = {r.cell: r for r in trend.sen_mann_kendall(df).collect()}
    assert set(got) == {"c", "u"} and got["c"].mk_z == 0.0 and got["c"].mk_p == pytest.approx(1.0, abs=1e-6)
    assert got["u"].sen_slope == 1.0 and got["u"].mk_s == 36.0 and got["u"].mk_p < 0.001
    assert {r.cell for r in trend.cell_trend(df).collect()} == {"u"}


def test_null_and_zero_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0, None, "Hackney 023"), (1.0, 0.0, 0.5, "Tower Hamlets 1A"), (2.0, 0.0, 3.0, "Soho")],
                               "a double, b double, s double, n string")
    rows = df.select(scalars.safe_divide(F.col("a"), F.col("b")).alias("d"), scalars.surprise_equity(F.col("a"), F.col("s")).alias("e"),
                     scalars.borough_from_name(F.col("n")).alias("n")).collect()
    assert [r.d for r in rows] == [None] * 3 and [r.e for r in rows] == [None, -0.5, -2.0]
    assert [r.n for r in rows] == ["Hackney", "Tower Hamlets", "Soho"]
    one = df.agg(scalars.safe_corr(F.col("a"), F.col("b")).alias("c"), scalars.std_or_one(F.col("b")).alias("s")).first()
    assert one.c is None and one.s == 1.0
    assert df.limit(0).agg(scalars.std_or_one(F.col("a")).alias("s")).first().s == 1.0


def test_mosaic_and_coverage_ignore_nodata(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 0, None), (0, 0, 0.0), (0, 1, None)], "row int, col int, B04 double")
    got = {(r.row, r.col): r.B04 for r in raster.mosaic_mean(df, ["row", "col"], ["B04"]).collect()}
    assert got == {(0, 0): 0.2, (0, 1): None}
    assert raster.band_coverage(df, ["B04"]).first().coverage == 0.25


def test_colour_ramp_ends_and_missing(spark):
    df = spark.createDataFrame([(-9.0,), (9.0,), (0.075,), (None,), (float("nan"),)], "v double")
    rows = [tuple(r.c) for r in df.select(colour.ramp_rgba(F.col("v"), colour.RAMP_NDVI).alias("c")).collect()]
    assert rows[0] == (165, 0, 38, 200) and rows[1] == (26, 152, 80, 200) and rows[2] == (190, 24, 39, 200)
    assert rows[3] == rows[4] == (180, 180, 180, 60)


def test_point_join_gives_the_same_rows_broadcast_and_shuffled(spark, monkeypatch):
    from conftest import box_geom
    from greenspark.functions import geometry as G
    from greenspark.operators import spatial

    rng = random.Random(4)
    boxes = [(i, x, y, x + w, y + w) for i in range(40) for x, y, w in [(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([1, 9, 70]))]]
    pts = [(j, rng.uniform(-60, 120), rng.uniform(-60, 120)) if j % 3 else (j, 1.5, 2.5) for j in range(300)]  # one popular spot
    areas = spark.createDataFrame([(i, box_geom(*b)) for i, *b in boxes], f"a int, geom {G.GEOM_TYPE}")
    points = spark.createDataFrame(pts, "p int, x double, y double")
    want = sorted((j, i) for j, x, y in pts for i, x0, y0, x1, y1 in boxes if x0 <= x < x1 and y0 <= y < y1)
    shaped = spatial.part_shapes(areas, ["a"], "e", "b")
    for limit in (spatial.BROADCAST_BYTES, 0):
        monkeypatch.setattr(spatial, "BROADCAST_BYTES", limit)
        got = spatial.point_join(points, shaped, "x", "y", "e", "b")
        assert sorted((r.p, r.a) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (limit == 0)


def test_sure_pairs_within_a_distance_skip_the_kernel(spark):
    from greenspark.functions import geometry as G
    from greenspark.operators import spatial

    rng = random.Random(8)

    def boxes(prefix, n):
        rows = [(f"{prefix}{k}", *(float(rng.randint(0, 60)) for _ in range(2)), float(rng.randint(1, 9))) for k in range(n)]
        df = spark.createDataFrame(rows, f"{prefix} string, x double, y double, w double")
        shape = G.polygon([(F.col("x"), F.col("y")), (F.col("x") + F.col("w"), F.col("y")), (F.col("x"), F.col("y") + F.col("w"))])
        return spatial.with_shape(df.select(prefix, shape.alias("geom")), "geom", f"{prefix}_edges", f"{prefix}_box").drop("geom")

    sides = boxes("a", 60), boxes("b", 60)
    pairs = [{(r.a, r.b): r.gap_m for r in spatial.within_distance_join(*sides, "a_edges", "b_edges", "a_box", "b_box", 20.0, exact=exact)
              .select("a", "b", "gap_m").collect()} for exact in (True, False)]
    assert pairs[0].keys() == pairs[1].keys() and any(gap == 0 for gap in pairs[0].values())
    assert all((gap == 0) == (pairs[1][pair] == 0) and pairs[1][pair] <= gap + 1e-9 for pair, gap in pairs[0].items())
    assert any(pairs[1][pair] < gap - 0.1 for pair, gap in pairs[0].items())
