"""Geographic test tables derived from the given parquet tables, for Spark and for DuckDB.

The Spark side builds real rings and runs the general kernels.  The SQL side states the same
tables by their corner coordinates, so the two computations are independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenspark.functions import geometry as G
from greenspark.operators.green import LAND_COVER_KINDS, LAND_USE_KINDS
from greenspark.sources.readers import spread

EXTENT = 40000.0  # width of the mapped strip in metres


USED_COLUMNS = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate"],
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table.select(*USED_COLUMNS[name])) if name in USED_COLUMNS else table


def area(spark: SparkSession, sf_dir: str, shear: float = 0.0) -> DataFrame:
    """Gap-free tiling of unequal cells, one per customer."""
    k = F.col("c_custkey")
    i, j = k % 40, F.expr("c_custkey div 40")
    x0, x1 = 1000 * i + 200 * (i % 3), 1000 * (i + 1) + 200 * ((i + 1) % 3)
    y0, y1 = 1000 * j + 150 * (j % 2), 1000 * (j + 1) + 150 * ((j + 1) % 2)
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return (read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.concat(F.lit("A"), F.lpad(k.cast("string"), 8, "0")).alias("area_code"),
                    F.concat_ws(" ", "n_name", F.lpad((k % 1000).cast("string"), 3, "0")).alias("area_name"),
                    F.col("n_name").alias("borough"),
                    (5000 + (37 * k) % 10000).alias("population"),
                    F.col("c_acctbal").alias("acctbal"), k.alias("area_key"),
                    G.polygon([(x + F.lit(shear) * y, y) for x, y in corners]).alias("geom")))


AREA_SQL = """
area AS (
  SELECT 'A' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS area_code,
         n_name || ' ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS area_name,
         n_name AS borough, 5000 + (37 * c_custkey) % 10000 AS population, c_acctbal AS acctbal,
         c_custkey AS area_key, c_custkey % 40 AS gi, c_custkey // 40 AS gj,
         1000 * (c_custkey % 40) + 200 * ((c_custkey % 40) % 3) AS x0,
         1000 * (c_custkey % 40 + 1) + 200 * ((c_custkey % 40 + 1) % 3) AS x1,
         1000 * (c_custkey // 40) + 150 * ((c_custkey // 40) % 2) AS y0,
         1000 * (c_custkey // 40 + 1) + 150 * ((c_custkey // 40 + 1) % 2) AS y1
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def green_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-use and land-cover features with a bbox struct, one per part."""
    k = F.col("p_partkey")
    x0, y0 = (7919 * k) % 39000, 20 * k + (104729 * k) % 1000
    w, h = 50 + (31 * k) % 800, 50 + (17 * k) % 800
    kinds = F.array(*[F.lit(kind) for kind in LAND_USE_KINDS + LAND_COVER_KINDS])
    return read(spark, sf_dir, "part").select(
        k.cast("string").alias("id"),
        F.element_at(kinds, (k % 21 + 1).cast("int")).alias("subtype"),
        F.when(k % 21 < len(LAND_USE_KINDS), "land_use").otherwise("land_cover").alias("source"),
        F.col("p_name").alias("name"),
        G.rectangle(x0, y0, x0 + w, y0 + h).alias("geom"),
        G.box(x0, y0, x0 + w, y0 + h).alias("bbox"))


GREEN_SQL = """
green AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
         ([{kinds}])[CAST(p_partkey % 21 AS INTEGER) + 1] AS kind,
         CASE WHEN p_partkey % 21 < 17 THEN 'land_use' ELSE 'land_cover' END AS source,
         CASE WHEN ([{kinds}])[CAST(p_partkey % 21 AS INTEGER) + 1] IN
                   ('park','village_green','nature_reserve','national_park','recreation_ground','playground',
                    'dog_park','allotments') THEN 'public'
              WHEN ([{kinds}])[CAST(p_partkey % 21 AS INTEGER) + 1] IN
                   ('garden','golf_course','pitch','farmland','orchard','cemetery') THEN 'restricted'
              ELSE 'cover' END AS access_class,
         (7919 * p_partkey) % 39000 AS gx0, 20 * p_partkey + (104729 * p_partkey) % 1000 AS gy0,
         (7919 * p_partkey) % 39000 + 50 + (31 * p_partkey) % 800 AS gx1,
         20 * p_partkey + (104729 * p_partkey) % 1000 + 50 + (17 * p_partkey) % 800 AS gy1
  FROM part
)""".replace("{kinds}", ",".join(f"'{kind}'" for kind in LAND_USE_KINDS + LAND_COVER_KINDS))


def pixel_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band observations: one pixel centre of one scene per line item; NULL is nodata."""
    ok = F.col("l_orderkey") % 50 != 0

    def band(value):
        return F.when(ok, F.round(value, 4))

    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("obs_order"), F.col("l_partkey").alias("obs_part"),
        ((7919 * F.col("l_partkey") + 131 * F.col("l_suppkey") + 17 * F.col("l_linenumber")) % 40000 + 0.5).alias("x"),
        (F.expr("(5 * l_orderkey) div 2") + (977 * F.col("l_partkey")) % 1000 + 0.5).alias("y"),
        F.to_date("l_shipdate").alias("scene"), F.year("l_shipdate").cast("bigint").alias("year"),
        band(0.02 + F.col("l_tax")).alias("B02"), band(0.03 + F.col("l_tax")).alias("B03"),
        band(0.02 + F.col("l_discount")).alias("B04"), band(0.05 + F.col("l_quantity") / 100).alias("B08"))


def with_pixel(obs: DataFrame, size: float = 500.0) -> DataFrame:
    return obs.select("*", F.floor(F.col("x") / size).cast("bigint").alias("col"),
                      F.floor(F.col("y") / size).cast("bigint").alias("row"))


PIXEL_SQL = """
obs AS (
  SELECT l_orderkey AS obs_order, l_partkey AS obs_part,
         (7919 * l_partkey + 131 * l_suppkey + 17 * l_linenumber) % 40000 + CAST(0.5 AS DOUBLE) AS x,
         (5 * l_orderkey) // 2 + (977 * l_partkey) % 1000 + CAST(0.5 AS DOUBLE) AS y,
         CAST(l_shipdate AS DATE) AS scene, CAST(year(l_shipdate) AS BIGINT) AS year,
         CASE WHEN l_orderkey % 50 <> 0 THEN round(CAST(0.02 AS DOUBLE) + l_tax, 4) END AS B02,
         CASE WHEN l_orderkey % 50 <> 0 THEN round(CAST(0.03 AS DOUBLE) + l_tax, 4) END AS B03,
         CASE WHEN l_orderkey % 50 <> 0 THEN round(CAST(0.02 AS DOUBLE) + l_discount, 4) END AS B04,
         CASE WHEN l_orderkey % 50 <> 0 THEN round(CAST(0.05 AS DOUBLE) + l_quantity / 100, 4) END AS B08
  FROM lineitem
), px AS (
  SELECT *, CAST(floor(x / 500) AS BIGINT) AS col, CAST(floor(y / 500) AS BIGINT) AS "row",
         CASE WHEN B08 + B04 > 0 THEN (B08 - B04) / (B08 + B04) END AS ndvi
  FROM obs
)"""


def cell_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly vegetation composite per cell, through the composite operator."""
    from greenspark.functions.spectral import ndvi
    from greenspark.operators.raster import yearly_composite

    obs = pixel_obs(spark, sf_dir).select(
        F.expr("obs_part div 4").alias("cell"), "year", "scene", ndvi(F.col("B08"), F.col("B04")).alias("ndvi"))
    return (yearly_composite(obs, ["cell", "year"], "ndvi", "scene")
            .withColumn("ndvi_median", F.round("ndvi_median", 9)))


CELL_YEAR_SQL = PIXEL_SQL + """, cell_year AS (
  SELECT obs_part // 4 AS cell, year, round(median(ndvi), 9) AS ndvi_median, count(DISTINCT scene) AS n_scenes
  FROM px WHERE ndvi IS NOT NULL GROUP BY 1, 2
)"""


def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell to area: every part names the cell and, by its key, an area."""
    areas = read(spark, sf_dir, "customer").agg(F.max("c_custkey")).scalar()
    k = F.expr("p_partkey div 4")
    return read(spark, sf_dir, "part").select(
        k.alias("cell"), F.concat(F.lit("A"), F.lpad((k % areas + 1).cast("string"), 8, "0")).alias("area_code")).distinct()


CELL_LOOKUP_SQL = """
cell_lookup AS (
  SELECT DISTINCT p_partkey // 4 AS cell,
         'A' || lpad(CAST((p_partkey // 4) % (SELECT max(c_custkey) FROM customer) + 1 AS VARCHAR), 8, '0') AS area_code
  FROM part
)"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per area: order turnover in units of 100,000, 0 without orders."""
    totals = (read(spark, sf_dir, "orders").groupBy("o_custkey")
              .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")))
    return (area(spark, sf_dir).hint("merge").join(totals, F.col("area_key") == F.col("o_custkey"), "left")
            .select("area_code", "borough", "geom", "area_key",
                    (F.coalesce("cents", F.lit(0)) / 1e7).alias("residual")))


RESIDUAL_SQL = AREA_SQL + """, res AS (
  SELECT a.*, coalesce(o.cents, 0) / CAST(1e7 AS DOUBLE) AS residual
  FROM area a LEFT JOIN (
    SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1
  ) o ON o.o_custkey = a.area_key
)"""

NEIGHBOUR_SQL = """
nb AS (
  SELECT a.area_code AS src, b.area_code AS dst
  FROM area a JOIN area b ON b.gi BETWEEN a.gi - 1 AND a.gi + 1 AND b.gj BETWEEN a.gj - 1 AND a.gj + 1
  WHERE a.area_code <> b.area_code
), w AS (SELECT src, dst, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY src) AS weight FROM nb)"""


def lsoa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small areas with population, income decile and public green from the overlay operators."""
    from greenspark.operators import equity, green

    areas = area(spark, sf_dir)
    features = unified_green(spark, sf_dir)
    public = features.where(F.col("access_class") == "public")
    greened = green.green_area_per_area(areas, public, "public_green_m2")
    return (equity.with_decile(areas, "acctbal", "area_code", "imd_income_decile")
            .hint("merge").join(greened, "area_code", "left")
            .select("area_code", "area_name", "borough", "imd_income_decile", "population",
                    F.coalesce("public_green_m2", F.lit(0.0)).alias("public_green_m2"),
                    (F.coalesce("public_green_m2", F.lit(0.0)) / F.col("population")).alias("green_per_capita_m2"),
                    (F.col("area_key") % 101 / 100).alias("prop_pop_within_400m_public_green"),
                    (F.col("area_key") % 3 == 0).alias("angst_compliant_2ha_300m")))


def unified_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    from greenspark.operators import green

    features = green_features(spark, sf_dir)
    return green.unify(
        green.select_kinds(features.where("source = 'land_use'"), LAND_USE_KINDS, "land_use"),
        green.select_kinds(features.where("source = 'land_cover'"), LAND_COVER_KINDS, "land_cover"))


def model_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with the columns the model needs: real measures, and vegetation from the observations."""
    from greenspark.functions.spectral import ndvi
    from greenspark.operators import zonal
    from greenspark.operators.features import area_measures

    areas = area_measures(area(spark, sf_dir), 20000.0, 20000.0)
    px = pixel_obs(spark, sf_dir).select("x", "y", ndvi(F.col("B08"), F.col("B04")).alias("ndvi"))
    greenness = zonal.zonal_stats(zonal.pixels_in_areas(px, areas), "ndvi").select("area_code", F.col("mean").alias("mean_ndvi_late"))
    return areas.hint("merge").join(greenness, "area_code", "left").select(
        F.col("area_code").alias("MSOA21CD"), F.col("area_name").alias("MSOA21NM"), "population", "pop_density",
        "dist_to_centre_km", (0.1 + (F.col("area_key") % 40) / 10).alias("dist_to_park_km"), "area_km2",
        "mean_ndvi_late", "geom", "area_key")
