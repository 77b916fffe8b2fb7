"""Green polygons: selection, unification, shares per area and access to public green."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenspark.functions import geometry as G
from greenspark.functions import kernels as K
from greenspark.functions.repair import make_valid
from greenspark.operators import spatial
from greenspark.operators.coverage import union_area
from greenspark.operators.nearest import nearest

# Feature kinds and their access class.
LAND_USE_KINDS = [
    "park", "village_green", "dog_park", "nature_reserve", "national_park", "recreation_ground", "playground",
    "garden", "allotments", "cemetery", "golf_course", "pitch", "meadow", "grass", "forest", "farmland", "orchard",
]
LAND_COVER_KINDS = ["tree", "grass", "shrub", "wetland"]
PUBLIC_KINDS = [
    "park", "village_green", "nature_reserve", "national_park", "recreation_ground", "playground", "dog_park",
    "allotments",
]
RESTRICTED_KINDS = ["garden", "golf_course", "pitch", "farmland", "orchard", "cemetery"]
GREENSPACE_FUNCTIONS = [
    "Public Park Or Garden", "Play Space", "Playing Field", "Allotments Or Community Growing Spaces",
]
LARGE_GREEN_M2 = 20000.0  # two hectares
SEARCH_RADIUS_M = 5000.0


def in_bounds(bbox: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Overlap with literal bounds; as plain ranges on struct leaves it reaches the Parquet scan."""
    return ((bbox["xmax"] >= F.lit(xmin)) & (bbox["xmin"] <= F.lit(xmax))
            & (bbox["ymax"] >= F.lit(ymin)) & (bbox["ymin"] <= F.lit(ymax)))


def select_kinds(features: DataFrame, kinds: list[str], source: str, bounds: tuple | None = None) -> DataFrame:
    """Features of the wanted kinds inside literal bounds, as (id, kind, source, geom)."""
    wanted = features.where(F.col("subtype").isin(kinds))
    if bounds is not None:
        wanted = wanted.where(in_bounds(F.col("bbox"), *bounds))
    return wanted.select("id", F.col("subtype").alias("kind"), F.lit(source).alias("source"), "geom")


def access_class(kind: Column) -> Column:
    return (F.when(kind.isin(PUBLIC_KINDS), "public").when(kind.isin(RESTRICTED_KINDS), "restricted")
            .otherwise("cover"))


def unify(land_use: DataFrame, land_cover: DataFrame) -> DataFrame:
    """Both sources in one table with provenance, access class, repaired geometry and its shape columns."""
    both = land_use.unionByName(land_cover)
    clean = (spatial.once(both.withColumnRenamed("geom", "_raw"), "geom", G.normalise(make_valid("_raw")))
             .drop("_raw").where(F.size("geom") > 0)
             .withColumn("access_class", access_class(F.col("kind"))))
    return spatial.with_shape(clean, "geom", "g_edges", "g_box")


def green_area_per_area(areas: DataFrame, greens: DataFrame, out: str, key: str = "area_code") -> DataFrame:
    """Overlap of every area with the green features, summed; overlapping features count repeatedly."""
    pairs = spatial.overlap_join(spatial.part_shapes(areas, [key], "a_edges", "a_box"), greens.select("g_edges", "g_box"),
                                 "a_edges", "g_edges", "a_box", "g_box")
    return pairs.groupBy(key).agg(F.sum("overlap_m2").alias(out))


def green_share(areas: DataFrame, greens: DataFrame, key: str) -> DataFrame:
    """Area-weighted green share per ``key``; areas of one key are taken together."""
    sizes = areas.groupBy(key).agg(F.sum(G.area(G.normalise(F.col("geom")))).alias("area_m2"))
    return (green_area_per_area(areas, greens, "green_m2_gross", key).hint("merge").join(sizes, key)
            .select(key, "green_m2_gross", "area_m2",
                    F.try_divide("green_m2_gross", F.nullif(F.col("area_m2"), F.lit(0.0))).alias("green_share")))


def green_share_dissolved(areas: DataFrame, greens: DataFrame, key: str) -> DataFrame:
    """As ``green_share``, but ground below several overlapping features counts once."""
    sizes = areas.groupBy(key).agg(F.sum(G.area(G.normalise(F.col("geom")))).alias("area_m2"))
    return (union_area(areas, greens, key, "green_m2_dissolved").hint("merge").join(sizes, key)
            .select(key, "green_m2_dissolved", "area_m2",
                    F.try_divide("green_m2_dissolved", F.nullif(F.col("area_m2"), F.lit(0.0))).alias("green_share")))


def overlap_weights(areas: DataFrame, greens: DataFrame) -> DataFrame:
    """Share of each feature that lies in each area it overlaps."""
    pairs = spatial.overlap_join(spatial.part_shapes(areas, ["area_code"], "a_edges", "a_box"), greens.select("id", "g_edges", "g_box"),
                                 "a_edges", "g_edges", "a_box", "g_box")
    return (pairs.withColumn("feature_m2", G.edges_area(F.col("g_edges")))
            .groupBy("id", "area_code", "feature_m2").agg(F.sum("overlap_m2").alias("overlap_m2"))
            .withColumn("weight", F.try_divide("overlap_m2", "feature_m2")))


def large_public(greens: DataFrame, at_least_m2: float = LARGE_GREEN_M2) -> DataFrame:
    return greens.where((F.col("access_class") == "public") & (G.edges_area(F.col("g_edges")) >= at_least_m2))


def angst(areas: DataFrame, greens: DataFrame, radius: float = SEARCH_RADIUS_M) -> DataFrame:
    """Distance to, area of and area per head of large public green near each area.

    The search radius applies to the distance between polygons; the reported distance runs from
    the centroid of the area.  Areas without a hit stay, with NULL distance and 0 area.
    """
    shaped = spatial.with_shape(areas.select("area_code", "population", G.normalise(F.col("geom")).alias("geom")), "geom", "a_edges", "a_box").drop("geom")
    centred = spatial.once(shaped, "centre", G.edges_centroid(F.col("a_edges")))
    pairs = spatial.within_distance_join(centred.drop("population"), large_public(greens).select("g_edges", "g_box"),
                                         "a_edges", "g_edges", "a_box", "g_box", radius, exact=False)
    touching = F.col("gap_m") == 0
    common = K.overlap_area(F.when(touching, F.col("a_edges")), F.when(touching, F.col("g_edges")))
    per_area = (pairs.select("area_code",
                             G.distance_xy(F.col("g_edges"), F.col("centre.x"), F.col("centre.y")).alias("d"),
                             F.when(touching, common).otherwise(F.lit(0.0)).alias("m2"))
                .groupBy("area_code").agg(F.min("d").alias("dist_to_public_green_2ha_m"),
                                          F.sum("m2").alias("public_green_m2")))
    return (shaped.select("area_code", "population").hint("merge").join(per_area, "area_code", "left")
            .withColumn("public_green_m2", F.coalesce("public_green_m2", F.lit(0.0)))
            .withColumn("public_green_per_capita_m2",
                        F.try_divide("public_green_m2", F.nullif(F.col("population"), F.lit(0)).cast("double"))))


def access_flags(areas: DataFrame, greens: DataFrame, near_m: float = 300.0, any_m: float = 400.0) -> DataFrame:
    """Per area: is the centroid within reach of large, and of any, public green?"""
    centres = spatial.once(areas, "c", G.centroid(F.col("geom")))
    centres = centres.select(*[c for c in areas.columns if c != "geom"], F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
    public = greens.where(F.col("access_class") == "public")
    large = nearest(centres.select("area_code", "cx", "cy"), "area_code", "cx", "cy",
                    large_public(greens), "id", "g_edges", "g_box", "large_id", "dist_large_m")
    small = nearest(centres.select("area_code", "cx", "cy"), "area_code", "cx", "cy",
                    public, "id", "g_edges", "g_box", "any_id", "dist_any_m")
    return (centres.drop("cx", "cy").hint("merge").join(large, "area_code", "left").hint("merge").join(small, "area_code", "left")
            .withColumn("angst_compliant_2ha_300m", F.coalesce(F.col("dist_large_m") <= near_m, F.lit(False)))
            .withColumn("within_400m_public_green", F.coalesce(F.col("dist_any_m") <= any_m, F.lit(False))))


def access_population(areas: DataFrame, greens: DataFrame, key: str) -> DataFrame:
    """Population-weighted access shares per ``key``."""
    flags = access_flags(areas, greens)

    def weighted(flag):
        return F.try_divide(F.sum(F.when(F.col(flag), F.col("population")).otherwise(0)),
                            F.nullif(F.sum("population"), F.lit(0)))

    return flags.groupBy(key).agg(
        F.sum("population").alias("population"),
        weighted("angst_compliant_2ha_300m").alias("pop_share_300m_2ha"),
        weighted("within_400m_public_green").alias("pop_share_400m_any"))
