"""Spectral clustering of pixels and what it says about areas."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenspark.operators.spatial import once

BANDS = ["B02", "B03", "B04", "B08"]


def fit_centres(pixels: DataFrame, k: int = 6, seed: int = 42, bands: list[str] = BANDS) -> list[list[float]]:
    """Cluster centres over all valid pixels, ordered by their coordinates so that labels are stable."""
    vectors = VectorAssembler(inputCols=bands, outputCol="features").transform(pixels.dropna(subset=bands))
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(vectors)
    return sorted([float(v) for v in c] for c in model.clusterCenters())


def assign(pixels: DataFrame, centres: list[list[float]], out: str = "cluster", bands: list[str] = BANDS) -> DataFrame:
    """Nearest centre per pixel as one expression, evaluated once; ties go to the lower label, nodata gets NULL."""
    def squared(centre):
        total = F.lit(0.0)
        for b, v in zip(bands, centre):
            total = total + (F.col(b) - v) * (F.col(b) - v)
        return total
    nearest = F.array_min(F.array(*[F.struct(squared(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    known = F.lit(True)
    for b in bands:
        known = known & F.col(b).isNotNull()
    return once(pixels, out, F.when(known, nearest["i"]))


def modal_cluster(labelled: DataFrame, key: str, cluster: str = "cluster") -> DataFrame:
    """Most frequent cluster per key; ties go to the lower label."""
    counts = labelled.where(F.col(cluster).isNotNull()).groupBy(key, cluster).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", (-F.col(cluster)).alias("neg"))).alias("m")).select(
        key, (-F.col("m.neg")).alias("modal_cluster"), F.col("m.n").alias("n_modal"))


def cluster_mix(labelled: DataFrame, key: str, k: int, cluster: str = "cluster") -> DataFrame:
    """Share of each cluster per key, one column per label."""
    return labelled.where(F.col(cluster).isNotNull()).groupBy(key).agg(
        *[F.avg((F.col(cluster) == i).cast("int")).alias(f"share_{i}") for i in range(k)])
