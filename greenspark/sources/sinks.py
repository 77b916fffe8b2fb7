"""Writers: sorted and partitioned Parquet, JSON payloads, run manifest, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from greenspark.functions import scalars
from greenspark.functions.colour import RAMP_NDVI, ramp_rgba


def write_sorted(df: DataFrame, path: str, keys: list[str], rows_per_group: int = 50000, files: int | None = None,
                 rows_per_file: int = 0) -> None:
    """Range-partitioned, sorted Parquet with zstd, so range reads on the leading keys skip files and row groups.

    A row group ends after ``rows_per_group`` rows; ``rows_per_file`` (0: no limit) also begins a new file.
    """
    spread = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    (spread.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd")
     .option("parquet.block.row.count.limit", rows_per_group).option("maxRecordsPerFile", rows_per_file).parquet(path))


def write_plain(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_city(df: DataFrame, path: str, keys: tuple[str, ...] = ("city",)) -> None:
    """Overwrite only the partitions present in ``df``: a weekly run of one city leaves the others."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(*keys).parquet(path))


def _finite(column: Column, kind) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~(F.isnan(column) | (F.abs(column) == float("inf"))), column)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda v: _finite(v, kind.elementType))
    if isinstance(kind, StructType):
        inner = F.struct(*[_finite(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), inner)
    return column


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL at any depth, as JSON cannot hold them."""
    return df.select(*[_finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def metrics_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; missing values are written as null."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("value"))


MAP_FIELDS = ["code", "name", "borough", "lon", "lat", "population", "ndvi_late", "ndvi_early", "delta_ndvi",
              "predicted_ndvi", "residual", "residual_z", "lisa_cluster", "surprise_score"]


def map_payload(rows: DataFrame, styled: bool = True) -> DataFrame:
    """The fields a map needs per area, with fill colour, marker radius and marker colour when styled."""
    base = rows.select(*MAP_FIELDS)
    if not styled:
        return base
    return base.select("*", ramp_rgba(F.col("ndvi_late"), RAMP_NDVI).alias("fill"),
                       scalars.marker_radius(F.col("residual_z")).alias("radius"),
                       scalars.marker_colour(F.col("residual")).alias("marker"))


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def table_hash(df: DataFrame, name: str) -> DataFrame:
    """Order-insensitive content hash and row count of a table, in one aggregation."""
    columns = sorted(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("content_hash")).select(
        F.lit(name).alias("dataset"), "n_rows", F.coalesce("content_hash", F.lit("0")).alias("content_hash"))


def run_manifest(spark: SparkSession, tables: dict[str, DataFrame], release: str, model_version: str) -> DataFrame:
    """One row per dataset of a run."""
    rows = None
    for name, df in tables.items():
        part = table_hash(df, name)
        rows = part if rows is None else rows.unionByName(part)
    return rows.select(F.lit(release).alias("release"), "*", F.lit(model_version).alias("model_version"))


def publish(df: DataFrame, name: str, layer: str, root: str | None = None) -> None:
    """Bronze is a view, silver a Parquet table, gold a Parquet table per city."""
    if layer == "bronze":
        df.createOrReplaceTempView(name)
    elif layer == "silver":
        write_plain(df, f"{root}/silver/{name}")
    elif layer == "gold":
        write_by_city(df, f"{root}/gold/{name}")
    else:
        raise ValueError(f"unknown layer: {layer}")
