"""Readers for the inputs: feature Parquet, GeoJSON, census CSV, scene items, band rasters, WKB."""

from __future__ import annotations

import io
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

from greenspark.functions import geometry as G

_POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
_GEOM = ArrayType(ArrayType(ArrayType(_POINT)))


def spread(df: DataFrame) -> DataFrame:
    """Give costly row work enough tasks when the input is a few small files; large inputs pass unchanged."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def released_features(spark: SparkSession, root: str, release: str, theme: str, kind: str) -> DataFrame:
    """Feature Parquet of one theme and type of a pinned release.

    Only that folder is listed, and its own schema is read: types of a release have different columns.
    """
    base = f"{root}/{release}"
    return spark.read.option("basePath", base).parquet(f"{base}/theme={theme}/type={kind}")


def geojson_features(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Features of GeoJSON collections with the wanted properties and a nested-array geometry.

    Each file is one document.  Coordinates are read as text and parsed by type, because a
    polygon and a multipolygon nest differently.
    """
    schema = ("type string, features array<struct<type: string, properties: map<string,string>, "
              "geometry: struct<type: string, coordinates: string>>>")
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = docs.select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    text = F.col("coordinates")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")

    def parts(nested: Column) -> Column:
        return F.transform(nested, lambda part: F.transform(part, lambda ring: F.transform(
            ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))

    geom = F.when(F.col("type") == "Polygon", parts(F.array(one))).when(F.col("type") == "MultiPolygon", parts(many))
    return rows.select(*[F.col("properties")[c].cast(t).alias(c) for c, t in fields.items()],
                       F.col("type").alias("geometry_type"), geom.alias("geom"))


def census_counts(spark: SparkSession, path: str, prefix: str = "E02", code_out: str = "area_code",
                  count_out: str = "population") -> DataFrame:
    """Area counts from a census CSV whose column names vary between downloads.

    The code column is called 'mnemonic' or contains 'geography code'; the count column contains
    'observation', else it is the last one that is numeric in the kept rows.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    code = _best_header(raw.columns, _CODE_HEADERS)
    if code is None:
        raise ValueError(f"no area code column among {raw.columns}")
    kept = raw.where(F.col(f"`{code}`").startswith(prefix))
    count = _best_header(raw.columns, _COUNT_HEADERS) or _last_numeric(kept)
    if count is None:
        raise ValueError(f"no numeric column among {raw.columns}")
    return kept.select(F.col(f"`{code}`").alias(code_out),
                       F.col(f"`{count}`").try_cast("double").cast("bigint").alias(count_out))


# What headers of census downloads say, and whether the whole header must say it.
_CODE_HEADERS = (("mnemonic", True), ("geography code", False))
_COUNT_HEADERS = (("observation", False),)


def _best_header(headers: list[str], roles: tuple[tuple[str, bool], ...]) -> str | None:
    """The first header that fits a role of the table."""
    def fits(header: str) -> bool:
        plain = header.casefold()
        return any(plain == said if whole else said in plain for said, whole in roles)

    fitting = [h for h in headers if fits(h)]
    return fitting[0] if fitting else None


def _last_numeric(rows: DataFrame) -> str | None:
    """The last column with values, all of them numbers."""
    def verdict(name: str):
        value = F.col(f"`{name}`")
        return ((F.count(value) > 0) & (F.count(value) == F.count(value.try_cast("double")))).alias(name)

    numeric = rows.agg(*[verdict(c) for c in rows.columns]).first()
    usable = [c for c, yes in zip(rows.columns, numeric, strict=True) if yes]
    return usable[-1] if usable else None


SCENE_SCHEMA = ("id string, properties struct<datetime: timestamp, `eo:cloud_cover`: double, `s2:mgrs_tile`: string>, "
                "bbox array<double>, geometry struct<type: string, coordinates: array<array<array<double>>>>, "
                "assets map<string, struct<href: string>>")


def scene_items(spark: SparkSession, path: str, indented: bool = False) -> DataFrame:
    """Scene catalogue items with their footprint as a geometry: one object per line, an item or a collection with ``features``.

    ``indented`` files hold one object over several lines; each is read by one task.
    """
    objects = spark.read.schema(f"features array<struct<{SCENE_SCHEMA}>>, {SCENE_SCHEMA}").option("multiLine", indented).json(path)
    own = F.array(F.struct("id", "properties", "bbox", "geometry", "assets"))
    items = objects.select(F.explode(F.when(F.col("features").isNotNull(), F.col("features")).otherwise(own)).alias("i")).select("i.*")
    b = F.col("bbox")
    ring = F.transform("geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return items.select("id", F.col("properties.datetime").alias("datetime"),
                        F.col("properties.`eo:cloud_cover`").alias("cloud"), F.col("properties.`s2:mgrs_tile`").alias("tile"),
                        G.box(b[0], b[1], b[2], b[3]).alias("box"), "assets",
                        F.when(F.col("geometry.type") == "Polygon", F.array(ring)).alias("footprint"))


def scene_assets(items: DataFrame) -> DataFrame:
    """One row per scene and asset with its address."""
    return items.select("id", "tile", F.explode("assets").alias("band", "asset")).select(
        "id", "tile", "band", F.col("asset.href").alias("href"))


TILE_SCHEMA = ("raster_id string, band string, tile_r bigint, tile_c bigint, h int, w int, tile_size int, "
               "values array<float>, affine struct<a: double, b: double, c: double, d: double, e: double, f: double>")


def npy_tiles(spark: SparkSession, path: str, meta_path: str, tile_size: int = 256, nodata: float = 0.0) -> DataFrame:
    """Tiles of ``<raster>_<band>.npy`` rasters with the affine of a metadata JSON; nodata becomes NULL.

    Rasters are cut where they are read; the result is repartitioned so that later stages see tiles,
    not files.
    """
    meta = json.loads(spark.read.text(meta_path, wholetext=True).first()[0])
    a = dict(zip("abcdef", [float(v) for v in meta["transform"][:6]]))

    def cut_tiles(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = file.rsplit("/", 1)[-1][:-len(".npy")]
                raster_id, _, band = name.rpartition("_")
                grid = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False).astype(np.float32)
                for r in range(0, grid.shape[0], tile_size):
                    for c in range(0, grid.shape[1], tile_size):
                        block = grid[r:r + tile_size, c:c + tile_size]
                        flat = block.ravel()
                        values = pa.array(flat, mask=~np.isfinite(flat) | (flat == nodata))
                        yield pa.RecordBatch.from_pydict({
                            "raster_id": [raster_id], "band": [band], "tile_r": [r // tile_size], "tile_c": [c // tile_size],
                            "h": pa.array([block.shape[0]], pa.int32()), "w": pa.array([block.shape[1]], pa.int32()),
                            "tile_size": pa.array([tile_size], pa.int32()),
                            "values": pa.ListArray.from_arrays([0, len(flat)], values), "affine": [a]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(cut_tiles, TILE_SCHEMA).repartition("raster_id", "band", "tile_r", "tile_c")


@F.arrow_udf(_GEOM)
def _from_wkb(blobs: pa.Array) -> pa.Array:
    def polygon(data, at):
        order = "<" if data[at] == 1 else ">"
        (n_rings,) = struct.unpack_from(order + "I", data, at + 5)
        at, rings = at + 9, []
        for _ in range(n_rings):
            (n,) = struct.unpack_from(order + "I", data, at)
            xy = np.frombuffer(data, order + "f8", 2 * n, at + 4).reshape(-1, 2)
            rings.append([{"x": float(x), "y": float(y)} for x, y in xy])
            at += 4 + 16 * n
        return rings, at

    out = []
    for blob in blobs.to_pylist():
        if blob is None:
            out.append(None)
            continue
        order = "<" if blob[0] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", blob, 1)
        if kind == 3:
            out.append([polygon(blob, 0)[0]])
        elif kind == 6:
            (n,) = struct.unpack_from(order + "I", blob, 5)
            at, parts = 9, []
            for _ in range(n):
                rings, at = polygon(blob, at)
                parts.append(rings)
            out.append(parts)
        else:
            out.append(None)
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    return pa.array(out, pa.list_(pa.list_(pa.list_(point))))


@F.arrow_udf(BinaryType())
def _to_wkb(geoms: pa.Array) -> pa.Array:
    def polygon(part):
        body = struct.pack("<BII", 1, 3, len(part))
        for ring in part:
            body += struct.pack("<I", len(ring)) + np.array([[p["x"], p["y"]] for p in ring], "<f8").tobytes()
        return body

    out = []
    for geom in geoms.to_pylist():
        if geom is None:
            out.append(None)
        elif len(geom) == 1:
            out.append(polygon(geom[0]))
        else:
            out.append(struct.pack("<BII", 1, 6, len(geom)) + b"".join(polygon(p) for p in geom))
    return pa.array(out, pa.binary())


def from_wkb(blob: Column) -> Column:
    """WKB polygon or multipolygon to a geometry column; other kinds become NULL."""
    return _from_wkb(blob)


def to_wkb(geom: Column) -> Column:
    """Little-endian WKB, a polygon for one part and a multipolygon for several."""
    return _to_wkb(geom)
