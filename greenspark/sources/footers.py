"""What Parquet footers say: rows and key ranges of every row group, read where the files are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def opened(path: str):
    """A file of any store that Arrow knows, for reading by ranges."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(name)


def row_groups(table: DataFrame, key: str) -> DataFrame:
    """(file, row_group, n_rows, n_bytes, low, high) of a table read from Parquet; low and high of ``key`` as text, NULL without statistics.

    One task reads the footers of its share of the files; pages are not read.  ``key`` is a column, or a field as ``a.b``.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file in batch["file"]:
                with opened(file) as source:
                    meta = pq.read_metadata(source)
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    column = next(c for k in range(group.num_columns) if (c := group.column(k)).path_in_schema == key)
                    held = column.statistics
                    known = held is not None and held.has_min_max
                    out.append((file, g, group.num_rows, group.total_byte_size, str(held.min) if known else None, str(held.max) if known else None))
            yield pd.DataFrame(out, columns=["file", "row_group", "n_rows", "n_bytes", "low", "high"])

    files = table.select(F.col("_metadata.file_path").alias("file")).distinct()
    return files.mapInPandas(read, "file string, row_group int, n_rows bigint, n_bytes bigint, low string, high string")


def group_audit(table: DataFrame, key: str, kind: str, max_rows: int) -> DataFrame:
    """Per file: rows, groups, groups of more than ``max_rows`` rows, and groups whose keys begin below the end of the group before.

    ``kind`` is the type of the key, as the bounds are text.  A window holds the groups of one file.
    """
    groups = row_groups(table, key).withColumn("_low", F.col("low").cast(kind)).withColumn("_high", F.col("high").cast(kind))
    before = F.lag("_high").over(Window.partitionBy("file").orderBy("row_group"))
    return groups.withColumn("_bad", F.coalesce(before > F.col("_low"), F.lit(False))).groupBy("file").agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n_rows") > max_rows).alias("n_large"),
        F.count_if(F.col("_bad")).alias("out_of_order"))
