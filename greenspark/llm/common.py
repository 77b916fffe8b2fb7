"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text column (null: none), split at ASCII white space."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.array_remove(parts, "")


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is.

    ``df`` must be cheap to count (a checkpoint or a written table).  Beyond the limit the join is
    a shuffle join with the same rows.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def words_bytes(text: str | None) -> list[bytes]:
    """The same words as ``words_of`` as UTF-8 bytes (``bytes.split`` cuts at ASCII white space)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def pandas_rows(batches: Iterator, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c] for c in columns), strict=True)
