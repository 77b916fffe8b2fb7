"""Sharding by a Feistel permutation of global row numbers.

The rows are numbered 0 .. N-1 in order of doc_id; a keyed permutation of these numbers gives each row its place in
the shuffled corpus, and place modulo shard count its shard.  Anyone who knows the keys, N and a row number can
compute shard and slot without the data.

Defined results: a null text has no bytes and checksum 0; null ids come first; repeated ids are numbered one after
the other, equal rows in any order; an empty table has no rows; other columns of the input are not read.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenspark.operators.lineage import cut
from greenspark.operators.ordering import row_numbers

PRIME = (1 << 31) - 1
ROUND_KEYS = (1103515245, 1566083941, 1812433253, 1181783497, 1013904223, 1597334677)


def _mix(half: Column, key: Column) -> Column:
    first = ((half % PRIME) * key + F.shiftright(key, 7)) % PRIME
    return (first.bitwiseXOR(F.shiftright(first, 13)) * 48271 + key) % PRIME


def feistel(value: Column, left: int, right: int, keys: tuple[int, ...] = ROUND_KEYS) -> Column:
    """A permutation of 0 .. left * right - 1: rounds that change the two mixed-radix digits in turn."""
    first, second = F.lit(left).cast("bigint"), F.lit(right).cast("bigint")
    digits = F.struct(((value - value % second) / second).cast("bigint").alias("a"), (value % second).alias("b"))
    rounds = F.array(*[F.struct(F.lit(k).cast("bigint").alias("key"), F.lit(n % 2 == 0).alias("on_a"))
                       for n, k in enumerate(keys)])
    mixed = F.aggregate(rounds, digits, lambda d, r: F.struct(
        F.when(r["on_a"], (d["a"] + _mix(d["b"], r["key"])) % first).otherwise(d["a"]).alias("a"),
        F.when(r["on_a"], d["b"]).otherwise((d["b"] + _mix(d["a"], r["key"])) % second).alias("b")))
    return F.transform(F.array(mixed), lambda d: d["a"] * second + d["b"])[0]


def permuted(number: Column, n: int) -> Column:
    """The place of row ``number`` (0 .. n-1) in the shuffle, by cycle walking.

    The domain is left * right with left = ceil(sqrt(n)), so fewer than left of its values lie outside
    0 .. n-1.  A walk meets no outside value twice, hence at most that many steps bring every row home.
    """
    left = isqrt(max(n - 1, 0)) + 1
    right = max(-(-n // left), 1)
    outside = left * right - n
    start = feistel(number, left, right)
    if outside == 0:
        return start

    def walk(place: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(outside))
        return F.when(place < n, place).otherwise(F.aggregate(
            steps, place, lambda at, _: F.when(at < n, at).otherwise(feistel(at, left, right))))

    return F.transform(F.array(start), walk)[0]


def shuffle_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; shard sizes are at most one apart.

    Only ids, sizes and checksums are shuffled.  The order key ends with the row's place in the input so that rows of
    one id can be spread over range partitions.
    """
    rows = cut(docs.select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.monotonically_increasing_id().alias("_at")))
    n = rows.count()
    numbered = row_numbers(rows, ["doc_id", "size", "text_crc32", "_at"], "_row")
    placed = numbered.withColumn("_place", permuted(F.col("_row") - 1, n))
    return placed.select("doc_id", "size", "text_crc32", (F.col("_place") % shards).cast("int").alias("shard"),
                         F.expr(f"_place div {shards}").alias("slot"))


def sharding_digest(docs: DataFrame) -> DataFrame:
    placed = shuffle_shards(docs, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
