"""Ranks and exact quantiles that never put a whole group into one task.

A window ``partitionBy(group)`` gives one task all rows of a popular group, and an exact
percentile keeps all its distinct values.  Here rows are first reduced to distinct
(group, value) pairs, range-partitioned over the whole table, and numbered inside each range;
the offsets of the ranges form a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenspark.operators.lineage import cut


def running_totals(df: DataFrame, order: list[str], amount: str, out: str = "before") -> DataFrame:
    """Add the sum of ``amount`` over all rows that come earlier in ``order``.

    The range partition of a row is pinned by a checkpoint, because a recomputed range shuffle may
    cut at other keys.  The table of partition totals has one row per range partition, which
    bounds both its window and its broadcast.
    """
    ranged = cut(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                 .withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_total"))
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_total").over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
            .join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_inside") + F.col("_offset"))
            .drop("_part", "_inside", "_offset"))


def row_numbers(df: DataFrame, order: list[str], out: str = "row_no") -> DataFrame:
    """Global 1-based row numbers; ``order`` must be a unique key."""
    return (running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", out)
            .withColumn(out, (F.col(out) + 1).cast("bigint")).drop("_one"))


def rank_table(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One row per distinct (group, value): ``n`` equal rows, ``below`` smaller ones, ``total``.

    rank = below + 1, average rank = below + (n + 1) / 2, percent_rank = below / (total - 1).
    NULL values carry no rank.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*groups, value)
              .agg(F.count(F.lit(1)).alias("n")))
    running = running_totals(counts, [*groups, value], "n", "_before")
    if groups:
        sizes = running.groupBy(*groups).agg(F.min("_before").alias("_first"), F.sum("n").alias("total"))
        same = [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
        joined = running.alias("r").join(sizes.alias("s"), same)
        keys = [F.col(f"r.{g}").alias(g) for g in groups]
        return joined.select(*keys, f"r.{value}", "n", (F.col("_before") - F.col("_first")).alias("below"), "total")
    total = running.agg(F.sum("n")).scalar()
    return running.select(value, "n", F.col("_before").alias("below"), total.alias("total"))


def quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``."""
    table = rank_table(df, groups, value)

    def at(position: Column) -> Column:
        here = (F.col("below") <= position) & (position < F.col("below") + F.col("n"))
        return F.max(F.when(here, F.col(value)))

    parts = []
    for name, p in probs.items():
        low = F.floor((F.col("total") - 1) * F.lit(p))
        high = F.ceil((F.col("total") - 1) * F.lit(p))
        parts += [at(low).alias(f"_{name}_low"), at(high).alias(f"_{name}_high")]
    agg = table.groupBy(*groups).agg(F.first("total").alias("_total"), *parts)

    def blend(name, p):
        position = (F.col("_total") - 1) * F.lit(p)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return agg.select(*groups, *[blend(name, p) for name, p in probs.items()])


def with_rank(df: DataFrame, groups: list[str], value: str, *, descending: bool = False,
              rank: str | None = None, percent_rank: str | None = None, average_rank: str | None = None) -> DataFrame:
    """Attach rank columns within groups by joining each row to its rank-table entry.

    The rows are pinned first: a mean that is computed again may differ in its last bit, and would
    then miss its own entry.
    """
    df = cut(df)
    table = rank_table(df, groups, value)
    lower = F.col("total") - F.col("below") - F.col("n") if descending else F.col("below")
    cols = []
    if rank:
        cols.append((lower + 1).cast("bigint").alias(rank))
    if percent_rank:
        cols.append(F.coalesce(F.try_divide(lower.cast("double"), (F.col("total") - 1).cast("double")),
                               F.lit(0.0)).alias(percent_rank))
    if average_rank:
        cols.append((lower + (F.col("n") + 1) / 2).cast("double").alias(average_rank))
    lookup = table.select(*[F.col(g).alias(f"_k_{g}") for g in groups], F.col(value).alias("_k_value"), *cols)
    on = [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in groups] + [F.col(value) == F.col("_k_value")]
    return df.hint("merge").join(lookup, on, "left").drop(*[f"_k_{g}" for g in groups], "_k_value")


def hash_order(df: DataFrame, key: str, salt: Column, groups: list[str] | None = None, prefix: int = 2,
               out: str = "hash_rank", amount: str | None = None, out_before: str = "before") -> DataFrame:
    """0-based rank of each row by ``md5(salt || key)`` within ``groups``.

    md5 is uniform whatever the keys are, so its leading hex digits cut every group into
    ``16**prefix`` even pieces; the piece offsets come from a table of that many rows per group.
    With ``amount``, also the sum of that column over the rows ranked before.
    """
    groups = groups or []
    hashed = df.withColumn("_md5", F.md5(F.concat(salt, F.col(key)).cast("binary")))
    hashed = hashed.withColumn("_piece", F.substring("_md5", 1, prefix)).withColumn("_one", F.lit(1).cast("bigint"))
    summed = {"_one": out} | ({amount: out_before} if amount else {})
    earlier = (Window.unboundedPreceding, -1)
    sizes = hashed.groupBy(*groups, "_piece").agg(*[F.sum(c).alias(f"_sum_{o}") for c, o in summed.items()])
    by_piece = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(*earlier)
    offsets = sizes.select(*groups, "_piece", *[
        F.coalesce(F.sum(f"_sum_{o}").over(by_piece), F.lit(0)).alias(f"_off_{o}") for o in summed.values()])
    inside = Window.partitionBy(*groups, "_piece").orderBy("_md5", key).rowsBetween(*earlier)
    return (hashed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{o}") for c, o in summed.items()])
            .join(offsets, [*groups, "_piece"])
            .select(*df.columns, *[(F.col(f"_in_{o}") + F.col(f"_off_{o}")).alias(o) for o in summed.values()]))
