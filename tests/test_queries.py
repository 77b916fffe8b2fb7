"""Every query with SQL against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    verdict = compare(spark, SF, entry.queries()[name], SQL[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["kmeans_fit", "cells_mart", "manifest_hash"])
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_manifest_hash_repeats_and_sees_changes(spark):
    from greenspark.sources.sinks import table_hash

    df = spark.range(100).selectExpr("id", "id * 2 as v")
    same, other = df.repartition(7), df.withColumn("v", df.v + 1)
    first = table_hash(df, "t").first()
    assert first == table_hash(same, "t").first() and first != table_hash(other, "t").first()
