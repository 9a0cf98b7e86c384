"""Ranks and running totals on skewed groups with equal rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaymill.operators.ranking import rank_rows, running_totals, surrogate_keys
from tests.compare import TESTDATA, compare, duck


def skewed(spark):
    # one group holds most rows, and many of its rows are equal
    return spark.range(3000).select(
        F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.when(F.col("id") < 1000, 5).otherwise(F.col("id") % 11).alias("v"),
        F.lit(1).alias("one"),
    )


def test_ranks_are_dense_and_ordered(spark):
    df = skewed(spark).repartition(6)
    ranked = rank_rows(df, ["g"], [F.col("v").desc()], "r").collect()
    groups = {}
    for row in ranked:
        groups.setdefault(row.g, []).append((row.r, row.v))
    assert sum(len(v) for v in groups.values()) == 3000
    for rows in groups.values():
        rows.sort()
        assert [r for r, _ in rows] == list(range(1, len(rows) + 1))
        values = [v for _, v in rows]
        assert values == sorted(values, reverse=True)


def test_running_totals(spark):
    df = skewed(spark).groupBy("g", "v").agg(F.sum("one").alias("n"))
    rows = running_totals(df, ["g"], [F.col("v").asc()], {"n": "so_far"}).collect()
    for g in {r.g for r in rows}:
        total = 0
        for row in sorted((r for r in rows if r.g == g), key=lambda r: r.v):
            total += row.n
            assert row.so_far == total


def test_surrogate_keys_put_missing_values_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "name string")
    keyed = surrogate_keys(df, [F.asc_nulls_last("name")], "k")
    assert {r.name: r.k for r in keyed.collect()} == {"a": 1, "b": 2, None: 3}


@pytest.mark.parametrize("name", ["candidates", "roc_auc_ap", "dim_train_service", "station_hour"])
def test_queries_on_ranks_agree_with_sql(spark, name):
    folder = TESTDATA / "sf0.001"
    ok, note = compare(spark, duck(folder), folder, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_hot_group_spreads_over_slices(spark):
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rank_rows(df, ["g"], [F.col("v").asc()], "r")
        assert ranked.select(F.count_distinct("r")).first()[0] == 20000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
