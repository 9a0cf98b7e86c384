"""Ranks and running totals over groups of any size.

A plain window sends each group to one task. Here rows are range-partitioned by group and order, so that a
group spreads over as many tasks as its size needs; the sorted slices are written once, so that a lost
executor cannot change their borders, and only one small row per slice and group is needed to link them.
Inputs of every size take this path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymill.session import spool

SLICE_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _sliced(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Sorted slices with positions.

    Rows of equal order are told apart by a hash of all columns, so that a task that runs again sends them
    where it sent them before; rows equal in every column by their place, so that even they spread over slices.
    """
    tied = df.withColumns({"_hash": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), "_tie": F.monotonically_increasing_id()})
    keys = [F.col(g).asc_nulls_first() for g in group] + order + [F.col("_hash").asc(), F.col("_tie").asc()]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.drop("_hash", "_tie").withColumn("_position", F.monotonically_increasing_id())
    return spool(placed.withColumn("_slice", F.shiftright("_position", SLICE_BITS)), "slices")


def _carried(slices: DataFrame, group: list[str], totals: dict[str, Column]) -> DataFrame:
    """Per group and slice: the totals of all earlier slices of the group."""
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = slices.groupBy(*group, "_slice").agg(
        F.min("_position").alias("_first"), *[c.alias(f"_sum_{n}") for n, c in totals.items()]
    )
    carried = {f"_before_{n}": F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)) for n in totals}
    return per_slice.select(*group, "_slice", "_first", *[c.alias(n) for n, c in carried.items()])


def _with_carry(slices: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    keys = [*group, "_slice"]
    carry = carried.select(*[F.col(k).alias(f"_c{k}") for k in keys], "_first", *[
        c for c in carried.columns if c.startswith("_before_")
    ])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys])
    return slices.join(carry, same, "inner").drop(*[f"_c{k}" for k in keys])


def rank_rows(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Row numbers 1..n inside each group in the given order."""
    slices = _sliced(df, group, order)
    linked = _with_carry(slices, _carried(slices, group, {"rows": F.count(F.lit(1))}), group)
    number = F.col("_before_rows") + F.col("_position") - F.col("_first") + 1
    return linked.select(*df.columns, number.cast("long").alias(name))


def running_totals(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums (own row included) of the columns that ``sums`` maps to new names."""
    slices = _sliced(df, group, order)
    linked = _with_carry(slices, _carried(slices, group, {n: F.sum(c) for c, n in sums.items()}), group)
    window = Window.partitionBy(*group, "_slice").orderBy("_position")
    window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = [(F.col(f"_before_{n}") + F.sum(c).over(window)).alias(n) for c, n in sums.items()]
    return linked.select(*df.columns, *totals)


def surrogate_keys(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense keys 1..n of a dimension whose rows are distinct, stored for the joins that read it."""
    keyed = rank_rows(df, [], order, name)
    return spool(keyed.select(F.col(name).cast("int").alias(name), *df.columns), "keyed")
