"""Exploratory profiling and cleaning of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaymill.operators.order_statistics import quantiles


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "null_count")


def describe_numbers(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of every numeric column."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    quartiles = quantiles(df, numeric, [0.25, 0.5, 0.75])

    def entry(name: str) -> Column:
        c = F.col(f"`{name}`").cast("double")
        values = {
            "n": F.count(c),
            "mean": F.avg(c),
            "deviation": F.stddev_samp(c),
            "lowest": F.min(c),
            "highest": F.max(c),
        }
        for label, value in zip(("lower_quartile", "median", "upper_quartile"), quartiles[name], strict=True):
            values[label] = F.lit(value).cast("double")
        return F.struct(F.lit(name).alias("column_name"), *[v.alias(k) for k, v in values.items()])

    return df.agg(F.array(*[entry(name) for name in numeric]).alias("entries")).select(F.inline("entries"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


def numbers_or_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast("string").try_cast("double") for c in columns})


def split_column(df: DataFrame, column: str, separator: str, into: list[str]) -> DataFrame:
    """Parts of a text column as columns of their own; missing parts are null."""
    parts = F.split(F.col(f"`{column}`"), separator)
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(into)}).drop(column)


def replace_value(df: DataFrame, column: str, old, new) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.withColumn(column, F.when(c == old, F.lit(new)).otherwise(c))


def fill_with_mean(df: DataFrame, *columns: str) -> DataFrame:
    """Missing values replaced by the column mean, which enters the plan as a scalar subquery."""
    means = df.agg(F.struct(*[F.avg(F.col(f"`{c}`")).alias(c) for c in columns]).alias("means")).scalar()
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), means.getField(c)) for c in columns})


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
