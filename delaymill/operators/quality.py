"""Quality rules as aggregates: every check is a count of violations, reduced before it is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of per-row conditions in one pass; a condition is true where it is violated.

    Rows that violate nothing are left out before the rules are counted one by one.
    """
    bad_rows = df.filter(reduce(lambda a, b: a | b, rules.values()))
    counted = bad_rows.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    return counted.unpivot([], [F.col(f"`{name}`") for name in rules], "rule", "violations")


def _count(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def duplicate_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _count(name, counted.filter(F.col("_n") > 1))


def broken_dependency(df: DataFrame, key: str, attributes: list[str], name: str) -> DataFrame:
    """Keys whose attributes are not all the same in every row; a missing value counts as a value.

    Equal rows are merged first, so that only distinct ones are compared; a dimension of the same columns shares that step.
    """
    parts = []
    for a in attributes:
        c = F.col(a)
        missing = F.count_if(c.isNull())
        parts.append((F.min(c) != F.max(c)) | ((missing > 0) & (missing < F.count(F.lit(1)))))
    mixed = reduce(lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)), parts, F.lit(False))
    return _count(name, df.select(key, *attributes).distinct().groupBy(key).agg(mixed.alias("_mixed")).filter("_mixed"))


def orphans(fact: DataFrame, dimension: DataFrame, key: str, name: str) -> DataFrame:
    """Fact keys missing in the dimension; keys are made distinct before the join."""
    keys = fact.select(key).distinct()
    return _count(name, keys.join(dimension.select(key), key, "left_anti"))


def single_value(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Columns that do not hold exactly one distinct known value."""
    low_high = df.agg(*[(F.min(c).isNull() | (F.min(c) != F.max(c))).alias(c) for c in columns])
    bad = reduce(lambda x, y: x + y, [F.col(c).cast("long") for c in columns])
    return low_high.select(F.lit(name).alias("rule"), bad.alias("violations"))


def union_reports(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.select("rule", F.col("violations").cast("long")) for r in reports])


def assert_clean(report: DataFrame) -> None:
    """Fails with the violated rules; a report has one row per rule."""
    broken = report.filter("violations > 0").orderBy("rule").collect()
    if broken:
        raise ValueError("; ".join(f"{row.rule}: {row.violations}" for row in broken))


def contract_violations(df: DataFrame, columns: list[dict], table: str) -> DataFrame:
    """Columns, order, nulls and ranges of a table contract.

    Each column is a dict with ``name`` and optionally ``nullable`` and ``range``.
    """
    expected = [c["name"] for c in columns]
    if df.columns != expected:
        raise ValueError(f"{table} columns do not match its contract: {df.columns}")
    rules = {}
    for c in columns:
        column = F.col(f"`{c['name']}`")
        if not c.get("nullable", True):
            rules[f"{table}.{c['name']} is null"] = column.isNull()
        if c.get("range"):
            low, high = c["range"]
            rules[f"{table}.{c['name']} out of range"] = ~column.between(low, high)
    return row_rules(df, rules or {f"{table} has no rules": F.lit(False)})
