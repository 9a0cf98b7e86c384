"""What the export checks do with every row: shared steps, merged rows, no exceptions."""

import re

import pytest
from pyspark.sql import functions as F

from delaymill.functions.labels import status_code
from delaymill.operators import export as ex
from delaymill.operators import quality
from registry import reporting, selection
from tests.compare import TESTDATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lowest_aggregate(df) -> str:
    return re.findall(r"(\w+Aggregate)\(", plan(df))[-1]


def test_export_rules_store_the_final_rows_once(spark, monkeypatch):
    stored = []

    def counted(real):
        def spool(df, name):
            stored.append(name)
            return real(df, name)

        return spool

    for module in (selection, reporting):
        monkeypatch.setattr(module, "spool", counted(module.spool))
    reporting.export_quality(spark, str(TESTDATA / "sf0.001"))
    assert sorted(stored) == ["events", "outcomes", "scored", "station_names"]


def test_one_mode_of_candidates_is_that_part_of_all(spark):
    folder = str(TESTDATA / "sf0.001")
    final = selection.prepared(spark, folder, ("final",))
    both = selection.prepared(spark, folder).filter("execution_mode = 'final'")
    assert final.columns == both.columns and final.count() == both.count() > 0
    assert final.exceptAll(both).isEmpty()


def test_status_names_are_looked_up_before_a_cast(spark):
    rows = spark.createDataFrame([("OPTIMAL",), ("deterministic",), ("time_limit_with_incumbent",), ("7",)], "status string")
    coded = rows.select("status", status_code(F.col("status")).alias("code"))
    assert dict(coded.collect()) == {"OPTIMAL": 2, "deterministic": 1, "time_limit_with_incumbent": 9, "7": 7}
    shown = plan(coded)
    assert shown.index("CASE") < shown.index("try_cast")
    for bad in ("gave up", None):
        with pytest.raises(Exception, match="unsupported solver status"):
            spark.createDataFrame([(bad,)], "status string").select(status_code(F.col("status"))).collect()


def test_station_names_merge_rows_before_they_compare(spark):
    feed = spark.createDataFrame(
        [("1", "b"), ("1", "a"), ("1", " "), ("2", " "), ("3", None), (None, "x"), ("4", "d"), ("4", "d")], "eva string, station_name string"
    )
    names = ex.station_names(feed)
    assert {tuple(r) for r in names.collect()} == {("1", "a"), ("4", "d")}
    assert lowest_aggregate(names) == "HashAggregate"


def test_dependencies_merge_rows_before_they_compare(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("b", "x", 1), ("b", "y", 1), ("c", None, 1), ("c", "x", 1), ("d", None, None), ("d", None, None), (None, "x", 1), (None, "y", 1)]
    df = spark.createDataFrame(rows, "k string, t string, v int")
    found = quality.broken_dependency(df, "k", ["t", "v"], "k fixes t")
    assert [tuple(r) for r in found.collect()] == [("k fixes t", 3)]
    assert lowest_aggregate(found) == "HashAggregate"


def test_rules_are_counted_on_violating_rows_only(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, None), (5, "c"), (None, "d")], "v int, t string")
    counted = quality.row_rules(df, {"v is null": F.col("v").isNull(), "v is large": F.col("v") > 4, "t is null": F.col("t").isNull()})
    assert {tuple(r) for r in counted.collect()} == {("v is null", 3), ("v is large", 1), ("t is null", 1)}
    assert "Filter" in plan(counted)
    clean = quality.row_rules(df.filter("v = 1"), {"v is null": F.col("v").isNull()})
    assert [tuple(r) for r in clean.collect()] == [("v is null", 0)]
