"""Readers and exploratory cleaning on small literal files."""

import json

import pytest
from pyspark.sql import functions as F

from delaymill.operators import explore
from delaymill.sources import exercise


def test_csv_cleaning(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(
        "height(cm),weight(kg),age_sex,section\n170,60,34_m,a\nxx,-60,41_f,a\n180,80,29_m,b\n,70,55_f,b\n160,50,x,c\n"
    )
    rows = exercise.read_csv(spark, str(path)).drop("section")
    rows = explore.numbers_or_null(rows, "height(cm)")
    rows = explore.split_column(rows, "age_sex", "_", ["age", "sex"])
    rows = explore.replace_value(explore.numbers_or_null(rows, "age"), "weight(kg)", -60, 60)
    filled = explore.fill_with_mean(rows, "height(cm)").collect()
    assert [r["height(cm)"] for r in filled] == [170.0, 170.0, 180.0, 170.0, 160.0]
    assert [r["weight(kg)"] for r in filled] == [60, 60, 80, 70, 50]
    assert [(r.age, r.sex) for r in filled][-1] == (None, None)
    nulls = {r.column_name: r.null_count for r in explore.null_profile(rows).collect()}
    assert nulls == {"height(cm)": 2, "weight(kg)": 0, "age": 1, "sex": 1}
    described = {r.column_name: r for r in explore.describe_numbers(rows).collect()}
    assert described["height(cm)"].n == 3 and described["height(cm)"].median == 170.0


def test_csv_matrix(spark, tmp_path):
    path = tmp_path / "matrix.csv"
    path.write_text("Values, Anna, Ben\nAnna, 0, 6\nBen, 4, 0\n")
    rows = {(r.row_name, r.column_name): r.value for r in exercise.read_csv_matrix(spark, str(path)).collect()}
    assert rows == {("Anna", "Anna"): 0, ("Anna", "Ben"): 6, ("Ben", "Anna"): 4, ("Ben", "Ben"): 0}


def test_coverage_xml(spark, tmp_path):
    path = tmp_path / "cover.xml"
    path.write_text(
        "<Roster><CoverRequirements><Cover Day='0' ShiftType='D' Skill='A' Required='2'/>"
        "<Cover Day='1' ShiftType='N' Skill='B' Required='1'></Cover></CoverRequirements></Roster>"
    )
    rows = sorted(tuple(r) for r in exercise.read_coverage_xml(spark, str(path)).collect())
    assert rows == [(0, "D", "A", 2), (1, "N", "B", 1)]


def test_machine_times(spark, tmp_path):
    path = tmp_path / "jobs.txt"
    path.write_text("2  3\n  0  45  1  31  2  54\n  0  44  1  7  2  52\n")
    rows = sorted(tuple(r) for r in exercise.read_machine_times(spark, str(path)).collect())
    assert rows == [(0, 0, 45), (0, 1, 31), (0, 2, 54), (1, 0, 44), (1, 1, 7), (1, 2, 52)]


def test_calendar(spark):
    bounds = spark.sql("SELECT DATE '2025-02-27' AS start, DATE '2025-03-01' AS end")
    rows = [(r.day_index, str(r.calendar_date)) for r in exercise.calendar_days(bounds).collect()]
    assert rows == [(0, "2025-02-27"), (1, "2025-02-28"), (2, "2025-03-01")]


def test_shape(spark):
    df = spark.range(5).withColumn("x", F.lit(1))
    assert tuple(explore.shape(df).first()) == (5, 2)


def test_settings_from_json(tmp_path):
    from delaymill.config import ScopeConfig, SearchConfig

    scope = {
        "scope_version": "v1",
        "extraction_query_version": "q1",
        "selected_month": "2025-03",
        "selected_hub": "Hub",
        "source_file_name": "data-2025-03.parquet",
        "source_url": "feed/data-2025-03.parquet",
        "source_version": "m@main",
        "required_columns": ["id", "time"],
        "complete_journey_rule": "all rows",
        "unknown": 1,
    }
    path = tmp_path / "scope.json"
    path.write_text(json.dumps(scope))
    assert ScopeConfig.from_json(path).required_columns == ("id", "time")
    path.write_text(json.dumps({"scenario_capacities": [2, 4], "random_seed": 3}))
    search = SearchConfig.from_json(path)
    assert search.scenario_capacities == (2, 4) and search.random_seed == 3


def test_scratch_is_cleared(spark):
    from delaymill.session import clear_scratch, spool

    stored = spool(spark.range(3), "few")
    assert stored.count() == 3
    assert clear_scratch(spark)
    assert spool(spark.range(4), "few").count() == 4


def test_month_files_keep_their_names_and_push_filters(spark, tmp_path):
    from pyspark.sql import functions as F

    from delaymill.config import STOP_EVENT_TYPES
    from delaymill.sources.layers import read_stop_events

    one = spark.range(3).select(*[F.lit(None).cast(kind).alias(c) for c, kind in STOP_EVENT_TYPES.items()], F.lit(1).alias("more"))
    folder, single = f"{tmp_path}/data-2025-02.parquet", f"{tmp_path}/data-2025-04.parquet"
    one.write.parquet(folder)
    one.coalesce(1).write.parquet(f"{tmp_path}/other")
    part = next((tmp_path / "other").glob("part-*.parquet"))
    (tmp_path / "data-2025-04.parquet").write_bytes(part.read_bytes())
    rows = read_stop_events(spark, folder, single)
    assert {r.source_file: r["count"] for r in rows.groupBy("source_file").count().collect()} == {
        "data-2025-02.parquet": 3,
        "data-2025-04.parquet": 3,
    }
    hub = rows.filter((F.col("station_name") == "x") & (F.col("time") >= F.lit("2025-02-01").cast("timestamp_ntz")))
    plan = hub.select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].splitlines()[0]
    assert "EqualTo(station_name,x)" in pushed and "GreaterThanOrEqual(time" in pushed and "more" not in plan
    one.drop("id").write.parquet(f"{tmp_path}/data-2025-05.parquet")
    with pytest.raises(ValueError, match="missing source columns"):
        read_stop_events(spark, folder, f"{tmp_path}/data-2025-05.parquet")


def test_rows_without_split_are_counted(spark):
    from delaymill.operators import split

    rows = spark.createDataFrame(
        [("j", "train", "2024-01-01", True), ("k", None, None, False), ("l", None, None, True)],
        f"journey_id string, prediction_split string, journey_anchor_date string, {split.TARGET} boolean",
    )
    assert {r.rule: r.violations for r in split.split_violations(rows).collect()}["split_is_known"] == 2
