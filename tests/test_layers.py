"""Semantics of the layer expressions that engines disagree on, and the scope rules."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from delaymill.functions import calendar, delays, labels
from delaymill.operators import features, quality, scope, split
from delaymill.operators import star_schema as star
from delaymill.sources import months


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_minutes_count_boundaries(spark):
    row = one(
        spark,
        a=calendar.minute_boundaries(ts("2025-01-01 10:00:50"), ts("2025-01-01 10:01:10")),
        b=calendar.minute_boundaries(ts("2025-01-01 00:01:00"), ts("2024-12-31 23:59:59")),
    )
    assert (row.a, row.b) == (1, -2)


def test_dates(spark):
    day = F.lit(date(2024, 12, 30))
    row = one(spark, key=calendar.date_key(day), **calendar.date_attributes(day))
    assert (row.key, row.week_of_year, row.day_of_week, row.day_name, row.is_weekend) == (20241230, 1, 1, "Monday", False)


@pytest.mark.parametrize(
    "delay,bucket",
    [
        (None, "unknown"),
        (0.0, "early_or_on_time"),
        (1.0, "minor"),
        (5.0, "minor"),
        (5.5, "extreme"),
        (14.0, "medium"),
        (15.0, "severe"),
        (30.0, "extreme"),
    ],
)
def test_buckets(spark, delay, bucket):
    assert one(spark, b=delays.delay_bucket(F.lit(delay).cast("double"))).b == bucket


def test_labels(spark):
    row = one(
        spark,
        top=labels.probability_bin(F.lit(1.0)),
        low=labels.probability_bin(F.lit(0.07)),
        band=labels.risk_band(F.lit(0.1)),
        sort=labels.risk_band_sort(F.lit(1.0)),
        none=labels.risk_band_sort(F.lit(None).cast("double")),
        hour=calendar.hour_label(F.lit(8)),
        code=labels.status_code(F.lit("optimal")),
        number=labels.status_code(F.lit("2")),
    )
    assert row.top == pytest.approx(0.95) and row.low == pytest.approx(0.05)
    assert (row.band, row.sort, row.none, row.hour, row.code, row.number) == ("10-20%", 10, 99, "08:00-08:59", 2, 2)
    with pytest.raises(Exception, match="unsupported solver status"):
        one(spark, code=labels.status_code(F.lit("INFEASIBLE")))


def test_month_files(spark):
    names = [f"data-2025-{m:02d}.parquet" for m in (1, 2, 3, 4, 6)] + ["data-2024-12.parquet", "notes.txt"]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    found = [r.file_name for r in months.candidate_months(files, "data-2025-03.parquet").collect()]
    assert found == [f"data-{m}.parquet" for m in ("2025-02", "2025-04", "2025-01", "2024-12")]
    row = months.month_labels(files).filter("file_name = 'data-2025-02.parquet'").first()
    assert (row.month_start, row.month_end) == (date(2025, 2, 1), date(2025, 2, 28))
    assert row.source_version == "monthly_processed_data/data-2025-02.parquet@main"


def stops(spark, rows):
    kind = "station_name string, train_line_ride_id string, time timestamp_ntz, delay_in_min int, is_canceled boolean"
    return spark.createDataFrame(rows, kind)


def test_scoped_journeys_keep_all_their_rows(spark):
    rows = [
        ("Hub", "R1", datetime(2025, 5, 13), 0, False),
        ("Other", "R1", datetime(2025, 5, 30), 0, False),
        ("Hub", "R2", datetime(2025, 5, 30), 0, False),
        ("Other", "R3", datetime(2025, 5, 13), 0, False),
    ]
    events = stops(spark, rows)
    assert scope.scope_journeys(events, "Hub").count() == 3
    weekly = scope.scope_journeys(events, "Hub", date(2025, 5, 12), date(2025, 5, 19)).collect()
    assert sorted(r.time.day for r in weekly) == [13, 30]


def test_week_pick_breaks_ties(spark):
    rows = [("Hub", "R", datetime(2025, 5, d), late, gone) for d, late, gone in [
        (6, 20, False), (7, 0, False), (13, None, True), (14, 15, None), (20, 30, False), (21, 16, False), (30, 99, False),
    ]]
    events = stops(spark, rows).withColumn("source_file", F.lit("data-2025-05.parquet"))
    weeks = scope.disrupted_weeks(events, "Hub")
    assert weeks.count() == 3  # the week of 30 May ends in June
    assert scope.pick_week(weeks).first().week_start_date == date(2025, 5, 12)


def test_missing_line_sorts_last_and_joins_as_empty(spark):
    kind = "train_type string, train_number string, line_number string"
    bronze = spark.createDataFrame([("ICE", "1", None), ("ICE", "1", "5"), ("S", "2", "")], kind)
    keys = {(r.train_type, r.line_number): r.train_service_key for r in star.dim_train_service(bronze).collect()}
    assert keys == {("ICE", "5"): 1, ("ICE", None): 2, ("S", ""): 3}


def test_mismatch_finds_changed_and_missing_hours(spark):
    from delaymill.sources.sample_feed import load_events
    from registry.layers import gold_frame

    gold = gold_frame(spark, "/root/testdata/sf0.001")
    hours = features.station_hour(gold)
    assert features.station_hour_mismatches(gold, hours).count() == 0
    first = hours.orderBy("station_key", "date_key", "hour_key").limit(1)
    changed = hours.withColumn("stop_event_count", F.col("stop_event_count") + (F.col("station_key") == 1).cast("int"))
    assert features.station_hour_mismatches(gold, changed).count() == hours.filter("station_key = 1").count()
    assert features.station_hour_mismatches(gold, hours.join(first, features.STATION_HOUR_KEYS, "left_anti")).count() == 1
    assert load_events(spark, "/root/testdata/sf0.001").count() == gold.count()


def journeys(spark, days):
    rows = [(f"J{i}", date(2025, 3, d)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "journey_id string, service_date date")


def test_split_of_five_dates(spark):
    rows = split.anchor_split(journeys(spark, [1, 2, 3, 4, 5, 1])).collect()
    assert {r.service_date.day: r.prediction_split for r in rows} == {
        1: "train", 2: "train", 3: "train", 4: "validation", 5: "test",
    }


@pytest.mark.parametrize("n,parts", [(3, (1, 1, 1)), (4, (2, 1, 1)), (10, (6, 2, 2)), (7, (4, 1, 2))])
def test_split_sizes(spark, n, parts):
    counts = split.split_counts(split.anchor_split(journeys(spark, range(1, n + 1)))).collect()
    found = {r.prediction_split: r.row_count for r in counts}
    assert (found["train"], found["validation"], found["test"]) == parts


def test_two_dates_cannot_be_split(spark):
    with pytest.raises(Exception, match="at least three"):
        split.anchor_split(journeys(spark, [1, 2])).collect()


def test_features_do_not_leak():
    assert not set(split.ALLOWED_FEATURES) & set(split.EXCLUDED_FEATURES)


def test_quality_rules_count_violations(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, None, 3.0), (2, "c", 3.0)], "k int, t string, v double")
    report = quality.union_reports(
        quality.row_rules(df, {"v missing": F.col("v").isNull()}),
        quality.duplicate_keys(df, ["k"], "k unique"),
        quality.broken_dependency(df, "k", ["t"], "k fixes t"),
        quality.broken_dependency(df, "k", ["v"], "k fixes v"),
        quality.single_value(df, ["k", "v"], "single"),
        quality.orphans(df, df.filter("k = 1"), "k", "orphans"),
    )
    assert {r.rule: r.violations for r in report.collect()} == {
        "v missing": 1, "k unique": 2, "k fixes t": 2, "k fixes v": 1, "single": 2, "orphans": 1,
    }
    with pytest.raises(ValueError, match="k unique: 2"):
        quality.assert_clean(report)
