"""Scoping of raw stop events to the journeys of one hub, with lineage."""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymill.config import STOP_EVENT_COLUMNS, ScopeConfig, ScopeSlice
from delaymill.functions.calendar import month_start_of_file, week_start
from delaymill.functions.delays import SEVERE_MINUTES, share
from delaymill.session import spool
from delaymill.sources.layers import read_stop_events
from delaymill.sources.months import SEARCHED_MONTHS, candidate_months, month_labels

SKETCH_BITS = 14  # 2 ** 14 registers: a relative standard error of about 0.8 %
SKETCH_ERROR = 0.0081


def hub_journeys(events: DataFrame, hub: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Ids of journeys that call at the hub, optionally within [start, end)."""
    calls = events.filter(F.col("station_name") == hub)
    if start is not None:
        calls = calls.filter((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end)))
    return calls.select("train_line_ride_id").distinct()


def scope_journeys(events: DataFrame, hub: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """All rows of the journeys that call at the hub, also those outside the period.

    The journey ids are stored, so that few are broadcast, and many are shuffled against a side whose
    hot journeys adaptive execution can split.
    """
    journeys = spool(hub_journeys(events, hub, start, end), "hub_journeys")
    return events.join(journeys, "train_line_ride_id", "left_semi").select(events.columns)


def stamp_lineage(rows: DataFrame, scope: ScopeConfig, part: ScopeSlice, loaded_at: str) -> DataFrame:
    weekly = part.week_start is not None
    label = part.label(scope.selected_month)
    stamp = F.lit(loaded_at).cast("timestamp_ntz")
    return rows.withColumns({
        "source_file": F.lit(part.source_file),
        "source_version": F.lit(part.source_version),
        "scope_label": F.lit(label),
        "loaded_at_utc": stamp,
        "selected_month": F.lit(scope.selected_month),
        "selected_hub": F.lit(scope.selected_hub),
        "required_columns_json": F.lit(json.dumps(list(scope.required_columns))),
        "complete_journey_rule": F.lit(scope.complete_journey_rule),
        "extraction_query_version": F.lit(scope.extraction_query_version),
        "scope_version": F.lit(scope.scope_version),
        "extraction_timestamp_utc": stamp,
        "source_month": F.lit(None if weekly else scope.selected_month).cast("string"),
        "scope_slice": F.lit(part.scope_slice),
        "scope_week_start_date": F.lit(part.week_start).cast("date"),
        "scope_week_end_date": F.lit(part.week_end).cast("date"),
    })


def bronze_slice(events: DataFrame, scope: ScopeConfig, part: ScopeSlice, loaded_at: str) -> DataFrame:
    until = part.week_end and part.week_end + timedelta(days=1)
    kept = scope_journeys(events.select(*STOP_EVENT_COLUMNS), scope.selected_hub, part.week_start, until)
    return stamp_lineage(kept, scope, part, loaded_at)


def bronze_events(parts: list[tuple[DataFrame, ScopeSlice]], scope: ScopeConfig, loaded_at: str) -> DataFrame:
    """Union of all slices; rows are kept even if two slices hold the same event."""
    first, *rest = [bronze_slice(events, scope, part, loaded_at) for events, part in parts]
    for other in rest:
        first = first.unionByName(other)
    return first


def station_reference(bronze: DataFrame) -> DataFrame:
    return bronze.select(
        F.col("eva").alias("station_id_raw"),
        F.col("station_name").alias("station_name_raw"),
        F.col("xml_station_name").alias("xml_station_name_raw"),
        "source_file",
        "loaded_at_utc",
    ).distinct()


def ingestion_manifest(bronze: DataFrame) -> DataFrame:
    constant = (
        "source_version",
        "scope_label",
        "scope_week_start_date",
        "scope_week_end_date",
        "scope_version",
        "extraction_query_version",
        "selected_month",
        "selected_hub",
        "required_columns_json",
        "complete_journey_rule",
        "extraction_timestamp_utc",
    )
    return bronze.groupBy("scope_slice", "source_file").agg(
        *[F.min(c).alias(c) for c in constant], F.count(F.lit(1)).alias("row_count")
    )


def bronze_summary(bronze: DataFrame, hub: str) -> DataFrame:
    """Row counts of the whole extract in one pass, and of its slices in the same frame."""
    day = F.to_date("time")
    measures = [
        F.min(day).alias("min_service_date"),
        F.max(day).alias("max_service_date"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("station_name") == hub).alias("hub_row_count"),
        F.count_distinct("train_line_ride_id").alias("journey_count"),
    ]
    slices = bronze.groupBy("scope_slice", "source_file").agg(*measures)
    whole = bronze.agg(*measures).withColumns({"scope_slice": F.lit("all"), "source_file": F.lit("all")})
    return slices.unionByName(whole)


def disrupted_weeks(events: DataFrame, hub: str) -> DataFrame:
    """Severe or cancelled stops at the hub per ISO week and source file.

    Only weeks that lie completely inside the month of their file are kept.
    """
    bad = (F.coalesce("delay_in_min", F.lit(0)) >= SEVERE_MINUTES) | F.coalesce("is_canceled", F.lit(False))
    monday = week_start(F.to_date("time"))
    weekly = (
        events.filter((F.col("station_name") == hub) & F.col("time").isNotNull())
        .groupBy("source_file", monday.alias("week_start_date"))
        .agg(F.count(F.lit(1)).alias("hub_stop_count"), F.count_if(bad).alias("severe_or_cancel_count"))
    )
    month = month_start_of_file(F.col("source_file"))
    sunday = F.date_add("week_start_date", 6)
    inside = (F.col("week_start_date") >= month) & (sunday <= F.last_day(month))
    return weekly.filter(inside).select(
        "source_file",
        "week_start_date",
        sunday.alias("week_end_date"),
        "hub_stop_count",
        "severe_or_cancel_count",
        share(F.col("severe_or_cancel_count"), F.col("hub_stop_count")).alias("severe_or_cancel_share"),
    )


def search_weeks(spark: SparkSession, paths: list[str], baseline: str, hub: str, n: int = SEARCHED_MONTHS) -> DataFrame:
    """The disrupted weeks of the ``n`` month files nearest to the baseline; no other file is opened.

    Only rows at the hub and inside the months of the chosen files matter, and both conditions reach the Parquet readers.
    """
    by_name = {path.rstrip("/").rsplit("/", 1)[1]: path for path in paths}
    names = spark.createDataFrame([(name,) for name in sorted(by_name)], "file_name string")
    chosen = month_labels(candidate_months(names, baseline, n)).select("file_name", "month_start", "month_end").collect()  # at most n
    if not chosen:
        raise ValueError(f"no month file besides {baseline}")
    first, last = min(m.month_start for m in chosen), max(m.month_end for m in chosen) + timedelta(days=1)
    events = read_stop_events(spark, *[by_name[m.file_name] for m in chosen])
    inside = (F.col("time") >= F.lit(first).cast("timestamp_ntz")) & (F.col("time") < F.lit(last).cast("timestamp_ntz"))
    return disrupted_weeks(events.filter((F.col("station_name") == hub) & inside), hub)


def journey_sketches(bronze: DataFrame) -> DataFrame:
    """Per slice and file a sketch of its journeys, to be stored; a layer that grows adds sketches and counts nothing anew."""
    return bronze.groupBy("scope_slice", "source_file").agg(
        F.hll_sketch_agg("train_line_ride_id", F.lit(SKETCH_BITS)).alias("journeys"), F.count(F.lit(1)).alias("row_count")
    )


def sketched_journeys(sketches: DataFrame, *by: str) -> DataFrame:
    """Distinct journeys of merged sketches, about; journeys that several slices hold count once."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("journeys"))
    return sketches.groupBy(*by).agg(merged.alias("journey_estimate"), F.sum("row_count").alias("row_count"))


def pick_week(weeks: DataFrame) -> DataFrame:
    """The most disrupted week; ties go to the larger share, then volume, then the earlier file and week."""
    return weeks.orderBy(
        F.desc("severe_or_cancel_count"),
        F.desc("severe_or_cancel_share"),
        F.desc("hub_stop_count"),
        "source_file",
        "week_start_date",
    ).limit(1)


def hub_weeks_sql(events: DataFrame, hub: str, first_day: date, last_day: date) -> DataFrame:
    """The weekly count as a parameterised SQL statement; values are bound, never pasted into the text."""
    return events.sparkSession.sql(
        """
        SELECT date_sub(to_date(time), weekday(to_date(time))) AS week_start_date,
               count(*) AS hub_stop_count,
               count_if(coalesce(delay_in_min, 0) >= :severe OR coalesce(is_canceled, false)) AS severe_or_cancel_count
        FROM {feed}
        WHERE station_name = :hub AND time IS NOT NULL
        GROUP BY 1
        HAVING week_start_date >= :first_day AND date_add(week_start_date, 6) <= :last_day
        """,
        args={"hub": hub, "severe": SEVERE_MINUTES, "first_day": first_day, "last_day": last_day},
        feed=events,
    )


def label_scope_slice(rows: DataFrame, baseline_file: str, added_file: str, week: tuple[date, date]) -> DataFrame:
    """Baseline file, disrupted week of the added file, or unknown (rows of its journeys on other days)."""
    in_week = F.col("service_date").between(F.lit(week[0]), F.lit(week[1]))
    label = (
        F.when((F.col("source_file") == added_file) & in_week, "added_disrupted_week")
        .when(F.col("source_file") == baseline_file, "baseline_month")
        .otherwise("unknown_scope_slice")
    )
    return rows.withColumn("scope_slice", label)
