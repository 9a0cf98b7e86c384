"""Feature layer: one wide row per stop event, and station-hour aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymill.functions.calendar import date_attributes, time_band
from delaymill.functions.delays import delay_flags, share

# Columns of the feature layer, in order.
FEATURE_COLUMNS = (
    "stop_event_key",
    "date_key",
    "hour_key",
    "station_key",
    "train_service_key",
    "service_date",
    "journey_id",
    "source_file",
    "stop_sequence",
    "station_id",
    "station_name",
    "train_type",
    "train_number",
    "line_number",
    "service_class",
    "calendar_date",
    "year",
    "month",
    "week_of_year",
    "day_of_week",
    "day_name",
    "is_weekend",
    "hour_of_day",
    "time_band",
    "provider_delay_in_min",
    "arrival_delay_min",
    "departure_delay_min",
    "delay_change_min",
    "is_cancellation",
    "is_arrival_cancelled",
    "is_departure_cancelled",
    "event_delay_min",
    "has_delay_measurement",
    "is_delayed",
    "is_severe_delay",
    "is_extreme_delay",
    "is_departure_severe_delay",
    "delay_bucket",
    "is_active_stop",
    "has_arrival_time_data",
    "has_departure_time_data",
)

STATION_HOUR_KEYS = ["station_key", "date_key", "hour_key"]

_STATION_HOUR_ATTRIBUTES = (
    "station_id",
    "station_name",
    "calendar_date",
    "year",
    "month",
    "week_of_year",
    "day_of_week",
    "day_name",
    "is_weekend",
    "hour_of_day",
    "time_band",
)


def feature_stop_event(fact: DataFrame, stations: DataFrame, services: DataFrame) -> DataFrame:
    """Fact rows with their station, service, date and hour attributes and the delay flags.

    Date and hour attributes are functions of the row's own date and hour, so they need no join.
    """
    delay = F.coalesce("departure_delay_min", "arrival_delay_min", "provider_delay_in_min")
    dated = fact.filter(F.col("service_date").isNotNull()).withColumn("event_delay_min", delay)
    wide = (
        dated.join(stations.select("station_key", "station_id", "station_name"), "station_key")
        .join(services, "train_service_key")
        .withColumns({
            "calendar_date": F.col("service_date"),
            "hour_of_day": F.col("hour_key"),
            "time_band": time_band(F.col("hour_key")),
            "is_active_stop": ~F.col("is_cancellation"),
            "has_arrival_time_data": F.col("planned_arrival_ts").isNotNull() | F.col("actual_arrival_ts").isNotNull(),
            "has_departure_time_data": F.col("planned_departure_ts").isNotNull()
            | F.col("actual_departure_ts").isNotNull(),
            **date_attributes(F.col("service_date")),
            **delay_flags(F.col("event_delay_min"), F.col("departure_delay_min")),
        })
    )
    return wide.select(*FEATURE_COLUMNS)


def station_hour_measures() -> dict[str, Column]:
    def ones(flag: str) -> Column:
        return F.count_if(F.col(flag))

    return {
        "stop_event_count": F.count(F.lit(1)),
        "measured_delay_event_count": ones("has_delay_measurement"),
        "delayed_event_count": ones("is_delayed"),
        "severe_delay_event_count": ones("is_severe_delay"),
        "extreme_delay_event_count": ones("is_extreme_delay"),
        "cancellation_event_count": ones("is_cancellation"),
        "arrival_time_data_count": ones("has_arrival_time_data"),
        "departure_time_data_count": ones("has_departure_time_data"),
        "avg_event_delay_min": F.avg("event_delay_min"),
        "max_event_delay_min": F.max("event_delay_min"),
    }


def _with_shares(hours: DataFrame) -> DataFrame:
    measured = F.col("measured_delay_event_count")
    return hours.withColumns({
        "pct_delayed": share(F.col("delayed_event_count"), measured),
        "pct_cancellation": share(F.col("cancellation_event_count"), F.col("stop_event_count")),
        "pct_severe_delay": share(F.col("severe_delay_event_count"), measured),
    })


def station_hour(features: DataFrame) -> DataFrame:
    measures = [c.alias(n) for n, c in station_hour_measures().items()]
    attributes = [F.min(c).alias(c) for c in _STATION_HOUR_ATTRIBUTES]
    return _with_shares(features.groupBy(*STATION_HOUR_KEYS).agg(*attributes, *measures))


def station_hour_mismatches(features: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored station-hours whose measures differ from a recomputation; also those on one side only."""
    measures = [c.alias(n) for n, c in station_hour_measures().items()]
    fresh = _with_shares(features.groupBy(*STATION_HOUR_KEYS).agg(*measures))
    names = [c for c in fresh.columns if c not in STATION_HOUR_KEYS]
    renamed = fresh.select(*STATION_HOUR_KEYS, *[F.col(c).alias(f"_fresh_{c}") for c in names])
    both = stored.select(*STATION_HOUR_KEYS, *names).join(renamed, STATION_HOUR_KEYS, "full_outer")
    differs = F.lit(False)
    for c in names:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_fresh_{c}"))
    return both.filter(differs)


def layer_counts(bronze: DataFrame, fact: DataFrame, features: DataFrame, stations: DataFrame) -> DataFrame:
    """Row and key counts of every layer as (measure, value) rows; each layer is read once."""

    def counted(df: DataFrame, **measures: Column) -> DataFrame:
        values = df.agg(*[c.cast("long").alias(name) for name, c in measures.items()])
        return values.unpivot([], list(measures), "measure", "value")

    rows = F.count(F.lit(1))
    parts = [
        counted(bronze, bronze_rows=rows, bronze_stations=F.count_distinct("eva")),
        counted(fact, silver_rows=rows),
        counted(stations, station_rows=rows),
        counted(features, gold_rows=rows, station_hour_keys=F.count_distinct(*STATION_HOUR_KEYS)),
    ]
    return reduce(DataFrame.unionByName, parts)
