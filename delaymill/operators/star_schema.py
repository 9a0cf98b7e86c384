"""Cleaned dimensions and the stop-event fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymill.functions.calendar import date_attributes, date_key, time_band
from delaymill.functions.delays import delay_minutes, service_class, side_cancelled
from delaymill.operators.ranking import rank_rows, surrogate_keys
from delaymill.session import spool


def _stations(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy(F.col("eva").alias("station_id")).agg(
        F.min("station_name").alias("station_name"), F.min("xml_station_name").alias("xml_station_name")
    )


def _services(bronze: DataFrame) -> DataFrame:
    services = bronze.select("train_type", "train_number", "line_number").distinct()
    return services.withColumn("service_class", service_class(F.col("train_type")))


def dim_station(bronze: DataFrame) -> DataFrame:
    return surrogate_keys(_stations(bronze), [F.asc_nulls_last("station_id")], "station_key")


def dim_train_service(bronze: DataFrame) -> DataFrame:
    services = _services(bronze)
    return surrogate_keys(services, [F.asc_nulls_last(c) for c in services.columns], "train_service_key")


def keyed_dimensions(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both dimensions as ``dim_station`` and ``dim_train_service`` have them, from one ranking of their rows."""
    stations, services = _stations(bronze), _services(bronze)
    names = {"station": stations.columns, "service": services.columns}
    rows = {
        kind: df.select(F.lit(kind).alias("kind"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
        for kind, df in (("station", stations), ("service", services))
    }
    union = rows["station"].unionByName(rows["service"], allowMissingColumns=True)
    order = [F.asc_nulls_last(f"c{i}") for i in range(len(services.columns))]  # a station id, which comes first, is unique
    keyed = spool(rank_rows(union, ["kind"], order, "key"), "dimensions")

    def part(kind: str, key: str) -> DataFrame:
        own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names[kind])]
        return keyed.filter(F.col("kind") == kind).select(F.col("key").cast("int").alias(key), *own)

    return part("station", "station_key"), part("service", "train_service_key")


def dim_date(bronze: DataFrame) -> DataFrame:
    days = bronze.select(F.to_date("time").alias("calendar_date")).distinct()
    day = F.col("calendar_date")
    attributes = [c.alias(n) for n, c in date_attributes(day).items()]
    return days.select(date_key(day).alias("date_key"), "calendar_date", *attributes)


def dim_hour(bronze: DataFrame) -> DataFrame:
    hours = bronze.select(F.hour("time").alias("hour_of_day")).distinct()
    return hours.select(
        F.col("hour_of_day").alias("hour_key"), "hour_of_day", time_band(F.col("hour_of_day")).alias("time_band")
    )


def fact_stop_event(bronze: DataFrame, stations: DataFrame, services: DataFrame) -> DataFrame:
    """One row per bronze row.

    The dimensions are stored tables, so the planner knows their size: small ones are broadcast,
    larger ones are joined by shuffle with the skew handling of adaptive execution.
    A missing line number counts as an empty one; a missing type or number matches no service.
    """
    arrival = (F.col("arrival_planned_time"), F.col("arrival_change_time"))
    departure = (F.col("departure_planned_time"), F.col("departure_change_time"))
    cancelled = F.coalesce("is_canceled", F.lit(False))
    day = F.to_date("time")
    rows = bronze.select(
        F.col("id").alias("stop_event_key"),
        date_key(day).alias("date_key"),
        F.hour("time").alias("hour_key"),
        day.alias("service_date"),
        F.col("train_line_ride_id").alias("journey_id"),
        F.col("train_line_station_num").alias("stop_sequence"),
        "final_destination_station",
        F.col("delay_in_min").alias("provider_delay_in_min"),
        F.col("time").alias("provider_event_ts"),
        arrival[0].alias("planned_arrival_ts"),
        arrival[1].alias("actual_arrival_ts"),
        departure[0].alias("planned_departure_ts"),
        departure[1].alias("actual_departure_ts"),
        delay_minutes(*arrival).alias("arrival_delay_min"),
        delay_minutes(*departure).alias("departure_delay_min"),
        cancelled.alias("is_cancellation"),
        side_cancelled(cancelled, *arrival).alias("is_arrival_cancelled"),
        side_cancelled(cancelled, *departure).alias("is_departure_cancelled"),
        "source_file",
        "loaded_at_utc",
        F.col("eva").alias("_eva"),
        F.col("train_type").alias("_type"),
        F.col("train_number").alias("_number"),
        F.coalesce("line_number", F.lit("")).alias("_line"),
    ).withColumn("delay_change_min", F.col("departure_delay_min") - F.col("arrival_delay_min"))
    station_keys = stations.select("station_key", F.col("station_id").alias("_eva"))
    service_keys = services.select(
        "train_service_key",
        F.col("train_type").alias("_type"),
        F.col("train_number").alias("_number"),
        F.coalesce("line_number", F.lit("")).alias("_line"),
    )
    keyed = rows.join(station_keys, "_eva").join(service_keys, ["_type", "_number", "_line"])
    front = ["stop_event_key", "date_key", "hour_key", "station_key", "train_service_key"]
    others = [c for c in rows.columns if c not in front and not c.startswith("_")]
    return keyed.select(*front, *others)
